"""A training corpus from raw documents: filter, dedup, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; stages are written
as Parquet and read back between them, so a lost executor costs one stage at most.
All but the last return the columns of ``documents``; the last returns one row per
document (as often as the mix takes it) with its token ids.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from verispark.llm import byte_bpe, jaccard_join, line_dedup, mixing, quality, queries
from verispark.session import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the posterior probability reject go."""
    return quality.keep_good(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go; every document stays, an emptied one with an empty text."""
    return line_dedup.dedup_lines(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0 to 3 rows each."""
    return mixing.repeat_documents(docs)


TOKENS = "doc_id long, source string, n_tokens long, ids array<int>, exact boolean"


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; ``exact`` says that decoding gives the text's bytes back."""

    def finish(part: pa.RecordBatch, ids: pa.ListArray, decoded: pa.Array) -> pa.RecordBatch:
        exact = pc.equal(decoded, pc.fill_null(part.column("text"), "").cast(pa.binary()))
        columns = [part.column("doc_id"), part.column("source"), pc.list_value_length(ids).cast(pa.int64()), ids, exact]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in TOKENS.split(", ")])

    return byte_bpe.encode_decode(docs, queries.public_tokenizer(), finish, TOKENS, keys=["doc_id", "source", "text"])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard", ngram_jaccard),
    ("source_mix", source_mix),
    ("byte_bpe", tokens),
]

#: Weak supervision, sampling and merges by rank have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read back."""
    queries.tidy(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
