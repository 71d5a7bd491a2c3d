"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

* ``encode(df)`` adds the ids of every whole text, ``decode(df)`` turns ids back
  into the raw bytes.  Each match of the split pattern is merged by itself;
  strings of special tokens are ordinary text.
* Long texts are cut at safe boundaries first, so that the library's regex engine
  and memory stay bounded.  A position between a character that is not white
  space and one that is lies between two matches in every context: no
  alternative of the pattern continues from a non-space into a space, and no
  look-ahead inspects the cut.  Very long runs of white space, on which the regex
  engine overflows, are matched directly by the rule of the pattern.
* The rank file is read once on the driver (its size is checked) and broadcast;
  executors need no copy of it.

Null texts are empty: no ids, no bytes.  Repeated rows give repeated rows, an
empty table gives an empty table, and any other columns are left out of the
output apart from those named in ``keys``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .arrow import text_slices

MAX_RANK_BYTES = 16 << 20
PIECE_CHARS = 1 << 15
LONG_RUN = 4096

# Characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_RUN = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")
_SAFE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")


class ByteBpe:
    """One vocabulary; picklable as the bytes of its rank file and its pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks, self.pattern = ranks, pattern

    def __getstate__(self):
        return self.ranks, self.pattern

    def __setstate__(self, state):
        self.ranks, self.pattern = state

    @property
    def library(self):
        if "_library" not in self.__dict__:
            import tiktoken

            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, self.ranks.splitlines())}
            self._library = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=table, special_tokens={})
        return self._library

    def pieces(self, text: str, limit: int = PIECE_CHARS) -> Iterator[tuple[str, bool]]:
        """(piece, whether it is one match); joined they give the text."""
        if len(text) <= limit:
            yield text, False
            return
        at = 0
        for run in _RUN.finditer(text):
            yield from self._stretch(text, at, run.start(), limit)
            # followed by anything, the last white space belongs to the next match
            at = run.end() if run.end() == len(text) else run.end() - 1
            yield text[run.start() : at], True
        yield from self._stretch(text, at, len(text), limit)

    @staticmethod
    def _stretch(text: str, at: int, to: int, limit: int) -> Iterator[tuple[str, bool]]:
        while to - at > limit:
            cut = _SAFE.search(text, at + limit, to)
            if cut is None:
                break
            yield text[at : cut.start()], False
            at = cut.start()
        if at < to:
            yield text[at:to], False

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if len(text) <= PIECE_CHARS:
            return self.library.encode_to_numpy(text, disallowed_special=())
        return np.concatenate(
            [
                np.array(self.library._encode_single_piece(piece), np.uint32)
                if whole
                else self.library.encode_to_numpy(piece, disallowed_special=())
                for piece, whole in self.pieces(text)
            ]
        )

    def encode_array(self, texts: pa.Array) -> pa.Array:
        """List of ids for each text."""
        rows = [self.ids(text.as_py()) for text in texts]
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r) for r in rows], out=offsets[1:])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))

    def decode_array(self, ids: pa.Array) -> pa.Array:
        """Raw bytes for each list of ids (null: none), whether or not they are UTF-8."""
        return pa.array([self.library.decode_bytes(row.values.to_pylist()) if row.is_valid else b"" for row in ids], pa.binary())


def tokenizer(rank_file: str, pattern: str) -> ByteBpe:
    """Read a rank file on the driver, with a check of its size."""
    with open(rank_file, "rb") as f:
        ranks = f.read(MAX_RANK_BYTES + 1)
    if len(ranks) > MAX_RANK_BYTES:
        raise ValueError(f"rank file of over {MAX_RANK_BYTES} bytes: {rank_file}")
    return ByteBpe(ranks, pattern)


def shared(spark: SparkSession, bpe: ByteBpe):
    """A function without arguments that gives the tokenizer in any task, built once per worker."""
    sent = spark.sparkContext.broadcast(bpe)
    return lambda: sent.value


def _columns(df: DataFrame, keys: list[str], *more: T.StructField) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + list(more))


def encode(df: DataFrame, bpe: ByteBpe, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """``keys`` and ``ids`` array<int> of every whole text."""
    keys = ["doc_id"] if keys is None else keys
    get = shared(df.sparkSession, bpe)

    def run(batches):
        for part in text_slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], get().encode_array(part.column("__text"))], [*keys, "ids"])

    source = df.select(*keys, df[text].cast("string").alias("__text"))
    return source.mapInArrow(run, _columns(df, keys, T.StructField("ids", T.ArrayType(T.IntegerType(), False))))


def decode(df: DataFrame, bpe: ByteBpe, ids: str = "ids", keys: list[str] | None = None) -> DataFrame:
    """``keys`` and ``decoded`` binary: the raw bytes of the ids."""
    keys = ["doc_id"] if keys is None else keys
    get = shared(df.sparkSession, bpe)

    def run(batches):
        for part in batches:
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], get().decode_array(part.column("__ids"))], [*keys, "decoded"])

    source = df.select(*keys, df[ids].alias("__ids"))
    return source.mapInArrow(run, _columns(df, keys, T.StructField("decoded", T.BinaryType())))


def encode_decode(df: DataFrame, bpe: ByteBpe, finish, schema: str, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """Encode and decode in one pass over the rows.

    ``finish(part, ids, decoded)`` turns a slice (the keys' columns, the lists of
    ids, the raw bytes) into the columns of ``schema``; nothing of the corpus is
    kept between slices.
    """
    keys = ["doc_id"] if keys is None else keys
    get = shared(df.sparkSession, bpe)

    def run(batches):
        for part in text_slices(batches, "__text"):
            ids = get().encode_array(part.column("__text"))
            yield finish(part.select(keys), ids, get().decode_array(ids))

    return df.select(*keys, df[text].cast("string").alias("__text")).mapInArrow(run, schema)
