"""Reading and writing the tables of a verification pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column layout of a protocol file.
PROTOCOL_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("trial_id", T.StringType()),
        T.StructField("label", T.ByteType()),
        T.StructField("target", T.StringType()),
        T.StructField("enroll_utt", T.StringType()),
        T.StructField("test_utt", T.StringType()),
        T.StructField("enroll_speaker", T.StringType()),
        T.StructField("test_speaker", T.StringType()),
        T.StructField("enroll_language", T.StringType()),
        T.StructField("test_language", T.StringType()),
        T.StructField("language_pair", T.StringType()),
        T.StructField("language_condition", T.StringType()),
        T.StructField("enroll_duration_sec", T.DoubleType()),
        T.StructField("test_duration_sec", T.DoubleType()),
        T.StructField("enroll_audio_exists", T.StringType()),
        T.StructField("test_audio_exists", T.StringType()),
    ]
)

EMBEDDING_JSON = T.StructType(
    [
        T.StructField("utterance", T.StringType()),
        T.StructField("audio_path", T.StringType()),
        T.StructField("model_key", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute an input that arrives in fewer pieces than there are cores.

    A table of many files is left alone; only a few-file input pays a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def require_columns(df: DataFrame, required: Sequence[str], what: str = "table") -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")
    return df


def read_protocol(spark: SparkSession, path: str, required: Sequence[str] | None = None) -> DataFrame:
    """Protocol CSV with typed columns, in whatever column order the file has."""
    raw = spark.read.csv(path, header=True)
    require_columns(raw, required or ["split", "trial_id", "label", "enroll_utt", "test_utt"], path)
    known = {f.name: f.dataType for f in PROTOCOL_SCHEMA}
    cols = []
    for c in raw.columns:
        value = F.col(c)
        if isinstance(known.get(c), T.DoubleType):
            value = numeric(value)
        elif c == "label":
            value = strict_label(value)
        cols.append(value.alias(c))
    return raw.select(*cols)


def numeric(value: Column) -> Column:
    """Number of a text; anything else (blank, word, NaN) is NULL."""
    number = value.cast("string").try_cast("double")
    return F.when(~F.isnan(number), number)


def strict_label(value: Column) -> Column:
    """0/1 label; anything else raises."""
    text = F.trim(value.cast("string"))
    bad = F.raise_error(F.concat(F.lit("label is not 0 or 1: "), F.coalesce(text, F.lit("null")))).cast("tinyint")
    return F.when(text.isin("0", "1"), text.try_cast("tinyint")).otherwise(bad)


def parse_trial_lines(lines: DataFrame, value: str = "value", *, strict: bool = False) -> DataFrame:
    """``label enroll test`` lines as columns plus ``ok`` (blank lines dropped).

    ``strict`` raises on the first bad line and names it.
    """
    parts = F.split(F.trim(F.col(value)), r"\s+")
    good = (F.size(parts) == 3) & F.get(parts, F.lit(0)).isin("0", "1")
    rows = lines.filter(F.trim(F.col(value)) != "").withColumn("_p", parts)
    if strict:
        where = F.col("line_no").cast("string") if "line_no" in lines.columns else F.lit("?")
        text = F.concat(F.lit("bad trial line "), where, F.lit(": "), F.col(value))
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
    rows = rows.withColumn("ok", good)
    keep = [c for c in lines.columns if c != value]
    return rows.select(
        *keep,
        F.col(value),
        "ok",
        F.when(F.col("ok"), F.get("_p", F.lit(0)).try_cast("tinyint")).alias("label"),
        F.when(F.col("ok"), F.get("_p", F.lit(1))).alias("enroll_utt"),
        F.when(F.col("ok"), F.get("_p", F.lit(2))).alias("test_utt"),
    )


def read_trial_list(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """Whitespace-separated trial list with 1-based line numbers.

    Lines are numbered within their file block during the scan; one short row
    per block gives the blocks their offsets.  No row moves.
    """
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    blocks = raw.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy("_file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    numbered = raw.join(blocks, ["_file", "_start"]).select(
        (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "value"
    )
    return parse_trial_lines(numbered, strict=strict)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV, JSON or Parquet by suffix, projected to ``columns``."""
    name = path.rstrip("/").lower().removesuffix(".gz")
    kind = next((k for k in ("csv", "json") if name.endswith(f".{k}") or name.endswith(f".{k}l")), "parquet")
    reader = spark.read.format(kind)
    df = reader.option("header", True).option("inferSchema", True).load(path) if kind == "csv" else reader.load(path)
    return require_columns(df, columns, path).select(*columns) if columns else df


def discover_scores(df: DataFrame, encoders: Sequence[str] | None = None) -> DataFrame:
    """Validate a long score table: one row per (split, encoder, trial), no "smoke" runs,
    and the same encoders in every split.  Problems raise when the plan runs."""
    require_columns(df, ["split", "embedding_name", "trial_id", "score"], "score table")
    real = df.filter(~F.lower("embedding_name").contains("smoke"))
    per = real.groupBy("split").agg(F.array_sort(F.collect_set("embedding_name")).alias("have"))
    sets = per.select("have").distinct().limit(2).collect()  # one row when all splits agree
    if len(sets) > 1:
        raise ValueError("splits have different encoder sets")
    if encoders and sets and set(sets[0].have) != set(encoders):
        raise ValueError(f"encoder set is {sets[0].have}, expected {sorted(encoders)}")
    again = real.groupBy("split", "embedding_name", "trial_id").count().filter("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"duplicate score for {again[0].asDict()}")
    return real


def read_embeddings(spark: SparkSession, root: str, model: str | None = None) -> DataFrame:
    """One JSON document per utterance and model, as (model, utterance, embedding)."""
    docs = spark.read.schema(EMBEDDING_JSON).option("multiLine", True).option("recursiveFileLookup", True).json(root)
    out = docs.select(F.coalesce("model_key", "model").alias("model"), "utterance", "embedding")
    return out.filter(F.col("model") == model) if model else out


def read_language_labels(spark: SparkSession, path: str) -> DataFrame:
    """(filename, label), trimmed, blank names dropped, last duplicate kept."""
    raw = require_columns(spark.read.csv(path, header=True), ["filename", "label"], path)
    return last_label(raw.withColumn("_at", F.monotonically_increasing_id()), "_at")


def last_label(rows: DataFrame, order: str) -> DataFrame:
    clean = rows.select(
        F.trim("filename").alias("filename"), F.trim(F.coalesce("label", F.lit(""))).alias("label"), order
    ).filter(F.col("filename") != "")
    return clean.groupBy("filename").agg(F.max_by("label", order).alias("label"))


def read_speaker_limit(spark: SparkSession, path: str) -> DataFrame:
    """Speaker allow-list from a CSV (speaker_id or speaker column) or plain text with # comments."""
    if path.endswith(".csv"):
        raw = spark.read.csv(path, header=True)
        name = next((c for c in ("speaker_id", "speaker") if c in raw.columns), None)
        if name is None:
            raise ValueError(f"{path} needs a speaker_id or speaker column")
        ids = raw.select(F.trim(name).alias("speaker_id"))
    else:
        text = spark.read.text(path).select(F.trim("value").alias("speaker_id"))
        ids = text.filter(~F.col("speaker_id").startswith("#"))
    return ids.filter(F.col("speaker_id").isNotNull() & (F.col("speaker_id") != "")).distinct()


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", *, overwrite: bool = False, partition_by: Sequence[str] = ()
) -> None:
    """zstd Parquet, CSV or JSON; an existing target is refused unless ``overwrite``."""
    writer = df.write.format(fmt).mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer = writer.option("compression", "zstd")
    elif fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_rows(frames: Sequence[DataFrame], path: str, *, overwrite: bool = False) -> None:
    """Union ragged metric rows (first-seen column order) and write them as CSV."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    write_table(out, path, "csv", overwrite=overwrite)
