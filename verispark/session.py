"""Session settings the library relies on for speed (never for results)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings for wide arithmetic projections.

    The JVM does not compile methods over 8000 bytes.  With the default limit a
    fused stage with a hundred feature expressions stays interpreted (measured
    about six times slower); with this one Spark splits it into small methods.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``.

    A private folder is taken only where nothing is configured and the session
    runs in a single local JVM, as in tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def materialise(df: DataFrame) -> DataFrame:
    """Write a table that several jobs read to the shared checkpoint folder, as Parquet.

    Reliable (survives lost executors), and its readers get column pruning and
    pushed filters.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint_dir(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()
