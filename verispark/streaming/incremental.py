"""Incremental scoring: new trial files are scored as they arrive.

The stream has no event time; each micro-batch is joined to the static
embedding table, calibrated and decided, and appended to Parquet.  The
checkpoint makes a restarted run continue after the last finished batch.

``resume_scoring`` keeps its state under a name: called again, it takes up files
that have come since, leaves out trials it has seen in any run, and puts trials it
cannot score into quarantine with a reason instead of failing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hash_key, sigmoid
from ..operators.scoring import WIDEST, cells_move_less, score_wide, vector_bytes
from ..operators.selective import decide


def scored_stream(
    trials: DataFrame,
    embeddings: DataFrame,
    encoders: Sequence[str],
    llr: Callable[[], object],
    *,
    confidence_threshold: float | None = None,
    on_missing: str = "error",
    utterances: int | None = None,
    dim: int = WIDEST,
) -> DataFrame:
    """Stream-static join to the embeddings, LLR and decision columns."""
    scored = score_wide(trials, embeddings, encoders, on_missing=on_missing, utterances=utterances, dim=dim)
    scored = scored.select(*trials.columns, llr())
    p = sigmoid(F.col("llr"))
    conf = F.greatest(p, 1.0 - p)
    threshold = None if confidence_threshold is None else F.lit(confidence_threshold)
    return scored.withColumn("decision", decide(p, conf, threshold))


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything that has arrived, append it to ``out`` and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def score_available(
    trials: DataFrame,
    embeddings: DataFrame,
    encoders: Sequence[str],
    llr: Callable[[], object],
    columns: Sequence[str],
    out: str,
    checkpoint: str,
    *,
    utterances: int | None = None,
    dim: int = WIDEST,
    **scoring,
) -> None:
    """Score everything that has arrived, batch by batch, write ``columns`` under ``out`` and stop.

    A batch is a table of known size, so where that moves less its trials meet the
    embeddings in cells, without vectors.  A repeated batch overwrites its subfolder.
    """

    def write(batch: DataFrame, number: int) -> None:
        known = utterances if cells_move_less(batch, utterances, vector_bytes(len(encoders), dim)) else None
        scored = scored_stream(batch, embeddings, encoders, llr, utterances=known, dim=dim, **scoring)
        scored.select(*columns).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = trials.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def resume_scoring(
    trials: DataFrame,
    embeddings: DataFrame,
    encoders: Sequence[str],
    llr: Callable[[], object],
    base: str,
    *,
    confidence_threshold: float | None = None,
    utterances: int | None = None,
    dim: int = WIDEST,
) -> None:
    """Score the trials (streaming: trial_id, label, enroll_utt, test_utt) that no earlier run under ``base`` has seen.

    ``base`` names a folder that all executors share: ``scored`` and ``quarantine``
    hold one subfolder per batch, which a repeated batch overwrites; ``state`` holds
    the progress and the trials seen, 32 bytes of state each.  A trial is its id and its two
    utterances: different trials may share an id, and each of them is scored.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.drop("_seen")
        tried = score_wide(batch, embeddings, encoders, on_missing="null", utterances=utterances, dim=dim).persist()
        reason = F.when(F.col("trial_id").isNull(), "no trial id").when(~F.coalesce(F.col("label").isin(0, 1), F.lit(False)), "no label")
        for e in encoders:
            reason = reason.when(F.col(f"score_{e}").isNull(), "no embedding")
        bad = tried.select(*batch.columns, reason.alias("reason")).filter("reason is not null")
        good = tried.filter(reason.isNull()).select(*batch.columns, llr())
        p = sigmoid(F.col("llr"))
        threshold = None if confidence_threshold is None else F.lit(confidence_threshold)
        good = good.withColumn("decision", decide(p, F.greatest(p, 1.0 - p), threshold))
        good.write.mode("overwrite").parquet(f"{base}/scored/batch={number}")
        bad.write.mode("overwrite").parquet(f"{base}/quarantine/batch={number}")
        tried.unpersist()

    seen = F.unhex(hash_key(F.col("trial_id"), F.col("enroll_utt"), F.col("test_utt")))
    once = trials.withColumn("_seen", seen).dropDuplicates(["_seen"])
    query = once.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def resumed(spark: SparkSession, base: str) -> DataFrame:
    """All trials of all runs: scored with llr and decision, quarantined with a reason."""
    scored = spark.read.parquet(f"{base}/scored").drop("batch")
    return scored.unionByName(spark.read.parquet(f"{base}/quarantine").drop("batch"), allowMissingColumns=True)
