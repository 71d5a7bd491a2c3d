"""Selective (abstaining) decisions from log-likelihood ratios."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bayes_threshold, guarded_ratio, sigmoid, zscore
from .metrics import BLOCK_COLUMNS, block_from_counts, metric_block
from .ranking import quantiles

# Coverage targets of the selective curve.
COVERAGE_TARGETS = [1.00, 0.98, 0.95, 0.90, 0.85, 0.80, 0.75, 0.70, 0.60, 0.50]

# Weights of the multi-enrollment disagreement risk.
GROUP_RISK_WEIGHTS = {
    "model_uncertainty": 1.00,
    "score_std": 0.50,
    "post_std": 0.75,
    "vote_entropy": 0.75,
    "post_entropy_mean": 0.50,
    "post_entropy_max": 0.25,
    "vote_margin_risk": 0.75,
}


def confidence(df: DataFrame, llr: str = "llr") -> DataFrame:
    """Add the target posterior and the confidence max(p, 1-p)."""
    p = sigmoid(F.col(llr))
    return df.withColumn("posterior", p).withColumn(
        "confidence", F.greatest(F.col("posterior"), 1.0 - F.col("posterior"))
    )


def confidence_thresholds(selection: DataFrame, keys: Sequence[str], coverages: dict[str, float]) -> DataFrame:
    """Confidence quantile 1 - coverage per group, one column per named coverage."""
    for c in coverages.values():
        if not 0.0 < c <= 1.0:
            raise ValueError("coverage must be in (0, 1]")
    return quantiles(selection, keys, "confidence", {n: 1.0 - c for n, c in coverages.items()})


def decide(posterior: Column, conf: Column | None = None, threshold: Column | None = None) -> Column:
    """target / nontarget at p >= 0.5, reject when confidence < threshold."""
    choice = F.when(posterior >= 0.5, F.lit("target")).otherwise(F.lit("nontarget"))
    if threshold is None:
        return choice
    return F.when(conf < threshold, F.lit("reject")).otherwise(choice)


def decide_by_risk(posterior: Column, risk: Column, threshold: Column) -> Column:
    return F.when(risk > threshold, F.lit("reject")).otherwise(decide(posterior))


def _decision_counts(decision: Column, label: Column, weight: Column | None = None) -> list[Column]:
    hit = label == 1

    def n(cond: Column) -> Column:
        if weight is None:
            return F.count_if(cond)
        return F.coalesce(F.sum(F.when(cond, weight)), F.lit(0))

    always = F.lit(True)
    return [
        n(always).alias("n"),
        n(hit).alias("target_n"),
        n(~hit).alias("nontarget_n"),
        n(decision != "reject").alias("accepted_n"),
        n(decision == "reject").alias("rejected_n"),
        n(((decision == "target") & hit) | ((decision == "nontarget") & ~hit)).alias("_right"),
        n((decision == "target") & ~hit).alias("_fa"),
        n((decision != "target") & hit).alias("_miss"),
    ]


def _decision_rates() -> list[Column]:
    right = guarded_ratio(F.col("_right"), F.col("n"))
    return [
        guarded_ratio(F.col("accepted_n"), F.col("n")).alias("coverage"),
        right.alias("accuracy"),
        right.alias("effective_acc"),
        guarded_ratio(F.col("_right"), F.col("accepted_n")).alias("covered_acc"),
        guarded_ratio(F.col("_fa"), F.col("nontarget_n")).alias("far"),
        guarded_ratio(F.col("_miss"), F.col("target_n")).alias("frr"),
    ]


DECISION_COUNTS = ["n", "target_n", "nontarget_n", "accepted_n", "rejected_n"]


def decision_metrics(
    df: DataFrame, keys: Sequence[str], decision: str = "decision", label: str = "label", weight: str | None = None
) -> DataFrame:
    """Coverage, accuracies, FAR and FRR; a rejected target counts as a miss."""
    w = F.col(weight) if weight else None
    agg = df.groupBy(*keys).agg(*_decision_counts(F.col(decision), F.col(label), w))
    return agg.select(*keys, *DECISION_COUNTS, *_decision_rates())


def selective_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Decision metrics plus the metric block of accepted rows and mean confidences.

    Expects llr, confidence, decision and label columns.
    """
    kept = F.col("decision") != "reject"
    base = decision_metrics(df, keys)
    conf = df.groupBy(*keys).agg(
        F.avg("confidence").alias("confidence_mean"),
        F.avg(F.when(kept, F.col("confidence"))).alias("confidence_accepted_mean"),
        F.avg(F.when(~kept, F.col("confidence"))).alias("confidence_rejected_mean"),
    )
    block = metric_block(df.filter(kept), keys, "llr")
    block = block.select(*keys, *[F.col(c).alias(f"accepted_{c}") for c in BLOCK_COLUMNS if c != "n"])
    return base.join(conf, list(keys)).join(block, list(keys), "left")


def coverage_curve(df: DataFrame, selection: DataFrame, key: str, targets: Sequence[float] = COVERAGE_TARGETS):
    """Selective report at each coverage target, thresholds from the selection rows.

    ``df`` and ``selection`` carry ``key``, label and llr.  Confidence depends on
    the LLR only, so rows are first compressed to distinct LLRs; the few
    targets are expanded on that compressed table, never on trials.
    """
    names = [f"t{i}" for i in range(len(targets))]
    partial = {x: c for x, c in zip(names, targets) if c < 1.0}
    thr = confidence_thresholds(confidence(selection), [key], partial)
    # full coverage has no threshold
    thr = thr.withColumns({x: F.lit(None).cast("double") for x in names if x not in partial})
    hit = F.col("label") == 1
    cells = df.groupBy(key, F.col("llr").alias("score")).agg(
        F.count_if(hit).alias("t"), F.count_if(~hit).alias("n")
    )
    cells = confidence(cells, "score").join(thr, key)
    points = F.explode(
        F.array(*[F.struct(F.lit(c).alias("coverage_target"), F.col(x).alias("threshold")) for c, x in zip(targets, names)])
    )
    cells = cells.select(key, "score", "t", "n", "posterior", "confidence", points.alias("_p"))
    cells = cells.select(key, "score", "t", "n", "posterior", "confidence", "_p.coverage_target", "_p.threshold")
    cells = cells.withColumn("kept", F.coalesce(F.col("confidence") >= F.col("threshold"), F.lit(True)))
    kept, says_target = F.col("kept"), F.col("posterior") >= 0.5
    all_n = F.col("t") + F.col("n")
    wrong = F.when(says_target, F.col("n")).otherwise(F.col("t"))

    def total(cond: Column, x: Column) -> Column:
        return F.sum(F.when(cond, x).otherwise(F.lit(0)))

    group = [key, "coverage_target"]
    agg = cells.groupBy(*group).agg(
        F.max("threshold").alias("confidence_threshold"),
        F.sum(all_n).alias("n"),
        F.sum("t").alias("target_n"),
        F.sum("n").alias("nontarget_n"),
        total(kept, all_n).alias("accepted_n"),
        total(~kept, all_n).alias("rejected_n"),
        total(kept, all_n - wrong).alias("_right"),
        total(kept & says_target, F.col("n")).alias("_fa"),
        total(~(kept & says_target), F.col("t")).alias("_miss"),
        total(~kept, wrong).alias("_rej_wrong"),
        total(~kept, F.col("t")).alias("rejected_target_n"),
        total(~kept, F.col("n")).alias("rejected_nontarget_n"),
        F.sum(F.when(kept, F.col("confidence") * all_n)).alias("_conf_acc"),
        F.sum(F.when(~kept, F.col("confidence") * all_n)).alias("_conf_rej"),
        F.min(F.when(kept, F.col("confidence"))).alias("confidence_accepted_min"),
        F.max(F.when(~kept, F.col("confidence"))).alias("confidence_rejected_max"),
    )
    base = agg.select(
        *group,
        "confidence_threshold",
        *DECISION_COUNTS,
        *_decision_rates(),
        guarded_ratio(F.col("_rej_wrong"), F.col("rejected_n")).alias("rejected_error_rate"),
        guarded_ratio(F.col("rejected_target_n"), F.col("rejected_n")).alias("rejected_target_rate"),
        (1.0 - guarded_ratio(F.col("_right"), F.col("accepted_n"))).alias("accepted_error_rate"),
        "rejected_target_n",
        "rejected_nontarget_n",
        guarded_ratio(F.col("_conf_acc"), F.col("accepted_n")).alias("confidence_accepted_mean"),
        guarded_ratio(F.col("_conf_rej"), F.col("rejected_n")).alias("confidence_rejected_mean"),
        "confidence_accepted_min",
        "confidence_rejected_max",
    )
    block = block_from_counts(cells.filter(kept).select(*group, "score", "t", "n"), group)
    block = block.select(*group, *[F.col(c).alias(f"accepted_{c}") for c in BLOCK_COLUMNS if c != "n"])
    return base.join(block, group, "left")


# --- composite risks -----------------------------------------------------------


def attach_stats(df: DataFrame, train: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Join the train mean and population std of columns, one row per key."""
    stats = train.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_std_{c}") for c in columns]
    )
    return df.join(stats, list(keys))


def _z(c: str) -> Column:
    return zscore(F.col(c), F.col(f"_mean_{c}"), F.col(f"_std_{c}"))


def reject_risk(
    df: DataFrame,
    train: DataFrame,
    keys: Sequence[str],
    *,
    decision_prior: float = 0.5,
    duration_weight: float = 0.25,
    language_weight: float = 0.25,
    llr: str = "llr",
) -> DataFrame:
    """Add ``risk``: closeness to the decision threshold, short or unequal durations,
    and language mismatch, z-scored with the train rows' statistics."""
    at = F.lit(bayes_threshold(decision_prior))

    def parts(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_margin", -F.abs(F.col(llr) - at)).withColumn(
            "_duration", F.col("short_duration_risk") + 1.0 - F.col("duration_ratio")
        )

    joined = attach_stats(parts(df), parts(train), keys, ["_margin", "_duration"])
    risk = (
        _z("_margin")
        + F.lit(duration_weight) * _z("_duration")
        + F.lit(language_weight) * (1.0 - F.col("target"))
    )
    return joined.withColumn("risk", risk).select(*df.columns, "risk")


def risk_threshold(selection: DataFrame, keys: Sequence[str], reject_rate: float) -> DataFrame:
    """Risk quantile 1 - reject_rate per group."""
    return quantiles(selection, keys, "risk", {"threshold": 1.0 - reject_rate})


def group_risk(df: DataFrame, train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the weighted sum of seven z-scored disagreement components."""

    def parts(frame: DataFrame) -> DataFrame:
        return frame.withColumn("model_uncertainty", 1.0 - F.col("confidence")).withColumn(
            "vote_margin_risk", 1.0 - F.abs(2.0 * F.col("vote_frac") - 1.0)
        )

    names = list(GROUP_RISK_WEIGHTS)
    joined = attach_stats(parts(df), parts(train), keys, names)
    risk = reduce(lambda a, b: a + b, (F.lit(w) * _z(c) for c, w in GROUP_RISK_WEIGHTS.items()))
    return joined.withColumn("risk", risk).select(*df.columns, "risk")

