"""Verification metrics as grouped aggregates.

All metrics of a group come from one table with a row per distinct score
(targets ``t`` and nontargets ``n`` at that score).  Compressing first makes
ties collapse to one operating point, shrinks the data before any ordering, and
lets the same code serve plain counts and resampling weights.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bayes_threshold, dcf, guarded_ratio, is_finite, softplus
from .ranking import prefix_sums

# Reporting priors of the detection cost.
PRIORS = {"p001": 0.001, "p01": 0.01}


def score_counts(
    df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", weight: str | None = None
) -> DataFrame:
    """Targets ``t`` and nontargets ``n`` per distinct finite score."""
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    hit, usable = F.col(label) == 1, is_finite(F.col(score))
    # Unusable scores are dropped after the aggregate: a filter on the score
    # itself would be pushed below it and evaluate the score expression twice.
    return (
        df.groupBy(*keys, F.col(score).alias("score"))
        .agg(
            F.sum(F.when(usable & hit, w).otherwise(F.lit(0))).alias("t"),
            F.sum(F.when(usable & ~hit, w).otherwise(F.lit(0))).alias("n"),
        )
        .filter(F.col("t") + F.col("n") > 0)
    )


def roc_from_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Miss and false-alarm rate when accepting ``score >= threshold``.

    One row per distinct score, highest first by meaning; ``prev_*`` hold the
    operating point just above (pmiss 1, pfa 0 for the first).
    """
    run = prefix_sums(counts, keys, "score", ["t", "n"], descending=True)

    def miss(accepted):
        return F.when(F.col("tot_n") > 0, guarded_ratio(F.col("tot_t") - accepted, F.col("tot_t")))

    def fa(accepted):
        return F.when(F.col("tot_t") > 0, guarded_ratio(accepted, F.col("tot_n")))

    return run.select(
        *keys,
        "score",
        "t",
        "n",
        "tot_t",
        "tot_n",
        "cum_t",
        "cum_n",
        miss(F.col("cum_t")).alias("pmiss"),
        fa(F.col("cum_n")).alias("pfa"),
        miss(F.col("cum_t") - F.col("t")).alias("prev_pmiss"),
        fa(F.col("cum_n") - F.col("n")).alias("prev_pfa"),
        F.col("prev_value").alias("prev_score"),
    )


def roc_points(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """ROC points with the leading (+inf, 1, 0); empty for one-class groups."""
    roc = roc_from_counts(score_counts(df, keys, score, label), keys).filter(F.col("pfa").isNotNull())
    roc = roc.filter(F.col("pmiss").isNotNull())
    points = roc.select(*keys, F.col("score").alias("threshold"), "pmiss", "pfa")
    first = roc.filter(F.col("prev_score").isNull()).select(
        *keys, F.lit(float("inf")).alias("threshold"), F.lit(1.0).alias("pmiss"), F.lit(0.0).alias("pfa")
    )
    return points.unionByName(first)


def _eer_columns(lead: bool = True) -> list[Column]:
    """EER and its threshold from the first crossing of pfa over pmiss.

    ``lead`` says whether the (+inf, 1, 0) point precedes the first score.
    """
    crossing = F.col("pfa") - F.col("pmiss") >= 0.0
    at = F.max_by(
        F.struct("score", "pmiss", "pfa", "prev_pmiss", "prev_pfa", "prev_score"), F.when(crossing, F.col("score"))
    )
    return [at.alias("_x")]


def _eer_value(lead: bool = True) -> tuple[Column, Column]:
    x = F.col("_x")
    left = x["prev_pfa"] - x["prev_pmiss"]
    right = x["pfa"] - x["pmiss"]
    den = left - right
    alpha = F.when(den == 0.0, F.lit(0.0)).otherwise(F.least(F.greatest(left / den, F.lit(0.0)), F.lit(1.0)))
    value = x["prev_pfa"] + alpha * (x["pfa"] - x["prev_pfa"])
    thr = F.when(x["prev_score"].isNull(), x["score"]).otherwise(
        x["prev_score"] + alpha * (x["score"] - x["prev_score"])
    )
    if not lead:
        value = F.when(x["prev_score"].isNull(), (x["pmiss"] + x["pfa"]) / 2.0).otherwise(value)
    return value, thr


def _class_ok() -> Column:
    return (F.col("target_n") > 0) & (F.col("nontarget_n") > 0)


def _confusion(threshold: Column) -> list[Column]:
    hit = F.col("score") >= threshold
    zero = F.lit(0)
    return [
        F.coalesce(F.sum(F.when(hit, F.col("t"))), zero).alias("_tp"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), zero).alias("_fp"),
        F.coalesce(F.sum(F.when(~hit, F.col("n"))), zero).alias("_tn"),
        F.coalesce(F.sum(F.when(~hit, F.col("t"))), zero).alias("_fn"),
    ]


def _classification() -> list[Column]:
    tp, fp, tn, fn = F.col("_tp"), F.col("_fp"), F.col("_tn"), F.col("_fn")
    precision, recall = guarded_ratio(tp, tp + fp), guarded_ratio(tp, tp + fn)
    return [
        guarded_ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        guarded_ratio(2.0 * precision * recall, precision + recall).alias("f1"),
    ]


def _cost_aggregates() -> list[Column]:
    """Sums over the compressed rows for Cllr and the actual detection costs."""
    s, t, n = F.col("score"), F.col("t"), F.col("n")
    out = [
        F.sum(t).alias("target_n"),
        F.sum(n).alias("nontarget_n"),
        F.sum(t * softplus(-s)).alias("_loss_t"),
        F.sum(n * softplus(s)).alias("_loss_n"),
    ]
    for tag, prior in PRIORS.items():
        hit = s >= F.lit(bayes_threshold(prior))
        out.append(F.coalesce(F.sum(F.when(~hit, t)), F.lit(0)).alias(f"_miss_{tag}"))
        out.append(F.coalesce(F.sum(F.when(hit, n)), F.lit(0)).alias(f"_fa_{tag}"))
    return out


def _cost_columns() -> list[Column]:
    tn, nn = F.col("target_n"), F.col("nontarget_n")
    cllr = F.lit(0.5 / math.log(2.0)) * (guarded_ratio(F.col("_loss_t"), tn) + guarded_ratio(F.col("_loss_n"), nn))
    out = [cllr.alias("cllr")]
    for tag, prior in PRIORS.items():
        cost = dcf(guarded_ratio(F.col(f"_miss_{tag}"), tn), guarded_ratio(F.col(f"_fa_{tag}"), nn), prior)
        out.append(cost.alias(f"act_dcf_{tag}"))
    return out


def block_from_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full metric block per group from (keys, score, t, n) rows."""
    roc = roc_from_counts(counts, keys)
    mins = []
    for tag, prior in PRIORS.items():
        never = prior / min(prior, 1.0 - prior)
        mins.append(F.least(F.min(dcf(F.col("pmiss"), F.col("pfa"), prior)), F.lit(never)).alias(f"_min_{tag}"))
    agg = roc.groupBy(*keys).agg(*_cost_aggregates(), *_confusion(F.lit(0.0)), *mins, *_eer_columns())
    value, thr = _eer_value()
    return agg.select(
        *keys,
        (F.col("target_n") + F.col("nontarget_n")).alias("n"),
        "target_n",
        "nontarget_n",
        F.when(_class_ok(), 100.0 * value).alias("eer_pct"),
        F.when(_class_ok(), thr).alias("eer_threshold"),
        *_cost_columns(),
        *[F.when(_class_ok(), F.col(f"_min_{tag}")).alias(f"min_dcf_{tag}") for tag in PRIORS],
        *_classification(),
    )


BLOCK_COLUMNS = [
    "n",
    "target_n",
    "nontarget_n",
    "eer_pct",
    "eer_threshold",
    "cllr",
    *[f"act_dcf_{t}" for t in PRIORS],
    *[f"min_dcf_{t}" for t in PRIORS],
    "accuracy",
    "precision",
    "recall",
    "f1",
]


def metric_block(
    df: DataFrame,
    keys: Sequence[str],
    score: str = "score",
    label: str = "label",
    weight: str | None = None,
    llr: str | None = None,
) -> DataFrame:
    """Counts, EER, Cllr, min/act DCF and classification metrics per group.

    Rank metrics come from ``score``; decision metrics from ``llr`` when it is
    a different column.  Groups lacking a class get NULL metrics, not no row.
    """
    block = block_from_counts(score_counts(df, keys, score, label, weight), keys)
    if llr is None or llr == score:
        return block
    costs = decision_costs(df, keys, llr, label, weight)
    ranked = ["eer_pct", "eer_threshold", *[f"min_dcf_{t}" for t in PRIORS]]
    return costs.join(block.select(*keys, *ranked), list(keys)).select(*keys, *BLOCK_COLUMNS)


def decision_costs(
    df: DataFrame, keys: Sequence[str], llr: str = "llr", label: str = "label", weight: str | None = None
) -> DataFrame:
    """Threshold-free-of-ranking metrics in a single grouped pass."""
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    hit = F.col(label) == 1
    rows = df.filter(is_finite(F.col(llr))).select(
        *keys,
        F.col(llr).alias("score"),
        F.when(hit, w).otherwise(F.lit(0)).alias("t"),
        F.when(~hit, w).otherwise(F.lit(0)).alias("n"),
    )
    agg = rows.groupBy(*keys).agg(*_cost_aggregates(), *_confusion(F.lit(0.0)))
    return agg.select(
        *keys,
        (F.col("target_n") + F.col("nontarget_n")).alias("n"),
        "target_n",
        "nontarget_n",
        *_cost_columns(),
        *_classification(),
    )


def eer(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", *, lead: bool = True):
    """EER (fraction) and threshold per group.

    ``lead=False`` drops the (+inf, 1, 0) point, the variant the
    multi-enrollment features use.
    """
    agg = roc_from_counts(score_counts(df, keys, score, label), keys).groupBy(*keys).agg(*_eer_columns(lead))
    value, thr = _eer_value(lead)
    return agg.filter(F.col("_x").isNotNull()).select(*keys, value.alias("eer"), thr.alias("eer_threshold"))


def min_dcf(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    cols = [c for c in (f"min_dcf_{t}" for t in PRIORS)]
    return metric_block(df, keys, score, label).select(*keys, *cols)


def best_threshold(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """Score with the most correct decisions; ties go to the highest score."""
    roc = roc_from_counts(score_counts(df, keys, score, label), keys)
    right = F.col("cum_t") + F.col("tot_n") - F.col("cum_n")
    return (
        roc.groupBy(*keys)
        .agg(F.max(F.struct(right.alias("correct"), F.col("score"))).alias("_b"))
        .select(*keys, F.col("_b.score").alias("threshold"), F.col("_b.correct").alias("correct"))
    )


def threshold_metrics(
    df: DataFrame, keys: Sequence[str], thresholds: DataFrame, score: str = "score", label: str = "label"
) -> DataFrame:
    """Classification metrics, FAR and FRR at a threshold given per group."""
    rows = df.filter(is_finite(F.col(score))).join(thresholds.select(*keys, "threshold"), list(keys))
    rows = rows.select(
        *keys,
        "threshold",
        F.col(score).alias("score"),
        (F.col(label) == 1).cast("bigint").alias("t"),
        (F.col(label) != 1).cast("bigint").alias("n"),
    )
    agg = rows.groupBy(*keys, "threshold").agg(*_confusion(F.col("threshold")))
    return agg.select(
        *keys,
        "threshold",
        *_classification(),
        guarded_ratio(F.col("_fp"), F.col("_fp") + F.col("_tn")).alias("far"),
        guarded_ratio(F.col("_fn"), F.col("_fn") + F.col("_tp")).alias("frr"),
    )


def eer_weights(df: DataFrame, keys: Sequence[str], encoder: str, score: str = "score", label: str = "label"):
    """Weight 1/max(EER, 1e-4) per encoder, normalised inside each key group."""
    per = eer(df, [*keys, encoder], score, label)
    inv = per.select(*keys, encoder, (1.0 / F.greatest(F.col("eer"), F.lit(1e-4))).alias("_inv"))
    total = inv.groupBy(*keys).agg(F.sum("_inv").alias("_all"))
    return inv.join(total, list(keys)).select(*keys, encoder, (F.col("_inv") / F.col("_all")).alias("weight"))


def balanced_weights(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Row weights giving each class half of a total of 1 per group."""
    sizes = (
        df.groupBy(*keys)
        .agg(F.count_if(F.col(label) == 1).alias("_t"), F.count_if(F.col(label) == 0).alias("_n"))
        .withColumn("_ok", (F.col("_t") > 0) & (F.col("_n") > 0))
    )
    need = F.when(F.col("_ok"), F.lit(0.5)).otherwise(
        F.raise_error(F.lit("both target and nontarget trials are required")).cast("double")
    )
    sized = sizes.select(*keys, (need / F.col("_t")).alias("_wt"), (need / F.col("_n")).alias("_wn"))
    return (
        df.join(sized, list(keys))
        .withColumn("weight", F.when(F.col(label) == 1, F.col("_wt")).otherwise(F.col("_wn")))
        .drop("_wt", "_wn")
    )


def curve_area(df: DataFrame, keys: Sequence[str], x: str, ys: Sequence[str]) -> DataFrame:
    """Trapezoid area of each ``y`` over ``x`` divided by the width of ``x``.

    For report curves (a few points per group).
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(x)
    step = F.col(x) - F.lag(x).over(w)
    parts = df.select(*keys, x, *[(step * (F.col(y) + F.lag(y).over(w)) / 2.0).alias(f"_a_{y}") for y in ys])
    width = F.max(x) - F.min(x)
    return parts.groupBy(*keys).agg(
        F.min(x).alias(f"{x}_min"),
        F.max(x).alias(f"{x}_max"),
        *[F.when(width > 0, F.sum(f"_a_{y}") / width).alias(f"{y}_auc") for y in ys],
    )
