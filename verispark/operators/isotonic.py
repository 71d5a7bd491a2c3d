"""Isotonic calibration of groups of any size by pool-adjacent-violators in parts.

1. Distinct scores of a group are cut into value ranges; each range pools its own
   adjacent violators as a stream that holds its pools only.
2. For a level c, the scores whose fitted posterior is below c are those up to the
   place where the running sum of (weighted targets - c * weight) is smallest.  That
   place is a grouped minimum over the pools of all ranges.  A few hundred levels
   thus cut the group at places that no pool of the answer spans.
3. Between two cuts the fit does not depend on the rest, so each part pools the
   ranges' pools alone.  No task sees the pools of a whole group.

A score is looked up by its part (from the cuts) and then among the pools of that
part; between two pools the posterior is interpolated.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_finite, logit
from ..session import materialise
from .ranking import prefix_sums, with_value_bucket

LEVELS = 256


def pooled(low: np.ndarray, high: np.ndarray, t: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pools of a sequence of pools: maximal runs whose means do not rise become one, until all means rise."""
    for _ in range(64):
        mean = t / w
        starts = np.flatnonzero(np.append(True, mean[1:] > mean[:-1]))
        if len(starts) == len(mean):
            return low, high, t, w
        ends = np.append(starts[1:], len(mean)) - 1
        low, high, t, w = low[starts], high[ends], np.add.reduceat(t, starts), np.add.reduceat(w, starts)
    stack: list[list[float]] = []  # a long cascade: one pool at a time
    for pool in zip(low, high, t, w):
        stack.append(list(pool))
        while len(stack) > 1 and stack[-2][2] * stack[-1][3] >= stack[-1][2] * stack[-2][3]:
            _, top, more, weight = stack.pop()
            stack[-1][1:] = [top, stack[-1][2] + more, stack[-1][3] + weight]
    return tuple(np.array(c) for c in zip(*stack))


_MEASURES = ["low", "high", "t", "w"]


def _pool_rows(parts: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted rows -> pools of each run of equal keys; only the pools of the run are held."""
    held: pd.DataFrame | None = None

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        pools = pooled(*(rows[c].to_numpy(float) for c in _MEASURES))
        out = pd.DataFrame(dict(zip(_MEASURES, pools)))
        for k in reversed(keys):
            out.insert(0, k, rows[k].iloc[0])
        return out

    for part in parts:
        if part.empty:
            continue
        new = np.zeros(len(part), bool)
        for k in keys:
            column = part[k]
            same = (column == column.shift()) | (column.isna() & column.shift().isna())
            new |= ~same.to_numpy()
        new[0] = True
        edges = [*np.flatnonzero(new).tolist(), len(part)]
        for a, b in zip(edges, edges[1:]):
            rows = part.iloc[a:b]
            if held is not None:
                if all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(held[keys].iloc[0], rows[keys].iloc[0])):
                    rows = pd.concat([held, rows], ignore_index=True)
                else:
                    yield held
            held = reduce(rows)
    if held is not None:
        yield held


def pool_runs(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pools (low, high, t, w) of the ordered pools of every group of ``keys``, each group one stream."""
    keys = list(keys)
    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in _MEASURES])
    schema = T.StructType([*[rows.schema[k] for k in keys], *[T.StructField(c, T.DoubleType()) for c in _MEASURES]])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "low").mapInPandas(lambda it: _pool_rows(it, keys), schema)


def weighted_cells(df: DataFrame, keys: Sequence[str], score: str, label: str = "label") -> DataFrame:
    """Distinct finite scores of each group with the summed weight of targets ``t`` and of all ``w``.

    Balanced weights: a trial of the larger class weighs 1, the classes weigh the
    same; a group lacking a class raises.
    """
    hit = F.col(label) == 1
    cells = df.filter(is_finite(F.col(score))).groupBy(*keys, F.col(score).cast("double").alias("x"))
    cells = cells.agg(F.count_if(hit).alias("_t"), F.count_if(~hit).alias("_n"))
    sizes = cells.groupBy(*keys).agg(F.sum("_t").alias("_all_t"), F.sum("_n").alias("_all_n"))
    missing = F.raise_error(F.lit("both target and nontarget trials are required")).cast("double")
    most = F.when((F.col("_all_t") > 0) & (F.col("_all_n") > 0), F.greatest("_all_t", "_all_n")).otherwise(missing)
    sizes = sizes.select(*keys, (most / F.col("_all_t")).alias("_wt"), (most / F.col("_all_n")).alias("_wn"))
    t = F.col("_t") * F.col("_wt")
    return cells.join(sizes, list(keys)).select(*keys, "x", t.alias("t"), (t + F.col("_n") * F.col("_wn")).alias("w"))


def _cuts(pools: DataFrame, keys: list[str]) -> DataFrame:
    """``_cuts`` of each group: ascending scores after which no pool of the answer goes on."""
    grid = F.array(*[F.lit((i + 1) / LEVELS) for i in range(LEVELS - 1)])
    levels = pools.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(F.col("t") / F.col("w"), grid, F.lit(4 * LEVELS))).alias("levels"), F.max("high").alias("top"))
    run = prefix_sums(pools, keys, "low", ["t", "w"], bucket="_bucket").join(levels, keys)
    each = run.select(*keys, "high", "top", "cum_t", "cum_w", F.explode("levels").alias("c"))
    # in weights of a trial, so sums that differ by rounding only are equal and the first place counts
    cost = F.round(F.col("cum_t") - F.col("c") * F.col("cum_w"), 6)
    # before the first score the sum is 0: a level at which nothing is smaller cuts nowhere, nor does one after the last score
    least = each.groupBy(*keys, "top", "c").agg(F.min(F.struct(cost.alias("cost"), F.col("high").alias("cut"))).alias("m")).filter("m.cost < 0 and m.cut < top")
    return least.groupBy(*keys).agg(F.array_sort(F.collect_set("m.cut")).alias("_cuts"))  # at most LEVELS numbers


def _part(x: Column) -> Column:
    return F.size(F.filter(F.coalesce(F.col("_cuts"), F.array().cast("array<double>")), lambda c: c < x))


class Isotonic:
    """``cuts`` (one row per group) and ``pools`` (keys, part, low, high, t, w) of a fit."""

    def __init__(self, cuts: DataFrame, pools: DataFrame, keys: list[str], eps: float):
        self.cuts, self.pools, self.keys, self.eps = cuts, pools, keys, eps

    def _parts(self) -> DataFrame:
        """One row per group and part: its pools in order, and the last pool before them."""
        from pyspark.sql import Window as W

        pool = F.struct("low", "high", (F.col("t") / F.col("w")).alias("p"))
        parts = self.pools.groupBy(*self.keys, "part").agg(F.array_sort(F.collect_list(pool)).alias("_pools"))
        # at most LEVELS rows of a group
        last = F.lag(F.element_at("_pools", -1)).over(W.partitionBy(*self.keys).orderBy("part"))
        return parts.withColumn("_before", last).withColumnRenamed("part", "_part")

    def posterior(self, df: DataFrame, score: str, out: str = "posterior") -> DataFrame:
        """Rows with the fitted posterior: interpolated between pools, that of the outermost pools beyond them."""
        x = F.col("_x")
        given = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != out]).alias("_row"), *self.keys, F.col(score).cast("double").alias("_x"))
        placed = given.join(self.cuts, self.keys, "left").withColumn("_part", _part(x))
        found = placed.join(self._parts(), [*self.keys, "_part"], "left")
        k = F.size(F.filter("_pools", lambda q: q["low"] <= x))
        here = F.when(k > 0, F.get("_pools", k - 1)).otherwise(F.col("_before"))
        after = F.get("_pools", k)
        between = here["p"] + (x - here["high"]) / (after["low"] - here["high"]) * (after["p"] - here["p"])
        p = F.when(here.isNull(), after["p"]).when(after.isNull() | (x <= here["high"]), here["p"]).otherwise(between)
        return found.select("_row.*", F.when(is_finite(x), p).alias(out))

    def apply(self, df: DataFrame, score: str, out: str = "llr") -> DataFrame:
        """Rows with the log-odds of the fitted posterior, clipped to ``eps``."""
        fitted = self.posterior(df, score, "_posterior")
        return fitted.withColumn(out, logit(F.col("_posterior"), self.eps)).drop("_posterior")


def fit_isotonic(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", eps: float = 1e-6) -> Isotonic:
    """Balanced isotonic regression of the label on the score, for every group of ``keys`` (at least one) at once."""
    keys = list(keys)
    cells = materialise(weighted_cells(df, keys, score, label))
    ranged = with_value_bucket(cells, keys, "x").select(*keys, "_bucket", F.col("x").alias("low"), F.col("x").alias("high"), "t", "w")
    pools = materialise(pool_runs(ranged, [*keys, "_bucket"]))
    cuts = materialise(_cuts(pools, keys))
    parted = pools.join(cuts, keys, "left").withColumn("part", _part(F.col("low")))
    return Isotonic(cuts, materialise(pool_runs(parted, [*keys, "part"])), keys, eps)
