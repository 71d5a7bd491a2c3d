"""Distributed order statistics.

A plain ``sum().over(partitionBy(group).orderBy(value))`` puts a whole group in
one task.  Here a group is first cut into value ranges ("buckets"): cut points
come from ``percentile_approx`` and are written, so that totals and rows read the
same ones; a bucket is a function of the value alone (so ties share one), and only
the short per-bucket totals are accumulated across buckets.  Rows are then windowed
inside (group, bucket), so a group holding a third of all rows is still spread
over many tasks.

Every function takes ``keys`` (at least one grouping column) so that all joins
are equi-joins; the side joined in has one row per group or per bucket, and
Spark broadcasts it only while its measured size is under
``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hash_key
from ..session import materialise

FAN = 16  # FAN * FAN buckets per group, found by two steps of FAN comparisons


def with_value_bucket(df: DataFrame, keys: Sequence[str], value: str, counted: Sequence[str] = ()) -> DataFrame:
    """Add ``_bucket``: an integer that grows with ``value`` inside each group.

    ``df`` (of its columns keys, value and ``counted``, if that is given) is written
    first: cut points and rows both need it, and Spark would make the table anew for
    each of them where their plans differ in a filter or hold a Python step.
    """
    n = FAN * FAN
    df = materialise(df.select(*dict.fromkeys([*keys, value, *counted])) if counted else df)
    grid = F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, grid, F.lit(4 * n)).alias("_c"))
    steps = F.sequence(F.lit(0), F.lit(FAN - 1))
    cuts = cuts.select(
        *keys,
        F.transform(F.sequence(F.lit(1), F.lit(FAN - 1)), lambda i: F.get(F.col("_c"), i * FAN - 1)).alias("_coarse"),
        F.transform(steps, lambda i: F.slice(F.col("_c"), i * FAN + 1, F.lit(FAN - 1))).alias("_fine"),
    )
    # the points depend on the order in which partial summaries arrive, and the plans of totals and
    # rows would each merge them anew: with points that differ, running sums are wrong
    rows = df.join(materialise(cuts), list(keys))
    below = F.size(F.filter(F.col("_coarse"), lambda c: c < F.col(value)))
    rows = rows.withColumn("_step", below)
    inside = F.size(F.filter(F.get(F.col("_fine"), F.col("_step")), lambda c: c < F.col(value)))
    return rows.withColumn("_bucket", F.col("_step") * FAN + inside).drop("_step", "_coarse", "_fine")


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: Sequence[str],
    *,
    descending: bool = False,
    ties: Sequence[str] = (),
    bucket: str | None = None,
) -> DataFrame:
    """Running totals of ``measures`` in order of ``value`` inside each group.

    Adds ``cum_<m>`` (up to and including the row), ``tot_<m>`` (whole group)
    and ``prev_value`` (value of the row before, NULL for the first).  Rows
    must be unique in (keys, value, ties).  ``bucket`` names an existing column
    that is monotone in ``value`` and used instead of computed cut points.
    """
    keys = list(keys)
    rows = df.withColumnRenamed(bucket, "_bucket") if bucket else with_value_bucket(df, keys, value)
    edge = F.min(value) if descending else F.max(value)
    totals = rows.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(m) for m in measures], edge.alias("_edge"))
    order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    across = W.partitionBy(*keys).orderBy(order)
    before = across.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(m).over(W.partitionBy(*keys)).alias(f"tot_{m}") for m in measures],
        F.lag("_edge").over(across).alias("_prev_edge"),
    )
    dirs = [F.col(value).desc() if descending else F.col(value).asc(), *[F.col(t).asc() for t in ties]]
    within = W.partitionBy(*keys, "_bucket").orderBy(*dirs)
    run = within.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.join(offsets, [*keys, "_bucket"])
    return out.select(
        *[F.col(c) for c in df.columns if c != bucket],
        *[(F.col(f"_off_{m}") + F.sum(m).over(run)).alias(f"cum_{m}") for m in measures],
        *[F.col(f"tot_{m}") for m in measures],
        F.coalesce(F.lag(value).over(within), F.col("_prev_edge")).alias("prev_value"),
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """1-based ranks of each distinct value, ties sharing their mean rank."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    summed = prefix_sums(counts, keys, value, ["n"])
    return summed.select(*keys, value, (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias("avg_rank"), "n")


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    The built-in exact ``percentile`` keeps every distinct value of a group in
    one task; this finds the two bracketing order statistics by rank instead.
    NULL and NaN values are ignored.
    """
    usable = F.col(value).isNotNull() & ~F.isnan(value)
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    # dropped after the aggregate, so the value expression is evaluated once
    counts = df.groupBy(*keys, value).agg(F.sum(F.when(usable, w).otherwise(F.lit(0))).alias("n")).filter(F.col("n") > 0)
    ranked = prefix_sums(counts, keys, value, ["n"])
    v, top, first = F.col(value), F.col("cum_n") - 1, F.col("cum_n") - F.col("n")
    aggs, outs = [], []
    for name, q in probs.items():
        if not 0.0 <= q <= 1.0:
            raise ValueError("quantile must be in [0, 1]")
        pos = F.lit(q) * (F.col("tot_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [
            F.max(F.when((first <= lo) & (lo <= top), v)).alias(f"_lo_{name}"),
            F.max(F.when((first <= hi) & (hi <= top), v)).alias(f"_hi_{name}"),
            F.max(pos - lo).alias(f"_at_{name}"),
        ]
        low, high, at = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_at_{name}")
        outs.append((low + (high - low) * at).alias(name))
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *outs)


def hash_rank(df: DataFrame, keys: Sequence[str], key_hex: str, ties: Sequence[str], name: str = "rank") -> DataFrame:
    """1-based rank by a uniform hex key: its leading digits are the buckets."""
    rows = df.withColumn("_one", F.lit(1).cast("bigint")).withColumn("_lead", F.substring(key_hex, 1, 3))
    out = prefix_sums(rows, keys, key_hex, ["_one"], ties=ties, bucket="_lead")
    return out.select(*df.columns, F.col("cum__one").alias(name))


def text_rank(df: DataFrame, keys: Sequence[str], text: str, ties: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """1-based rank of rows in byte order of a text column, inside each group of ``keys`` (none: over all rows).

    The rows are sorted by range partitions, whose cut points Spark samples from
    the texts themselves, so common prefixes do not matter.  A row's number is its
    place in its partition plus the sizes of the partitions before; a group's rank
    counts from the number of its first row.  The sorted table is written, so the
    numbers stay the same when it is read again.
    """
    keys = list(keys)
    placed = materialise(df.orderBy(*keys, text, *ties).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = placed.join(sizes, "_part").withColumn("_row", F.col("_before") + F.col("_at"))
    if keys:
        firsts = placed.groupBy(*keys).agg(F.min("_row").alias("_first"))
        placed = placed.join(firsts, keys)
    first = F.col("_first") if keys else F.lit(0)
    return placed.select(*df.columns, (F.col("_row") - first + 1).alias(name))


def top_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, *, spread: Sequence[str], salts: int = 32
) -> DataFrame:
    """First ``n`` rows of each group; adds ``row_number``.

    Each group is cut by a hash of the ``spread`` columns, every cut keeps its
    own first n (no row of the answer can be lost), and the final ranking sees
    at most n * salts rows of any group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    local = W.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn("_rn", F.row_number().over(local)).filter(F.col("_rn") <= n).drop("_rn", "_salt")
    return kept.withColumn("row_number", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(
        F.col("row_number") <= n
    )


def hash_sample(df: DataFrame, keys: Sequence[str], id_col: str, n: int, seed: str) -> DataFrame:
    """The n rows of each group with the lowest salted hash of their id."""
    tagged = df.withColumn("_h", hash_key(*[F.col(k) for k in keys], F.lit(seed), F.col(id_col), sep="|"))
    return top_n_per_group(tagged, keys, [F.col("_h"), F.col(id_col)], n, spread=[id_col]).drop("_h", "row_number")
