"""Bootstrap confidence intervals without materialising resampled trials.

Draws belong to the cells of the compressed table (distinct scores, decision cells
or clusters) and are exact multinomial counts, made for all replicates at once
(``resampling``).  They are functions of the seed and the cell's place, so a
recomputed task repeats them.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import hash_key, hash_number, is_finite
from ..session import materialise
from . import resampling as S
from .metrics import block_from_counts, score_counts
from .ranking import prefix_sums, text_rank, with_value_bucket
from .selective import DECISION_COUNTS, _decision_rates

BASE_SEED = 20260608  # fixed value: base of all resampling seeds
SAMPLES = 1000

CI_METRICS = ["eer_pct", "cllr", "min_dcf_p001", "act_dcf_p001", "min_dcf_p01", "act_dcf_p01"]
DECISION_METRICS = ["accuracy", "effective_acc", "covered_acc", "coverage", "far", "frr"]


def stable_seed(description: str) -> int:
    return (BASE_SEED + zlib.crc32(description.encode())) % (2**32 - 1)


def percentile_ci95(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Half width of the 2.5-97.5 percentile band of the finite values.

    Groups here are replicates (about a thousand rows), which the built-in exact
    percentile holds easily.
    """
    aggs = []
    for c in columns:
        usable = F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
        band = F.percentile(usable, F.array(F.lit(0.025), F.lit(0.975)))
        aggs.append(((F.get(band, F.lit(1)) - F.get(band, F.lit(0))) / 2.0).alias(f"{c}_ci95"))
    return df.groupBy(*keys).agg(*aggs)


def _group_schema(df: DataFrame, keys: Sequence[str], *more: T.StructField) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in keys], *more])


def _replicate_schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField("replicate", T.LongType()), *[df.schema[k] for k in keys], *[T.StructField(m, T.DoubleType()) for m in S.METRICS]])


#: Distinct scores drawn together, and the most ranges of them whose counts the driver sends to all tasks.
CELLS = 256
RANGES = 1 << 20


def replicate_metrics(counts: DataFrame, keys: Sequence[str], samples: int, seed: int) -> DataFrame:
    """(replicate, keys, metrics) of multinomial resamples of each group's trials.

    ``counts``: keys, score, t, n.  Scores are cut by rank into ranges; a task draws
    its ranges' counts in all replicates from the group's totals downwards, so the
    draws depend on the data and the seed alone.  At most RANGES counts per class
    reach the driver.
    """
    keys = list(keys)
    one = counts.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = materialise(prefix_sums(one, keys, "score", ["t", "n", "_one"], descending=True).drop("prev_value"))
    n_cells = max(CELLS, ranked.count() // RANGES)
    ranked = ranked.withColumn("_range", F.expr(f"(cum__one - 1) div {n_cells}"))
    sizes = ranked.groupBy(*keys, "_range").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    ends: dict[tuple, tuple] = {}
    for r in sizes.orderBy(*keys, "_range").collect():
        for k, c in enumerate((r.t, r.n)):
            ends.setdefault(tuple(r[: len(keys)]), ([], []))[k].append(c)
    ends = {g: tuple(np.cumsum(c) for c in both) for g, both in ends.items()}
    shared = counts.sparkSession.sparkContext.broadcast(ends)

    def totals(group: tuple) -> tuple[np.ndarray, np.ndarray]:
        both = shared.value[group]
        n_t, n_n = int(both[0][-1]), int(both[1][-1])
        t = S.generator(seed, zlib.crc32(repr(group).encode()), 0).binomial(np.full(samples, n_t + n_n), n_t / (n_t + n_n))
        return t, n_t + n_n - t

    def made(parts):
        for key, rows in S.whole_runs(parts, [*keys, "_range"]):
            group, at = key[:-1], int(key[-1])
            rows = rows.sort_values("score", ascending=False)
            both, draws, before = totals(group), [], []
            for k, name in enumerate(("t", "n")):
                place = (zlib.crc32(repr(group).encode()), k + 1)
                drawn, earlier = S.split_range(both[k], np.zeros_like(both[k]), shared.value[group][k], at, seed, *place)
                draws.append(S.split_cells(drawn, rows[name].to_numpy(np.int64), S.generator(seed, *place, -1, at)))
                before.append(earlier)
            block = S.Block(samples)
            block.add(at, rows["score"].to_numpy(float), *draws, tuple(before), both)
            yield group, block

    rows = ranked.select(*keys, "_range", "score", "t", "n").repartition(*keys, "_range").sortWithinPartitions(*keys, "_range")
    blob = T.StructField("block", T.BinaryType())
    parts = rows.mapInPandas(S.partial_blocks(made, keys), _group_schema(counts, keys, blob))
    gathered = parts.repartition(*keys).sortWithinPartitions(*keys)
    return gathered.mapInPandas(lambda it: S.merged_blocks(it, keys, samples, totals), _replicate_schema(counts, keys))


def bootstrap_metrics(df: DataFrame, keys: Sequence[str], score: str = "llr", *, samples: int = SAMPLES, description: str = "") -> DataFrame:
    """Point metrics with 95% half widths of exact multinomial resamples of the trials."""
    counts = materialise(score_counts(df, keys, score))
    reps = replicate_metrics(counts, keys, samples, stable_seed(description))
    return block_from_counts(counts, keys).join(percentile_ci95(reps, keys, CI_METRICS), list(keys))


def fixed_weights(df: DataFrame, replicate: str = "replicate", id_col: str = "trial_id", modulus: int = 4) -> DataFrame:
    """Row weights 0..modulus-1 from sha256(replicate|id): a reproducible resampling."""
    h = hash_number(hash_key(F.col(replicate), F.col(id_col), sep="|"), 8)
    return df.withColumn("weight", F.pmod(h, F.lit(modulus)))


def bootstrap_fixed(df: DataFrame, keys: Sequence[str], score: str, samples: int) -> DataFrame:
    """Replicate metric blocks under ``fixed_weights`` (checkable anywhere)."""
    reps = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    weighted = fixed_weights(reps).filter(F.col("weight") > 0)
    return block_from_counts(score_counts(weighted, ["replicate", *keys], score, weight="weight"), ["replicate", *keys])


DECISION_CELLS = [(y, d) for y in (1, 0) for d in ("target", "nontarget", "reject")]


def bootstrap_decisions(
    df: DataFrame, keys: Sequence[str], *, samples: int = SAMPLES, description: str = ""
) -> DataFrame:
    """Decision metrics with half widths.

    A resample only changes the counts of the six (label, decision) cells, so
    each replicate is one exact multinomial draw, whatever the number of trials.
    """
    seed = stable_seed(description)
    counts = df.groupBy(*keys).agg(
        F.array(*[F.count_if((F.col("label") == y) & (F.col("decision") == d)) for y, d in DECISION_CELLS]).alias("c")
    )

    @F.pandas_udf("array<array<bigint>>")
    def draws(c: pd.Series, stream: pd.Series) -> pd.Series:
        """All multinomial draws of a group at once, from a stream of its own; the counts themselves come first."""
        out = []
        for cell, key in zip(c, stream):
            cell = np.asarray(cell, dtype=np.int64)
            rng = np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), int(key) & (2**64 - 1)]))
            drawn = rng.multinomial(int(cell.sum()), cell / cell.sum(), size=samples)
            out.append([cell.tolist(), *drawn.tolist()])
        return pd.Series(out)

    drawn = counts.select(*keys, F.posexplode(draws("c", F.xxhash64(*keys))).alias("replicate", "w"))
    return _decision_intervals(drawn, keys)


def bootstrap_decisions_fixed(df: DataFrame, keys: Sequence[str], samples: int, id_col: str = "trial_id") -> DataFrame:
    """Decision metrics of replicates under ``fixed_weights`` (checkable anywhere)."""
    reps = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    weighted = fixed_weights(reps, id_col=id_col)
    of = lambda y, d: F.sum(F.when((F.col("label") == y) & (F.col("decision") == d), F.col("weight")).otherwise(0))
    return decision_rates(weighted.groupBy("replicate", *keys).agg(F.array(*[of(y, d) for y, d in DECISION_CELLS]).alias("w")), keys)


def decision_rates(drawn: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Decision metrics of (replicate, keys, w): counts of the six cells."""
    w = [F.get("w", F.lit(i)) for i in range(6)]
    return drawn.select(
        *keys,
        "replicate",
        (w[0] + w[1] + w[2] + w[3] + w[4] + w[5]).alias("n"),
        (w[0] + w[1] + w[2]).alias("target_n"),
        (w[3] + w[4] + w[5]).alias("nontarget_n"),
        (w[0] + w[1] + w[3] + w[4]).alias("accepted_n"),
        (w[2] + w[5]).alias("rejected_n"),
        (w[0] + w[4]).alias("_right"),
        w[3].alias("_fa"),
        (w[1] + w[2]).alias("_miss"),
    ).select(*keys, "replicate", *DECISION_COUNTS, *_decision_rates())


def _decision_intervals(drawn: DataFrame, keys: Sequence[str]) -> DataFrame:
    rates = decision_rates(drawn, keys)
    ci = percentile_ci95(rates.filter(F.col("replicate") > 0), keys, DECISION_METRICS)
    return rates.filter(F.col("replicate") == 0).drop("replicate").join(ci, list(keys))


def cluster_weights(df: DataFrame, cluster: str, samples: int, seed: int) -> DataFrame:
    """(cluster, weights) with how often each replicate draws it: ``samples`` numbers of 16 bits.

    Every replicate draws as many clusters as there are, with replacement.  Clusters
    are numbered in the order of their names and drawn in ranges of CELLS.
    """
    names = text_rank(df.filter(F.col(cluster).isNotNull()).select(F.col(cluster).cast("string").alias("cluster")).distinct(), [], "cluster", name="_at")
    names = materialise(names.select("cluster", (F.col("_at") - 1).alias("_at")))
    n = names.count()
    ends = np.minimum(np.arange(1, -(-n // CELLS) + 1) * CELLS, n)

    def rows(parts):
        for (at,), some in S.whole_runs(parts, ["_range"]):
            some = some.sort_values("_at")
            total = np.full(samples, n)
            drawn, _ = S.split_range(total, total, ends, int(at), seed)
            drawn = S.split_cells(drawn, np.ones(len(some), np.int64), S.generator(seed, -1, int(at)))
            yield pd.DataFrame({"cluster": some["cluster"], "weights": [w.tobytes() for w in np.minimum(drawn, 65535).astype(np.uint16)]})

    ranged = names.withColumn("_range", F.expr(f"_at div {CELLS}")).repartition("_range").sortWithinPartitions("_range")
    return materialise(ranged.mapInPandas(rows, "cluster string, weights binary"))


def fixed_cluster_weights(df: DataFrame, cluster: str, samples: int, modulus: int = 4) -> DataFrame:
    """The same table with weights 0..modulus-1 from sha256(replicate|cluster)."""
    import hashlib

    @F.pandas_udf("binary")
    def weights(names: pd.Series) -> pd.Series:
        number = lambda r, c: int(hashlib.sha256(f"{r}|{c}".encode()).hexdigest()[:8], 16) % modulus
        return pd.Series([np.array([number(r, c) for r in range(1, samples + 1)], np.uint16).tobytes() for c in names])

    return df.filter(F.col(cluster).isNotNull()).select(F.col(cluster).cast("string").alias("cluster")).distinct().withColumn("weights", weights("cluster"))


#: Largest table of cluster weights that is sent to all tasks.
WEIGHT_BYTES = 64 << 20


def cluster_replicates(df: DataFrame, keys: Sequence[str], cluster: str, weights: DataFrame, samples: int, score: str = "llr") -> DataFrame:
    """(replicate, keys, metrics) with every trial weighted by its cluster's weight, for each group of ``keys``.

    Trials are compressed to (score, cluster) counts and dealt by ranges of scores.
    The first pass adds up the weighted counts of the ranges, as one array of
    replicates each; the second walks every range with what lies before it.
    """
    keys = list(keys)
    hit = F.col("label") == 1
    rows = df.filter(is_finite(F.col(score))).groupBy(*keys, F.col(cluster).cast("string").alias("cluster"), F.col(score).alias("score"))
    rows = rows.agg(F.count_if(hit).alias("t"), F.count_if(~hit).alias("n"))
    rows = materialise(with_value_bucket(rows, keys, "score"))
    place = [*keys, "_bucket"]
    known = None
    if weights.count() * samples * 2 <= WEIGHT_BYTES:
        known = df.sparkSession.sparkContext.broadcast({r.cluster: bytes(r.weights) for r in weights.collect()})

    def dealt(some: DataFrame) -> DataFrame:
        """Rows of a range in one task by descending score; each has its cluster's weights unless all tasks have all."""
        some = some.join(weights, "cluster") if known is None else some
        return some.repartition(*place).sortWithinPartitions(*place, F.col("score").desc())

    def matrices(some: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        each = some["weights"] if known is None else [known.value[c] for c in some["cluster"]]
        w = np.frombuffer(b"".join(each), np.uint16).reshape(len(some), samples).astype(np.float64)
        return w * some["t"].to_numpy()[:, None], w * some["n"].to_numpy()[:, None]

    def sums(parts):
        for key, some in S.runs(parts, place):
            for at in range(0, len(some), CELLS):
                wt, wn = matrices(some.iloc[at : at + CELLS])
                out = pd.DataFrame([key], columns=place)
                out["t"], out["n"] = [wt.sum(axis=0).tobytes()], [wn.sum(axis=0).tobytes()]
                yield out

    both = [T.StructField(c, T.BinaryType()) for c in ("t", "n")]
    schema = _group_schema(rows, place, *both)

    def added(parts):
        total: dict[tuple, list[np.ndarray]] = {}
        for key, some in S.runs(parts, place):
            arrays = [sum(np.frombuffer(x, np.float64) for x in some[c]) for c in ("t", "n")]
            total[key] = [a + b for a, b in zip(total[key], arrays)] if key in total else arrays
        for key, (t, n) in total.items():
            out = pd.DataFrame([key], columns=place)
            out["t"], out["n"] = [t.tobytes()], [n.tobytes()]
            yield out

    ranges = dealt(rows).mapInPandas(sums, schema).mapInPandas(added, schema)
    offsets: dict[tuple, list] = {}  # ranges x replicates numbers of each group: of a fixed size
    for r in ranges.orderBy(*keys, F.col("_bucket").desc()).collect():
        t, n = np.frombuffer(r.t, np.float64), np.frombuffer(r.n, np.float64)
        done = offsets.setdefault(tuple(r[: len(keys)]), [{}, np.zeros(samples), np.zeros(samples)])
        done[0][r["_bucket"]] = (len(done[0]), done[1], done[2])
        done[1], done[2] = done[1] + t, done[2] + n
    shared = df.sparkSession.sparkContext.broadcast(offsets)

    def made(parts):
        walker, last = None, None
        for key, some in S.runs(parts, place):
            if walker is None or key != last:
                if walker is not None:
                    yield last[:-1], walker.finished()
                at, *before = shared.value[key[:-1]][0][key[-1]]
                walker, last = S.Walker(at, tuple(before), shared.value[key[:-1]][1:], samples), key
            for k in range(0, len(some), CELLS):
                piece = some.iloc[k : k + CELLS]
                walker.feed(piece["score"].to_numpy(float), *matrices(piece))
        if walker is not None:
            yield last[:-1], walker.finished()

    blob = T.StructField("block", T.BinaryType())
    parts = dealt(rows).mapInPandas(S.partial_blocks(made, keys), _group_schema(df, keys, blob))
    gathered = parts.repartition(*keys).sortWithinPartitions(*keys)
    totals = lambda group: tuple(shared.value[group][1:])
    return gathered.mapInPandas(lambda it: S.merged_blocks(it, keys, samples, totals), _replicate_schema(df, keys))


def paired_cluster_bootstrap(
    df: DataFrame,
    keys: Sequence[str],
    cluster: str,
    system: str,
    pair: tuple[str, str],
    *,
    score: str = "llr",
    samples: int = SAMPLES,
    description: str = "speaker-clustered paired",
) -> DataFrame:
    """Difference of two systems' metrics with clusters (speakers) resampled together.

    Both systems share a replicate's cluster weights.  Trials without a cluster
    take no part.
    """
    base, other = pair
    rows = df.filter(F.col(system).isin(base, other) & F.col(cluster).isNotNull())
    group = [*keys, system]
    weights = cluster_weights(rows, cluster, samples, stable_seed(description))
    reps = cluster_replicates(rows, group, cluster, weights, samples, score)
    point = block_from_counts(score_counts(rows, group, score), group).select(F.lit(0).cast("long").alias("replicate"), *group, *CI_METRICS)
    blocks = point.unionByName(reps.select("replicate", *group, *CI_METRICS))
    tall = blocks.unpivot(["replicate", *group], CI_METRICS, "metric", "value")
    tall = tall.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    both = tall.groupBy("replicate", *keys, "metric").pivot(system, [base, other]).agg(F.first("value"))
    both = both.withColumn("d", F.col(other) - F.col(base))
    rep = F.col("replicate") > 0
    d = F.when(rep & F.col("d").isNotNull(), F.col("d"))
    band = F.percentile(d, F.array(F.lit(0.025), F.lit(0.975)))
    low, high = F.get(band, F.lit(0)), F.get(band, F.lit(1))
    share = lambda cond: F.avg(F.when(d.isNotNull(), cond.cast("double")))
    return both.groupBy(*keys, "metric").agg(
        F.max(F.when(~rep, F.col(base))).alias("base_value"),
        F.max(F.when(~rep, F.col(other))).alias("other_value"),
        F.max(F.when(~rep, F.col("d"))).alias("difference"),
        low.alias("ci95_low"),
        high.alias("ci95_high"),
        ((high - low) / 2.0).alias("ci95_half_width"),
        share(F.col("d") < 0).alias("probability_better"),
        F.least(F.lit(1.0), 2.0 * F.least(share(F.col("d") <= 0), share(F.col("d") >= 0))).alias("p_two_sided"),
    )
