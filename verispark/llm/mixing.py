"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source is taken ``floor(r)`` times for sure, ``r`` being the
source's target over its size, and once more with the fractional part of ``r`` as
inclusion probability.  The flight phase of the cube method draws those extra
copies so that the words and the number of documents of each source keep their
expected totals exactly: three documents at a time, probabilities move along the
null space of the two balancing constraints until one of them is 0 or 1.

Documents are dealt into buckets of about ``BUCKET`` by a hash inside their
source, so a source of any size is many small tasks.  A bucket leaves at most two
undecided documents; those meet again in fewer, larger buckets, until each source
has one, whose last undecided documents are landed by dropping the balance on
documents and then on words.  So a source's words miss their target by at most
about two documents.

Targets: weights fill up a share of the total size proportional to them; a target
stops at ``max_epochs`` times its source's size, and the excess goes to the others
by weight.  The table of sources (one row per source) is solved by running sums.

Null texts have size 0, null sources are one source that sorts last.  Random
numbers come from hashes of the rows and ``seed``: reruns agree whatever the
partitions.  Repeated rows are drawn independently.  An empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import written
from .quality import SPACE

BUCKET = 2000
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
TINY = 1e-9


def word_count(text: str = "text") -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACE), "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: its size, documents and target, from (source, size) rows.

    With sources sorted by cap over weight, those before a certain place are
    capped and the rest share what is left by weight; running sums find the place.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).cast("double"))
    cap = F.lit(max_epochs) * F.col("source_size")
    per = per.withColumn("cap", cap.cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    by_level = W.orderBy("level", F.col("source").asc_nulls_last())
    before, rest = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    share = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    per = per.withColumn("_share", share / F.sum("weight").over(rest))
    # the first source that its share does not fill gives the level for all after it
    free = F.when(F.col("_share") <= F.col("level"), F.col("_share"))
    per = per.withColumn("_level", F.first(free, ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("cap"), F.coalesce(F.col("_level"), F.col("level")) * F.col("weight"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _move(size: np.ndarray, p: np.ndarray, trio: list[int], u: float) -> None:
    """Move three probabilities along the null space of (words, documents) until one is 0 or 1."""
    a, b, c = trio
    # orthogonal to (1, 1, 1) and to the sizes; equal sizes leave a free direction
    v = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
    if v == (0.0, 0.0, 0.0):
        v = (1.0, -1.0, 0.0)
    up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(trio, v) if d)
    down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(trio, v) if d)
    step = up if u * (up + down) < down else -down
    for i, d in zip(trio, v):
        p[i] += step * d
        if p[i] < TINY:
            p[i] = 0.0
        elif p[i] > 1 - TINY:
            p[i] = 1.0


def _move_wide(size: np.ndarray, p: np.ndarray, at: np.ndarray, u: float) -> None:
    """Move the first of ``at`` against all the others together until one of them is 0 or 1.

    The others share the step as a linear function of their size, which is solved
    so that words and documents both keep their totals.
    """
    rest = size[at[1:]]
    m, s1, s2 = len(rest), rest.sum(), (rest * rest).sum()
    det = m * s2 - s1 * s1
    v = np.ones(len(at))
    if det > TINY * max(1.0, m * s2):
        v[1:] = (s1 * size[at[0]] - s2) / det + (s1 - m * size[at[0]]) / det * rest
    elif size[at[0]] == rest[0]:
        v[1:] = -1.0 / m
    else:  # equal sizes can't make up for another one: they move against each other
        v[:] = 0.0
        v[1:3] = 1.0, -1.0
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.min(np.where(v > 0, (1 - p[at]) / v, np.where(v < 0, p[at] / -v, np.inf)))
        down = np.min(np.where(v > 0, p[at] / v, np.where(v < 0, (1 - p[at]) / -v, np.inf)))
    p[at] += (up if u * (up + down) < down else -down) * v
    p[at] = np.where(p[at] < TINY, 0.0, np.where(p[at] > 1 - TINY, 1.0, p[at]))


def _wide(size: np.ndarray, p: np.ndarray, at: np.ndarray, random: np.random.Generator, steps: int) -> None:
    """Decide the largest of ``at`` (sorted by falling size) one by one."""
    for _ in range(steps):
        at = at[(p[at] > 0) & (p[at] < 1)]
        if len(at) < 3:
            return
        _move_wide(size, p, at, random.random())


#: How many of a bucket's largest and smallest documents are moved against many others at once.
ENDS = 64


def flight(size: np.ndarray, p: np.ndarray, random: np.random.Generator, land: bool = False) -> np.ndarray:
    """Probabilities after the flight phase; with ``land`` all are 0 or 1.

    A large document can only be decided if many small ones make up for it, so the
    largest are moved first, against all others; then come trios in falling size;
    what these leave is moved against the smallest documents.  So the undecided
    ones at the end are small, and landing them costs little balance.
    """
    size, p = size.astype(float), p.astype(float)
    order = np.argsort(-size, kind="stable")
    order = order[(p[order] > 0) & (p[order] < 1)]
    _wide(size, p, order, random, ENDS)
    middle, last = order[: max(0, len(order) - ENDS)], order[max(0, len(order) - ENDS) :]
    held: list[int] = []
    sizes, q, draws = size.tolist(), p.tolist(), iter(())
    for i in middle.tolist():
        if 0.0 < q[i] < 1.0:
            held.append(i)
            while len(held) == 3:
                u = next(draws, None)
                if u is None:
                    draws = iter(random.random(1024).tolist())
                    u = next(draws)
                _move(sizes, q, held, u)
                held = [k for k in held if 0.0 < q[k] < 1.0]
    p = np.array(q)
    _wide(size, p, np.concatenate([np.array(held, int), last]), random, 2 * ENDS)
    if land:
        held = [k for k in order if 0.0 < p[k] < 1.0]
        if len(held) == 2:  # keep the number of documents, not their words
            a, b = held
            total = p[a] + p[b]
            if total <= 1:
                p[a], p[b] = (total, 0.0) if random.random() * total < p[a] else (0.0, total)
            else:
                p[a], p[b] = (1.0, total - 1) if random.random() * (2 - total) < 1 - p[b] else (total - 1, 1.0)
        for k in held:
            p[k] = float(random.random() < p[k])
    return p


def _fly_bucket(land: bool, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "size"], kind="stable")
        random = np.random.default_rng([seed, len(pdf), int(pdf["place"].iloc[0]) & 0xFFFFFFFF, int(pdf["size"].sum()) & 0xFFFFFFFF])
        return pdf.assign(p=flight(pdf["size"].to_numpy(), pdf["p"].to_numpy(), random, land))

    return run


def mix(documents: DataFrame, keys: tuple[str, ...] = ("doc_id",), weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 1) -> DataFrame:
    """``keys``, source, size, source_size, target and copies of every document."""
    place = F.xxhash64(*keys, F.lit(seed))
    rows = documents.select(*keys, F.col("source").cast("string").alias("source"), word_count().alias("size"))
    rows = written(rows.withColumn("place", place))
    targets = written(source_targets(rows, weights, max_epochs))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = rows.withColumnRenamed("source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    sure = F.floor(ratio + TINY).cast("long")
    part = F.when(ratio - sure > TINY, ratio - sure).otherwise(0.0)
    rows = joined.withColumn("sure", sure).withColumn("p", part)
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    levels, left = 1, most
    while left > BUCKET:
        left, levels = 2 * (left // BUCKET + 1), levels + 1
    parts, todo = [], rows
    for level in range(levels):
        last = level == levels - 1
        # about BUCKET documents each: the first level counts documents, later ones what is left of them
        n_buckets = F.greatest(F.ceil(F.col("n_docs") / F.pow(F.lit(BUCKET / 2), F.lit(level)) / BUCKET), F.lit(1))
        bucket = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("place", F.lit(level)), n_buckets)
        flown = todo.withColumn("bucket", bucket).groupBy("source", "bucket").applyInPandas(
            _fly_bucket(last, seed + level), todo.withColumn("bucket", bucket).schema
        )
        if not last:
            flown = written(flown)
            parts.append(flown.filter((F.col("p") == 0) | (F.col("p") == 1)).drop("bucket"))
            todo = flown.filter((F.col("p") > 0) & (F.col("p") < 1)).drop("bucket")
        else:
            parts.append(flown.drop("bucket"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select(*keys, "source", "size", "source_size", "target", (F.col("sure") + F.col("p").cast("long")).alias("copies"))


def repeat_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 1) -> DataFrame:
    """The mix itself: every document as often as the mix takes it, with its own columns.

    Rows are matched by a hash of their content; equal rows are one document whose
    copies add up.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"))
    whole = documents.select(key.alias("_doc_key"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_doc"))
    copies = mix(documents.select(key.alias("_doc_key"), "source", "text"), ("_doc_key",), weights, max_epochs, seed)
    taken = copies.filter("copies > 0").groupBy("_doc_key").agg(F.collect_list("copies").alias("_copies"))
    joined = whole.join(taken, "_doc_key")
    # the rows of one document, if it is repeated, take one entry each
    turn = F.row_number().over(W.partitionBy("_doc_key").orderBy("_doc_key"))
    joined = joined.withColumn("_n", F.get("_copies", turn - 1)).filter("_n > 0")
    return joined.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_doc.*")
