"""Consistent-hash ring with virtual nodes and bounded loads, DataFrame functions only.

A row's place on the ring is a hash of its key and content.  The ring is cut into
``2**ring_bits`` equal arcs; clockwise from each arc lie the virtual nodes of the
shards, which gives every arc an order of distinct shards.  Rows go to the first
shard of their arc; what exceeds the shard's capacity continues clockwise to the
next shard with room, in rounds: a shard serves the rows that reach it earlier
first.  Capacities differ by at most one row and add up to the number of rows, so
the counts of any two shards differ by at most one.

Only the counts of the arcs reach the driver (``2**ring_bits`` numbers, whatever
the input).  The plan made from them, at most one interval per arc and per shard,
is sent back as a bounded table.  Equal rows are counted first and travel as one row
with their number; these are ranked inside their arc by running sums of the
numbers, and the intervals that hold their ranks name the shards and slots, over
which they are given out again.  A row repeated very often thus stays small until
the end, where its copies are spread over tasks in pieces of ``PIECE``.  Placement
depends on the rows alone, not on how the table is partitioned.

Null texts have no bytes; null ids hash to a fixed place.  Equal rows are
interchangeable and take a slot each.  An empty table gives an empty one.
Only ``doc_id`` and ``text`` are read; other columns do not matter.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import written

#: Equal rows given out by one step.
PIECE = 10_000


def ring_order(n_shards: int, ring_bits: int, virtual_nodes: int) -> list[list[int]]:
    """For each arc the distinct shards in clockwise order from its beginning."""
    nodes = sorted(
        (int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big"), shard)
        for shard in range(n_shards)
        for v in range(virtual_nodes)
    )
    places = [p for p, _ in nodes]
    orders = []
    for arc in range(1 << ring_bits):
        at, order = bisect.bisect_left(places, arc << (64 - ring_bits)), {}
        for step in range(len(nodes)):
            order.setdefault(nodes[(at + step) % len(nodes)][1])
            if len(order) == n_shards:
                break
        orders.append(list(order))
    return orders


def capacities(n_rows: int, n_shards: int) -> list[int]:
    return [n_rows // n_shards + (shard < n_rows % n_shards) for shard in range(n_shards)]


def intervals(counts: dict[int, int], orders: list[list[int]], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, slot of the first rank) for every row of every arc."""
    free = capacities(sum(counts.values()), n_shards)
    used, done, out = [0] * n_shards, dict.fromkeys(counts, 0), []
    waiting = sorted(counts)
    for turn in range(n_shards):
        for arc in waiting:
            shard = orders[arc][turn]
            take = min(counts[arc] - done[arc], free[shard])
            if take:
                out.append((arc, done[arc], done[arc] + take, shard, used[shard]))
                done[arc] += take
                used[shard] += take
                free[shard] -= take
        waiting = [arc for arc in waiting if done[arc] < counts[arc]]
    return out


def _table(df: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of numbers from a literal."""
    text = json.dumps([dict(zip(names, r)) for r in rows])
    schema = f"array<struct<{', '.join(f'{n}: long' for n in names)}>>"
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), schema)))


def arc_of(place: Column, ring_bits: int) -> Column:
    return F.shiftrightunsigned(place, 64 - ring_bits).cast("int")


def shard_documents(documents: DataFrame, n_shards: int, ring_bits: int = 12, virtual_nodes: int = 128, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, size, text_crc32, shard and slot (gapless from 0 inside a shard) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = [*keys, "size", "text_crc32"]
    rows = documents.select(*keys, (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("_n")).withColumn("_place", F.xxhash64(*same))
    rows = written(rows.withColumn("_arc", arc_of(F.col("_place"), ring_bits)))
    counts = {r["_arc"]: r["_n"] for r in rows.groupBy("_arc").agg(F.sum("_n").alias("_n")).collect()}
    plan = intervals(counts, ring_order(n_shards, ring_bits, virtual_nodes), n_shards)
    before = W.partitionBy("_arc").orderBy("_place", *same).rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.withColumn("_rank", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    bounded = F.broadcast(_table(rows, plan, ["_arc", "_from", "_to", "_shard", "_base"]))
    held = (F.col("_rank") < F.col("_to")) & (F.col("_rank") + F.col("_n") > F.col("_from"))
    placed = ranked.alias("r").join(bounded.alias("p"), (F.col("r._arc") == F.col("p._arc")) & held)
    low, high = F.greatest("_rank", "_from"), F.least(F.col("_rank") + F.col("_n"), F.col("_to"))
    slot = (F.col("_base") + low - F.col("_from")).alias("_slot")
    runs = written(placed.select(*[f"r.{c}" for c in same], F.col("_shard").cast("int").alias("shard"), slot, (high - low).alias("_n")))
    few = runs.filter(F.col("_n") <= PIECE)
    many = runs.filter(F.col("_n") > PIECE).withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(PIECE))))
    many = many.withColumns({"_slot": F.col("_slot") + F.col("_at"), "_n": F.least(F.lit(PIECE), F.col("_n") - F.col("_at"))}).drop("_at")
    out = few.unionByName(many.repartition("_slot", "shard"))
    return out.select(*same, "shard", F.explode(F.sequence(F.col("_slot"), F.col("_slot") + F.col("_n") - 1)).alias("slot"))
