"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with a cosine of at least 0.9 are at most ``eps`` = sqrt(0.2) apart, and
so are their projections on any axes.

1. The leading principal axes come from the second moments of all unit vectors,
   added up in tasks; only a matrix of dimension x dimension reaches the driver.
2. Vectors are sorted by their grid cells (width eps) on those axes, and the
   sequence is cut into blocks of 4096 by rank.
3. Sequence intervals are joined recursively: intervals of 16^k blocks are paired
   only if their bounding boxes are within eps, and only such pairs are opened into
   their parts.  Inside a pair of blocks the recursion goes on with runs of 256.
4. What is left is compared exactly in double precision.  Links are counted, not
   given out: each task returns one row per linked vector with the number of its
   links and a neighbour in a spanning forest, and components join the forests.

Equal vectors are one vector with a number of copies, so a vector that makes up a
third of all rows costs no more than any other.

Defined results: vectors that are null, zero, or hold null or non-finite components
link with nothing, neither do vectors of different lengths.  Repeated rows are
vectors of their own.  Null ids are no smallest id.  Other columns are ignored.  An
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import groups, written
from .components import components

COSINE = 0.9
AXES = 8
BLOCK = 4096
RUN = 256
FAN = 16
SLACK = 1e-9


def usable(vector) -> F.Column:
    """Finite, without nulls and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def _unit(column: pa.Array) -> np.ndarray:
    rows = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small numbers stay in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        if batch.num_rows:
            x = _unit(batch.column("vector"))
            total = total + x.T @ x
    if not np.isscalar(total):
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["moments"])


def _moment_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for m in batch.column("moments"):
            part = np.frombuffer(m.as_py())
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["moments"])


def principal_axes(nodes: DataFrame, axes: int = AXES) -> np.ndarray:
    sums = nodes.select("vector").mapInArrow(_moment_rows, "moments binary").repartition(16).mapInArrow(_moment_sums, "moments binary").collect()
    total = sum(np.frombuffer(r.moments) for r in sums)
    width = int(round(len(total) ** 0.5))
    _, vectors = np.linalg.eigh(total.reshape(width, width))
    return vectors[:, ::-1][:, :axes]


def _cell_rows(batches: Iterator[pa.RecordBatch], axes: np.ndarray, eps: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            at = _unit(batch.column("vector")) @ axes
            columns = [pa.array(c) for c in np.floor(at / eps).astype(np.int32).T] + [pa.array(at[:, 0])]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns], [*[f"c{k}" for k in range(axes.shape[1])], "p0", *batch.schema.names])


def grid_order(nodes: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """Nodes with their rank in the epsilon grid order, from 0 without gaps."""
    cells = [f"c{k}" for k in range(axes.shape[1])]
    schema = ", ".join([*[f"{c} int" for c in cells], "p0 double", *[f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema]])
    placed = nodes.mapInArrow(lambda it: _cell_rows(it, axes, eps), schema)
    ordered = written(placed.orderBy(*cells, "p0", "node").drop(*cells, "p0").withColumn("_id", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    parts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    # a running sum over one row per partition of the sort
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ordered.join(parts, "_part").withColumn("rank", F.col("_at") + F.col("_before")).drop("_id", "_part", "_at", "_before")


def _block_rows(batches: Iterator[pa.RecordBatch], axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    for group in groups(batches, ["block"]):
        x = _unit(group.column("vector"))
        at = x @ axes
        low, high = at.min(axis=0), at.max(axis=0)
        payload = [group.column("block")[:1], pa.array([group.column("node").to_numpy().tobytes()]), pa.array([group.column("copies").to_numpy().tobytes()]), pa.array([x.tobytes()])]
        bounds = [pa.array([v]) for v in (*low, *high)]
        names = ["block", "nodes", "copies", "vectors", *[f"lo{k}" for k in range(len(low))], *[f"hi{k}" for k in range(len(low))]]
        yield pa.RecordBatch.from_arrays([*payload, *bounds], names)


def block_pairs(blocks: DataFrame, n_blocks: int, axes: int, eps: float) -> DataFrame:
    """(a, b) with a <= b of all blocks whose boxes are within eps, found by opening pairs of intervals."""
    levels = 0
    while FAN**levels < n_blocks:
        levels += 1
    edges = [F.min(f"lo{k}").alias(f"lo{k}") for k in range(axes)] + [F.max(f"hi{k}").alias(f"hi{k}") for k in range(axes)]
    root = blocks.groupBy((F.col("block") * 0).alias("a")).agg(F.count("*").alias("_n"))
    pairs = root.select("a", F.col("a").alias("b"))
    for level in range(levels - 1, -1, -1):
        step = FAN**level
        parts = written(blocks.groupBy(F.floor(F.col("block") / step).cast("long").alias("part")).agg(*edges).withColumn("above", F.floor(F.col("part") / FAN).cast("long")))
        a, b = (parts.select([F.col(c).alias(f"{side}_{c}") for c in parts.columns]) for side in "ab")
        gap = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}")), 2) for k in range(axes))
        near = pairs.join(a, pairs.a == F.col("a_above")).join(b, pairs.b == F.col("b_above")).filter((F.col("a_part") <= F.col("b_part")) & (gap <= eps * eps + SLACK))
        pairs = written(near.select(F.col("a_part").alias("a"), F.col("b_part").alias("b")))
    return pairs


def _near(x: np.ndarray, y: np.ndarray, axes: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x and y are links, comparing only runs whose boxes are near enough."""
    eps = (2 - 2 * cosine) ** 0.5
    linked = np.zeros((len(x), len(y)), bool)
    p, q = x @ axes, y @ axes
    ends = [(a, min(a + RUN, len(y))) for a in range(0, len(y), RUN)]
    low, high = np.array([q[a:b].min(axis=0) for a, b in ends]), np.array([q[a:b].max(axis=0) for a, b in ends])
    for a in range(0, len(x), RUN):
        part = p[a : a + RUN]
        gap = np.maximum(0, np.maximum(low - part.max(axis=0), part.min(axis=0) - high))
        for k in np.flatnonzero((gap * gap).sum(axis=1) <= eps * eps + SLACK):
            c, d = ends[k]
            linked[a : a + RUN, c:d] = x[a : a + RUN] @ y[c:d].T >= cosine
    return linked


def _pair_links(nodes: np.ndarray, copies: np.ndarray, linked: np.ndarray) -> list[tuple[int, int, int]]:
    """Rows (node, links, peer) of a square symmetric matrix of links."""
    np.fill_diagonal(linked, False)
    links = np.concatenate([linked[a : a + 512].astype(np.float64) @ copies for a in range(0, len(nodes), 512)])
    some = np.flatnonzero(links)
    peer = np.full(len(nodes), -1)
    for k in some.tolist():
        if peer[k] < 0:
            peer[k], waiting = k, [k]
            while waiting:
                new = np.flatnonzero(linked[waiting.pop()] & (peer < 0))
                peer[new] = k
                waiting += new.tolist()
    return [(int(nodes[k]), int(links[k]), int(nodes[peer[k]])) for k in some]


def _cross_links(n1, c1, n2, c2, linked: np.ndarray) -> list[tuple[int, int, int]]:
    """The same for links between two blocks."""
    l1 = np.concatenate([linked[a : a + 512].astype(np.float64) @ c2 for a in range(0, len(n1), 512)])
    turned = np.ascontiguousarray(linked.T)
    l2 = np.concatenate([turned[a : a + 512].astype(np.float64) @ c1 for a in range(0, len(n2), 512)])
    peer1, peer2 = np.full(len(n1), -1), np.full(len(n2), -1)
    for k in np.flatnonzero(l1).tolist():
        if peer1[k] < 0:
            peer1[k], waiting = k, [(0, k)]
            while waiting:
                side, at = waiting.pop()
                row, seen = (linked[at], peer2) if side == 0 else (turned[at], peer1)
                new = np.flatnonzero(row & (seen < 0))
                seen[new] = k
                waiting += [(1 - side, x) for x in new.tolist()]
    return [
        *[(int(n1[k]), int(l1[k]), int(n1[peer1[k]])) for k in np.flatnonzero(l1)],
        *[(int(n2[k]), int(l2[k]), int(n1[peer2[k]])) for k in np.flatnonzero(l2)],
    ]


def _link_rows(batches: Iterator[pa.RecordBatch], axes: np.ndarray, cosine: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            side = [(np.frombuffer(row[f"nodes_{s}"], np.int64), np.frombuffer(row[f"copies_{s}"], np.int64), np.frombuffer(row[f"vectors_{s}"]).reshape(-1, len(axes))) for s in "ab"]
            (n1, c1, x), (n2, c2, y) = side
            linked = _near(x, y, axes, cosine)
            rows = _pair_links(n1, c1, linked) if row["a"] == row["b"] else _cross_links(n1, c1, n2, c2, linked)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["node", "links", "peer"])


def vector_links(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(node, links, peer) per task for nodes (node, copies, vector) of one dimension."""
    eps = (2 - 2 * cosine) ** 0.5
    axes = principal_axes(nodes)
    ranked = grid_order(nodes, axes, eps).withColumn("block", F.floor(F.col("rank") / BLOCK).cast("long"))
    dealt = ranked.select("block", "node", "copies", "vector", "rank").repartition("block").sortWithinPartitions("block", "rank")
    bounds = ", ".join(f"{s}{k} double" for s in ("lo", "hi") for k in range(axes.shape[1]))
    blocks = written(dealt.mapInArrow(lambda it: _block_rows(it, axes), f"block long, nodes binary, copies binary, vectors binary, {bounds}"))
    pairs = block_pairs(blocks.drop("nodes", "copies", "vectors"), blocks.count(), axes.shape[1], eps)
    side = lambda s: blocks.select(F.col("block").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("nodes", "copies", "vectors")])
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.mapInArrow(lambda it: _link_rows(it, axes, cosine), "node long, links long, peer long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row (columns vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    rows = rows.withColumn("_fine", usable(F.col("vector")))
    fine = rows.filter("_fine")
    nodes = fine.groupBy("vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("width", F.size("vector")))
    found = None
    for r in nodes.select("width").distinct().collect():  # lengths of vectors
        part = vector_links(nodes.filter(F.col("width") == r.width).select("node", "copies", "vector"), cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        classed = nodes.select("vector", F.lit(0).cast("long").alias("n_links"), "first_id")
    else:
        found = written(found)
        labels = components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
        counts = found.groupBy("node").agg(F.sum("links").alias("links"))
        classed = nodes.join(labels, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = classed.groupBy("component").agg(F.min("first_id").alias("least"))
        n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
        classed = classed.join(least, "component").select("vector", n_links.alias("n_links"), F.col("least").alias("first_id"))
    linked = fine.select("vec_id", "vector").join(classed, "vector").select("vec_id", "n_links", F.col("first_id").alias("component_id"))
    alone = rows.filter(~F.col("_fine") | F.col("_fine").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
