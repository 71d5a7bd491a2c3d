"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of shingles of five consecutive words; two texts are linked when
the Jaccard similarity of their sets reaches the threshold (0.8).

1. One pass makes a MinHash signature of every whole text.  Equal texts become one
   node with a number of copies, so copies are never compared.
2. Nodes that agree in one of 24 bands of four values are candidates: a pair at
   the threshold is missed with probability (1 - 0.8^4)^24 = 3e-6.
3. Inside a bucket, MinHash values are compared in steps of 16.  With a uniform
   prior on the similarity, the posterior probability of reaching the threshold
   after m of n agreements is P(Binomial(n + 1, t) <= m); a pair is dropped once it
   falls below ``TOLERANCE`` (1e-6).  Survivors are followed from node to node, so a
   bucket of near copies costs one comparison per node and gives a spanning forest.
4. Survivors are joined to groups, and inside each group all pairs are compared
   exactly by their shingle sets.  Every link is counted; what is given out is one
   row per node: the number of linked documents and a spanning forest.

Buckets and groups that exceed a block are cut into blocks by hash, and every pair
of blocks is a task of its own, so memory is bounded and no pair is lost.

Defined results: a text of one to four words is a single shingle; null texts and
texts without words have none and are linked with nothing.  Repeated rows are
copies.  Null ids take part like others.  Other columns are ignored.  An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import Words, groups, mix, text_slices, written
from .components import components

SHINGLE = 5
THRESHOLD = (4, 5)
HASHES, ROWS = 96, 4
STEP = 16
TOLERANCE = 1e-6
BUCKET_BLOCK = 2048
SHINGLE_BLOCK = 400_000

_rng = np.random.default_rng(20240607)
_SEEDS = _rng.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
_FACTORS = _rng.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32) | np.uint32(1)


def least_agreements(threshold: float, hashes: int = HASHES, step: int = STEP, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared values, the fewest agreements at which a pair may still be a link."""
    least = {}
    for n in range(step, hashes + 1, step):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        least[n] = m
    return least


LEAST = least_agreements(THRESHOLD[0] / THRESHOLD[1])


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the offset at which each text's shingles begin."""
    counts = np.diff(words.first)
    per = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(counts.dtype))
    first = np.concatenate([[0], np.cumsum(per)])
    total = np.zeros(first[-1], np.uint64)
    at = np.repeat(words.first[:-1] - first[:-1], per) + np.arange(first[-1])
    length = np.minimum(np.repeat(counts, per), SHINGLE)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for k in range(SHINGLE):
        total *= factor
        inside = length > k
        total[inside] += words.hash[at[inside] + k]
    return mix(total), first


def signatures(shingle: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values, one row of ``HASHES`` per text that has shingles."""
    starts = first[:-1][np.diff(first) > 0]
    x = (shingle >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), HASHES), np.uint32)
    if len(starts):
        for j in range(HASHES):
            y = (x ^ _SEEDS[j]) * _FACTORS[j]
            y ^= y >> np.uint32(16)
            y *= np.uint32(0x7FEB352D)
            out[:, j] = np.minimum.reduceat(y, starts)
    return out


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, limit=2 << 20):
        shingle, first = shingles(Words(part.column("text")))
        size = np.diff(first)
        some = iter(signatures(shingle, first))
        values = [next(some).tobytes() if n else None for n in size.tolist()]
        columns = [part.column("doc_id"), part.column("text_key"), pa.array(size), pa.array(values, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "signature"])


def with_text_key(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"), text.alias("text"))


def bands(signature: np.ndarray) -> np.ndarray:
    """64-bit bucket keys, a row of HASHES / ROWS per signature."""
    values = signature.reshape(len(signature), HASHES // ROWS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(HASHES // ROWS, dtype=np.uint64), values.shape[:2])
    for r in range(ROWS):
        key = mix(key ^ (values[:, :, r] << np.uint64(8)))
    return key.view(np.int64)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = bands(_matrix(batch.column("signature")))
        nodes = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], ["bucket", "node"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def pruned(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Indices of signatures in ``many`` that may be links of ``one`` (a signature, or one for each)."""
    alive, agree = np.arange(len(many)), np.zeros(len(many), np.int64)
    for n, least in LEAST.items():
        mine = one[n - STEP : n] if one.ndim == 1 else one[alive, n - STEP : n]
        agree = agree + (many[alive, n - STEP : n] == mine).sum(axis=1)
        keep = agree >= least
        alive, agree = alive[keep], agree[keep]
        if not len(alive):
            break
    return alive


def forest(signature: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs that survive pruning."""
    edges, rest = [], np.arange(len(signature))
    while len(rest) > 1:
        waiting, rest = [rest[0]], rest[1:]
        while waiting and len(rest):
            node = waiting.pop()
            found = pruned(signature[node], signature[rest])
            if len(found):
                edges += [(node, k) for k in rest[found]]
                waiting += rest[found].tolist()
                rest = np.delete(rest, found)
    return edges


def _survivor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, pairs = [], [], []

    def flush():
        if pairs:
            left, right = _matrix(pa.array([p[1] for p in pairs])), _matrix(pa.array([p[3] for p in pairs]))
            for k in pruned(left, right):
                a.append(pairs[k][0])
                b.append(pairs[k][2])
            pairs.clear()
        out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        a.clear()
        b.clear()
        return out

    for group in groups(batches, ["bucket", "i", "j"]):
        if group.num_rows == 2:
            (n1, n2), (s1, s2) = group.column("node").to_pylist(), group.column("signature").to_pylist()
            pairs.append((n1, s1, n2, s2))
        elif group.num_rows > 2:
            nodes = group.column("node").to_numpy()
            for x, y in forest(_matrix(group.column("signature"))):
                a.append(nodes[x])
                b.append(nodes[y])
        if len(pairs) + len(a) > 20_000:
            yield flush()
    yield flush()


def in_blocks(rows: DataFrame, n_blocks, key: str) -> DataFrame:
    """Rows given to every pair (i, j) of blocks of their group that holds their own block."""
    rows = rows.withColumn("_blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("_blocks").cast("int") - 1), lambda k: (k != F.col("block")) | (F.col("_blocks") == 1))
    rows = rows.withColumn("_other", F.explode(others))
    rows = rows.withColumn("i", F.least("block", "_other")).withColumn("j", F.greatest("block", "_other"))
    return rows.drop("_other").repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "node")


def survivors(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of a spanning forest of the candidate pairs that survive pruning."""
    members = nodes.filter("n_shingles > 0").select("node", "signature").mapInArrow(_band_rows, "bucket long, node long")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("node"), 16)).alias("_who")).filter("n > 1")
    # bands of the same nodes need one look
    buckets = sizes.groupBy("n", "_who").agg(F.min("bucket").alias("bucket")).drop("_who")
    chosen = members.join(buckets, "bucket").join(nodes.select("node", "signature"), "node")
    blocks = in_blocks(chosen, F.ceil(F.col("n") / BUCKET_BLOCK), "bucket")
    return blocks.select("bucket", "i", "j", "node", "signature").mapInArrow(_survivor_rows, "a long, b long")


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        shingle, first = shingles(Words(part.column("text")))
        sets = [np.unique(shingle[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])]
        size = [len(s) // 8 for s in sets]
        rest = [part.column(c) for c in ("group_id", "node", "copies")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(size, pa.int64()), pa.array(sets, pa.binary())], ["group_id", "node", "copies", "n_set", "set"])


def common_counts(sets: list[np.ndarray], cells: int = 1 << 24) -> np.ndarray:
    """Sizes of the pairwise intersections."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[which] > 1
    column = (np.cumsum(count > 1) - 1)[which[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((m, m), np.float64)
    width = max(1, cells // m)
    for low in range(0, int((count > 1).sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        block = np.zeros((m, min(width, int(column[b - 1]) - low + 1) if b > a else 1), np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        out += block @ block.T
    return np.rint(out).astype(np.int64)


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, int, int]] = []

    def batch():
        columns = list(zip(*rows)) if rows else [()] * 3
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "links", "peer"])

    for group in groups(batches, ["group_id", "i", "j"]):
        rows += _links(group)
        if len(rows) > 20_000:
            yield batch()
    yield batch()


def _links(group: pa.RecordBatch) -> list[tuple[int, int, int]]:
    nodes, first = np.unique(group.column("node").to_numpy(), return_index=True)  # repeated rows count once
    block, copies = (group.column(c).to_numpy()[first] for c in ("block", "copies"))
    values = group.column("set")
    sets = [np.frombuffer(values[int(k)].as_py(), np.uint64) for k in first]
    size = np.array([len(s) for s in sets], np.int64)
    i, j, blocks = (group.column(c)[0].as_py() for c in ("i", "j", "_blocks"))
    common = common_counts(sets)
    up, down = THRESHOLD
    linked = down * common >= up * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(linked, False)
    # pairs inside a block meet in several tasks and are counted in one of them
    own = {i} if j == i + 1 else set()
    if i == j or (j == blocks - 1 and i == j - 1):
        own.add(j)
    skip = np.isin(block, list(own), invert=True)
    linked[(block[:, None] == block[None, :]) & skip[:, None]] = False
    links = linked @ copies
    peer, out = np.full(len(nodes), -1), []
    for k in range(len(nodes)):
        if peer[k] < 0:
            peer[k], waiting = k, [k]
            while waiting:
                new = np.flatnonzero(linked[waiting.pop()] & (peer < 0))
                peer[new] = k
                waiting += new.tolist()
        if links[k]:
            out.append((int(nodes[k]), int(links[k]), int(nodes[peer[k]])))
    return out


def jaccard_join(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, class_id, n_links, keeper of every row of ``documents``.

    ``class_id`` is the smallest doc_id reachable by links, itself included;
    ``n_links`` the number of other rows linked directly; ``keeper`` marks the text
    that stays for its class (its rows with that doc_id are equal).
    """
    keyed = with_text_key(documents)
    signed = written(keyed.mapInArrow(_signature_rows, "doc_id long, text_key binary, n_shingles long, signature binary"))
    texts = signed.groupBy("text_key").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )
    nodes = written(texts.withColumn("node", F.monotonically_increasing_id()))
    candidates = components(survivors(nodes)).select("node", F.col("component").alias("group_id"))
    wanted = nodes.drop("signature", "n_shingles").join(candidates, "node")
    there = keyed.alias("d").join(wanted.alias("w"), (F.col("d.text_key") == F.col("w.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("w.first_id")))
    sets = there.select("w.group_id", "w.node", "w.copies", "d.text").mapInArrow(_set_rows, "group_id long, node long, copies long, n_set long, set binary")
    sets = written(sets)
    weight = sets.groupBy("group_id").agg(F.ceil(F.sum("n_set") / SHINGLE_BLOCK).alias("_n"))
    blocks = in_blocks(sets.join(weight, "group_id"), F.col("_n"), "group_id")
    found = written(blocks.select("group_id", "i", "j", "_blocks", "block", "node", "copies", "set").mapInArrow(_link_rows, "node long, links long, peer long"))
    labels = components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    classed = nodes.select("text_key", "node", "first_id", "copies", "n_shingles").join(labels, "node", "left").join(counts, "node", "left")
    classed = classed.withColumn("component", F.coalesce("component", "node"))
    smallest = F.struct(F.col("first_id").isNull(), "first_id", "node")
    heads = classed.groupBy("component").agg(F.min(smallest).alias("head"))
    classed = classed.join(heads, "component").select(
        "text_key",
        F.col("head.first_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.when(F.col("n_shingles") > 0, F.col("copies") - 1).otherwise(0)).alias("n_links"),
        (F.col("head.node") == F.col("node")).alias("_head"),
        "first_id",
        "n_shingles",
    )
    rows = signed.select("doc_id", "text_key").join(classed, "text_key")
    alone = F.col("n_shingles") == 0  # without words: linked with nothing, so every row is its own class
    keeper = alone | (F.col("_head") & F.col("doc_id").eqNullSafe(F.col("first_id")))
    return rows.select("doc_id", "text_key", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "n_links", keeper.alias("keeper"), "n_shingles")


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each class, with its own columns; texts without words all stay."""
    key = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    marked = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), key.alias("_key"))
    stay = jaccard_join(documents).filter("keeper").groupBy("doc_id", "text_key").agg(F.min("n_shingles").alias("_words")).withColumnRenamed("doc_id", "_kept")
    out = marked.join(stay, (F.col("_key") == F.col("text_key")) & F.col("_id").eqNullSafe(F.col("_kept")))
    once = out.filter("_words > 0").dropDuplicates(["_key", "_id"])
    return once.unionByName(out.filter("_words = 0")).select("_doc.*")
