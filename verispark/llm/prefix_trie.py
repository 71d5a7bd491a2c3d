"""Prefix trie of conversations, built by van Emde Boas recursion.

A conversation is a sequence of items (role and text, as a 128-bit digest).  Its
prefixes are named by a running digest, so that equal prefixes have one name
wherever they occur; a node of the trie is a name.

1. Sequences of up to ``2 * half`` turns are cut at ``half``: all upper parts, and
   all lower parts below each cut prefix, are tries of half the depth.  Equal parts
   under one root are merged with their counts, then all of them are cut again, the
   upper tries and the lower forests together, until parts have ``LEAF`` turns.
2. Parts of at most ``LEAF`` turns are spread into their nodes; totals of a node
   over its subtree inside its part are sums over at most ``LEAF`` ancestors.
3. Totals are grafted upward, from the lowest cuts to the topmost: what the trees
   below a cut prefix add up to is added to the nodes on its path in the upper part.

A node thus adds to O(LEAF + log depth) sums instead of one per ancestor, and
there is one round per halving.  Only digests move; texts are read once.

The items of a conversation are named in one sorted stream of bounded memory,
which gives out parts of at most ``PART`` turns; conversations beyond that have
their parts grafted one after the other, the last first.  Parents with many
children (the root, common first turns) are looked up in a table of bounded size.

Defined results: turns are ordered by turn (null first), equal turns by their
digest; null roles and texts are empty; rows without conv_id are left out; a
conversation of no turns is a member of the root; an empty table has no nodes,
not even the root.  Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import written

ROOT = bytes(16)
#: Turns of the smallest tries; a power of two.
LEAF = 8
#: Turns of the largest parts; a power of two.
PART = 1 << 16
#: A parent with more children than this (or than a share of all nodes) is looked up in a broadcast table.
POPULAR = 10_000
POPULAR_ROWS = 100_000
#: Bytes of decimal ids that travel as one row.
IDS_BYTES = 1 << 20


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, item (128-bit digest of role and text) and bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    item = F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), item.alias("item"), F.octet_length(text).cast("long").alias("bytes"))
    return out.filter("conv_id is not null")


# --- shared beginnings ---------------------------------------------------------------------

SHARE_EVERY = 5
SHARE_TURNS = 9


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first of its group of ids."""
    return F.crc32(conv_id.cast("string").cast("binary")) % F.lit(SHARE_TURNS)


def rebuilt(own: DataFrame) -> DataFrame:
    """Turns with ``head``: 0 taken over from conversation ``c - c % 5``, 1 the own ones, ``skip`` of which are to go."""
    base = own.filter(F.col("conv_id") % SHARE_EVERY == 0)
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "item"))
    first = base.withColumn("_place", place).filter(F.col("_place") < SHARE_TURNS)  # at most SHARE_TURNS - 1 are taken over
    steps = F.array(*[F.lit(k).cast("long") for k in range(1 - SHARE_EVERY, SHARE_EVERY)])
    ids = F.transform(steps, lambda k: F.try_add(F.col("conv_id"), k))
    ids = F.filter(ids, lambda c: c.isNotNull() & (c - c % SHARE_EVERY == F.col("conv_id")) & (F.col("_place") <= shared_turns(c)))
    taken = first.select(F.explode(ids).alias("conv_id"), F.lit(0).alias("head"), F.col("_place").cast("long").alias("turn"), "item", "bytes", F.lit(0).cast("long").alias("skip"))
    return taken.unionByName(own.select("conv_id", F.lit(1).alias("head"), "turn", "item", "bytes", shared_turns(F.col("conv_id")).cast("long").alias("skip")))


# --- named parts of conversations ----------------------------------------------------------

PARTS = "conv_id long, at long, root binary, names array<binary>, bytes array<long>, last boolean"


def _part_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns -> parts of at most ``most`` turns, every prefix named by its running digest."""
    rows: list[tuple] = []
    size, conv, own, place, skip = 0, None, False, 0, 0
    at, root, names, lengths, last = 0, ROOT, [], [], ROOT

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.bool_())
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in PARTS.split(", ")])

    for part in batches:
        columns = [part.column(c).to_pylist() for c in ("conv_id", "head", "item", "bytes", "skip")]
        for conv_id, head, item, n_bytes, skipped in zip(*columns):
            if conv_id != conv:
                if own:
                    rows.append((conv, at, root, names, lengths, True))
                conv, own, place = conv_id, False, 0
                at, root, names, lengths, last = 0, ROOT, [], [], ROOT
            if head:
                own, place, skip = True, place + 1, skipped
                if place <= skip:
                    continue
            if len(names) == most:
                rows.append((conv, at, root, names, lengths, False))
                at, root, names, lengths = at + most, last, [], []
            last = hashlib.blake2b(last + item, digest_size=16).digest()
            names.append(last)
            lengths.append(n_bytes)
            size += 1
            if size >= 100_000:
                yield batch()
                size = 0
    if own:
        rows.append((conv, at, root, names, lengths, True))
    yield batch()


def named_parts(sequences: DataFrame) -> DataFrame:
    """Parts of each conversation; one with shared turns only (no own rows) does not exist and gives none."""
    dealt = sequences.repartition("conv_id").sortWithinPartitions("conv_id", "head", "turn", "item")
    most = PART
    return dealt.mapInArrow(lambda it: _part_rows(it, most), PARTS)


# --- 1: cuts -------------------------------------------------------------------------------

_PIECE = ["at", "root", "names", "bytes"]


def merged(pieces: DataFrame, *more: Column) -> DataFrame:
    """Equal parts under one root become one, with their members; the names tell all else."""
    out = pieces.groupBy(*_PIECE).agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), *more)
    return out.withColumn("len", F.size("names"))


def cut(work: DataFrame, half: int) -> DataFrame:
    """Upper and lower parts of sequences of ``half`` to ``2 * half`` turns; ``cut`` marks uppers with a tree below."""
    longer = F.col("len") > half
    upper = F.struct("at", "root", F.slice("names", 1, half).alias("names"), F.slice("bytes", 1, half).alias("bytes"), longer.alias("cut"))
    rest = [F.slice(c, half + 1, F.greatest(F.col("len") - half, F.lit(0))).alias(c) for c in ("names", "bytes")]
    lower = F.struct((F.col("at") + half).alias("at"), F.get("names", F.lit(half - 1)).alias("root"), *rest, F.lit(False).alias("cut"))
    both = work.select(F.explode(F.when(longer, F.array(upper, lower)).otherwise(F.array(upper))).alias("piece"), "n", "conv_id")
    return both.select("piece.*", "n", "conv_id")


def cuts(parts: DataFrame, deepest: int) -> tuple[DataFrame, dict[int, DataFrame]]:
    """Parts of at most LEAF turns, and for each cut depth the upper parts with a tree below.

    ``parts`` has distinct parts of at most ``deepest`` turns.
    """
    half, carried, uppers = LEAF, None, {}
    while 2 * half < deepest:
        half *= 2
    while half >= LEAF and deepest > LEAF:
        top = carried is None
        work = parts.filter((F.col("len") >= half) & (F.lit(top) | (F.col("len") < 2 * half)))
        short = None
        if not top:
            work = work.unionByName(carried.filter(F.col("len") >= half))
            short = carried.filter(F.col("len") < half)
        pieces = cut(work.select(*_PIECE, "n", "conv_id", "len"), half)
        if short is not None:
            pieces = pieces.unionByName(short.select(*_PIECE, F.lit(False).alias("cut"), "n", "conv_id"))
        carried = written(merged(pieces, F.bool_or("cut").alias("cut")).withColumn("half", F.lit(half)))
        uppers[half] = carried.filter(F.col("cut") & (F.col("len") == half))
        carried = carried.drop("cut", "half")
        half //= 2
    small = parts.filter(F.col("len") < LEAF) if carried is not None else parts
    return (small if carried is None else small.unionByName(carried)), uppers


# --- 2, 3: nodes and totals ----------------------------------------------------------------


def chain(names: Column, at: Column, root: Column) -> Column:
    """(name, parent, depth) of every node on a path; the trie's root belongs to paths that begin at it."""
    nodes = F.transform(names, lambda x, i: F.struct(x.alias("name"), F.when(i == 0, root).otherwise(F.get(names, i - 1)).alias("parent"), (at + i + 1).cast("long").alias("depth")))
    top = F.struct(F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"))
    return F.when(at == 0, F.concat(F.array(top), nodes)).otherwise(nodes)


def nodes_of(small: DataFrame) -> DataFrame:
    """name, parent, depth, bytes, path (the nodes from its part's top down to it), n and conv_id of every node."""
    path = chain(F.col("names"), F.col("at"), F.col("root"))
    laid = small.select(path.alias("path"), F.concat(F.when(F.col("at") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>")), F.col("bytes")).alias("bytes"), "n", "conv_id")
    each = laid.select(F.posexplode("bytes").alias("k", "b"), "path", "n", "conv_id")
    each = each.select(F.col("b").alias("bytes"), F.slice("path", F.lit(1), F.col("k") + 1).alias("path"), "n", "conv_id")
    out = each.groupBy("path", "bytes").agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"))
    own = F.element_at("path", -1)
    return out.select(own.getField("name").alias("name"), own.getField("parent").alias("parent"), own.getField("depth").alias("depth"), "bytes", "path", "n", "conv_id")


_TOTALS = ["tokens", "leaves"]


def added(paths: DataFrame) -> DataFrame:
    """Sums of ``tokens`` and ``leaves`` for every node of ``path``."""
    out = paths.select(F.explode("path").alias("node"), *_TOTALS).groupBy("node").agg(*[F.sum(c).alias(c) for c in _TOTALS])
    return out.select("node.*", *_TOTALS)


def grafted(known: list[DataFrame], uppers: DataFrame, below: Column) -> DataFrame:
    """What the trees whose first nodes satisfy ``below`` add to the paths down to their cut prefixes."""
    rows = reduce(DataFrame.unionByName, [k.filter(below).select("parent", *_TOTALS) for k in known])
    trees = rows.groupBy("parent").agg(*[F.sum(c).alias(c) for c in _TOTALS])
    paths = uppers.select(F.element_at("names", -1).alias("parent"), chain(F.col("names"), F.col("at"), F.col("root")).alias("path"))
    return added(paths.join(trees, "parent"))


def with_children(nodes: DataFrame) -> DataFrame:
    counts = nodes.filter("depth > 0").groupBy(F.col("parent").alias("_parent")).agg(F.count("*").alias("n_children"))
    return nodes.join(counts, nodes.name == F.col("_parent"), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).drop("_parent")


def with_parents(nodes: DataFrame) -> DataFrame:
    """``parent_conv_id``; parents of many children are few and broadcast, the others are joined by their name."""
    most = max(POPULAR, nodes.count() // POPULAR_ROWS)
    keys = [F.col("name").alias("_parent"), F.col("conv_id").alias("parent_conv_id")]
    popular = nodes.filter(F.col("n_children") > most).select(*keys)  # at most nodes / most <= POPULAR_ROWS rows
    found = nodes.join(F.broadcast(popular), nodes.parent == F.col("_parent"), "left")
    rest = nodes.filter((F.col("n_children") > 0) & (F.col("n_children") <= most)).select(*keys)
    plain = found.filter("_parent is null").drop("_parent", "parent_conv_id")
    return found.filter("_parent is not null").unionByName(plain.join(rest, plain.parent == F.col("_parent"), "left")).drop("_parent")


# --- members that end at a node ------------------------------------------------------------


def _id_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, conv_id) -> runs of decimal ids of one node, joined by commas, as rows of bounded size."""
    name, first, ids, size, rows, held = None, 0, [], 0, [], 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 3
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.string()))], ["name", "first", "ids"])

    for part in batches:
        for n, c in zip(part.column("name").to_pylist(), part.column("conv_id").to_pylist()):
            if n != name or size >= IDS_BYTES:
                if ids:
                    rows.append((name, first, ",".join(ids)))
                name, first, ids, size, held = n, c, [], 0, held + size
                if held >= IDS_BYTES:
                    yield batch()
                    held = 0
            ids.append(str(c))
            size += 20
    if ids:
        rows.append((name, first, ",".join(ids)))
    yield batch()


def _end_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, digest, rows = None, None, []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 2
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.string()))], ["_ended", "ends_sha256"])

    for part in batches:
        for n, ids in zip(part.column("name").to_pylist(), part.column("ids").to_pylist()):
            if n == name:
                digest.update(b"," + ids.encode())
                continue
            if digest is not None:
                rows.append((name, digest.hexdigest()))
            name, digest = n, hashlib.sha256(ids.encode())
        if len(rows) >= 10_000:
            yield batch()
    if digest is not None:
        rows.append((name, digest.hexdigest()))
    yield batch()


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node, ascending.

    Ids are joined to long strings by range, so a node at which very many end is
    spread over tasks; only its few strings meet, as a stream, for the digest.
    """
    ranged = ends.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    runs = ranged.mapInArrow(_id_rows, "name binary, first long, ids string")
    return runs.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_end_rows, "_ended binary, ends_sha256 string")


# --- all of it -----------------------------------------------------------------------------


def build(sequences: DataFrame) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv_id, head, turn, item, bytes, skip)."""
    parts = written(named_parts(sequences))
    distinct = written(merged(parts.withColumn("n", F.lit(1).cast("long"))))
    size = distinct.agg(F.max("len").alias("len"), F.max("at").alias("at")).first()
    small, uppers = cuts(distinct, size.len or 0)
    nodes = written(with_children(nodes_of(small)))
    tokens = ((F.col("n") - 1) * F.col("bytes")).alias("tokens")
    known = [written(added(nodes.select("path", tokens, (F.col("n_children") == 0).cast("long").alias("leaves"))))]
    for half in sorted(uppers):
        known.append(written(grafted(known, uppers[half], F.expr(f"depth > {half} and (depth - 1) % {2 * half} = {half}"))))
    for at in range(size.at or 0, 0, -PART):  # parts of very long conversations, the last first
        above = distinct.filter((F.col("at") == at - PART) & (F.col("len") == PART))
        known.append(written(grafted(known, above, F.expr(f"depth = {at + 1}"))))
    totals = reduce(DataFrame.unionByName, known).groupBy(F.col("name").alias("_node")).agg(F.sum("tokens").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    last = F.coalesce(F.element_at(F.when(F.size("names") > 0, F.col("names")), -1), F.lit(ROOT))
    ends = end_digests(parts.filter("last").select(last.alias("name"), "conv_id"))
    out = with_parents(nodes.drop("path", "bytes"))
    out = out.join(totals, out.name == F.col("_node")).join(ends, out.name == F.col("_ended"), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "name", "parent", "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, share: bool = False) -> DataFrame:
    """Nodes of the trie of ``conversations`` (conv_id, turn, role, text); ``share`` rebuilds them with shared beginnings first."""
    own = turns(conversations)
    plain = own.select("conv_id", F.lit(1).alias("head"), "turn", "item", "bytes", F.lit(0).cast("long").alias("skip"))
    return build(rebuilt(own) if share else plain)
