"""Helpers for Arrow-batched functions: bounded slices, word hashes, written tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

SLICE_BYTES = 4 << 20

#: A random odd multiplier and its inverse modulo 2^64, for the polynomial word hash.
BASE = 0x9E6D62D06F6A9A9B
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def written(df: DataFrame) -> DataFrame:
    """Write a table that several jobs read to the shared checkpoint folder and read it back.

    Unlike a cached or locally checkpointed table it survives lost executors.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(string_lengths(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def string_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset at which each row begins (null: no bytes)."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a string column, as arrays over all its words.

    ``hash``: 64-bit hash; ``row``: index of the text; ``start``, ``end``: byte
    positions in ``data``; ``first``: for each row the index of its first word
    (one entry more than rows).
    """

    def __init__(self, column: pa.Array):
        self.data, self.offsets = string_buffer(column)
        data, offsets = self.data, self.offsets
        n = len(data)
        inside = (data - np.uint8(9) > np.uint8(4)) & (data != 32)  # below 9 the difference wraps around
        change = np.zeros(n + 1, bool)
        if n:
            change[0], change[1:n], change[n] = inside[0], inside[1:] != inside[:-1], inside[-1]
        edges = np.flatnonzero(change)
        self.start, self.end = edges[0::2], edges[1::2]
        cuts = np.unique(offsets[(offsets > 0) & (offsets < n)])
        cuts = cuts[inside[cuts - 1] & inside[cuts]]  # texts that meet without a blank
        if len(cuts):
            self.start, self.end = np.sort(np.append(self.start, cuts)), np.sort(np.append(self.end, cuts))
        self.hash = _hash(data, self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        low = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, low + block, side="right")))
        high = int(end[to - 1])
        up, down = _power_table(high - low + 1)
        total = np.empty(high - low + 1, np.uint64)
        total[0] = 0
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=total[1:])
        s, e = start[at:to] - low, end[at:to] - low
        out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        edges = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(columns[:, a].tolist())
            if held and key != last:
                yield _joined(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def array_sums(parts: DataFrame, kind: str, spread: int = 32) -> dict[int, np.ndarray]:
    """Element-wise sums by key of rows (key long, part long, values binary), in two rounds.

    Each task keeps one array per key, so memory does not grow with the number of
    parts; what reaches the driver is one array per key.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, values in zip(batch.column("key").to_pylist(), batch.column("values")):
                some = np.frombuffer(values.as_py(), kind)
                sums[key] = sums[key] + some if key in sums else some
        if sums:
            columns = [pa.array(list(sums), pa.int64()), pa.array([0] * len(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "part", "values"])

    schema = "key long, part long, values binary"
    first = parts.repartition(F.col("key"), F.pmod("part", F.lit(spread))).mapInArrow(add, schema)
    rows = first.repartition("key").mapInArrow(add, schema).collect()
    return {r.key: np.frombuffer(r["values"], kind) for r in rows}


def task_part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()
