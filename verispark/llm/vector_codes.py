"""Vector code compression by per-dimension value dictionaries.

Components become integers ``floor(scale * x)``; a vector is cut into equal
consecutive parts and each part is replaced by the index of the nearest entry of
that part's codebook (squared Euclidean distance, ties to the lower index).

1. Vectors are packed once into blocks of at most ``BLOCK_CELLS`` components: for
   each dimension the sorted distinct integers of the block (its dictionary) and
   one 16-bit dictionary code per vector.  Packing needs no shuffle; the blocks are
   written to the shared folder.
2. A codebook starts as the parts of the vectors with the smallest ids.
3. In each round, every dimension of a block tabulates the squared differences of
   all its distinct integers to all entries; the distance of a part to every entry is
   then a sum of gathered table rows, one per dimension.  Tasks return sums and
   counts by entry, which are added up in two rounds; only these (model-sized)
   numbers reach the driver, which moves each used entry to the floor of its mean.
4. A last pass assigns all parts to the final entries.

Defined results: vectors that are null or hold a null or non-finite component are
left out.  Vectors of one length form a code space of their own, so a task and the
driver hold one codebook per distinct length.  A length that the number of parts
does not divide is filled up with zeros, which add nothing to distances; the vector
of length 0 has distance 0 to its entries.  Integers saturate at +-2^24, so that the
distances of vectors of up to 2^13 components fit in a long.  Fewer vectors than
entries give fewer entries; null ids come last, equal ids are ordered by their
integers.  Repeated rows are coded one by one.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import array_sums, task_part, written

LIMIT = 1 << 24
BLOCK_ROWS = 4096
BLOCK_CELLS = 1 << 20
CHUNK_ROWS = 512


@dataclass(frozen=True)
class Settings:
    n_parts: int = 4
    n_entries: int = 256
    rounds: int = 4
    scale: int = 1024

    def __post_init__(self):
        if self.n_parts < 1 or not 1 <= self.n_entries <= 256:
            raise ValueError("a part is coded in one byte: 1 to 256 entries, at least one part")

    def width(self, n_dims: int) -> int:
        return -(-n_dims // self.n_parts)


def usable(vectors: DataFrame, id_col: str, vector_col: str, keep: Sequence[str]) -> DataFrame:
    """``row`` (id and kept columns) and ``vector`` (doubles) of the vectors that can be coded."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    row = F.struct(F.col(f"`{id_col}`").cast("long").alias("id"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(row.alias("row"), vector.alias("vector")).filter(F.col("vector").isNotNull() & finite)


def _integers(batch: pa.RecordBatch, settings: Settings) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length in the batch: the length, row indices and integers (rows x filled-up length)."""
    vector = batch.column("vector")
    offsets = vector.offsets.to_numpy().astype(np.int64)
    values = vector.values.to_numpy(zero_copy_only=False)
    length = np.diff(offsets)
    for n_dims in np.unique(length).tolist():
        rows = np.flatnonzero(length == n_dims)
        full = settings.n_parts * settings.width(n_dims)
        step = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(full, 1)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            out = np.zeros((len(some), full), np.int32)
            cells = values[offsets[some][:, None] + np.arange(n_dims)]
            out[:, :n_dims] = np.clip(np.floor(cells * settings.scale), -LIMIT, LIMIT)
            yield n_dims, some, out


# --- 1: blocks -----------------------------------------------------------------------------


def block_schema(row: T.StructType) -> T.StructType:
    names = [("n_dims", T.LongType()), ("rows", T.ArrayType(row)), ("n_values", T.ArrayType(T.LongType())), ("values", T.BinaryType()), ("codes", T.BinaryType())]
    return T.StructType([T.StructField(n, t) for n, t in names])


def _block_rows(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n_dims, some, cells in _integers(batch, settings):
            found = [np.unique(column, return_inverse=True) for column in cells.T]
            rows = batch.column("row").take(pa.array(some))
            values = b"".join(v.astype(np.int32).tobytes() for v, _ in found)
            codes = b"".join(c.astype(np.uint16).tobytes() for _, c in found)
            columns = [
                pa.array([n_dims], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), rows),
                pa.array([[len(v) for v, _ in found]], pa.list_(pa.int64())),
                pa.array([values], pa.binary()),
                pa.array([codes], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["n_dims", "rows", "n_values", "values", "codes"])


class Block:
    """Dictionaries (one array of distinct integers per dimension) and codes (dimensions x rows)."""

    def __init__(self, n_values: list[int], values: bytes, codes: bytes, n_rows: int):
        ends = np.cumsum(n_values, dtype=np.int64)
        self.dictionaries = np.split(np.frombuffer(values, np.int32).astype(np.int64), ends[:-1]) if n_values else []
        self.codes = np.frombuffer(codes, np.uint16).reshape(len(n_values), n_rows)
        self.n_rows = n_rows

    def assign(self, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entries (parts x rows) and squared distances summed over parts, for codebook[part, entry, position]."""
        n_parts, n_entries, width = codebook.shape
        entry, error = np.zeros((n_parts, self.n_rows), np.int64), np.zeros(self.n_rows, np.int64)
        for part in range(n_parts):
            dims = range(part * width, (part + 1) * width)
            tables = [(self.dictionaries[d][:, None] - codebook[part, :, d - part * width]) ** 2 for d in dims]
            if sum(int(t.max()) for t in tables) < 1 << 31:
                tables = [t.astype(np.int32) for t in tables]
            for at in range(0, self.n_rows, CHUNK_ROWS):
                to = min(at + CHUNK_ROWS, self.n_rows)
                total = np.zeros((to - at, n_entries), tables[0].dtype if tables else np.int64)
                gathered = np.empty_like(total)
                for d, table in zip(dims, tables):
                    np.take(table, self.codes[d, at:to], axis=0, out=gathered, mode="clip")
                    total += gathered
                entry[part, at:to] = best = total.argmin(axis=1)
                error[at:to] += total[np.arange(to - at), best]
        return entry, error

    def sums(self, entry: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
        """By part and entry: sums of the components assigned, and their count as last column."""
        n_parts, n_entries, width = shape
        out = np.zeros((n_parts, n_entries, width + 1), np.int64)
        for part in range(n_parts):
            out[part, :, width] = np.bincount(entry[part], minlength=n_entries)
            for k in range(width):
                d = part * width + k
                # a block's sums stay below 2^53, so they are exact as doubles
                out[part, :, k] = np.bincount(entry[part], self.dictionaries[d][self.codes[d]], n_entries)
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, Block]]:
    for batch in batches:
        for n_dims, rows, n_values, values, codes in zip(*(batch.column(c) for c in ("n_dims", "rows", "n_values", "values", "codes"))):
            yield n_dims.as_py(), rows.values, Block(n_values.as_py(), values.as_py(), codes.as_py(), len(rows.values))


# --- 2: the first codebooks ----------------------------------------------------------------


def _integer_rows(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[tuple[int, list[tuple]]]:
    """Of each length in a batch (is null, id, integers) of the vectors with the smallest ids, and ties."""
    for batch in batches:
        ids = batch.column("row").field("id")
        order = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        for n_dims, some, cells in _integers(batch, settings):
            if len(some) > settings.n_entries:
                last = np.partition(order[some], settings.n_entries - 1)[settings.n_entries - 1]
                few = np.flatnonzero(order[some] <= last)
                some, cells = some[few], cells[few]
            rows = zip(ids.take(pa.array(some)).to_pylist(), cells[:, :n_dims].tolist())
            yield n_dims, [(k is None, k or 0, c) for k, c in rows]


def _merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    for batch in batches:
        for k, c in zip(batch.column("id").to_pylist(), batch.column("cells").to_pylist()):
            yield len(c), [(k is None, k or 0, c)]


def _smallest(found: Iterator[tuple[int, list[tuple]]], n: int) -> dict[int, list[tuple]]:
    held: dict[int, list[tuple]] = {}
    for n_dims, rows in found:
        some = held.setdefault(n_dims, [])
        some += rows
        if len(some) > 8 * n:
            held[n_dims] = sorted(some)[:n]
    return {n_dims: sorted(rows)[:n] for n_dims, rows in held.items()}


def _batch_of(held: dict[int, list[tuple]]) -> pa.RecordBatch:
    rows = [(None if null else k, c) for kept in held.values() for null, k, c in kept]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.list_(pa.int64()))], ["id", "cells"])


def first_codebooks(vectors: DataFrame, settings: Settings, spread: int = 32) -> dict[int, np.ndarray]:
    """By length, the parts of the vectors with the smallest ids: codebook[part, entry, position].

    Every task keeps ``n_entries`` vectors of each length, ``spread`` tasks merge
    theirs, and the driver sees at most ``spread * n_entries`` of each length.
    """
    schema, n = "id long, cells array<long>", settings.n_entries
    some = vectors.mapInArrow(lambda it: iter([_batch_of(_smallest(_integer_rows(it, settings), n))]), schema)
    merged = some.repartition(spread, F.spark_partition_id()).mapInArrow(lambda it: iter([_batch_of(_smallest(_merged_rows(it), n))]), schema)
    by_length = _smallest(((len(c), [(k is None, k or 0, c)]) for k, c in merged.collect()), n)
    out = {}
    for n_dims, rows in by_length.items():
        width = settings.width(n_dims)
        cells = np.zeros((len(rows), settings.n_parts * width), np.int64)
        for at, (*_, values) in enumerate(rows):
            cells[at, :n_dims] = values
        out[n_dims] = cells.reshape(len(cells), settings.n_parts, width).transpose(1, 0, 2).copy()
    return out


# --- 3, 4: rounds and codes ----------------------------------------------------------------


def _sum_rows(batches: Iterator[pa.RecordBatch], codebooks: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for n_dims, _, block in _blocks(batches):
        entry, _ = block.assign(codebooks[n_dims])
        some = block.sums(entry, codebooks[n_dims].shape)
        total[n_dims] = total[n_dims] + some if n_dims in total else some
    if total:
        columns = [pa.array(list(total), pa.int64()), pa.array([task_part()] * len(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "part", "values"])


def refined(blocks: DataFrame, codebooks: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Codebooks whose used entries have moved to the floor of the mean of their parts."""
    given = blocks.sparkSession.sparkContext.broadcast(codebooks)
    sums = array_sums(blocks.mapInArrow(lambda it: _sum_rows(it, given.value), "key long, part long, values binary"), "i8")
    out = {}
    for n_dims, codebook in codebooks.items():
        n_parts, n_entries, width = codebook.shape
        total = sums[n_dims].reshape(n_parts, n_entries, width + 1)
        count = total[:, :, width:]
        out[n_dims] = np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), codebook)
    return out


def _code_rows(batches: Iterator[pa.RecordBatch], codebooks: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for n_dims, rows, block in _blocks(batches):
        entry, error = block.assign(codebooks[n_dims])
        codes = np.ascontiguousarray(entry.T.astype(np.uint8))
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes)])
        columns = [rows, pa.array(np.full(len(codes), n_dims)), packed.cast(pa.binary()), pa.array(error)]
        yield pa.RecordBatch.from_arrays(columns, ["row", "n_dims", "code", "error"])


@dataclass(frozen=True)
class Compressed:
    """``codes``: id and kept columns, n_dims, code (one byte per part), error; ``codebooks`` by length."""

    codes: DataFrame
    codebooks: dict[int, np.ndarray]
    settings: Settings

    def decoded(self, vector_col: str = "vector") -> DataFrame:
        """``codes`` with the vectors that the codes stand for, in the units of the input."""
        schema = T.StructType([*self.codes.schema.fields, T.StructField(vector_col, T.ArrayType(T.DoubleType()))])
        books, scale = self.codes.sparkSession.sparkContext.broadcast(self.codebooks), self.settings.scale

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for n_dims, code in zip(batch.column("n_dims").to_pylist(), batch.column("code").to_pylist()):
                    book = books.value[n_dims]
                    out.append((book[np.arange(len(code)), np.frombuffer(code, np.uint8)].ravel()[:n_dims] / scale).tolist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [f.name for f in schema])

        return self.codes.mapInArrow(rows, schema)


def compress(vectors: DataFrame, settings: Settings | None = None, id_col: str = "vec_id", vector_col: str = "embedding", keep: Sequence[str] = ()) -> Compressed:
    """Codes of all vectors by codebooks fitted to all of them; ``keep`` names columns that go along."""
    settings = settings or Settings()
    given = usable(vectors, id_col, vector_col, keep)
    row = given.schema["row"].dataType
    blocks = written(given.mapInArrow(lambda it: _block_rows(it, settings), block_schema(row)))
    codebooks = first_codebooks(given, settings)
    for _ in range(settings.rounds if codebooks else 0):
        codebooks = refined(blocks, codebooks)
    books = vectors.sparkSession.sparkContext.broadcast(codebooks)
    schema = T.StructType([T.StructField("row", row), T.StructField("n_dims", T.LongType()), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    codes = written(blocks.mapInArrow(lambda it: _code_rows(it, books.value), schema))
    named = [F.col("row.id").alias(id_col), *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)]]
    return Compressed(codes.select(*named, "n_dims", "code", "error"), codebooks, settings)


def codebook_digest(codebook: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers by part, entry and position, joined by commas."""
    import hashlib

    return hashlib.sha256(",".join(map(str, codebook.ravel().tolist())).encode()).hexdigest()


def with_label_errors(codes: DataFrame, label: str = "label") -> DataFrame:
    """``label_error``: the errors of all rows with an equal label (nulls together), null if beyond a long.

    The sums have one row per label; Spark sends them to all tasks only under its
    size threshold and splits a hot label's rows otherwise.
    """
    sums = codes.groupBy(F.col(label).alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return codes.join(sums, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
