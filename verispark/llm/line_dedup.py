"""Line dedup: an exact set-similarity join of the lines of all documents.

A line is the set of its words.  A line is removed when some earlier line has a
Jaccard similarity of at least 0.8 with it; earlier means a smaller (doc_id, hash
of the text, line number), null ids last.  Lines without words stay.

1. Words are counted over all documents in a table of 2^20 hash buckets; the
   ranks of the buckets, then the hashes, order words by rarity.  Any order is
   correct, a rare-first order is selective.
2. Each distinct line of a slice sends its prefix (n - ceil(0.8 n) + 1 rarest words)
   to the bucket of each word, with its size, position, first place and a 128-bit
   parity bitmap.  Lines equal to an earlier one of the slice are settled at once,
   so a line repeated a million times is not sent a million times.
3. In a bucket, lines sharing a prefix word are compared by length, position and
   bitmap; each filter only drops pairs that cannot reach 0.8.  Equal lines are
   settled there.  For each line the earliest candidates go on: up to ``WIDE``, or
   ``FIRST`` where that would be too many pairs.
   Words that occur more than ``FREQUENT`` times are left out of the buckets: their
   postings are dealt by line size and set into blocks of about ``BLOCK``, and every
   pair of blocks whose sizes can match is a task of its own.
4. Candidates are verified by the Jaccard similarity of their whole word sets: first
   the earliest of each line, then all others of the lines that it does not settle.
   Lines whose earliest candidates all fail and that had more are looked up again
   with all of their candidates, so the limit loses nothing.

The number of buckets follows the number of words, so a bucket stays small.

Defined results: null texts stay null; repeated rows (same id and text) are one
document and lose the same lines; an empty table gives an empty table; other
columns pass through, except that ``n_chars`` follows the shortened text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import Words, array_sums, groups, mix, task_part, text_slices, written

COUNT_BITS = 20
CHUNKS = 16
#: Candidates listed per line where lists of up to ``WIDE`` would be longer than ``PAIRS`` times the postings compared.
#: Lines that their list leaves open, while there are more candidates, cost a second look at all texts.
FIRST = 8
WIDE = 256
PAIRS = 4
POSTINGS_PER_BUCKET = 100_000
BUCKETS_PER_TASK = 2
#: Occurrences from which a word's postings meet in pairs of blocks instead of in a bucket.
FREQUENT = 200_000
BLOCK = 1 << 14
#: Pairs compared at once, small enough for a core's cache; four times as many are held before they are cut to the earliest.
CHUNK = 1 << 18
#: Bytes of text whose lines are taken apart at once; their postings are held until there are enough to pack by bucket.
SLICE = 1 << 20
POSTINGS_AT_ONCE = 1 << 17
NO_ID = (1 << 63) - 1
#: Size of the bitmaps that say which lines or words a pass has to send; full ones only send more.
LINE_BITS = 1 << 23

RECORD = np.dtype([("word", "u4"), ("size", "u4"), ("at", "u4"), ("line", "u4"), ("set", "u8"), ("bitmap", "u8"), ("bitmap2", "u8"), ("doc", "i8"), ("text", "i8")])


def keyed_columns() -> list:
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")
    return [doc, F.xxhash64(F.col("text").cast("string")).alias("text_hash")]


def keyed(documents: DataFrame) -> DataFrame:
    """doc (id, or the largest number), text_hash and text."""
    return documents.select(*keyed_columns(), F.col("text").cast("string").alias("text"))


# --- 1: rarity -----------------------------------------------------------------------------


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << COUNT_BITS, np.int64)
    for part in text_slices(batches, limit=SLICE):
        total += np.bincount((Words(part.column("text")).hash >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS)
    if total.any():
        values = [c.tobytes() for c in np.split(total, CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int64()), pa.array([task_part()] * CHUNKS, pa.int64()), pa.array(values)], ["key", "part", "values"])


def word_counts(documents: DataFrame) -> np.ndarray:
    """Occurrences of words in each of the hash buckets, over all documents."""
    sums = array_sums(documents.select("text").mapInArrow(_count_rows, "key long, part long, values binary"), "i8")
    return np.concatenate([sums[k] for k in range(CHUNKS)]) if sums else np.zeros(1 << COUNT_BITS, np.int64)


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    ranks = np.empty(len(counts), np.uint32)
    ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint32)
    return ranks


# --- lines of a slice ----------------------------------------------------------------------


class Lines:
    """Word sets of the lines of some texts: ``hash`` sorted by rarity inside each line.

    ``first``: offsets of the lines' words; ``row``, ``number``: where a line stands;
    only lines with words are present.
    """

    def __init__(self, column: pa.Array, ranks: np.ndarray | None = None, select: Callable | None = None):
        """``select(row, number, hashes, starts)`` says which lines are needed, before anything is sorted."""
        words = Words(column)
        breaks = np.flatnonzero(words.data == 10)
        line = np.searchsorted(breaks, words.start) + words.row
        hashes = words.hash
        row_lines = np.searchsorted(breaks, words.offsets[:-1]) + np.arange(len(words.offsets) - 1)
        if select is not None and len(line):
            starts = np.flatnonzero(np.diff(line, prepend=-1))
            row = words.row[starts]
            keep = select(row, line[starts] - row_lines[row], hashes, starts)
            keep = np.repeat(keep, np.diff(np.append(starts, len(line))))
            line, hashes = line[keep], hashes[keep]
        order = np.lexsort((hashes, line)) if ranks is None else self._by_rarity(line, hashes, ranks)
        line, hashes = line[order], hashes[order]
        new_line = np.ones(len(line), bool)
        new_line[1:] = line[1:] != line[:-1]
        fresh = new_line.copy()
        fresh[1:] |= hashes[1:] != hashes[:-1]
        self.hash = hashes[fresh]
        starts = np.flatnonzero(new_line[fresh])
        self.first = np.append(starts, len(self.hash))
        self.size = np.diff(self.first)
        ids = line[fresh][starts]
        self.row = np.searchsorted(row_lines, ids, side="right") - 1
        self.number = ids - row_lines[self.row]

    @staticmethod
    def _by_rarity(line: np.ndarray, hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        rank = ranks[(hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)].astype(np.uint64)
        low = hashes & np.uint64((1 << COUNT_BITS) - 1)
        if len(line) and line[-1] < 1 << (64 - 2 * COUNT_BITS):
            key = (line.astype(np.uint64) << np.uint64(2 * COUNT_BITS)) | (rank << np.uint64(COUNT_BITS)) | low
            order = np.argsort(key)
            key = key[order]
            same = np.flatnonzero(key[1:] == key[:-1])
            if (hashes[order[same + 1]] == hashes[order[same]]).all():
                return order
        return np.lexsort((hashes, low, rank, line))


def prefix_length(size: np.ndarray) -> np.ndarray:
    return size - -(-4 * size // 5) + 1


def size_classes(size: np.ndarray) -> np.ndarray:
    """Classes of line sizes such that sizes of a ratio up to 5 / 4 are in one or in neighbouring classes."""
    edges = [1]
    while edges[-1] <= int(size.max(initial=1)):
        edges.append(edges[-1] * 5 // 4 + 1)
    return np.searchsorted(edges, size, side="right")


def _frequent_rows(records: np.ndarray, word: np.ndarray, salts: np.ndarray, spot: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Postings of frequent words, by word and size class; ``spot`` spreads a word over several tasks."""
    kind = size_classes(records["size"].astype(np.int64))
    salt = spot % salts
    order = np.lexsort((salt, kind, word))
    records, word, kind, salt = records[order], word[order], kind[order], salt[order]
    new = np.ones(len(order), bool)
    new[1:] = (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]) | (salt[1:] != salt[:-1])
    edges = np.flatnonzero(new)
    bucket = mix(mix(word[edges]) + kind[edges].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt[edges]) % np.uint64(n_buckets)
    parts = np.split(records, edges[1:])
    yield _columns(bucket=bucket.astype(np.int64), blob=[_packed(p) for p in parts], hot=word[edges].view(np.int64), kind=kind[edges].astype(np.int32), n=[len(p) for p in parts])


def _posting_rows(batches: Iterator[pa.RecordBatch], ranks: np.ndarray, frequent: dict[int, int], n_buckets: int, only: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    often = np.array(sorted(frequent), np.uint64)
    n_salts = np.array([frequent[int(k)] for k in often], np.uint64)
    held: list[tuple[np.ndarray, dict[str, np.ndarray]]] = []
    for part in text_slices(batches, limit=SLICE):
        some = None if only is None else lambda row, number, hashes, starts: np.logical_or.reduceat(_has(only, hashes), starts)
        lines = Lines(part.column("text"), ranks, some)
        if not len(lines.size):
            continue
        doc, text = (part.column(c).to_numpy()[lines.row] for c in ("doc", "text_hash"))
        starts = lines.first[:-1]
        sets = np.add.reduceat(lines.hash * (lines.hash | np.uint64(1)), starts)
        bitmap, bitmap2 = (np.bitwise_xor.reduceat(half, starts) for half in _parity(lines.hash))
        # the earliest line of each set stands for it
        order = np.lexsort((lines.number, text, doc, bitmap, lines.size, sets))
        head = np.ones(len(order), bool)
        same = lambda c: c[order][1:] == c[order][:-1]
        head[1:] = ~(same(sets) & same(lines.size) & same(bitmap))
        leader = order[np.flatnonzero(head)][np.cumsum(head) - 1]
        later = order[(doc[order] != doc[leader]) | (text[order] != text[leader]) | (lines.number[order] != lines.number[leader])]
        if only is None and len(later):
            settled = _removed(doc[later], text[later], lines.number[later])
            yield settled.set_column(0, "bucket", pa.array(np.mod(text[later], n_buckets)))
        chosen = np.sort(order[head])
        prefix = prefix_length(lines.size[chosen])
        owner = np.repeat(chosen, prefix)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
        word = lines.hash[lines.first[owner] + at]
        if only is not None:
            keep = _has(only, word)
            owner, at, word = owner[keep], at[keep], word[keep]
        columns = {"word": word, "size": lines.size, "at": at, "line": lines.number, "set": sets, "bitmap": bitmap, "bitmap2": bitmap2, "doc": doc, "text": text}
        held.append((word, {f: (c if f in ("word", "at") else c[owner]).astype(RECORD[f]) for f, c in columns.items()}))  # a word's lower half
        if sum(len(w) for w, _ in held) >= POSTINGS_AT_ONCE:
            yield from _bucket_rows(held, often, n_salts, n_buckets)
            held = []
    if held:
        yield from _bucket_rows(held, often, n_salts, n_buckets)


def _bucket_rows(held: list[tuple[np.ndarray, dict[str, np.ndarray]]], often: np.ndarray, n_salts: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Postings of some slices, packed by bucket; ``often`` and ``n_salts`` are frequent words and their tasks."""
    word = np.concatenate([w for w, _ in held])
    columns = {f: np.concatenate([c[f] for _, c in held]) for f in RECORD.names}
    rest = np.arange(len(word))
    if len(often):
        head = word >> np.uint64(64 - COUNT_BITS)
        known = np.minimum(np.searchsorted(often, head), len(often) - 1)
        hot = often[known] == head
        if hot.any():
            rows, rest = np.flatnonzero(hot), np.flatnonzero(~hot)
            out = np.empty(len(rows), RECORD)
            for f, c in columns.items():
                out[f] = c[rows]
            yield from _frequent_rows(out, word[rows], n_salts[known[rows]], mix(out["set"]), n_buckets)
    bucket = ((word[rest] >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    if not len(order):
        return
    bucket, rest = bucket[order], rest[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    packed = {f: c[rest] for f, c in columns.items()}
    blobs = [b"".join(packed[f][a:b].tobytes() for f in RECORD.names) for a, b in zip(edges, [*edges[1:], len(order)])]
    yield _columns(bucket=bucket[edges].astype(np.int64), blob=blobs)


def _parity(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one bit of 128 that each word turns over, in two halves."""
    bit = np.uint64(1) << (hashes & np.uint64(63))
    lower = (hashes >> np.uint64(6)) & np.uint64(1) == 0
    return np.where(lower, bit, np.uint64(0)), np.where(lower, np.uint64(0), bit)


def _packed(records: np.ndarray) -> bytes:
    """One column after the other, which the shuffle's compression can make use of."""
    return b"".join(records[f].tobytes() for f in RECORD.names)


def _unpacked(blob: bytes) -> np.ndarray:
    out, at = np.empty(len(blob) // RECORD.itemsize, RECORD), 0
    for f in RECORD.names:
        out[f] = np.frombuffer(blob, RECORD[f], len(out), at)
        at += len(out) * RECORD[f].itemsize
    return out


def _marks(doc: np.ndarray, text: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash of a line's place, for bitmaps of lines."""
    return mix(mix(doc.astype(np.int64).view(np.uint64)) + text.astype(np.int64).view(np.uint64) + mix(line.astype(np.uint64)))


CANDIDATES = (
    "bucket long, blob binary, hot long, kind int, n long, doc long, text_hash long, line int, "
    "others array<struct<doc: long, text_hash: long, line: int>>, more boolean"
)
_OTHER = pa.struct([("doc", pa.int64()), ("text_hash", pa.int64()), ("line", pa.int32())])
_KINDS = {
    "bucket": pa.int64(), "blob": pa.binary(), "hot": pa.int64(), "kind": pa.int32(), "n": pa.int64(),
    "doc": pa.int64(), "text_hash": pa.int64(), "line": pa.int32(),
    "others": pa.list_(_OTHER), "more": pa.bool_(),
}


def _columns(**given) -> pa.RecordBatch:
    """A batch of CANDIDATES in which columns not given are null."""
    n = len(next(iter(given.values())))
    arrays = [given[k] if isinstance(given.get(k), pa.Array) else pa.array(given[k], k_type) if k in given else pa.nulls(n, k_type) for k, k_type in _KINDS.items()]
    return pa.RecordBatch.from_arrays(arrays, list(_KINDS))


def _removed(doc: np.ndarray, text: np.ndarray, line: np.ndarray) -> pa.RecordBatch:
    """Rows without candidates: lines settled as later matches."""
    return _columns(doc=doc, text_hash=text, line=line.astype(np.int32))


def _has(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = (values & np.uint64(len(bits) * 64 - 1)).astype(np.int64)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def _candidate_rows(batches: Iterator[pa.RecordBatch], first: int | None, wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for group in groups(batches, ["bucket"]):
        settled = group.filter(group.column("blob").is_null())
        if settled.num_rows:
            yield settled
        frequent = group.filter(group.column("hot").is_valid())
        if frequent.num_rows:
            yield from _gathered(frequent)
        blobs = group.filter(pc.and_(group.column("hot").is_null(), group.column("blob").is_valid())).column("blob")
        if len(blobs):
            yield from _candidates(np.concatenate([_unpacked(b.as_py()) for b in blobs]), first, wanted)


def _gathered(frequent: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Postings of frequent words with one row per word and size class; equal lines are settled."""
    by: dict[tuple[int, int], list[np.ndarray]] = {}
    for hot, kind, blob in zip(*(frequent.column(c) for c in ("hot", "kind", "blob"))):
        by.setdefault((hot.as_py(), kind.as_py()), []).append(_unpacked(blob.as_py()))
    for (hot, kind), parts in by.items():
        records, later = _leaders(np.concatenate(parts))
        later = later[later["at"] == 0]
        if len(later):
            yield _removed(later["doc"], later["text"], later["line"])
        yield _columns(hot=[hot], kind=[kind], blob=[_packed(records)], n=[len(records)])


def _leaders(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings sorted by word and size, the earliest line of equal sets only, and the others that stand elsewhere."""
    whole = mix(records["set"] ^ mix(records["bitmap"]))
    order = np.lexsort((whole, (records["word"].astype(np.uint64) << np.uint64(32)) | records["size"].astype(np.uint64)))
    records = records[order]
    new = np.ones(len(records), bool)
    new[1:] = np.logical_or.reduce([records[f][1:] != records[f][:-1] for f in ("word", "size", "set", "bitmap")])
    if new.all():
        return records, records[:0]
    run = np.cumsum(new) - 1
    shared = np.flatnonzero(np.bincount(run)[run] > 1)
    some = records[shared]
    shared = shared[np.lexsort((some["line"], some["text"], some["doc"], run[shared]))]
    lead = np.ones(len(records), bool)
    lead[shared] = first = np.diff(run[shared], prepend=-1) != 0
    leader = records[shared[np.flatnonzero(first)[np.cumsum(first) - 1]]]
    others = records[shared]
    elsewhere = np.logical_or.reduce([others[f] != leader[f] for f in ("doc", "text", "line")])
    return records[lead], others[elsewhere]


def _candidates(records: np.ndarray, first: int | None, wanted: np.ndarray | None, side: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """Later matches of equal sets, and for every line (or those in a bitmap) its earliest candidates.

    ``first`` is the length of a list where pairs abound; None lists all.

    ``side`` tells two blocks apart whose lines are compared with those of the other only.
    """
    records, later = _leaders(records)
    later = later[later["at"] == 0]  # equal sets share their first word too
    if len(later):
        yield _removed(later["doc"], later["text"], later["line"])
    sides = None if side is None else side(records)
    key = (records["word"].astype(np.uint64) << np.uint64(32)) | records["size"].astype(np.uint64)
    size = records["size"].astype(np.int64)
    # places in corpus order, equal for postings of one line
    order = np.lexsort((records["line"], records["text"], records["doc"]))
    place = np.empty(len(records), np.int64)
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(records["doc"][order]) != 0) | (np.diff(records["text"][order]) != 0) | (np.diff(records["line"][order].astype(np.int64)) != 0)
    place[order] = np.cumsum(new) - 1
    shown = order[new]  # a posting of each place
    limit = np.searchsorted(key, (key & np.uint64(0xFFFFFFFF00000000)) | (size * 5 // 4).astype(np.uint64), side="right")
    count = np.maximum(limit - np.arange(len(records)) - 1, 0)
    ends = np.cumsum(count)
    asked = np.ones(len(records), bool) if wanted is None else _has(wanted, _marks(records["doc"], records["text"], records["line"]))
    best: list[np.ndarray] = []
    at, held, most = 0, 0, 4 * CHUNK
    length = None if first is None else max(WIDE, first)
    bound = PAIRS * len(records)

    def cut(pairs: np.ndarray, length: int) -> tuple[np.ndarray, int]:
        """The earliest candidates of each line, one more than are listed, and the length of lists."""
        pairs = _earliest(pairs, length + 1)
        if len(pairs) > bound and length > first:
            return _earliest(pairs, first + 1), first
        return pairs, length

    while at < len(records):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
        n = count[at:to]
        a = np.repeat(np.arange(at, to), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        at = to
        if sides is not None:
            across = sides[a] != sides[b]
            a, b = a[across], b[across]
        both = size[a] + size[b]
        overlap = -(-4 * both // 9)
        apart = np.bitwise_count(records["bitmap"][a] ^ records["bitmap"][b]) + np.bitwise_count(records["bitmap2"][a] ^ records["bitmap2"][b])
        keep = apart <= both - 2 * overlap
        a, b, overlap = a[keep], b[keep], overlap[keep]
        left = 1 + np.minimum(size[a] - records["at"][a] - 1, size[b] - records["at"][b] - 1)
        keep = (left >= overlap) & (place[a] != place[b])
        a, b = a[keep], b[keep]
        x, y = np.where(place[a] < place[b], a, b), np.where(place[a] < place[b], b, a)
        near = asked[y]
        pairs = np.unique(place[y[near]] << np.int64(32) | place[x[near]])
        if first is None:
            if len(pairs):
                yield _listed(records, shown, pairs, None)
            continue
        best.append(_earliest(pairs, length + 1))
        held += len(best[-1])
        if held > most:
            pairs, length = cut(np.unique(np.concatenate(best)), length)
            best, held, most = [pairs], len(pairs), max(4 * CHUNK, 2 * len(pairs))
    if held:
        pairs, length = cut(np.unique(np.concatenate(best)), length)
        yield _listed(records, shown, pairs, length)


def _listed(records: np.ndarray, shown: np.ndarray, pairs: np.ndarray, length: int | None) -> pa.RecordBatch:
    """Lines with their candidates, from sorted (line << 32 | earlier line); one beyond ``length`` says that there are more."""
    n_found = np.unique(pairs >> 32, return_counts=True)[1]
    kept = _earliest(pairs, length)
    y, x = kept >> 32, kept & np.int64(0xFFFFFFFF)
    starts = np.flatnonzero(np.diff(y, prepend=-1))
    r, o = records[shown[y[starts]]], records[shown[x]]
    others = pa.StructArray.from_arrays([pa.array(o["doc"]), pa.array(o["text"]), pa.array(o["line"].astype(np.int32))], fields=list(_OTHER))
    others = pa.ListArray.from_arrays(pa.array(np.append(starts, len(y)), pa.int32()), others)
    more = n_found > length if length is not None else np.zeros(len(starts), bool)
    return _columns(doc=r["doc"], text_hash=r["text"], line=r["line"].astype(np.int32), others=others.cast(_KINDS["others"]), more=more)


def _earliest(pairs: np.ndarray, first: int | None) -> np.ndarray:
    """Of sorted (line << 32 | earlier line), the first few of each line."""
    if first is None or not len(pairs):
        return pairs
    starts = np.flatnonzero(np.diff(pairs >> 32, prepend=-1))
    return pairs[np.arange(len(pairs)) - np.repeat(starts, np.diff(np.append(starts, len(pairs)))) < first]


_PAIR = ["hot", "kind", "i", "other_kind", "j"]
BLOCKS = "hot long, kind int, i long, other_kind int, j long, blob binary"


def _block_of(records: np.ndarray, n_blocks: int) -> np.ndarray:
    return (mix(records["set"] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(n_blocks)).astype(np.int64)


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of frequent words, given to every pair of blocks that holds their own."""
    for batch in batches:
        for hot, kind, blob, below, own, above in zip(*(batch.column(c) for c in ("hot", "kind", "blob", "below", "own", "above"))):
            hot, kind, below, own, above = (x.as_py() for x in (hot, kind, below, own, above))
            records = _unpacked(blob.as_py())
            block = _block_of(records, own)
            for b in np.unique(block).tolist():
                pairs = [(hot, kind, min(b, j), kind, max(b, j)) for j in range(own)]
                pairs += [(hot, kind, b, kind + 1, j) for j in range(above)] + [(hot, kind - 1, j, kind, b) for j in range(below)]
                mine = _packed(records[block == b])
                step = max(1, (16 << 20) // max(1, len(mine)))
                for at in range(0, len(pairs), step):
                    some = pairs[at : at + step]
                    columns = [pa.array(c, k) for c, k in zip(zip(*some), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([mine] * len(some), pa.binary())], [*_PAIR, "blob"])


def _pair_rows(batches: Iterator[pa.RecordBatch], first: int | None, wanted: np.ndarray | None, n_blocks: dict[tuple[int, int], int]) -> Iterator[pa.RecordBatch]:
    for group in groups(batches, _PAIR):
        hot, kind, i, other, j = (group.column(c)[0].as_py() for c in _PAIR)
        records = np.concatenate([_unpacked(b.as_py()) for b in group.column("blob")])
        side = None
        if other != kind:
            low = size_classes(np.arange(1, int(records["size"].max()) + 1))
            side = lambda r: low[r["size"] - 1] == kind
        elif i != j:
            side = lambda r: _block_of(r, n_blocks[hot, kind]) == i
        yield from _candidates(records, first, wanted, side)


def block_candidates(found: DataFrame, first: int | None, wanted) -> DataFrame:
    """Candidates among the postings of frequent words, one task for every pair of blocks."""
    hot = found.filter("hot is not null").select("hot", "kind", "n", "blob")
    counts = written(hot.groupBy("hot", "kind").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks")))
    beside = lambda by, name: counts.select("hot", (F.col("kind") + by).alias("kind"), F.col("blocks").alias(name))
    sized = hot.join(beside(0, "own"), ["hot", "kind"]).join(beside(1, "below"), ["hot", "kind"], "left").join(beside(-1, "above"), ["hot", "kind"], "left")
    sized = sized.fillna(0, ["below", "above"]).select("hot", "kind", "blob", "below", "own", "above")
    # words of several blocks occur more than BLOCK times, so there are at most postings / BLOCK of them
    n_blocks = {(r.hot, r.kind): r.blocks for r in counts.filter("blocks > 1").collect()}
    dealt = sized.mapInArrow(_block_rows, BLOCKS).repartition(*_PAIR).sortWithinPartitions(*_PAIR)
    return dealt.mapInArrow(lambda it: _pair_rows(it, first, None if wanted is None else wanted.value, n_blocks), CANDIDATES)


def frequent_words(counts: np.ndarray) -> dict[int, int]:
    """Buckets of words that occur more than FREQUENT times (at most words / FREQUENT), and over how many tasks each goes."""
    often = np.flatnonzero(counts > FREQUENT)
    return {int(k): int(-(-counts[k] // FREQUENT)) for k in often}


_FOUND = ["doc", "text_hash", "line", "others", "more"]


def candidates(texts: DataFrame, ranks, frequent: dict[int, int], n_buckets: int, first: int | None, only=None, wanted=None) -> DataFrame:
    """Settled lines (``others`` null) and lines with candidates to verify."""
    posted = texts.mapInArrow(lambda it: _posting_rows(it, ranks.value, frequent, n_buckets, None if only is None else only.value), CANDIDATES)
    n_tasks = max(texts.sparkSession.sparkContext.defaultParallelism, n_buckets // BUCKETS_PER_TASK)
    dealt = posted.repartition(n_tasks, "bucket").sortWithinPartitions("bucket")
    found = written(dealt.mapInArrow(lambda it: _candidate_rows(it, first, None if wanted is None else wanted.value), CANDIDATES).drop("bucket"))
    plain = found.filter("hot is null").select(*_FOUND)
    if not frequent or found.filter("hot is not null").isEmpty():
        return plain
    return plain.unionByName(written(block_candidates(found, first, wanted).select(*_FOUND)))


# --- 4: verification -----------------------------------------------------------------------

_LINE = ["doc", "text_hash", "line"]


BITS = "word long, bits long"


def _bit_rows(marks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's marks as the words of one bitmap of LINE_BITS bits that are not zero."""
    out = np.zeros(LINE_BITS // 64, np.uint64)
    for some in marks:
        at = np.unique(some & np.uint64(LINE_BITS - 1))
        np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    word = np.flatnonzero(out)
    if len(word):
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(out[word].view(np.int64))], ["word", "bits"])


def _line_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield _marks(*(batch.column(c).to_numpy() for c in _LINE))


def _word_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield batch.column("word").to_numpy().view(np.uint64)


def bitmap_of(rows: DataFrame, marks: Callable) -> np.ndarray:
    """The bitmap of all marks of the rows' batches; at most LINE_BITS / 64 numbers are collected."""
    parts = rows.mapInArrow(lambda it: _bit_rows(marks(it)), BITS)
    found = parts.groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()
    out = np.zeros(LINE_BITS // 64, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _needed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines and their candidates, each once a batch: lists of one bucket name the same few lines again and again."""
    for batch in batches:
        others = batch.column("others").flatten().flatten()
        columns = {c: np.concatenate([batch.column(c).to_numpy(), o.to_numpy()]) for c, o in zip(_LINE, others)}
        yield pa.RecordBatch.from_pandas(pd.DataFrame(columns).drop_duplicates(), preserve_index=False)


def _set_rows(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, limit=SLICE):
        docs, hashes = (part.column(c).to_numpy() for c in ("doc", "text_hash"))
        lines = Lines(part.column("text"), None, lambda row, number, *_: _has(wanted, _marks(docs[row], hashes[row], number)))
        doc, text = docs[lines.row], hashes[lines.row]
        words = pa.ListArray.from_arrays(pa.array(lines.first, pa.int32()), pa.array(lines.hash.view(np.int64)))
        columns = [pa.array(doc), pa.array(text), pa.array(lines.number, pa.int32()), words]
        yield pa.RecordBatch.from_arrays(columns, [*_LINE, "words"])


def verified(texts: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with a true match among their candidates; words of those without that had more candidates."""
    mine = found.filter("others is not null")
    needed = written(mine.select(*_LINE, "others").mapInArrow(_needed_rows, "doc long, text_hash long, line int").distinct())
    wanted = texts.sparkSession.sparkContext.broadcast(bitmap_of(needed, _line_marks))
    sets = texts.mapInArrow(lambda it: _set_rows(it, wanted.value), "doc long, text_hash long, line int, words array<long>")
    sets = written(sets.join(needed, _LINE, "left_semi").dropDuplicates(_LINE))
    xs = sets.select(*[F.col(c).alias(f"x_{c}") for c in _LINE], F.col("words").alias("x_words"))

    def true(some: DataFrame) -> DataFrame:
        joined = some.join(sets, _LINE).join(xs, [f"x_{c}" for c in _LINE])
        common = F.size(F.array_intersect("words", "x_words"))
        return written(joined.filter(9 * common >= 4 * (F.size("words") + F.size("x_words"))).select(*_LINE).distinct())

    # the earliest candidate settles most lines; the whole lists are set out only for lines that it leaves open
    first = F.col("others")[0]
    earliest = mine.select(*_LINE, first.alias("x")).groupBy(*_LINE).agg(F.min("x").alias("x"))
    links = true(earliest.select(*_LINE, *[F.col(f"x.{c}").alias(f"x_{c}") for c in _LINE]))
    left = mine.join(links, _LINE, "left_anti").select(*_LINE, F.explode("others").alias("x"))
    links = written(links.union(true(left.select(*_LINE, *[F.col(f"x.{c}").alias(f"x_{c}") for c in _LINE]).distinct())))
    unsure = mine.filter("more").select(*_LINE).distinct().join(links, _LINE, "left_anti").join(sets, _LINE)
    return links, written(unsure)


def _prefix_rows(batches: Iterator[pa.RecordBatch], ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The prefix words of lines, given their sets of words."""
    for batch in batches:
        sets = batch.column("words")
        size = np.diff(sets.offsets.to_numpy()).astype(np.int64)
        line = np.repeat(np.arange(len(size)), size)
        hashes = sets.flatten().to_numpy().view(np.uint64)
        order = Lines._by_rarity(line, hashes, ranks)
        at = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
        rare = hashes[order][at < np.repeat(prefix_length(size), size)]
        yield pa.RecordBatch.from_arrays([pa.array(rare.view(np.int64))], ["word"])


def later_matches(documents: DataFrame) -> DataFrame:
    """(doc, text_hash, line) of every line that an earlier one matches."""
    context = documents.sparkSession.sparkContext
    texts = keyed(documents).filter("text is not null")
    counts = word_counts(texts)
    ranks = context.broadcast(rarity_ranks(counts))
    n_buckets = max(16, int(counts.sum() // 4 // POSTINGS_PER_BUCKET))
    frequent = frequent_words(counts)
    found = candidates(texts, ranks, frequent, n_buckets, FIRST)
    removed = found.filter("others is null").select(*_LINE)
    links, unsure = verified(texts, found)
    removed = removed.union(links)
    if not unsure.isEmpty():
        wanted = context.broadcast(bitmap_of(unsure.select(*_LINE), _line_marks))
        rare = unsure.select("words").mapInArrow(lambda it: _prefix_rows(it, ranks.value), "word long")
        words = context.broadcast(bitmap_of(rare, _word_marks))
        rest = candidates(texts, ranks, frequent, n_buckets, None, words, wanted).filter("others is not null").join(unsure.select(*_LINE), _LINE, "left_semi")
        removed = removed.union(verified(texts, written(rest))[0])
    return removed.distinct()


def dedup_lines(documents: DataFrame) -> DataFrame:
    """``documents`` without the lines that an earlier line matches."""

    @F.pandas_udf("string")
    def without(text: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for t, g in zip(text, gone):
            if t is not None and g is not None:
                drop = set(g)
                t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop)
            out.append(t)
        return pd.Series(out, dtype=object)

    lines = later_matches(documents).groupBy("doc", "text_hash").agg(F.collect_list("line").alias("_gone"))
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_doc"), *keyed_columns())
    joined = whole.join(lines, ["doc", "text_hash"], "left")
    shorter = F.when(F.col("_gone").isNull(), F.col("_doc.text")).otherwise(without(F.when(F.col("_gone").isNotNull(), F.col("_doc.text")), F.col("_gone")))
    joined = joined.withColumn("_text", shorter)
    new = {"text": F.col("_text")}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(F.col("_gone").isNull(), F.col("_doc.n_chars")).otherwise(F.length("_text")).cast(documents.schema["n_chars"].dataType)
    return joined.select(*[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in documents.columns])
