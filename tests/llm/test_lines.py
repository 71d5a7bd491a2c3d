import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from verispark.llm import line_dedup, queries

from .brute import WORD, brute_lines

SF = "/root/testdata/sf0.001"


def with_places(spark, df):
    """Rows with the hash of the text that orders documents of equal id."""
    return [(r.doc_id, r.text, r.h) for r in df.selectExpr("doc_id", "text", "xxhash64(text) h").collect()]


def check(spark, df):
    rows = with_places(spark, df)
    want = sorted(zip([r[0] for r in rows], brute_lines(rows)), key=repr)
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()), key=repr)
    assert got == want


def test_op9_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = with_places(spark, df)
    want = {r[0]: hashlib.sha256((t or "").encode()).hexdigest() for r, t in zip(rows, brute_lines(rows))}
    got = {r.doc_id: r.text_sha256 for r in queries.QUERIES["op9_line_dedup"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("first", [1, 4])
def test_many_variants(spark, monkeypatch, first):
    """Variants of lines around the threshold; with one candidate per line the second look decides."""
    monkeypatch.setattr(line_dedup, "FIRST", first)
    monkeypatch.setattr(line_dedup, "PAIRS", 0)
    rng = np.random.default_rng(first)
    rows = []
    bases = [[f"b{k}_{w}" for w in range(n)] for k, n in enumerate([1, 2, 4, 5, 6, 9, 10, 25, 60])]
    for d in range(60):
        text = []
        for base in bases:
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(0, 1 + len(words) // 5 + 1)):
                words[at] = f"v{rng.integers(0, 30)}"
            rng.shuffle(words)
            text.append(" ".join(words))
        rows.append((int(rng.integers(0, 50)), "\n".join(text)))
    check(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


@pytest.mark.parametrize("first", [1, 4])
def test_one_template(spark, monkeypatch, first):
    """Thousands of variants of one template: its words are frequent and their postings meet in small blocks."""
    for name, value in {"FIRST": first, "PAIRS": 1, "FREQUENT": 100, "BLOCK": 64, "CHUNK": 5000}.items():
        monkeypatch.setattr(line_dedup, name, value)
    rng = np.random.default_rng(first)
    template = [f"word{k}" for k in range(10)]
    rows = []
    for d in range(5000):
        words = template[: rng.integers(7, 11)] + [f"own{rng.integers(0, 4000)}" for _ in range(rng.integers(1, 4))]
        rng.shuffle(words)
        rows.append((d, " ".join(words)))
    rows += [(5000 + d, rows[d][1]) for d in range(300)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_odd_rows(spark, odd_docs):
    check(spark, odd_docs)
    out = line_dedup.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert all(r.n_chars == len(r.text) for r in out.filter("text is not null and doc_id > 5").collect())
    assert line_dedup.dedup_lines(odd_docs.limit(0)).count() == 0


def test_prefix_length():
    for n in range(1, 200):
        need = -(-4 * n // 5)
        assert line_dedup.prefix_length(np.array([n]))[0] == n - need + 1


def test_lines_of_a_slice(odd_docs):
    texts = [r.text for r in odd_docs.collect()]
    want = [(k, n, len(set(WORD.findall(x)))) for k, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    for ranks in (None, np.random.default_rng(0).permutation(1 << line_dedup.COUNT_BITS).astype(np.uint32)):
        lines = line_dedup.Lines(pa.array(texts), ranks)
        assert list(zip(lines.row.tolist(), lines.number.tolist(), lines.size.tolist())) == want


def test_lists_are_set_out_for_open_lines_only(spark, monkeypatch):
    """Many variants that their earliest candidate settles: their lists of candidates never become rows."""
    monkeypatch.setattr(line_dedup, "PAIRS", 1000)
    write, counts = line_dedup.written, []

    def counted(df):
        out = write(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "written", counted)
    template = " ".join(f"word{k}" for k in range(12))
    rows = [(d, f"{template} own{d}") for d in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    left = line_dedup.dedup_lines(df).filter("text <> ''").collect()
    assert [r.doc_id for r in left] == [0]
    assert max(counts) <= 4 * 400  # a line has three words in its prefix


def test_memory_of_one_bucket():
    """Five million pairs of one word's lines are compared in bounded steps."""
    n = 3200
    records = np.zeros(n, line_dedup.RECORD)
    records["size"], records["doc"] = 12, np.arange(n)
    records["set"] = np.random.default_rng(5).integers(0, 1 << 63, n)
    tracemalloc.start()
    try:
        rows = sum(r.num_rows for r in line_dedup._candidates(records, line_dedup.FIRST, None))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == n - 1
    assert peak < 64 << 20


def test_memory_of_a_batch_of_texts():
    """Lines of one large batch are taken apart in bounded steps; postings wait for a full pack."""
    random = np.random.default_rng(3)
    texts = ["\n".join(" ".join(f"w{k}" for k in random.integers(0, 50_000, 12)) for _ in range(30)) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(range(4000)), pa.array(texts)], ["doc", "text_hash", "text"])
    ranks = np.arange(1 << line_dedup.COUNT_BITS, dtype=np.uint32)
    line_dedup.Lines(batch.column("text").slice(0, 10))
    tracemalloc.start()
    try:
        sent = sum(len(b.as_py()) for r in line_dedup._posting_rows(iter([batch]), ranks, {}, 64, None) for b in r.column("blob") if b.is_valid)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sent > 300_000 * line_dedup.RECORD.itemsize
    assert peak < 60 << 20
