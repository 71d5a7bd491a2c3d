import numpy as np
import pyarrow as pa
import pytest

from verispark.llm import arrow, components, jaccard_join, queries

from .brute import WORD, brute_classes

SF = "/root/testdata/sf0.01"


def key(row):
    return tuple((x is None, x or 0) for x in row)


def test_words_and_hashes(odd_docs):
    texts = [r.text for r in odd_docs.collect()]
    words = arrow.Words(pa.array(texts))
    got = [[] for _ in texts]
    for row, a, b, h in zip(words.row, words.start, words.end, words.hash):
        got[row].append((bytes(words.data[a:b]).decode(), int(h)))
    assert [[w for w, _ in g] for g in got] == [WORD.findall(t or "") for t in texts]
    by_word = {}
    for g in got:
        for w, h in g:
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    sliced = arrow.Words(pa.array(["skip", *texts]).slice(1))
    assert (sliced.hash == words.hash).all()


def test_op1_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in queries.QUERIES["op1_jaccard_join"](spark, SF).collect()), key=key)
    assert got == sorted(brute_classes(docs), key=key)


@pytest.mark.parametrize("block", [1 << 30, 3])
def test_near_copies_in_blocks(spark, monkeypatch, block):
    """A group of near copies, as one block and cut into many."""
    monkeypatch.setattr(jaccard_join, "SHINGLE_BLOCK", block * 100)
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", block)
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
    rows = []
    for k in range(60):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 7)):
            words[at] = f"x{rng.integers(0, 50)}"
        rows.append((k % 50, " ".join(words)))
    rows += [(100 + k, " ".join(f"y{v}" for v in rng.integers(0, 9000, 80))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(df).collect()), key=key)
    assert got == sorted(brute_classes(rows), key=key)


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(odd_docs).collect()), key=key)
    assert got == sorted(brute_classes(rows), key=key)
    kept = jaccard_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    classes = {c for _, c, _ in brute_classes(rows)}
    assert kept.count() == len(classes)
    assert jaccard_join.jaccard_join(odd_docs.limit(0)).count() == 0 and jaccard_join.keep_one(odd_docs.limit(0)).count() == 0


def test_pruning_bound():
    from math import comb

    for n, least in jaccard_join.LEAST.items():
        post = lambda m: sum(comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1))
        assert post(least) >= jaccard_join.TOLERANCE and (least == 0 or post(least - 1) < jaccard_join.TOLERANCE)


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))] + [(k, k + 1) for k in range(1000, 1300)] + [(2000, k) for k in range(2001, 2300)] + [(5, 5)]
    label = {}

    def find(k):
        while label.setdefault(k, k) != k:
            k = label[k]
        return k

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        label[y] = x
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == {k: find(k) for k in label}
    assert components.components(df.limit(0)).count() == 0
