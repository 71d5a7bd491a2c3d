import numpy as np

from verispark.llm import embedding_join, queries

SF = "/root/testdata/sf0.01"


def brute(rows):
    fine = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    label, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for width in {len(rows[k][1]) for k in fine}:
        ks = [k for k in fine if len(rows[k][1]) == width]
        x = np.array([rows[k][1] for k in ks], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        sim = x @ x.T >= 0.9
        np.fill_diagonal(sim, False)
        for i, j in zip(*np.nonzero(sim)):
            links[ks[i]] += 1
            a, b = sorted((find(ks[i]), find(ks[j])))
            label[b] = a
    least = {}
    for k in range(len(rows)):
        if rows[k][0] is not None:
            least[find(k)] = min(rows[k][0], least.get(find(k), rows[k][0]))
    return [(rows[k][0], links[k], least.get(find(k))) for k in range(len(rows))]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def check(df):
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = embedding_join.near_duplicates(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_op8_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in queries.QUERIES["op8_embedding_neardup"](spark, SF).collect()), key=key)
    assert got == sorted(brute([(r.vec_id, r.embedding) for r in df.collect()]), key=key)


def test_many_blocks(spark, monkeypatch):
    """Small blocks and fan, clusters of several widths and copies."""
    monkeypatch.setattr(embedding_join, "BLOCK", 20)
    monkeypatch.setattr(embedding_join, "FAN", 3)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(25, 12))
    rows = []
    for k in range(600):
        v = centres[k % 25] + rng.normal(size=12) * rng.choice([0.05, 0.3, 0.6])
        rows.append((k, [float(x) for x in v.astype(np.float32)]))
    rows += [(1000 + k, rows[7][1]) for k in range(80)]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
        (None, [1.0, 0.1]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.01, 0.0]), (11, [-1.0, 0.0]), (12, [1e-30, 0.0]), (13, [3e38, 1.0]),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, node long, copies long")
    check(df)
    assert embedding_join.near_duplicates(df.limit(0)).count() == 0
