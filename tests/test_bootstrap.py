import numpy as np
import pytest

from verispark.operators import bootstrap as R
from verispark.operators import resampling as S
from verispark.operators.metrics import block_from_counts, score_counts


def trials(n, seed, ties):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=n) * 2 + 3 * y - 1.5
    return [(float(round(a, 1) if ties else a), int(b)) for a, b in zip(x, y)]


def test_splits_are_multinomial():
    counts = np.array([5, 0, 900, 17, 3, 1, 60_000])
    total = np.full(4000, 1000)
    draws = S.split_cells(total, counts, S.generator(1, 2))
    assert draws.shape == (7, 4000) and (draws.sum(0) == 1000).all() and not draws[1].any()
    p = counts / counts.sum()
    assert draws.mean(1) == pytest.approx(1000 * p, abs=6 * np.sqrt(1000 * p.max() / 4000))
    assert draws[2].var() == pytest.approx(1000 * p[2] * (1 - p[2]), rel=0.15)
    # walking to each range alone gives ranges that add up, and what lies before them
    ends, done = np.cumsum([400, 0, 25, 75, 1000]), np.zeros(50, np.int64)
    for at in range(5):
        drawn, before = S.split_range(np.full(50, 1500), np.zeros(50, np.int64), ends, at, 3)
        assert (before == done).all()
        done = done + drawn
    assert (done == 1500).all()


def test_cells_of_few_rows_are_drawn_row_by_row():
    """Distinct scores need no binomial draw per cell and replicate; the draws are multinomial all the same."""

    class Rows:
        def __init__(self):
            self.rng = S.generator(7, 1)

        def integers(self, *args, **kind):
            return self.rng.integers(*args, **kind)

    counts, total = np.array([1, 0, 2, 1, 1, 5, 1, 0]), np.repeat([11, 0, 14], 20_000)
    draws = S.split_cells(total, counts, Rows())
    assert draws.shape == (8, 60_000) and (draws.sum(0) == total).all() and not draws[[1, 7]].any()
    p = counts / counts.sum()
    for some in (slice(0, 20_000), slice(40_000, None)):
        n = total[some][0]
        assert draws[:, some].mean(1) == pytest.approx(n * p, abs=0.1)
        assert draws[:, some].var(1) == pytest.approx(n * p * (1 - p), rel=0.1)
        assert np.cov(draws[5, some], draws[2, some])[0, 1] == pytest.approx(-n * p[5] * p[2], rel=0.2)


@pytest.mark.parametrize("cells", [3, 256])
def test_replicates_equal_metrics_of_their_draws(spark, monkeypatch, cells):
    """Metrics of blocks under weights against the metric block of the weighted trials."""
    rng = np.random.default_rng(cells)
    rows = sorted(trials(300, 4, True), reverse=True)
    weight = rng.integers(0, 3, (len(rows), 5)).astype(float)
    weight[:, 4] *= [y for _, y in rows]  # one class only
    score, label = np.array([x for x, _ in rows]), np.array([y for _, y in rows])[:, None]
    totals = (weight * label).sum(0), (weight * (1 - label)).sum(0)
    blocks, before = [], (np.zeros(5), np.zeros(5))
    edges = [*range(0, len(rows), 100), len(rows)]
    while any(score[k] == score[k - 1] for k in edges[1:-1]):
        edges = [k + 1 if 0 < k < len(rows) and score[k] == score[k - 1] else k for k in edges]
    for at, (a, b) in enumerate(zip(edges, edges[1:])):
        walker = S.Walker(at, before, totals, 5)
        for k in range(a, b, cells):
            some = slice(k, min(k + cells, b))
            walker.feed(score[some], weight[some] * label[some], weight[some] * (1 - label[some]))
        blocks.append(S.Block.unpack(walker.finished().pack(), 5))
        before = tuple(x + (weight[a:b] * lab[a:b]).sum(0) for x, lab in zip(before, (label, 1 - label)))
    whole = blocks[1]
    for k in (2, 0):
        whole.merge(blocks[k])
    got = whole.metrics(totals)
    tall = [(r, x, int(y), int(weight[k, r])) for k, (x, y) in enumerate(rows) for r in range(5) if weight[k, r]]
    df = spark.createDataFrame(tall, "replicate int, score double, label int, w long")
    want = {r.replicate: r for r in block_from_counts(score_counts(df, ["replicate"], weight="w"), ["replicate"]).collect()}
    for r in range(4):
        assert [got[m][r] for m in S.METRICS] == pytest.approx([want[r][m] for m in S.METRICS], abs=1e-9)
    assert got.iloc[4].isna().all()


def test_bootstrap_metrics(spark, monkeypatch):
    """Draws do not depend on partitioning, add up, and spread as resampling does."""
    monkeypatch.setattr(R, "CELLS", 40)
    rows = [(g, x, y) for g, n in (("a", 400), ("b", 90)) for x, y in trials(n, n, g == "b")] + [("one", 0.5, 1)]
    df = spark.createDataFrame(rows, "g string, llr double, label int")
    out = [sorted(map(tuple, R.bootstrap_metrics(df.repartition(k), ["g"], samples=300).collect()), key=repr) for k in (1, 5)]
    assert repr(out[0]) == repr(out[1])
    found = {r.g: r for r in R.bootstrap_metrics(df, ["g"], samples=300).collect()}
    assert found["one"].eer_pct_ci95 is None and found["one"].n == 1
    rng, mine = np.random.default_rng(0), [(x, y) for g, x, y in rows if g == "a"]
    costs = []
    for _ in range(300):
        some = [mine[k] for k in rng.integers(0, len(mine), len(mine))]
        t, n = np.array([x for x, y in some if y]), np.array([x for x, y in some if not y])
        costs.append((np.logaddexp(0, -t).mean() + np.logaddexp(0, n).mean()) / 2 / np.log(2))
    low, high = np.percentile(costs, [2.5, 97.5])
    assert found["a"].cllr_ci95 == pytest.approx((high - low) / 2, rel=0.3)


def test_cluster_weights(spark):
    df = spark.range(1000).selectExpr("cast(id % 600 as string) as c").union(spark.createDataFrame([(None,)], "c string"))
    table = {r.cluster: np.frombuffer(r.weights, np.uint16) for r in R.cluster_weights(df, "c", 64, 5).collect()}
    w = np.array(list(table.values()))
    assert w.shape == (600, 64) and (w.sum(0) == 600).all() and w.var() == pytest.approx(1, rel=0.1)
    again = {r.cluster: np.frombuffer(r.weights, np.uint16) for r in R.cluster_weights(df.repartition(7), "c", 64, 5).collect()}
    assert all((again[k] == v).all() for k, v in table.items())


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_paired_clusters(spark, monkeypatch, limit):
    """Equal results whether weights are sent to all tasks or joined; a copy of a system does not differ from it."""
    monkeypatch.setattr(R, "WEIGHT_BYTES", limit)
    rows = [(s, x + (s == "b") * 0.0, y, f"c{k % 23}", "all") for s in "ab" for k, (x, y) in enumerate(trials(500, 1, True))]
    rows += [("c", -x, y, f"c{k % 23}", "all") for k, (x, y) in enumerate(trials(500, 1, True))]
    df = spark.createDataFrame(rows, "system string, llr double, label int, speaker string, split string")
    same = R.paired_cluster_bootstrap(df, ["split"], "speaker", "system", ("a", "b"), samples=50).collect()
    assert len(same) == 6 and all(r.difference == r.ci95_low == r.ci95_high == 0 and r.p_two_sided == 1 for r in same)
    worse = {r.metric: r for r in R.paired_cluster_bootstrap(df, ["split"], "speaker", "system", ("a", "c"), samples=50).collect()}
    assert worse["cllr"].ci95_low > 0 and worse["cllr"].probability_better == 0


def test_bootstrap_decisions(spark):
    rows = [(f"t{k}", "all", k % 2, ["target", "nontarget", "reject"][k % 3]) for k in range(300)]
    df = spark.createDataFrame(rows, "trial_id string, split string, label int, decision string")
    out = R.bootstrap_decisions(df, ["split"], samples=400).first()
    assert out.n == 300 and out.coverage == pytest.approx(2 / 3)
    assert out.coverage_ci95 == pytest.approx(1.96 * np.sqrt(2 / 9 / 300), rel=0.2)
