import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from verispark.operators import isotonic
from verispark.operators.isotonic import fit_isotonic


def brute_fit(rows):
    """Exact pools [low, high, t, n] of (score, label) rows, one score after the other."""
    nt, nn = sum(y == 1 for _, y in rows), sum(y == 0 for _, y in rows)
    cells = {}
    for x, y in rows:
        cell = cells.setdefault(x, [0, 0])
        cell[1 - y] += 1
    pools = []
    for x in sorted(cells):
        t, n = cells[x]
        pools.append([x, x, Fraction(t, 2 * nt), Fraction(n, 2 * nn)])
        while len(pools) > 1 and pools[-2][2] * (pools[-1][2] + pools[-1][3]) >= pools[-1][2] * (pools[-2][2] + pools[-2][3]):
            _, high, t, n = pools.pop()
            pools[-1][1:] = [high, pools[-1][2] + t, pools[-1][3] + n]
    return [(low, high, float(t / (t + n))) for low, high, t, n in pools]


def brute_posterior(pools, x):
    knots = [(v, p) for low, high, p in pools for v in (low, high)]
    return float(np.interp(x, [v for v, _ in knots], [p for _, p in knots]))


def rows_of(seed, n):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=n) + 1.2 * y
    return x, y


def make(spark):
    rows = []
    for g, n in (("big", 4000), ("small", 40), (None, 300)):
        x, y = rows_of(n, n)
        rows += [(g, float(a), int(b), "clash") for a, b in zip(x, y)]
    rows += [("steps", float(k), int(k >= 50), "clash") for k in range(100)]
    rows += [("falling", float(k), int(k < 50), "clash") for k in range(100)]
    rows += [("ties", float(k // 40), int((k * 7) % 40 < 10 * (k // 40)), "clash") for k in range(160)]
    odd = [("big", x, 1, "clash") for x in (None, math.nan, math.inf, -math.inf)]
    return rows, spark.createDataFrame(rows + odd, "g string, score double, label int, part string")


def test_equals_brute_force(spark):
    rows, df = make(spark)
    keyed = df.withColumn("g", F.coalesce("g", F.lit("none")))
    fit = fit_isotonic(keyed, ["g"])
    pools = {}
    for r in fit.pools.collect():
        pools.setdefault(r.g, []).append((r.low, r.high, r.t / r.w))
    for g in pools:
        want = brute_fit([(x, y) for k, x, y, _ in rows if (k or "none") == g])
        got = []  # equal means may stay apart
        for low, high, p in sorted(pools[g]):
            if got and p - got[-1][2] < 1e-12:
                low = got.pop()[0]
            got.append((low, high, p))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want], g
        assert [p for *_, p in got] == pytest.approx([p for *_, p in want], abs=1e-12)
        grid = np.linspace(-8, 110, 300).tolist()
        asked = spark.createDataFrame([(g, x, "kept") for x in [*grid, None, math.nan]], "g string, score double, pools string")
        out = {r.score: r for r in fit.posterior(asked, "score").collect() if r.score is not None and not math.isnan(r.score)}
        assert [out[x].posterior for x in grid] == pytest.approx([brute_posterior(want, x) for x in grid], abs=1e-9)
        assert fit.posterior(asked, "score").filter("posterior is null").count() == 2


def test_no_task_sees_all_pools(spark):
    """Continuous scores with very many pools: every part holds a small share."""
    n = 40_000
    rng = np.random.default_rng(1)
    # posteriors that rise by tiny steps: each score is worth a pool of its own
    share = np.linspace(0.02, 0.98, 400)
    rows = [(float(k), int(y)) for k, p in enumerate(share) for y in (rng.permutation(100) < round(100 * p))]
    df = spark.createDataFrame(rows, "score double, label int").withColumn("g", F.lit(1))
    assert len(rows) == n
    fit = fit_isotonic(df, ["g"])
    sizes = [r["count"] for r in fit.pools.groupBy("part").count().collect()]
    assert sum(sizes) > 90 and max(sizes) <= 8
    assert fit.pools.count() >= len(brute_fit(rows)) > 50


def test_llr_is_monotone_and_pools_ties(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (2.0, 0), (3.0, 0), (4.0, 1), (4.0, 1)], "score double, label int").withColumn("g", F.lit(0))
    out = [r.llr for r in fit_isotonic(df, ["g"]).apply(df, "score").orderBy("score").collect()]
    assert out == sorted(out) and out[0] < 0 < out[-1] and out[1] == out[2] == out[3]
    with pytest.raises(Exception, match="both target and nontarget"):
        fit_isotonic(df.filter("label = 1"), ["g"])


def test_long_cascade():
    """A fall at the end that takes in one pool after the other."""
    t = np.append(np.arange(1, 301, dtype=float), -50_000.0)
    low, high, s, w = isotonic.pooled(np.arange(301.0), np.arange(301.0), t, np.ones(301))
    assert len(low) == 1 and s[0] == t.sum() and w[0] == 301
