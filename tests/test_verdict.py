"""Missing data, ranks, splits and fits that must not lose or bend anything."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from verispark.functions.scalars import array_std, hash_key, softmax
from verispark.functions.vectors import centre_own, unit
from verispark.operators import analysis as A
from verispark.operators import backends as K
from verispark.operators import calibration as C
from verispark.operators import groups as G
from verispark.operators import scoring as J
from verispark.operators.protocol import split_sizes
from verispark.operators.ranking import text_rank
from verispark.sources.tables import read_table


@pytest.fixture(scope="module")
def gap(spark):
    """Two trials, one of whose test utterances has no vector."""
    trials = spark.createDataFrame([("t1", "s", 1, "a", "b"), ("t2", "s", 0, "a", "gone")], "trial_id string, split string, label int, enroll_utt string, test_utt string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], "utterance string, enc1 array<double>")
    return trials, vectors


def paths(trials, vectors, how):
    backend = K.Backend(metric="centered_cosine", mean=np.zeros(2), matrix=np.eye(2))
    return {
        "wide": lambda: J.score_wide(trials, vectors, ["enc1"], on_missing=how),
        "similarity": lambda: J.similarity_columns(trials, vectors, ["enc1"], ["cosine"], on_missing=how),
        "one": lambda: J.score_trials(trials, vectors.withColumnRenamed("enc1", "embedding"), on_missing=how),
        "backend": lambda: K.score_backend(trials, vectors.withColumnRenamed("enc1", "vec"), backend, on_missing=how),
    }


@pytest.mark.parametrize("path", ["wide", "similarity", "one", "backend"])
def test_missing_vectors(gap, path):
    trials, vectors = gap
    with pytest.raises(Exception, match="no embedding"):
        paths(trials, vectors, "error")[path]().collect()
    assert [r.trial_id for r in paths(trials, vectors, "skip")[path]().collect()] == ["t1"]
    lost = J.missing_embeddings(trials, vectors).first()
    assert (lost.trials, lost.missing_enroll, lost.missing_test, lost.skipped) == (2, 0, 1, 1)


def test_group_without_scores_raises(spark):
    slots = [(k, f"u{k}", f"t{k}") for k in range(2)]
    groups = spark.createDataFrame([("g", "test", 1, slots)], "group_hash string, split string, label int, slots array<struct<row_number: int, enroll_utt: string, trial_id: string>>")
    scores = spark.createDataFrame([("t0", "e1", 0.5), ("t1", "e1", 0.7), ("t0", "e2", 0.1)], "trial_id string, embedding_name string, score double")
    assert G.group_scores(groups, scores, ["e1"], 2).first().scores == [0.5, 0.7]
    for encoders in (["e1", "e2"], ["e3"]):
        with pytest.raises(Exception, match="missing scores"):
            G.group_scores(groups, scores, encoders, 2).collect()
    with pytest.raises(Exception, match="more than one slot"):
        G.slots_of(groups.union(groups)).collect()


def test_text_rank_mixed_prefixes(spark):
    rows = [(k % 2, f"{'a-very-long-shared-prefix' if k % 3 else 'zz'}-{k * 7919 % 1000:04d}") for k in range(900)]
    df = spark.createDataFrame(rows, "g int, name string").repartition(5)
    want = {n: i for i, n in enumerate(sorted(n for _, n in rows), 1)}
    assert {r.name: r["rank"] for r in text_rank(df, [], "name").collect()} == want
    for g in (0, 1):
        want = {n: i for i, n in enumerate(sorted(n for x, n in rows if x == g), 1)}
        assert {r.name: r["rank"] for r in text_rank(df, ["g"], "name").filter(F.col("g") == g).collect()} == want


def test_split_sizes_are_the_closest():
    for n in [*range(3, 40), 101, 997]:
        for c, v in product([0.1, 0.25, 0.5, 0.7], [0.0, 0.05, 0.2]):
            sizes, share = split_sizes(n, c, v), {"calibration": c, "validation": v, "test": 1 - c - v}
            share = {k: r for k, r in share.items() if r > 0}
            assert sum(sizes.values()) == n and set(sizes) == set(share) and min(sizes.values()) >= 1
            if all(n * r >= 1 for r in share.values()):
                assert all(abs(sizes[k] - n * r) < 1 for k, r in share.items())
    assert split_sizes(2, 0.5, 0.0) == {"calibration": 1, "test": 1}
    assert split_sizes(3, 0.01, 0.01) == {"calibration": 1, "validation": 1, "test": 1}
    for bad in ((5, 0.0, 0.1), (5, 0.6, 0.4), (1, 0.5, 0.0), (2, 0.3, 0.3), (5, 0.5, -0.1)):
        with pytest.raises(ValueError):
            split_sizes(*bad)


def test_platt_is_at_its_optimum(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    x = np.round(rng.normal(size=400) * 0.2 + 0.3 * y, 3)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, label int")
    fit = C.fit_platt(df, 400)
    w = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    p = 1 / (1 + np.exp(-(fit.slope * x + fit.intercept)))
    assert (w * (p - y) * x).sum() + fit.slope / 400 == pytest.approx(0, abs=1e-6)
    assert (w * (p - y)).sum() == pytest.approx(0, abs=1e-6)


def test_bound_values(spark):
    a = np.array([1.0, 2.0, 4.0])
    row = spark.createDataFrame([(a.tolist(),)], "a array<double>").select(
        unit(F.col("a")).alias("u"), centre_own(F.col("a")).alias("c"), array_std(F.col("a")).alias("s"), softmax(F.col("a")).alias("p")
    ).first()
    assert row.u == pytest.approx(a / np.linalg.norm(a)) and row.c == pytest.approx(a - a.mean())
    assert row.s == pytest.approx(a.std()) and row.p == pytest.approx(np.exp(a) / np.exp(a).sum())


def test_null_parts_count(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert len({r.h for r in df.select(hash_key(F.col("x"), F.col("y")).alias("h")).collect()}) == 2


def test_format_follows_the_suffix(spark, tmp_path):
    path = f"{tmp_path}/old.csv.d/table.parquet"
    spark.range(3).write.parquet(path)
    assert read_table(spark, path).count() == 3


def test_pivot_similarity_equals_wide(spark):
    trials = spark.createDataFrame([("s", "t1", 1, "a", "b"), ("s", "t2", 0, "b", "b")], "split string, trial_id string, label int, enroll_utt string, test_utt string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0], [0.0, 2.0]), ("b", [1.0, 1.0], [1.0, 1.0])], "utterance string, e1 array<double>, e2 array<double>")
    metrics = ["cosine", "neg_l1_raw"]
    wide = J.similarity_columns(trials, vectors, ["e1", "e2"], metrics)
    long = None
    for e in ("e1", "e2"):
        one = J.score_trials(trials, vectors.select("utterance", F.col(e).alias("embedding")), metrics)
        one = one.select("split", "trial_id", "label", F.lit(e).alias("embedding_name"), *[f"score_{m}" for m in metrics])
        long = one if long is None else long.unionByName(one)
    pivoted = J.pivot_similarity(long, ["e1", "e2"], metrics)
    names = [c for c in pivoted.columns if c.startswith("score")]
    assert len(names) == 6 and J.missing_score_columns(pivoted.columns, ["e1", "e2"], metrics) == []
    assert J.missing_score_columns(["score_e1"], ["e1"], metrics) == ["score__e1__neg_l1_raw"]
    got = {r.trial_id: [r[c] for c in names] for r in pivoted.collect()}
    assert got == {r.trial_id: pytest.approx([r[c] for c in names]) for r in wide.collect()}


def test_freeze_selection(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5, 0.1, 2.0), ("b", 0.4, 0.2, 3.0), ("c", None, 0.0, 0.0)], "name string, cllr double, act_dcf_p01 double, eer_pct double")
    A.freeze_selection(rows, f"{tmp_path}/best")
    best = spark.read.json(f"{tmp_path}/best").first()
    assert (best["name"], best["status"]) == ("b", "frozen")
    with pytest.raises(ValueError):
        A.freeze_selection(rows.limit(0), f"{tmp_path}/none")


def test_fit_refuses_leaking_speakers(spark):
    fit = spark.createDataFrame([("u", "p", [1.0, 0.0]), ("v", "q", [0.0, 1.0])], "utterance string, speaker string, vec array<double>")
    leak = spark.createDataFrame([("q",)], "speaker_id string")
    with pytest.raises(K.BackendFitError, match="intersect"):
        K.fit_backend("centered_cosine", fit, held_out=leak)
    assert K.fit_backend("centered_cosine", fit, held_out=leak.replace("q", "r")).status == "ok"


def test_plans_without_cross_joins(spark):
    """Constant keys are not folded into cross joins."""
    from verispark.plans.catalog import QUERIES

    for name in ("trial_ids", "group_dictionaries", "coverage_curve"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan and not any(x.strip(" :+-|*").startswith("Join Inner") and x.rstrip().endswith("Inner") for x in plan.splitlines()), name
