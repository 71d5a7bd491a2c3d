"""Operators against brute force on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verispark.functions import features as X
from verispark.functions import vectors as V
from verispark.operators import backends as K
from verispark.operators import calibration as C
from verispark.operators import groups as G
from verispark.operators import metrics as M
from verispark.operators import protocol as P
from verispark.operators import ranking as R
from verispark.operators import scoring as J
from verispark.operators import selective as D
from verispark.sources import tables as T


def brute_eer(scores, labels):
    pts = [(math.inf, 1.0, 0.0)]
    t, n = sum(labels), len(labels) - sum(labels)
    for thr in sorted(set(scores), reverse=True):
        hit = [s >= thr for s in scores]
        miss = sum(1 for h, y in zip(hit, labels) if y and not h) / t
        fa = sum(1 for h, y in zip(hit, labels) if h and not y) / n
        pts.append((thr, miss, fa))
    i = next(k for k, p in enumerate(pts) if p[2] - p[1] >= 0)
    (_, m0, f0), (_, m1, f1) = pts[i - 1], pts[i]
    d0, d1 = f0 - m0, f1 - m1
    a = min(max(d0 / (d0 - d1), 0.0), 1.0)
    best = {p: min((p * m + (1 - p) * f) / min(p, 1 - p) for _, m, f in pts) for p in (0.001, 0.01)}
    return f0 + a * (f1 - f0), best


def make(spark, groups=3, size=400, ties=True, seed=1):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        for i in range(size if g else size * 3):  # one group is much larger
            y = int(rng.random() < 0.4)
            s = rng.gauss(1.0 if y else -1.0, 1.5)
            rows.append((f"g{g}", round(s, 1) if ties else s, y))
    return rows, spark.createDataFrame(rows, "g string, score double, label int")


@pytest.mark.parametrize("ties", [True, False])
def test_metric_block_matches_brute_force(spark, ties):
    rows, df = make(spark, ties=ties)
    got = {r.g: r for r in M.metric_block(df, ["g"]).collect()}
    for g in got:
        s, y = [r[1] for r in rows if r[0] == g], [r[2] for r in rows if r[0] == g]
        eer, dcf = brute_eer(s, y)
        assert got[g].eer_pct == pytest.approx(100 * eer, abs=1e-9)
        assert got[g].min_dcf_p001 == pytest.approx(dcf[0.001], abs=1e-9)
        assert got[g].min_dcf_p01 == pytest.approx(dcf[0.01], abs=1e-9)
        loss_t = np.mean([np.logaddexp(0, -a) for a, b in zip(s, y) if b])
        loss_n = np.mean([np.logaddexp(0, a) for a, b in zip(s, y) if not b])
        assert got[g].cllr == pytest.approx((loss_t + loss_n) / 2 / math.log(2), abs=1e-9)


def test_metric_edges(spark):
    df = spark.createDataFrame(
        [("one", 1.0, 1), ("one", 2.0, 1), ("flat", 0.0, 1), ("flat", 0.0, 0), ("nan", float("nan"), 1), ("nan", 1.0, 1), ("nan", 0.0, 0)],
        "g string, score double, label int",
    )
    got = {r.g: r for r in M.metric_block(df, ["g"]).collect()}
    assert got["one"].eer_pct is None and got["one"].cllr is None and got["one"].n == 2
    assert got["flat"].cllr == pytest.approx(1.0) and got["flat"].eer_pct == pytest.approx(50.0)
    assert got["nan"].n == 2 and got["nan"].eer_pct == pytest.approx(0.0)
    assert {r.g for r in M.roc_points(df, ["g"]).collect()} == {"flat", "nan"}


def test_eer_invariant_under_increasing_map_and_unit_weights(spark):
    _, df = make(spark)
    a = M.metric_block(df, ["g"]).orderBy("g").collect()
    b = M.metric_block(df.withColumn("score", F.exp("score")), ["g"]).orderBy("g").collect()
    w = M.metric_block(df.withColumn("w", F.lit(1)), ["g"], weight="w").orderBy("g").collect()
    for x, y, z in zip(a, b, w):
        assert x.eer_pct == pytest.approx(y.eer_pct, abs=1e-9)
        assert x.asDict() == pytest.approx(z.asDict())


def test_prefix_sums_equal_plain_window_on_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i + rng.random(), 1) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, v double, m bigint")
    from pyspark.sql import Window as W

    w = W.partitionBy("k").orderBy("v")
    plain = df.withColumn("c", F.sum("m").over(w)).withColumn("p", F.lag("v").over(w))
    ours = R.prefix_sums(df, ["k"], "v", ["m"]).select("k", "v", "m", F.col("cum_m").alias("c"), F.col("prev_value").alias("p"))
    assert plain.exceptAll(ours).count() == 0
    buckets = R.with_value_bucket(df, ["k"], "v", ["m"]).filter("k = 'hot'").groupBy("_bucket").count()
    assert buckets.count() > 100 and buckets.agg(F.max("count")).first()[0] < 100


def test_quantiles_equal_numpy(spark):
    rows, df = make(spark)
    df = df.unionByName(spark.createDataFrame([("g0", float("nan"), 1), ("g0", None, 1)], df.schema))
    got = {r.g: r for r in R.quantiles(df, ["g"], "score", {"a": 0.1, "b": 0.5, "c": 1.0}).collect()}
    for g in got:
        v = [r[1] for r in rows if r[0] == g]
        assert np.allclose([got[g].a, got[g].b, got[g].c], np.quantile(v, [0.1, 0.5, 1.0]))


def test_text_and_hash_rank(spark):
    names = [f"common/prefix/{random.Random(i).randint(0, 10**6):06d}" for i in range(500)] + ["common/prefix", "common/prefix/é"]
    df = spark.createDataFrame([(n, 0) for n in set(names)], "name string, k int")
    got = {r.name: r["rank"] for r in R.text_rank(df, ["k"], "name").collect()}
    order = sorted(set(names), key=lambda s: s.encode())
    assert got == {n: i + 1 for i, n in enumerate(order)}


def test_top_n_per_group(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(300)], "g string, v int")
    got = R.top_n_per_group(df, ["g"], [F.col("v").desc()], 4, spread=["v"])
    assert sorted(r.v for r in got.filter("g = 'b'").collect()) == [288, 291, 294, 297]


def test_vector_forms_agree_and_zero_vector_is_null(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.normal(size=7).tolist(), rng.normal(size=7).tolist()) for _ in range(30)] + [([0.0] * 7, [1.0] * 7)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>").withColumn("i", F.monotonically_increasing_id())
    names = list(V.PAIRWISE)
    x = df.select("i", *V.pairwise_scores(F.col("a"), F.col("b"), names, rbf_gamma=0.3)).orderBy("i").collect()
    y = df.select("i", V.pairwise_arrow(names, rbf_gamma=0.3)("a", "b").alias("m")).orderBy("i").collect()
    for p, q in zip(x, y):
        for n in names:
            u, v = p[f"score_{n}"], q.m[n]
            assert (u is None and v is None) or u == pytest.approx(v, abs=1e-9), n
    assert x[-1].score_cosine is None and x[-1].score_angular_similarity_diagnostic is None
    with pytest.raises(ValueError):
        V.pairwise_scores(F.col("a"), F.col("b"), ["nope"])


def test_duration_features_null_rules(spark):
    df = spark.createDataFrame([(2.0, 4.0), (None, 4.0), (0.0, 4.0), (-1.0, 4.0)], "enroll_duration_sec double, test_duration_sec double")
    rows = X.duration_features(df, 3.0).collect()
    assert rows[0].duration_ratio == 0.5 and rows[0].qmf1 == pytest.approx(math.log(2))
    assert all(r.qmf3 is None and r.min_duration is None for r in rows[1:])


def test_rich_expand_has_112_features(spark):
    s, m = [f"s{i}" for i in range(6)], [f"m{i}" for i in range(4)]
    df = spark.createDataFrame([tuple(float((i * 7) % 5) for i in range(10))], ", ".join(f"{c} double" for c in s + m))
    out = X.rich_expand(df, s, m)
    assert len(out.columns) == 112
    row, v = out.first(), [float((i * 7) % 5) for i in range(6)]
    assert row.s_q25 == pytest.approx(np.quantile(v, 0.25)) and row.s_std == pytest.approx(np.std(v))
    with pytest.raises(ValueError):
        X.feature_columns("nope", s)


def test_split_sizes_and_disjointness(spark):
    assert P.split_sizes(50, 0.6, 0.2) == {"calibration": 30, "validation": 10, "test": 10}
    assert P.split_sizes(3, 0.9, 0.05) == {"calibration": 1, "validation": 1, "test": 1}
    with pytest.raises(ValueError):
        P.split_sizes(2, 0.6, 0.2)
    people = spark.createDataFrame([(f"s{i}",) for i in range(40)], "speaker_id string")
    m = P.assign_speakers(people, seed="x", calibration_ratio=0.5, validation_ratio=0.25)
    trials = spark.createDataFrame([(f"s{i}", f"s{(i * 3) % 40}", f"t{i}") for i in range(40)] + [("s1", "zz", "t99")], "enroll_speaker string, test_speaker string, trial_id string")
    out = P.split_protocol(trials, m)
    assert out.count() == 41 and out.filter("unused_reason = 'missing_speaker_split'").count() == 1
    P.assert_speaker_disjoint(out, ["calibration", "validation", "test"])
    with pytest.raises(ValueError):
        P.assert_speaker_disjoint(out.withColumn("split", F.when(F.col("trial_id") < "t2", "test").otherwise("calibration")), ["calibration", "test"])


def test_paths_and_lines(spark):
    df = spark.createDataFrame([("spk/en/x.wav",), ("spk/x.wav",), ("/abs/a/b",), ("a/../b",), ("a..b/c/d",)], "u string")
    rows = P.parse_path(df, "u", "e").select("e_speaker", "e_language", P.unsafe_path(F.col("u")).alias("bad")).collect()
    assert [tuple(r) for r in rows] == [("spk", "en", False), ("", "", False), ("", "abs", True), ("a", "..", True), ("a..b", "c", False)]
    lines = spark.createDataFrame([("1 a b",), ("2 a b",), ("1 a",), ("  ",)], "value string")
    assert [r.ok for r in T.parse_trial_lines(lines).collect()] == [True, False, False]
    with pytest.raises(Exception, match="bad trial line"):
        T.parse_trial_lines(lines, strict=True).collect()


def test_sources_and_sinks(spark, tmp_path):
    text = tmp_path / "list.txt"
    text.write_text("\n".join(f"{i % 2} a{i} b{i}" for i in range(50)))
    got = T.read_trial_list(spark, str(text), strict=True).orderBy("line_no").collect()
    assert [r.line_no for r in got] == list(range(1, 51)) and got[7].enroll_utt == "a7"
    (tmp_path / "emb" / "m").mkdir(parents=True)
    (tmp_path / "emb" / "m" / "u.json").write_text('{"utterance": "u", "model_key": "m",\n "embedding": [1.0, 2.0]}')
    assert T.read_embeddings(spark, str(tmp_path / "emb"), "m").first().embedding == [1.0, 2.0]
    (tmp_path / "lab.csv").write_text("filename,label\n a ,x\na,y \n,z\n")
    assert [tuple(r) for r in T.read_language_labels(spark, str(tmp_path / "lab.csv")).collect()] == [("a", "y")]
    (tmp_path / "lim.txt").write_text("# c\ns1\n\ns2\n")
    assert {r.speaker_id for r in T.read_speaker_limit(spark, str(tmp_path / "lim.txt")).collect()} == {"s1", "s2"}
    df = spark.createDataFrame([("test", "t1", 1, "1.5", "u", "v")], "split string, trial_id string, label int, enroll_duration_sec string, enroll_utt string, test_utt string")
    T.write_table(df, str(tmp_path / "p.csv"), "csv")
    assert T.read_protocol(spark, str(tmp_path / "p.csv")).first().enroll_duration_sec == 1.5
    with pytest.raises(Exception, match="(?i)exists"):
        T.write_table(df, str(tmp_path / "p.csv"), "csv")
    T.write_rows([df.select("split"), df.select("trial_id")], str(tmp_path / "r.csv"))
    assert T.read_table(spark, str(tmp_path / "r.csv"), ["trial_id"]).count() == 2
    with pytest.raises(ValueError):
        T.read_table(spark, str(tmp_path / "r.csv"), ["absent"])


def test_pivot_and_missing_embeddings(spark):
    long = spark.createDataFrame([("s", "t1", 1, "a", 0.1), ("s", "t1", 1, "b", 0.2), ("s", "t2", 0, "a", 0.3)], "split string, trial_id string, label int, embedding_name string, score double")
    assert J.pivot_scores(long.filter("trial_id = 't1'"), ["a", "b"]).first().score_b == 0.2
    with pytest.raises(Exception, match="not exactly one score"):
        J.pivot_scores(long, ["a", "b"]).collect()
    with pytest.raises(ValueError):
        T.discover_scores(long, ["a"])
    trials = spark.createDataFrame([("t1", "u", "v"), ("t2", "u", "w")], "trial_id string, enroll_utt string, test_utt string")
    emb = spark.createDataFrame([("u", [1.0, 0.0]), ("v", [1.0, 1.0])], "utterance string, embedding array<float>")
    assert J.score_trials(trials, emb, on_missing="skip").count() == 1
    with pytest.raises(Exception, match="no embedding"):
        J.score_trials(trials, emb).collect()


def test_selective_rules(spark):
    df = spark.createDataFrame([(1, "reject"), (1, "target"), (0, "reject"), (0, "target"), (0, "nontarget")], "label int, decision string").withColumn("g", F.lit(1))
    r = D.decision_metrics(df, ["g"]).first()
    assert (r.coverage, r.accuracy, r.far, r.frr) == (pytest.approx(0.6), pytest.approx(0.4), pytest.approx(1 / 3), 0.5)
    with pytest.raises(ValueError):
        D.confidence_thresholds(df, ["g"], {"x": 0.0})


def test_group_caps_equal_greedy_loop(spark):
    rng = random.Random(5)
    rows = [("s", f"c{rng.randrange(4)}", f"x{rng.randrange(5)}", rng.randrange(2), f"{rng.random():.12f}") for _ in range(400)]
    df = spark.createDataFrame(rows, "split string, enroll_speaker string, test_speaker string, label int, group_hash string")
    got = {r.group_hash: r.drop_reason for r in G.select_groups(df, per_claim_label=15, per_nontarget_pair=4, per_split_label=40).collect()}
    claim, pair, wide, want = {}, {}, {}, {}
    for split, c, x, y, h in sorted(rows, key=lambda r: r[4]):
        if wide.get(y, 0) >= 40:
            want[h] = "split_label_cap"
        elif claim.get((c, y), 0) >= 15:
            want[h] = "speaker_label_cap"
        elif y == 0 and pair.get((c, x), 0) >= 4:
            want[h] = "speaker_pair_cap"
        else:
            want[h] = None
            wide[y] = wide.get(y, 0) + 1
            claim[c, y] = claim.get((c, y), 0) + 1
            pair[c, x] = pair.get((c, x), 0) + (y == 0)
    assert got == want


def _vectors(spark, speakers=6, per=8, d=4):
    rng = np.random.default_rng(2)
    rows = []
    for s in range(speakers):
        c = rng.normal(size=d) * 2
        rows += [(f"s{s}/u{i}", f"s{s}", (c + rng.normal(size=d)).tolist()) for i in range(per)]
    return rows, spark.createDataFrame(rows, "utterance string, speaker string, vec array<double>")


def test_backend_fits(spark):
    rows, df = _vectors(spark)
    x = np.array([r[2] for r in rows])
    white = K.fit_backend("whitened_cosine", df, method="empirical")
    y = (x - white.mean) @ white.matrix
    assert np.allclose(np.cov(y, rowvar=False, bias=True), np.eye(4), atol=1e-6)
    lda = K.fit_backend("lda_cosine", df)
    res = x - np.array([x[[i for i, r in enumerate(rows) if r[1] == s]].mean(axis=0) for s in [r[1] for r in rows]])
    sw = res.T @ res / (len(x) - 6)
    assert np.allclose(lda.matrix.T @ sw @ lda.matrix, np.eye(lda.matrix.shape[1]), atol=1e-8)
    maha = K.fit_backend("neg_mahalanobis", df)
    trials = spark.createDataFrame([("t", "s0/u0", "s1/u1")], "trial_id string, enroll_utt string, test_utt string")
    gap = x[0] - x[9]
    assert K.score_backend(trials, df, maha).first().score_neg_mahalanobis == pytest.approx(-gap @ maha.matrix @ gap)
    single = df.filter("utterance like '%u0'")
    bad = K.fit_backend("wccn_cosine", single)
    assert bad.status == "blocked" and K.score_backend(trials, df, bad, blocked="null").first().score_wccn_cosine is None
    with pytest.raises(K.BackendFitError):
        K.score_backend(trials, df, bad)
    table = K.artefact_table(spark, {"e": [white]})
    assert np.allclose(K.load_backend(table, "e", "whitened_cosine").matrix, white.matrix)
    s = spark.createDataFrame([("a",), ("b",)], "speaker_id string")
    with pytest.raises(K.BackendFitError):
        K.assert_no_leakage(s, s.filter("speaker_id = 'a'"))


def test_logistic_is_at_the_optimum(spark):
    rows, df = make(spark, groups=1, ties=False)
    fit = C.fit_logistic(df)
    s, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    w = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    g = w * (1 / (1 + np.exp(-(fit.slope * s + fit.intercept))) - y)
    assert abs(g.sum()) < 1e-5 and abs((g * s).sum()) < 1e-5
    aff = C.fit_affine_llr(df, "score")
    assert aff.slope == pytest.approx(fit.slope, rel=1e-3)
    with pytest.raises(ValueError):
        C.fit_logistic(df.filter("label = 1"))
