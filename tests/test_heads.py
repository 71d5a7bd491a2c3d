import numpy as np
import pytest
from pyspark.sql import functions as F

from verispark.operators import backends as K
from verispark.operators import heads as H


def brute_fit(x, y, penalty, steps=60):
    """Coefficients on inputs as they are, by plain Newton steps on standardised ones."""
    mean, std = x.mean(0), x.std(0)
    scale = np.divide(1.0, std, out=np.zeros(len(std)), where=std > 0)
    z = np.column_stack([(x - mean) * scale, np.ones(len(x))])
    w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    ridge = np.append(np.full(x.shape[1], penalty), 0.0)
    b = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ b)))
        hessian = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        b = b - np.linalg.lstsq(hessian, z.T @ (w * (p - y)) + ridge * b, rcond=None)[0]
    coef = b[:-1] * scale
    return coef, b[-1] - coef @ mean


def cost(llr, y):
    return (np.logaddexp(0, -llr[y == 1]).mean() + np.logaddexp(0, llr[y == 0]).mean()) / 2 / np.log(2)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(600):
        y = int(rng.random() < 0.3)
        a, b = rng.normal(1.3 * y, 1), rng.normal(0.5 * y, 2)
        rows.append((float(a), float(b), float(a + b), 7.0, y, "ab"[k % 2], ["train", "validation"][k % 3 == 0]))
    df = spark.createDataFrame(rows, "a double, b double, both double, same double, label int, g string, part string").repartition(5)
    return rows, df


def arrays(rows, columns, part=None, group=None):
    at = {"a": 0, "b": 1, "both": 2, "same": 3}
    some = [r for r in rows if (part is None or r[6] == part) and (group is None or r[5] == group)]
    return np.array([[r[at[c]] for c in columns] for r in some]), np.array([r[4] for r in some])


def test_models_of_one_pass_equal_single_fits(spark, data):
    rows, df = data
    specs = {
        "one": H.Spec(("a",), 0.0), "two": H.Spec(("a", "b"), 0.1), "deficient": H.Spec(("a", "b", "both", "same"), 1.0),
        "first": H.Spec(("b", "a"), 0.01, "a"), "second": H.Spec(("b", "a"), 0.01, "b"),
    }
    heads = H.fit_heads(df, specs, by="g")
    for name, spec in specs.items():
        x, y = arrays(rows, spec.features, group=spec.group)
        coef, intercept = brute_fit(x, y, spec.penalty)
        assert heads[name].coef == pytest.approx(coef, abs=1e-7) and heads[name].intercept == pytest.approx(intercept, abs=1e-7), name
    out = {(r.a, r.system): r.llr for r in H.scored(df, heads, ["a"]).collect()}
    x, _ = arrays(rows, ("a", "b"))
    assert out[(rows[0][0], "two")] == pytest.approx(heads["two"].coef @ x[0] + heads["two"].intercept)
    exact = df.select("a", heads["two"].column().alias("s")).filter(F.col("a") == rows[0][0]).first()
    assert exact.s == pytest.approx(out[(rows[0][0], "two")])


def test_calibrated_choice(spark, data):
    """C with the lowest Cllr on validation, and scale and bias that no small change improves."""
    rows, df = data
    train, val = (df.filter(F.col("part") == p) for p in ("train", "validation"))
    grid = [0.001, 1.0, 100.0]
    found = H.fit_calibrated(train, val, {"m": ["a", "b"], "n": ["b"]}, grid)
    for mode, cols in (("m", ["a", "b"]), ("n", ["b"])):
        costs = {}
        for c in grid:
            coef, intercept = brute_fit(*arrays(rows, cols, "train"), 1 / c)
            x, y = arrays(rows, cols, "validation")
            slope, bias = brute_fit((x @ coef + intercept)[:, None], y, 0.0)
            costs[f"C={c:g}"] = cost(slope * (x @ coef + intercept) + bias, y)
        best = min(costs, key=costs.get)
        assert found[mode].cllr == pytest.approx(costs[best], abs=1e-9)
        assert found[mode].setting == best or costs[found[mode].setting] == pytest.approx(costs[best], abs=1e-12)
        x, y = arrays(rows, cols, "validation")
        llr = x @ found[mode].llr().coef + found[mode].llr().intercept
        assert cost(llr, y) == pytest.approx(found[mode].cllr, abs=1e-9)


def test_scale_stays_in_range(spark):
    """Separable scores: the scale stops at its edge; scores that point the wrong way keep a positive scale."""
    df = spark.createDataFrame([(float(k), int(k >= 10)) for k in range(20)], "s double, label int")
    for sign, edge in ((1.0, np.exp(8.0)), (-1.0, np.exp(-8.0))):
        head = H.Linear(("s",), np.array([sign]), 0.0)
        assert H.calibrate_heads(df, {"h": head})["h"].affine.slope == pytest.approx(edge)


def test_errors(spark, data):
    _, df = data
    with pytest.raises(ValueError, match="both target"):
        H.fit_heads(df.filter("label = 1"), {"m": H.Spec(("a",))})
    with pytest.raises(Exception, match="non-finite"):
        H.fit_heads(df.withColumn("a", F.when(F.col("a") > 1, F.col("a"))), {"m": H.Spec(("a",))})
    with pytest.raises(ValueError, match="missing"):
        H.frozen_eval(df, df, ["a", "nothing"], ["label"])
    frozen = H.frozen_eval(df, df, ["a", "b"], ["label"])
    assert frozen.columns == ["label", "llr"] and frozen.count() == 600


def test_backends_in_two_joins_equal_single_scores(spark):
    rng = np.random.default_rng(1)
    people = spark.createDataFrame([(f"u{k}", f"s{k // 4}", rng.normal(size=5).tolist()) for k in range(60)], "utterance string, speaker string, vec array<double>")
    trials = spark.createDataFrame([(f"t{k}", f"u{k}", f"u{59 - k}") for k in range(30)], "trial_id string, enroll_utt string, test_utt string")
    nobody = spark.createDataFrame([], "speaker_id string")
    fitted = {m: K.fit_backend(m, people, held_out=nobody) for m in K.FITTERS}
    many = K.score_backends(trials, people, {f"x_{m}": ("vec", b) for m, b in fitted.items()})
    assert "BroadcastNestedLoopJoin" not in many._jdf.queryExecution().toString()
    got = {r.trial_id: r for r in many.collect()}
    for m, b in fitted.items():
        for r in K.score_backend(trials, people, b).collect():
            assert got[r.trial_id][f"x_{m}"] == pytest.approx(r[f"score_{m}"], abs=1e-12)
    blocked = K.Backend("lda_cosine", status="blocked", meta={"reason": "too few"})
    assert K.score_backends(trials, people, {"l": ("vec", blocked)}, blocked="null").filter("l is null").count() == 30
    with pytest.raises(K.BackendFitError, match="too few"):
        K.score_backends(trials, people, {"l": ("vec", blocked)})


def test_set_hash_ignores_order_and_partitions(spark):
    names = spark.range(5000).selectExpr("concat('spk', id) as n")
    one, two = (K.set_hash(names.repartition(k).orderBy(F.rand(k)), "n", "h").first().h for k in (1, 7))
    assert one == two != K.set_hash(names.limit(4999), "n", "h").first().h
