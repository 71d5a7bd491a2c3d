"""Cases of the fourth round's findings."""

from functools import partial

import duckdb
import numpy as np
import pytest
from test_larger import compare

from verispark.functions import features as X
from verispark.operators import heads as H
from verispark.operators import metrics as M
from verispark.plans.decision_queries import META, SCORES


def test_cut_points_are_found_once(spark):
    """Totals and rows of a ranking read the same cut points; approximate ones would differ at each evaluation."""
    df = spark.createDataFrame([("a", k % 2, k / 900) for k in range(900)], "k string, label int, score double")
    out = M.roc_from_counts(M.score_counts(df, ["k"]), ["k"])
    assert "percentile_approx" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.score: r.cum_t + r.cum_n for r in out.collect()} == {k / 900: 900 - k for k in range(900)}


@pytest.mark.parametrize("name", ["platt_fit", "group_decisions", "group_summary", "group_features"])
def test_groups_of_one_class_equal_sql(spark, name):
    """The smallest tables have groups of target trials only."""
    compare(spark, "/root/testdata/sf0.001", name)


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """The smallest tables with order lines that share key, number and price, hence the trial id, but nothing else."""
    d, sf = tmp_path_factory.mktemp("shared"), "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"copy (select * from '{sf}/embeddings.parquet') to '{d}/embeddings.parquet'")
    more = f"select * replace (l_suppkey + 3 as l_suppkey, l_partkey + 5 as l_partkey) from '{sf}/lineitem.parquet' where l_orderkey % 100 = 1"
    con.execute(f"copy (select * from '{sf}/lineitem.parquet' union all {more}) to '{d}/lineitem.parquet'")
    return str(d)


@pytest.mark.parametrize("name", ["metadata_join", "stream_resume", "resplit_wide", "rich_expand", "score_entropy"])
def test_trials_that_share_an_id_equal_sql(spark, shared, name):
    compare(spark, shared, name)


def test_tasks_expand_as_columns_do(spark):
    """The 112 features of a matrix are those of the columns, and heads fitted on ten packed inputs equal heads on all."""
    rng = np.random.default_rng(4)
    rows = [[*rng.normal(size=6), float(rng.integers(2)), *rng.random(3)] for _ in range(500)]
    rows[0][:6] = [0.25] * 6
    df = spark.createDataFrame([(*map(float, r), int(r[0] + rng.normal() > 0.5)) for r in rows], [*SCORES, *META, "label"]).repartition(3)
    names = X.rich_names(SCORES, META)
    wide = X.rich_expand(df, SCORES, META, keep=["label"])
    assert wide.columns == ["label", *names] and len(names) == 112
    assert np.array(df.collect())[:, :10].shape == (500, 10)
    want = np.array(sorted(tuple(r)[1:] for r in wide.collect()))
    got = X.rich_matrix(np.array(rows), SCORES, META)
    assert np.array(sorted(map(tuple, got))) == pytest.approx(want, abs=1e-12)
    expand = H.Expansion((*SCORES, *META), tuple(names), partial(X.rich_matrix, scores=SCORES, meta=META))
    specs = {"all": H.Spec(tuple(names), 1.0), "few": H.Spec(tuple(names[:30]), 0.1)}
    one, two = H.fit_heads(wide, specs), H.fit_heads(df, specs, expand=expand)
    for k in specs:
        assert two[k].coef == pytest.approx(one[k].coef, abs=1e-7)
    scores = [sorted(r.llr for r in H.scored(f, {"all": one["all"]}, ["label"], expand=e).collect()) for f, e in ((wide, None), (df, expand))]
    assert scores[1] == pytest.approx(scores[0], abs=1e-9)


def test_streams_meet_vectors_in_cells(spark, tmp_path, monkeypatch):
    """A batch with many trials to an utterance is scored in cells, one with few by plain joins; both give the same."""
    from pyspark.sql import functions as F

    from verispark.operators import scoring as J
    from verispark.streaming import incremental as I

    monkeypatch.setattr(J, "BROADCAST_BYTES", 0)
    vectors = spark.createDataFrame([(f"u{k}", [1.0 + k, 2.0 - k]) for k in range(9)], "utterance string, e array<double>")
    spark.createDataFrame([(f"t{k}", f"u{k % 9}", f"u{k * 5 % 9}") for k in range(200)], "trial_id string, enroll_utt string, test_utt string").write.parquet(f"{tmp_path}/in")
    seen, cells = [], J.in_cells
    monkeypatch.setattr(J, "in_cells", lambda *a: seen.append(1) or cells(*a))

    def run(name, **size):
        stream = spark.readStream.schema("trial_id string, enroll_utt string, test_utt string").parquet(f"{tmp_path}/in")
        I.score_available(stream, vectors, ["e"], lambda: F.col("score_e").alias("llr"), ["trial_id", "llr"], f"{tmp_path}/{name}", f"{tmp_path}/{name}-state", dim=2, **size)
        return {r.trial_id: r.llr for r in spark.read.parquet(f"{tmp_path}/{name}").collect()}

    plain = run("plain")
    assert not seen and len(plain) == 200
    assert run("cells", utterances=9) == pytest.approx(plain, abs=1e-12) and seen
    few = spark.createDataFrame([("t", "u1", "u2")], "trial_id string, enroll_utt string, test_utt string")
    assert not J.cells_move_less(few, 9, 100)
