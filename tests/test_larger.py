"""Queries on tables whose sizes the given ones never have, against their SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F
from test_queries import _rows
from verispark.operators import analysis as A
from verispark.operators import backends as K
from verispark.operators import scoring as J
from verispark.operators.protocol import split_sizes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The smallest tables with 53 speakers, the last of them with six utterances."""
    d = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    more = f"select vec_id + 500 as vec_id, list_reverse(embedding) as embedding, label from '{SF}/embeddings.parquet' where vec_id < 26"
    con.execute(f"copy (select * from '{SF}/embeddings.parquet' union all {more}) to '{d}/embeddings.parquet'")
    con.execute(f"copy (select * from '{SF}/lineitem.parquet') to '{d}/lineitem.parquet'")
    return str(d)


def compare(spark, d, name):
    con = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    want = _rows([c[0] for c in cur.description], cur.fetchall())
    df = entry.queries()[name](spark, d)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert [x for x in a if not isinstance(x, float)] == [x for x in b if not isinstance(x, float)]
        assert [x for x in a if isinstance(x, float)] == pytest.approx([x for x in b if isinstance(x, float)], abs=2e-6)


def test_split_sizes_leave_the_rest_to_test():
    assert split_sizes(1026, 0.6, 0.2, "test") == {"calibration": 615, "validation": 205, "test": 206}
    assert split_sizes(53, 0.5, 0.0, "test") == {"calibration": 26, "test": 27}
    assert split_sizes(1026, 0.6, 0.2) == {"calibration": 616, "validation": 205, "test": 205}
    with pytest.raises(ValueError):
        split_sizes(5, 0.6, 0.2, "validation")


@pytest.mark.parametrize("name", ["speaker_manifest", "split_protocol", "alignment_audit", "resplit_wide", "asnorm_cohort"])
def test_odd_speaker_count_equals_sql(spark, odd, name):
    compare(spark, odd, name)


def _cell_case(spark):
    name = lambda k: f"s/{k % 7}/{k}"
    vectors = [(name(k), [float(k % 5) - 1.5, 1.0 + k, -0.25 * k], [0.5, float(k)]) for k in range(40)]
    vectors += [("none", None, [1.0, 2.0]), ("zero", [0.0, 0.0, 0.0], [1.0, 1.0])]
    trials = [(i, name(i * 7 % 40), name(i * 11 % 40)) for i in range(300)]
    trials += [(1000, "none", name(3)), (1001, name(4), "zero"), (1002, "gone", name(1)), (1003, name(1), None)]
    schema = "utterance string, a array<double>, b array<double>"
    return spark.createDataFrame(trials, "trial_id int, enroll_utt string, test_utt string"), spark.createDataFrame(vectors, schema)


def test_cells_give_what_plain_joins_give(spark, monkeypatch):
    trials, vectors = _cell_case(spark)

    def run(how, **size):
        wide = J.score_wide(trials, vectors, ["a", "b"], on_missing=how, utterances=size.get("rows"), dim=3)
        many = J.similarity_columns(trials, vectors, ["a", "b"], ["cosine", "neg_l1_raw"], on_missing=how, dim=3, **size)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (wide, many)]
        return [{tuple(sorted(r.asDict().items())) for r in df.collect()} for df in (wide, many)], plans

    monkeypatch.setattr(J, "BROADCAST_BYTES", 0)
    for how, rows in (("null", 304), ("skip", 302)):
        plain, _ = run(how)
        cells, plans = run(how, rows=42)
        assert cells == plain and [len(x) for x in cells] == [rows, rows]
        assert all("MapInArrow" in p and "SortMergeJoin" not in p for p in plans)
    with pytest.raises(Exception, match="no embedding"):
        J.score_wide(trials, vectors, ["a"], utterances=42, dim=3).collect()
    assert J.side_blocks(trials, 10**9, 1000) is None and J.side_blocks(trials, None, 1000) is None


def test_backends_in_cells_give_what_plain_joins_give(spark, monkeypatch):
    """All kinds of backends; neither a projection nor a vector leaves a cell."""
    rng = np.random.default_rng(5)
    name = lambda k: f"s/{k % 7}/{k}"
    people = [(name(k), rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for k in range(40)] + [("zero", [0.0] * 4, [1.0] * 4)]
    trials = [(i, name(i * 7 % 40), name(i * 11 % 40)) for i in range(300)] + [(300, "zero", name(1)), (301, "gone", name(2))]
    people = spark.createDataFrame(people, "utterance string, a array<double>, b array<double>")
    trials = spark.createDataFrame(trials, "trial_id int, enroll_utt string, test_utt string")
    square, mean = rng.normal(size=(4, 4)), rng.normal(size=4)
    fitted = {
        "cos": ("a", K.Backend("cosine")),
        "centred": ("a", K.Backend("centered_cosine", mean)),
        "white": ("b", K.Backend("whitened_cosine", mean, square[:, :3])),
        "maha": ("b", K.Backend("neg_mahalanobis", matrix=square @ square.T)),
        "as": ("b", K.Backend("asnorm_cosine", matrix=rng.normal(size=(20, 4)), meta={"top_k": "5", "sigma_floor": "1e-4"})),
        "none": ("a", K.Backend("lda_cosine", status="blocked")),
    }
    monkeypatch.setattr(J, "BROADCAST_BYTES", 0)

    def run(rows):
        df = K.score_backends(trials, people, fitted, blocked="null", on_missing="null", rows=rows)
        return {r.trial_id: r.asDict() for r in df.collect()}, df

    (plain, _), (cells, df) = run(None), run(41)
    assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert set(cells) == set(plain) == set(range(302)) and cells[300]["cos"] is None and cells[301]["white"] is None
    for i, want in plain.items():
        assert cells[i] == {k: v if v is None or isinstance(v, str) else pytest.approx(v, abs=1e-9) for k, v in want.items()}
    assert sum(K._brought_bytes(b, 4) for _, b in fitted.values()) < 1500  # a cohort is not what an utterance brings
    with pytest.raises(Exception, match="no embedding"):
        K.score_backends(trials, people, fitted, blocked="null", rows=41).collect()


def test_rank_correlations_equal_plain_ranks(spark, monkeypatch):
    """Ties, gaps, a constant, one very frequent value; blocks and ranges smaller than the rows."""
    monkeypatch.setattr(A, "RANGES", 8)
    rng = np.random.default_rng(3)
    rows = []
    for e in ("a", "b", None):
        for k in range(700):
            x = float(rng.normal())
            rows.append((e, f"t{k}", x, round(x + float(rng.normal()), 1), 1.0, 0.0 if k % 3 else x, [x * x, None, float("nan")][k % 3], None))
    names = ["v", "w", "constant", "often", "gaps", "nothing"]
    df = spark.createDataFrame(rows, "encoder string, trial_id string, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {(r.encoder, r.metric, r.reference_metric): r for r in A.metric_redundancy(df, names, reference="v").collect()}
    assert {k[0] for k in got} == {"a", "b"}
    for e, of in pd.DataFrame(rows, columns=["encoder", "trial_id", *names]).groupby("encoder"):
        ranks = of[names].astype(float).rank()
        for a in names:
            r = got[e, a, "v"]
            both = ranks[a].notna() & ranks["v"].notna()
            want = np.corrcoef(ranks[a][both], ranks["v"][both])[0, 1] if a not in ("constant", "nothing") else None
            assert r.spearman == (want if want is None else pytest.approx(want, abs=1e-9)) and r.finite_count == both.sum()
            assert r.unique_value_count == (of[a].astype(float).nunique() or None)


def test_counts_are_made_once(spark, tmp_path):
    """Cut points, totals and rows of a ranking read the same counts: what makes them runs once."""
    from verispark.operators import metrics as M

    seen = str(tmp_path / "seen")

    def noted(batches):
        with open(seen, "a") as out:
            for batch in batches:
                out.write("x" * batch.num_rows)
                yield batch

    df = spark.createDataFrame([("a", k % 2, k / 60) for k in range(60)], "k string, label int, score double").coalesce(1)
    assert M.eer(df.mapInArrow(noted, df.schema), ["k"]).count() == 1
    with open(seen) as out:
        assert len(out.read()) == 60


def test_scores_without_ids(spark):
    """Scores that are only ranked are those of the trials with ids, of the splits asked for."""
    from verispark.sources import fixtures as fx

    d = "/root/testdata/sf0.001"
    parts = ("calibration", "test")
    want = fx.scored_long(spark, d).filter(F.col("split").isin(*parts)).drop("trial_id")
    got = fx.scores_long(spark, d, parts)
    assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
