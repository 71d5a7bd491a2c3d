"""A sample of registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "lineitem embeddings documents labels".split()
SAMPLE = ["metric_block", "speaker_manifest", "duration_features", "asnorm_cosine", "group_caps", "coverage_curve", "stream_scoring"]


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(r[i] for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    want = _rows([c[0] for c in cur.description], cur.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert list(a) == pytest.approx(list(b), abs=2e-6) if not any(isinstance(v, str) for v in a) else repr(a) == repr(b)


def test_registry_is_consistent(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 18
