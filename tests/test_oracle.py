"""Every registered query with oracle SQL matches DuckDB on sf0.01 (strict compare)."""

import pytest

from tools.oracle_check import compare, duck

import __spark_entry__ as entry

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck("/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.01")
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    verdict = compare(rows, df.columns, res.fetchall(), cols)
    assert verdict.startswith("ok"), verdict


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert len(df.columns) > 0
