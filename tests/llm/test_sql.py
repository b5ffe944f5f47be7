"""Operators that SQL can express, against DuckDB over the whole table."""

import os

import duckdb
import pytest

from ledgerflow.llm import queries

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect())))
    con = duckdb.connect()
    for file in os.listdir(DIR):
        con.execute(f"create view {file.split('.')[0]} as select * from read_parquet('{DIR}/{file}')")
    rel = con.sql(queries.ORACLE[name])
    assert sorted(rel.columns) == columns
    assert got == sorted(map(str, rel.select(*columns).fetchall()))
