"""Every query against its SQL on the smallest tables; the SQL runs in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from flowloom.plans.queries import QUERIES, SQL


@pytest.fixture(scope="session")
def tables(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, tables, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in SQL:
        assert got
        return
    want = tables.sql(SQL[name])
    names = sorted(want.columns)
    assert names == sorted(df.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted(repr([plain(r[n]) for n in names]) for r in got) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
