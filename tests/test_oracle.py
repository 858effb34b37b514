"""Every query with SQL gives the same rows, values and types as DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from loomgraph import catalogue

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return c


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    want = con.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(want.columns, map(str, want.types)))
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(cell(r[i]) for i in at) for r in want.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(catalogue.QUERIES) >= 60
