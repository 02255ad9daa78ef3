"""Queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = [k for k in entry.registry.queries()]


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, str, bool)) else str(v)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query(spark, data, con, name):
    df = entry.queries()[name](spark, data)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cols = sorted(df.columns)
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    theirs = sorted(repr([norm(x[names.index(c)]) for c in cols]) for x in r.fetchall())
    assert sorted(repr([norm(x[c]) for c in cols]) for x in rows) == theirs


def test_entry(spark, data):
    assert entry.entry(spark).limit(1).count() == 1
