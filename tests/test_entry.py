"""Each query against its SQL over the smallest tables, and the rest for rows and columns."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from loamline.plans import queries as core

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    return x


def compare(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.select(*columns).collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    ran = duck.execute(sql)
    names = [d[0] for d in ran.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in ran.fetchall()]
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    compare(spark, duck, name)


def test_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
