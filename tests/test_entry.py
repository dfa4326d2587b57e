"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: "NULL" if v is None or isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(show(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    said = duck.sql(SQL[name])
    assert canon(got.columns, got.collect()) == canon(said.columns, said.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
