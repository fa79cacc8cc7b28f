"""Every query against its oracle on the smallest tables; queries without one must run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, list):
        return tuple(map(plain, x))
    if hasattr(x, "to_eng_string"):
        return round(float(x), 9)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    oracle = entry.oracle_sql().get(name)
    if oracle:
        found = duck.sql(oracle)
        assert sorted(df.columns) == sorted(found.columns)
        assert rows(df.columns, got) == rows(found.columns, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
