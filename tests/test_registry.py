"""Registered queries next to their SQL, on the smallest of the given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def comparable(names, records):
    order = sorted(names)
    places = [names.index(n) for n in order]
    return order, sorted(([plain(r[p]) for p in places] for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_agrees_with_its_sql(spark, con, name):
    df = entry_points.queries()[name](spark, DATA)
    result = con.execute(entry_points.oracle_sql()[name])
    expected = comparable([d[0] for d in result.description], result.fetchall())
    assert comparable(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
