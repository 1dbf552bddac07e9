"""Every query with SQL gives the same rows in both engines."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point
from corpuslab.plans.catalog import QUERIES
from corpuslab.plans.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield connection
    connection.close()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (bool, int, str)):
        return value
    return round(float(value), 9)


def sorted_rows(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, database, name):
    result = QUERIES[name](spark, FOLDER)
    columns = sorted(result.columns)
    found = sorted_rows(tuple(r[c] for c in columns) for r in result.collect())
    cursor = database.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert found == sorted_rows(tuple(r[i] for i in order) for r in expected)
    assert found


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
