"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["events", "documents", "pages", "benchmark", "conversations"]


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert contract.QUERIES.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    df = contract.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([r[c] for c in columns] for r in df.collect()), key=repr)
    cursor = tables.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted(([r[names.index(c)] for c in columns] for r in cursor.fetchall()), key=repr)
    assert got == expected and got


def test_entry(spark):
    assert contract.entry(spark).count() > 0
