"""Every registered query against its SQL, on the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog.plans.compare import difference, oracle_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return connection


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    rows = spark_rows(entry.queries()[name](spark, SF))
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        assert difference(rows, oracle_rows(con, sql)) is None
