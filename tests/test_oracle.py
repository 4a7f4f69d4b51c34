"""Every registered query against its reference SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from netloom.plans.registry import DRIVER_TABLES, QUERIES
from tools.check import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in DRIVER_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    verdict, _ = compare(spark, con, FOLDER, name, entry.oracle_sql().get(name))
    assert not verdict.startswith("FAIL"), verdict
    assert "types" not in verdict, verdict


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"server", "remote", "clients", "score", "mode"}
