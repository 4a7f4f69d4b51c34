"""Registered training-data queries against their reference SQL, and the pipeline."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from netloom.llm import queries
from netloom.plans.registry import DRIVER_TABLES
from tools.check import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in DRIVER_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    verdict, _ = compare(spark, con, FOLDER, name, entry.oracle_sql().get(name))
    assert not verdict.startswith("FAIL"), verdict


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    junk = spark.createDataFrame(
        [(-1, "1234 5678 ...", "en", "src0", 13), (-2, None, None, None, None), (-3, "", "en", "src0", 0)], docs.schema
    )
    df = docs.unionByName(junk)
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, FOLDER).cache()
        assert df.columns == docs.columns
        counts.append(df.count())
    assert counts[0] == docs.count()
    assert counts[1] == docs.select("text").distinct().count()
    assert counts == sorted(counts, reverse=True)
    last = corpus_pipeline.STAGES[-1][1](spark, df, FOLDER)
    assert last.count() == counts[-1] and last.where("NOT lossless").count() == 0


def test_pipeline_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.where(~F.col("lossless")).count() == 0 and rows.count() > 0
