"""Clean a document table for training, in stages that each use one operator.

Every stage takes (spark, docs, folder) and returns a table; `run` writes each
result to the shared folder and reads it back for the next stage. All but the
last return the columns of the documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import exact_dedup, language_id, mixing, near_dedup, sentencepiece_codec
from netloom.llm.common import scratch_of, written


def stage(fn):
    """A stage drops the intermediate tables of the one before, whose result is stored by then."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        with scratch_of(spark, "pipeline"):
            return fn(spark, docs, folder)

    return run_stage


@stage
def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a letter; a missing language is filled with the predicted one."""
    return language_id.keep_identified(docs)


@stage
def exact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each text."""
    return exact_dedup.drop_copies(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    return near_dedup.drop_near_copies(docs)


@stage
def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """A sample whose token shares follow tempered source, language and topic targets."""
    return mixing.sample(docs)


@stage
def pieces(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids under merge-dropout, with the flag that they decode to the text."""
    coded = sentencepiece_codec.encode(docs, lossless="lossless")
    return coded.selectExpr("doc_id", "lang", "source", "size(token_ids) AS n_tokens", "token_ids", "lossless")


STAGES = [
    ("language", language),
    ("exact copies", exact),
    ("near copies", near),
    ("mixing", mix),
    ("pieces", pieces),
]

# Stages 1, 3 and 5 are not expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = written(step(spark, docs, folder), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, folder)
