"""Registered queries of the training-data operators, and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import (
    exact_dedup,
    language_id,
    line_dedup,
    mixing,
    near_dedup,
    periodic_runs,
    quality_rules,
    sentencepiece_codec,
    suffix_dedup,
    token_counts,
    training_order,
    warc,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a table reader as the query `name`."""

    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op4_language_id")
def language(table):
    return language_id.language_report(table("documents"))


@query("op5_sentencepiece")
def pieces(table):
    docs = table("documents").select("doc_id", "text")
    return sentencepiece_codec.encode(docs, lossless="lossless").selectExpr(
        "doc_id", "size(token_ids) AS n_tokens", "token_ids", "lossless"
    )


@query("op6_token_counts")
def tokens(table):
    return token_counts.token_report(table("documents"))


@query("op7_minhash")
def near(table):
    return near_dedup.near_report(table("documents"))


@query(
    "op10_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)
def exact(table):
    return exact_dedup.exact_report(table("documents"))


@query("op1_mixing", mixing.report_sql())
def mixed(table):
    return mixing.mixing_report(table("documents"))


@query("op9_quality_rules", quality_rules.REPORT_SQL)
def quality(table):
    return quality_rules.quality_report(table("documents"))


@query("op3_warc_revisits", warc.REPORT_SQL)
def revisits(table):
    return warc.revisit_report(table("pages"))


@query("op2_training_order")
def ordered(table):
    return training_order.order_report(table("documents"))


@query("op8_suffix_dedup")
def repeats(table):
    return suffix_dedup.suffix_report(table("documents"))


@query("op11_whitening")
def whitened(table):
    return whitening.whitening_report(table("embeddings"))


@query("op12_line_dedup", line_dedup.REPORT_SQL)
def lines(table):
    return line_dedup.line_report(table("documents"))


@query("op13_periodic_runs")
def periodic(table):
    return periodic_runs.runs_report(table("documents"))
