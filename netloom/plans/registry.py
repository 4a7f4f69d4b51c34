"""Names queries and pairs them with their reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.plans.views import VIEWS

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def wall_clock(df: DataFrame) -> DataFrame:
    """Zoned timestamps (date_trunc makes them) as UTC wall clocks."""
    zoned = [name for name, kind in df.dtypes if kind == "timestamp"]
    return df.withColumns({n: F.col(f"`{n}`").cast("timestamp_ntz") for n in zoned}) if zoned else df


class Tables:
    """Resolves driver tables and the views over them for one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __call__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return wall_clock(self.sql(VIEWS[name]))
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run SQL in which `{name}` stands for a table or view."""
        names = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{name: self(name) for name in names})


def _mentioned(sql: str) -> list[str]:
    """Views a text uses, directly or through other views, in definition order."""
    used = {name for name in VIEWS if re.search(rf"\b{name}\b", sql)}
    while True:
        more = {v for name in used for v in re.findall(r"\{(t_\w+)\}", VIEWS[name])} - used
        if not more:
            return [name for name in VIEWS if name in used]
        used |= more


def _with_views(sql: str) -> str:
    """Prefix the views a reference SQL mentions as common table expressions."""
    used = _mentioned(sql)
    if not used:
        return sql
    parts = []
    for name in used:
        body = re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])
        parts.append(f"{name} AS ({body})")
    views = ",\n".join(parts)
    sql = sql.strip()
    for lead in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(lead):
            return f"{lead}{views},\n{sql[len(lead):]}"
    return f"WITH {views}\n{sql}"


def query(name: str, sql: str | None = None):
    """Register a function of `Tables` as the query `name`."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: wall_clock(fn(Tables(spark, folder)))
        if sql is not None:
            ORACLES[name] = _with_views(sql)
        return fn

    return register
