"""Reputation histories per address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.net import ip_net, p_public_ip

DOCUMENT = "map<string,map<string,bigint>>"
RAW = "map<string,map<string,string>>"
KEYS = ["ip", "kind", "date"]


def compact(incidents: DataFrame) -> DataFrame:
    """Total per (ip, date, kind)."""
    return incidents.groupBy("ip", "date", "kind").agg(F.sum("cnt").alias("cnt"))


def histories(incidents: DataFrame, v6_nets: bool = False, legacy: bool = False) -> DataFrame:
    """Counts per (ip, kind, date) of public addresses; with `v6_nets` also per /64."""
    rows = compact(incidents)
    if v6_nets:
        net = F.concat(ip_net("ip", 64), F.lit("/64"))
        both = F.when(F.contains("ip", F.lit(":")), F.array("ip", net)).otherwise(F.array("ip"))
        rows = rows.where(p_public_ip("ip", legacy)).withColumn("ip", F.explode(both))
        return rows.groupBy(*KEYS).agg(F.sum("cnt").alias("cnt"))
    return rows.where(p_public_ip("ip", legacy)).select(*KEYS, "cnt")


def documents(rows: DataFrame) -> DataFrame:
    """One document {kind: {date: count}} per address from history rows.

    A list holds the days of one kind, then the kinds of one address: both are
    bounded by the calendar and the kinds, not by the incidents. Rows without a
    kind or a date have no place in a document and go; readers report such lines.
    """
    per_kind = rows.where("kind IS NOT NULL AND date IS NOT NULL").groupBy("ip", "kind").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("date").cast("string"), "cnt")))).alias("days")
    )
    return per_kind.groupBy("ip").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", F.map_entries("days").alias("days"))))).alias("raw")
    ).select("ip", F.transform_values("raw", lambda k, v: F.map_from_entries(v)).alias("data"))


def reputation(incidents: DataFrame, v6_nets: bool = False, legacy: bool = False) -> DataFrame:
    """Reputation documents of the public addresses in an incident list."""
    return documents(histories(incidents, v6_nets, legacy))


def to_json(docs: DataFrame) -> DataFrame:
    return docs.select("ip", F.to_json("data").alias("data"))


def _readable(date, count):
    return date.try_cast("date").isNotNull() & count.try_cast("bigint").isNotNull()


def from_json(lines: DataFrame) -> DataFrame:
    """Documents of JSON lines; entries without a date or a count are in `rejected_entries`."""

    def days(kind, entries):
        kept = F.map_filter(entries, _readable)
        return F.transform_values(kept, lambda date, count: count.try_cast("bigint"))

    return lines.select("ip", F.transform_values(F.from_json("data", RAW), days).alias("data"))


def rejected_entries(lines: DataFrame) -> DataFrame:
    """What `from_json` cannot read of JSON lines (ip, data): ip, raw and reason, in one pass.

    A line without an address or a document, a kind without days, a date that is
    none and a count that is no long are a row each.
    """

    def problem(raw, reason: str):
        return F.struct(raw.cast("string").alias("raw"), F.lit(reason).alias("reason"))

    def of_entry(kind, entry):
        raw = F.concat_ws(" ", kind, entry["key"], entry["value"])
        wrong = F.when(entry["key"].try_cast("date").isNull(), "unreadable date").otherwise("unreadable count")
        return F.struct(raw.alias("raw"), wrong.alias("reason"))

    def of_kind(kind):
        bad = F.filter(F.map_entries(kind["value"]), lambda e: ~_readable(e["key"], e["value"]))
        none = F.array(problem(kind["key"], "kind without days"))
        return F.when(kind["value"].isNull(), none).otherwise(F.transform(bad, lambda e: of_entry(kind["key"], e)))

    doc = F.from_json("data", RAW)
    found = (
        F.when(F.length(F.coalesce("ip", F.lit(""))) == 0, F.array(problem(F.col("data"), "no address")))
        .when(doc.isNull(), F.array(problem(F.col("data"), "unreadable document")))
        .otherwise(F.flatten(F.transform(F.map_entries(doc), of_kind)))
    )
    return lines.select("ip", F.inline(found))


def exploded(docs: DataFrame) -> DataFrame:
    """History rows of documents; a date that is none goes."""
    kinds = docs.select("ip", F.explode("data").alias("kind", "days"))
    return kinds.select("ip", "kind", F.explode("days").alias("date", "cnt")).withColumn(
        "date", F.col("date").try_cast("date")
    ).where("date IS NOT NULL")


def merge_reputation(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents whose counts are the sums of two sets of documents."""
    rows = exploded(old).unionByName(exploded(new))
    return documents(rows.groupBy(*KEYS).agg(F.sum("cnt").alias("cnt")))
