"""Readers with declared schemas, and parsers of text formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.net import ip_bin, parse_set_item
from netloom.operators.reputation import from_json, rejected_entries, to_json
from netloom.schemas import TABLES


JDBC_SPLIT = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def read_table(spark: SparkSession, name: str, path: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """A telemetry table, from parquet files or over JDBC.

    `jdbc` holds the reader options. It must have partitionColumn, lowerBound,
    upperBound and numPartitions, which split the read over the executors.
    """
    if path is not None:
        return spark.read.schema(TABLES[name]).parquet(path)
    missing = [option for option in JDBC_SPLIT if option not in (jdbc or {})]
    if missing:
        raise ValueError(f"the read would be one task without {', '.join(missing)}")
    rows = spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    wanted = spark.createDataFrame([], TABLES[name]).schema
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])


def write_table(df: DataFrame, path: str, time: str | None = None) -> None:
    """A table as parquet, partitioned by the date of its time column.

    Only the partitions in `df` are replaced.
    """
    rows = df if time is None else df.withColumn("day", F.to_date(time)).hint("rebalance", "day")
    out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (out if time is None else out.partitionBy("day")).parquet(path)


def _incident_lines(spark: SparkSession, paths) -> DataFrame:
    """Incident lines with `raw`, the line itself where it is damaged or lacks a field."""
    schema = spark.createDataFrame([], TABLES["incidents"]).schema
    lines = spark.read.schema(schema.add("raw", "string")).option("columnNameOfCorruptRecord", "raw").csv(paths)
    fields = [F.col(c) for c in lines.columns if c != "raw"]
    lacking = reduce(lambda a, b: a | b, [c.isNull() for c in fields])
    return lines.withColumn("raw", F.when(lacking, F.coalesce("raw", F.to_csv(F.struct(*fields)))).otherwise(F.col("raw")))


def read_incidents(spark: SparkSession, paths) -> DataFrame:
    """Header-less `ip,date,count,kind` lines; .gz and .bz2 files are unpacked.

    Damaged lines and lines without one of the fields are in `rejected_incidents`.
    """
    return _incident_lines(spark, paths).where(F.col("raw").isNull()).drop("raw")


def rejected_incidents(spark: SparkSession, paths) -> DataFrame:
    """Lines (raw) that `read_incidents` leaves out, with the reason."""
    lines = _incident_lines(spark, paths).where(F.col("raw").isNotNull())
    return lines.select("raw", F.lit("damaged or incomplete line").alias("reason"))


def write_incidents(df: DataFrame, path: str) -> None:
    """Incident lines; readers see the files only when the job has finished."""
    df.select("ip", "date", "cnt", "kind").write.mode("overwrite").csv(path)


def _reputation_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ip string, data string").option("sep", "\t").option("quote", "").csv(path)


def read_reputation(spark: SparkSession, path: str) -> DataFrame:
    """`ip<TAB>json` lines as documents; what cannot be read of them is in `rejected_reputation`."""
    return from_json(_reputation_lines(spark, path).where("ip IS NOT NULL"))


def rejected_reputation(spark: SparkSession, path: str) -> DataFrame:
    """Lines and entries (ip, raw) that `read_reputation` leaves out, with the reason."""
    return rejected_entries(_reputation_lines(spark, path))


def write_reputation(docs: DataFrame, path: str) -> None:
    to_json(docs).write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def strip_comment(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"#.*", ""), F.lit(" \t\r"))


def _listed(lines: DataFrame) -> DataFrame:
    """Lines with `address`, their text without a comment; comments and blank lines go."""
    return lines.withColumn("address", strip_comment(F.col("value"))).where(F.length("address") > 0)


def parse_address_list(lines: DataFrame) -> DataFrame:
    """Addresses in text lines (column value); other text is in `rejected_address_list`."""
    return _listed(lines).where(ip_bin("address").isNotNull()).select("address").distinct()


def rejected_address_list(lines: DataFrame) -> DataFrame:
    """Lines that `parse_address_list` leaves out, with the reason."""
    return _listed(lines).where(ip_bin("address").isNull()).drop("address").withColumn("reason", F.lit("no address"))


def read_address_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_address_list(spark.read.text(path))


# Fixed value: the form of a rule that adds an item to a set.
SET_RULE = r"^\s*add\s+(\S+)\s+(\S+)"


def _item() -> Column:
    return parse_set_item(F.regexp_extract("value", SET_RULE, 2))


def rejected_set_rules(lines: DataFrame) -> DataFrame:
    """Rules that `parse_set_rules` leaves out as it cannot read their item, with the reason."""
    bad = F.col("value").rlike(SET_RULE) & _item().getField("ip").isNull()
    return lines.where(bad).withColumn("reason", F.lit("unreadable item"))


def parse_set_rules(lines: DataFrame) -> DataFrame:
    """Rules `add <set> <item>` as (set, ip, proto, port, prefix); other lines go.

    Rules whose item cannot be read are in `rejected_set_rules`.
    """
    rules = lines.where(F.col("value").rlike(SET_RULE) & _item().getField("ip").isNotNull())
    item = _item()
    carried = [c for c in lines.columns if c != "value"]
    return rules.select(*carried, F.regexp_extract("value", SET_RULE, 1).alias("set"), item.alias("i")).select(
        *carried, "set", "i.*"
    )


def read_set_rules(spark: SparkSession, path: str) -> DataFrame:
    return parse_set_rules(spark.read.text(path))


def _greylist_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col(f"`{rows.columns[0]}`").alias("address"))


def read_greylist(spark: SparkSession, path: str) -> DataFrame:
    """Addresses in the first column of a CSV with a header; other columns are not read."""
    return _greylist_rows(spark, path).where(ip_bin("address").isNotNull())


def rejected_greylist(spark: SparkSession, path: str) -> DataFrame:
    """First fields (raw) that `read_greylist` leaves out, with the reason."""
    rows = _greylist_rows(spark, path).where(ip_bin("address").isNull())
    return rows.select(F.col("address").alias("raw"), F.lit("no address").alias("reason"))


# Columns of a local traffic line with their forms; counters have no default.
LAN_TEXT = {"proto": r"^\w+$", "src": r"^[\w.:]+$", "dst": r"^[\w.:]+$", "port": r"^\w+$"}
LAN_COUNTERS = ("d_count", "d_size", "d_dsize", "u_count", "u_size", "u_dsize")
LAN_NAME = r"^[\w.-]+$"
LAN_NUMBER = r"^[\d.]+$"
UNDEFINED, NO_NAME = "UNDEFINED", "none"


def _whole(number: Column) -> Column:
    """The whole part of a decimal number, exact in all digits; NULL if it is none or no long."""
    digits = F.substring_index(number, ".", 1)
    digits = F.when(digits == "", "0").otherwise(digits)
    return F.when(number.rlike(LAN_NUMBER) & number.try_cast("double").isNotNull(), digits.try_cast("long"))


def rejected_lan_flows(lines: DataFrame) -> DataFrame:
    """Lines that `parse_lan_flows` leaves out, with the reason."""
    parts = F.split("value", ",")
    counters = [_whole(F.trim(F.get(parts, F.lit(len(LAN_TEXT) + i)))) for i in range(len(LAN_COUNTERS))]
    bad = reduce(lambda a, b: a | b, [c.isNull() for c in counters])
    return lines.where(bad).withColumn("reason", F.lit("a counter is missing or unreadable"))


def parse_lan_flows(lines: DataFrame) -> DataFrame:
    """Local traffic lines (column value); a missing name is 'none'.

    Lines without all counters are in `rejected_lan_flows`.
    """
    parts = F.split("value", ",")
    at = lambda i: F.trim(F.get(parts, F.lit(i)))
    columns = [
        F.when(at(i).rlike(form), at(i)).otherwise(UNDEFINED).alias(name)
        for i, (name, form) in enumerate(LAN_TEXT.items())
    ]
    for i, name in enumerate(LAN_COUNTERS, start=len(LAN_TEXT)):
        columns.append(_whole(at(i)).alias(name))
    last = len(LAN_TEXT) + len(LAN_COUNTERS)
    columns.append(F.when(at(last).rlike(LAN_NAME), at(last)).otherwise(NO_NAME).alias("resolved"))
    carried = [c for c in lines.columns if c != "value"]
    return lines.select(*carried, *columns).dropna(subset=list(LAN_COUNTERS))


def read_lan_flows(spark: SparkSession, path: str) -> DataFrame:
    return parse_lan_flows(spark.read.text(path))


def _redirections(lines: DataFrame, marker: str) -> DataFrame:
    """Log lines with the marker, their fields as columns; a field may stand anywhere in the line."""
    field = lambda key: F.nullif(F.regexp_extract("value", rf"(?:^|\s){key}=(\S*)", 1), F.lit(""))
    port = field("DPT").try_cast("int")
    return lines.where(F.contains("value", F.lit(marker))).withColumns({
        "suffix": F.regexp_extract(F.substring_index("value", marker, -1), "^([^:]*)", 1),
        "src": field("SRC"), "dst": field("DST"), "proto": field("PROTO"),
        "dport": F.when(port.between(0, 65535), port),
    })


_COMPLETE = "src IS NOT NULL AND dst IS NOT NULL AND proto IS NOT NULL AND dport IS NOT NULL"


def parse_fw_log(lines: DataFrame, marker: str = "fake-open-") -> DataFrame:
    """Kernel firewall log lines (column value) as redirections of probed ports.

    `marker` is the text in front of the set's suffix in the log prefix. Marked
    lines without addresses, protocol or port are in `rejected_fw_log`.
    """
    carried = [c for c in lines.columns if c != "value"]
    item = F.concat("src", F.lit(","), "proto", F.lit(":"), F.col("dport").cast("string"), F.lit(","), "dst")
    found = _redirections(lines, marker).where(_COMPLETE)
    return found.select(*carried, "suffix", "src", "dst", "proto", "dport", item.alias("item"))


def rejected_fw_log(lines: DataFrame, marker: str = "fake-open-") -> DataFrame:
    """Marked lines that `parse_fw_log` leaves out, with the reason."""
    bad = _redirections(lines, marker).where(f"NOT ({_COMPLETE})")
    return bad.select(*lines.columns, F.lit("an address, the protocol or the port is missing or unreadable").alias("reason"))
