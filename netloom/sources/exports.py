"""Exports: reports, address lists and dumps as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.net import p_private_text

BLACKLIST_COLUMNS = ("server", "remote", "clients", "score", "mode")
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", parts=()) -> None:
    """The output committer publishes a finished job only.

    With folders, rows are first brought together by folder; adaptive execution
    splits a folder that is too large for one task.
    """
    gathered = df.hint("rebalance", *parts) if parts else df
    writer = gathered.write.mode("overwrite").option("header", header).option("sep", sep)
    writer = writer.option("timestampNTZFormat", MICROS)
    (writer.partitionBy(*parts) if parts else writer).csv(path)


def blacklist_rows(listed: DataFrame, omit: DataFrame) -> DataFrame:
    """Blacklist without omitted addresses, in report order."""
    kept = listed.join(omit.select(F.col("address").alias("remote")), "remote", "left_anti")
    return kept.select(*BLACKLIST_COLUMNS).orderBy("server", "remote")


def export_blacklist(listed: DataFrame, omit: DataFrame, path: str) -> None:
    _write_csv(blacklist_rows(listed, omit), path)


def bad_connection_rows(connections: DataFrame, omit: DataFrame, day: str | None = None) -> DataFrame:
    """Bad connections to export: no omitted remote, no private local address."""
    ended = F.to_date(F.coalesce("end_time_utc", "start_time_utc"))
    kept = (
        connections.withColumn("day", ended)
        .where(F.col("local").isNull() | ~p_private_text("local"))
        .join(omit.select(F.col("address").alias("remote")), "remote", "left_anti")
    )
    if day is not None:
        kept = kept.where(F.col("day") == F.lit(day).cast("date"))
    return kept.select(
        "server", "day", "remote", "remote_port", "local", "local_port",
        F.col("start_time_utc").alias("start"), F.col("end_time_utc").alias("end"),
    )


def export_bad_connections(connections: DataFrame, omit: DataFrame, path: str, day: str | None = None) -> None:
    """One folder per (server, day)."""
    _write_csv(bad_connection_rows(connections, omit, day), path, parts=("server", "day"))


def dump_activities(activities: DataFrame, clients: DataFrame) -> DataFrame:
    """Activities with client names, in time order."""
    named = activities.join(clients.select(F.col("id").alias("client"), "name"), "client")
    return named.select("name", "timestamp", "activity").orderBy("timestamp", "name", "activity")


def dump_counts(counts: DataFrame, clients: DataFrame, types: DataFrame) -> DataFrame:
    """Counts with client and type names, in time order."""
    named = counts.join(clients.select(F.col("id").alias("client"), F.col("name")), "client").join(
        types.select(F.col("id").alias("type"), F.col("name").alias("type_name"), "ord"), "type"
    )
    return named.select("timestamp", "name", "type_name", "count", "size", "ord").orderBy(
        "timestamp", "name", "ord"
    ).drop("ord")


def dump_capture_stats(stats: DataFrame, clients: DataFrame) -> DataFrame:
    """Capture statistics with client names, in time order."""
    named = stats.join(clients.select(F.col("id").alias("client"), "name"), "client")
    return named.select("timestamp", "name", "interface", "captured", "dropped", "dropped_driver").orderBy(
        "timestamp", "name", "interface"
    )


def write_dump(df: DataFrame, path: str) -> None:
    _write_csv(df, path, header=False, sep="\t")


def csv_rows(df: DataFrame, columns) -> DataFrame:
    """The chosen columns in the chosen order."""
    return df.select(*columns)


def export_csv(df: DataFrame, columns, path: str) -> None:
    _write_csv(csv_rows(df, columns), path)


def pseudonym(c: Column, salt: str) -> Column:
    """A salted digest: equal values stay equal, others cannot be read back."""
    return F.sha2(F.concat(F.lit(salt), c), 256)


def anonymize(df: DataFrame, columns, salt: str) -> DataFrame:
    """Replace address columns by pseudonyms."""
    return df.withColumns({c: pseudonym(F.col(c), salt) for c in columns})
