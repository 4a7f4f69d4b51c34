"""Incremental archives, retention and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.predicates import p_login, redact_credentials
from netloom.functions.times import bin_start, hour_of, now_literal
from netloom.operators.groups import BUCKETS, SPEED_ARRAYS, array_sum
from netloom.operators.ordering import latest


def _mark(target: DataFrame, column: str) -> DataFrame:
    """The target's newest value as one row (NULL when it is empty)."""
    return F.broadcast(target.agg(F.max(column).alias("_mark")))


def incremental(source: DataFrame, target: DataFrame, column: str, target_column: str | None = None) -> DataFrame:
    """Source rows newer than everything in the target."""
    mark = _mark(target, target_column or column)
    newer = F.col("_mark").isNull() | (F.col(column) > F.col("_mark"))
    return source.crossJoin(mark).where(newer).drop("_mark")


def recompute_last(source: DataFrame, target: DataFrame, column: str, build) -> DataFrame:
    """Target with its newest batch, and everything later, built again from the source.

    Written with dynamic partition overwrite, only the touched partitions change.
    """
    mark = _mark(target, column)
    open_rows = source.crossJoin(mark).where(F.col("_mark").isNull() | (F.col(column) >= F.col("_mark"))).drop("_mark")
    closed = target.crossJoin(mark).where(F.col(column) < F.col("_mark")).drop("_mark")
    return closed.unionByName(build(open_rows))


CREDENTIALS = ["timestamp", "server", "remote", "name", "password", "remote_port"]


def credential_attempts(logs: DataFrame, target: DataFrame, keep: bool = True) -> DataFrame:
    """Archive of login attempts that gave a name and a password, its newest day built again.

    Without `keep`, names and passwords of the logs go first, and so the attempts.
    """

    def build(rows: DataFrame) -> DataFrame:
        given = F.col("name").isNotNull() & F.col("password").isNotNull()
        return redact_credentials(rows, keep).where(p_login() & given).select(*CREDENTIALS, "_date")

    dated = lambda df: df.withColumn("_date", F.to_date("timestamp"))
    return recompute_last(dated(logs), dated(target.select(*CREDENTIALS)), "_date", build).drop("_date")


def closed_until(df: DataFrame, column: str, delay: str, now=None) -> DataFrame:
    """Rows that can no longer change: older than `delay` before `now` or the newest row."""
    if now is not None:
        return df.where(F.col(column) < now_literal(now) - F.expr(f"INTERVAL {delay}"))
    limit = F.col("_mark") - F.expr(f"INTERVAL {delay}")
    return df.crossJoin(_mark(df, column)).where(F.col(column) < limit).drop("_mark")


def reopen_from(target: DataFrame, column: str, delay: str) -> DataFrame:
    """The hour from which refused connections are computed again, as one row `since`."""
    return target.agg((F.max(column) - F.expr(f"INTERVAL {delay}")).alias("since")).select(
        hour_of("since").alias("since")
    )


def merge_add(current: DataFrame, delta: DataFrame, keys, sums, latest_of=()) -> DataFrame:
    """Upsert: add the delta to matching rows, insert the others.

    `sums` are added; `latest_of` columns take the delta's value where it has one.
    """
    columns = [*keys, *sums, *latest_of]
    both = current.select(*columns, F.lit(0).alias("_turn")).unionByName(
        delta.select(*columns, F.lit(1).alias("_turn"))
    )
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_turn"))).alias(c) for c in latest_of]
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *newest)


def hourly_buckets(current: DataFrame, partial: DataFrame, size: int = BUCKETS) -> DataFrame:
    """Hourly histograms with partial reports of the same hours added."""
    rows = current.unionByName(partial.withColumn("timestamp", hour_of("timestamp")).select(*current.columns))
    return array_sum(rows, ["timestamp", "client"], SPEED_ARRAYS, size).drop("clients")


def bucket_arrays(buckets: DataFrame, edges) -> DataFrame:
    """Positions of decoded speed buckets (kbit); unknown buckets, like 0, are left out."""
    places = F.create_map(*[F.lit(x) for i, edge in enumerate(edges) for x in (edge, i)])
    return buckets.withColumn("pos", F.try_element_at(places, F.col("kbit").cast("int"))).where(
        F.col("pos").isNotNull()
    )


def assemble_snapshots(answers: DataFrame, interval_s: int, delay_s: int) -> DataFrame:
    """Answers grouped to the request they answer.

    `answers` has client, received and stamp (the request's time); requests go
    out every `interval_s`. An answer counts when it comes within `delay_s` of
    the request it names; per client the last one counts.
    """
    request = bin_start("stamp", interval_s * 1_000_000)
    timely = answers.withColumn("snapshot", request).where(
        (F.col("received") >= F.col("snapshot"))
        & (F.col("received") <= F.col("snapshot") + F.make_dt_interval(secs=F.lit(delay_s)))
    )
    return latest(timely, ["snapshot", "client"], "received", *[c for c in ("id",) if c in answers.columns])


# Time columns by table, for retention.
RETENTION = {
    "activities": "timestamp", "count_snapshots": "timestamp", "bandwidth": "timestamp",
    "bandwidth_stats": "timestamp", "refused": "timestamp", "fake_logs": "timestamp",
    "plugin_history": "timestamp", "pings": "batch", "certs": "batch", "spoof": "batch",
    "ssh_sessions": "start_time", "firewall_log": "time",
}


def _cutoff(now, days: int) -> Column:
    return F.date_trunc("day", now_literal(now) - F.make_dt_interval(F.lit(days))).cast("timestamp_ntz")


def carried_forward(history: DataFrame, now) -> DataFrame:
    """Each client's last plug-in rows, stamped `now`, so that retention keeps its state.

    All rows that share a client's newest time per plug-in are carried.
    """
    newest = history.groupBy("client", "name").agg(F.max("timestamp").alias("timestamp"))
    last = history.drop("id").join(newest, ["client", "name", "timestamp"], "left_semi")
    return last.distinct().withColumn("timestamp", now_literal(now))


def purge(tables: dict[str, DataFrame], now, days: int) -> dict[str, DataFrame]:
    """Tables without rows older than `days`; plug-in states are carried forward first.

    The filter is a plain range on the time column, so it prunes partitions.
    """
    limit = _cutoff(now, days)
    kept = {}
    for name, df in tables.items():
        if name == "plugin_history":
            carried = carried_forward(df, now)
            if "id" in df.columns:
                carried = carried.withColumn("id", F.lit(None).cast(df.schema["id"].dataType))
            df = df.unionByName(carried)
        if name == "biflows":
            kept[name] = df.where(F.coalesce("start_in", "start_out") >= limit)
        else:
            kept[name] = df.where(F.col(RETENTION[name]) >= limit)
    return kept
