"""Streaming twins of the batch operators, and an idempotent sink.

Event time is the packet's own time. A watermark bounds the state and says how
late a packet may come; rows behind it are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.times import bin_start
from netloom.operators import lan, packets
from netloom.operators.ordering import latest
from netloom.session import discard, stored

# Late frames a peak window keeps, by window length in ms.
KEPT_FRAMES = {500: 12, 1000: 6, 2000: 3, 5000: 2, 10000: 2}
PEAK_LATENESS = f"{max(length * n for length, n in KEPT_FRAMES.items())} milliseconds"


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", each: Callable | None = None, wait: bool = True):
    """Write a stream as one folder per micro-batch.

    A batch that is run again after a failure replaces its own folder, so with
    the checkpoint every input row counts exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if each is None else each(batch)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    if wait:
        query.awaitTermination()
    return query


# The time of a closing marker, past any event, and one that pandas can hold.
END_OF_TIME = "2200-01-01 00:00:00"
# Values with which a closing marker passes the filters of flows, local traffic, alarms and sessions.
FLOW_MARKER = {"direction": "in", "layer": "I", "ip_protocol": 4, "app_protocol": "T"}
LAN_MARKER = {"direction": "in", "proto": "T", "mac_local": "02:00:00:00:00:01", "mac_remote": "02:00:00:00:00:01"}
LOGIN_MARKER = {"event": "login"}
SESSION_MARKER = {"activity": "login"}


def write_to_end(source: DataFrame, build: Callable[[DataFrame], DataFrame], column: str, path: str, checkpoint: str, mode: str = "append", each: Callable | None = None, marker: dict | None = None) -> None:
    """Write all a finite stream gives, also what waits for a watermark: open windows, sessions and attempts.

    `build` makes the stream from `source`, whose event time is `column`. Once
    the input is read, closing markers, rows of that time only, move the watermark
    past every event; what it closes comes out in order. The markers' own windows
    stay open, so nothing of them is written. `marker` gives the values with which
    a row passes the filters of the stream; the rest is NULL. The checkpoint ends
    here: rows that come after would be late.
    """
    spark = source.sparkSession
    markers = f"{checkpoint}-markers"
    schema = source.schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(markers)
    closing = spark.readStream.schema(schema).parquet(markers)
    stream = build(source.unionByName(closing))
    write_batches(stream, path, checkpoint, mode, each)
    values = {**(marker or {}), column: END_OF_TIME}
    row = spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])
    # The watermark of a batch moves after it: the second marker sees the first one's.
    for _ in range(2):
        row.write.mode("append").parquet(markers)
        write_batches(stream, path, checkpoint, mode, each)


def _numbers(spark: SparkSession, path: str, name: str, done: bool = False) -> list[int]:
    """Numbers of the folders `name`=N below a path, ascending; with `done` only those whose job has ended."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}=*" + ("/_SUCCESS" if done else ""))
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    folders = [x.getPath().getParent() if done else x.getPath() for x in found]
    return sorted(int(x.getName().split("=")[1]) for x in folders)


def compact_batches(spark: SparkSession, path: str, keys, time: str, lateness: str) -> None:
    """Merge the batch folders of an updated stream, so that `read_latest` reads few files.

    Rows whose `time` is `lateness` behind the newest one can change no more: they
    are appended once to `{path}-closed` and never read again here. The last states
    of the others go to `{path}-open`, whose success mark completes a compaction;
    what an ended attempt has left is deleted first. `lateness` is the one of the
    stream's watermark, plus the length of its windows where `time` is their start.
    The newest batch stays as it is, since a retry may replace it. Folders are deleted
    one compaction after they were merged, so that readers can finish. One
    compaction of a path runs at a time. Rows without a time stay open.
    """
    merged = _numbers(spark, f"{path}-open", "upto", done=True)
    before = merged[-1] if merged else -1
    upto = max([before, *_numbers(spark, path, "batch")[:-1]])
    if upto == before:
        return
    for left in _numbers(spark, f"{path}-closed", "upto"):
        if left > before:
            discard(spark, f"{path}-closed/upto={left}")
    rows = latest(_changing(spark, path, before).where(F.col("batch") <= upto), list(keys), "batch")
    step, place = stored(rows.drop("batch"), "compacted")
    edge = step.agg((F.max(time) - F.expr(f"INTERVAL {lateness}")).alias("_edge"))  # one row
    marked = step.crossJoin(F.broadcast(edge)).withColumn("_closed", F.coalesce(F.col(time) < F.col("_edge"), F.lit(False)))
    marked.where("_closed").drop("_edge", "_closed").write.parquet(f"{path}-closed/upto={upto}")
    marked.where("NOT _closed").drop("_edge", "_closed").write.mode("overwrite").parquet(f"{path}-open/upto={upto}")
    discard(spark, place)
    for old in merged[:-1]:
        discard(spark, f"{path}-open/upto={old}")
    for batch in _numbers(spark, path, "batch"):
        if batch <= before:
            discard(spark, f"{path}/batch={batch}")


def _changing(spark: SparkSession, path: str, before: int) -> DataFrame:
    """Rows that may be updated, with `batch`: the open states up to a batch, and the batches after it."""
    rows = spark.read.parquet(path).where(F.col("batch") > before)
    if before < 0:
        return rows
    kept = spark.read.parquet(f"{path}-open/upto={before}")
    return rows.unionByName(kept.withColumn("batch", F.lit(before)))


def read_latest(spark: SparkSession, path: str, keys) -> DataFrame:
    """Rows of a written stream; of a key that was updated, the last state.

    After `compact_batches` only open states and newer batches are compared; closed
    rows are read as they are.
    """
    merged = _numbers(spark, f"{path}-open", "upto", done=True)
    before = merged[-1] if merged else -1
    rows = latest(_changing(spark, path, before), list(keys), "batch").drop("batch")
    if before < 0:
        return rows
    closed = spark.read.option("basePath", f"{path}-closed").parquet(
        *[f"{path}-closed/upto={n}" for n in _numbers(spark, f"{path}-closed", "upto", done=True) if n <= before]
    )
    return rows.unionByName(closed.select(*rows.columns))


def timed(stream: DataFrame, column: str, lateness: str) -> DataFrame:
    """A stream with its event time declared; Spark wants a zoned time for that."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def stream_packet_counts(stream: DataFrame, interval: str = "60 seconds", lateness: str = "5 seconds", servers=()) -> DataFrame:
    """Packet counters per interval, client and type."""
    counted = packets.packet_counts(timed(stream, "ts", lateness), F.window("ts", interval), servers)
    return counted.withColumn("start", F.col("start.start"))


def stream_peaks(stream: DataFrame, interval: str = "900 seconds", lengths=packets.WINDOW_LENGTHS, lateness: str = PEAK_LATENESS) -> DataFrame:
    """Peak bandwidth per interval, client and window length (append mode).

    All lengths divide the longest one, so that one event-time window holds the
    shorter ones and bounds the state of the sums.
    """
    longest = max(lengths)
    inbound = F.col("direction") == "in"
    spread = timed(stream, "ts", lateness).withColumn(
        "win_len", F.explode(F.array(*[F.lit(n).cast("long") for n in lengths]))
    )
    start = F.lit(None).cast("timestamp_ntz")
    for n in lengths:
        start = F.when(F.col("win_len") == n, bin_start("ts", n)).otherwise(start)
    sums = spread.groupBy(F.window("ts", f"{longest} microseconds").alias("w"), "client", "win_len", start.alias("start")).agg(
        F.sum(F.when(inbound, F.col("length")).otherwise(0)).alias("in_bytes"),
        F.sum(F.when(inbound, 0).otherwise(F.col("length"))).alias("out_bytes"),
    )
    return (
        sums.groupBy(F.window(F.window_time("w"), interval).alias("report"), "client", "win_len")
        .agg(F.max("in_bytes").alias("in_max"), F.max("out_bytes").alias("out_max"))
        .select(F.col("report.start").alias("timestamp"), "client", "win_len", "in_max", "out_max")
    )


def stream_flows(stream: DataFrame, timeout: str = "30 minutes", min_packets: int = 1, lateness: str = "1 minute") -> DataFrame:
    """Flow records per time-out window; small flows are dropped when it closes."""
    flows = packets.assemble_flows(timed(stream, "ts", lateness), min_packets, F.window("ts", timeout))
    return flows.withColumn("start", F.col("start.start"))


def stream_flow_sessions(stream: DataFrame, gap: str = "30 minutes", min_packets: int = 1, lateness: str = "1 minute") -> DataFrame:
    """Flow records that close after a silence of `gap` (append mode)."""
    flows = packets.assemble_flows(timed(stream, "ts", lateness), min_packets, F.session_window("ts", gap))
    return flows.withColumn("start", F.col("start.start"))


def stream_lan_summary(stream: DataFrame, interval: str = "1 minute", lateness: str = "10 seconds") -> DataFrame:
    """Local traffic per interval; fold each batch with `fold_lan`."""
    summary = lan.lan_summary(timed(stream, "ts", lateness), window=F.window("ts", interval).alias("start"))
    return summary.withColumn("start", F.col("start.start"))


def fold_lan(k: int = lan.SOURCE_LIMIT) -> Callable[[DataFrame], DataFrame]:
    """Batch step that folds the items beyond a source's busiest `k` (complete intervals)."""
    return lambda batch: lan.topk_with_other(batch, k, keys=("start", "src"))


def stream_snapshots(answers: DataFrame, interval: str, delay_s: int) -> DataFrame:
    """Answers that reach the request they name within `delay_s`, last one per client."""
    seconds = F.make_dt_interval(secs=F.lit(delay_s))
    timely = timed(answers, "stamp", f"{delay_s} seconds").withColumn("w", F.window("stamp", interval))
    timely = timely.where(
        (F.col("received") >= F.col("w.start")) & (F.col("received") <= F.col("w.start") + seconds)
    )
    rest = [c for c in answers.columns if c not in ("client", "stamp")]
    last = F.max_by(F.struct(*rest), F.struct("received", "id")).alias("last")
    return timely.groupBy("w", "client").agg(last).select(F.col("w.start").alias("snapshot"), "client", "last.*")


def stream_closed_hours(stream: DataFrame, keys, aggregates, column: str = "timestamp", lateness: str = "90 minutes") -> DataFrame:
    """Hourly aggregates that come out once no row can change them (append mode)."""
    closed = timed(stream, column, lateness).groupBy(F.window(column, "1 hour").alias("w"), *keys).agg(*aggregates)
    return closed.withColumn("since", F.col("w.start")).drop("w")


def stream_hourly_buckets(partial: DataFrame, target: str, checkpoint: str, keys=("timestamp", "client", "pos"), sums=("in_time", "in_bytes", "out_time", "out_bytes"), lateness: str = "2 hours") -> None:
    """Add partial reports (cells of a histogram) to hourly totals.

    The state store holds the running totals of the hours that may still change;
    each batch writes the totals it changed, and `read_latest` gives the table.
    """
    totals = timed(partial, "timestamp", lateness).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    write_batches(totals, target, checkpoint)


def stream_spoof_pairs(tokens: DataFrame, probes: DataFrame, timeout: str = "60 seconds") -> DataFrame:
    """Spoofing probes joined to their token in time; both states are bounded (append mode)."""
    sent = tokens.select("token", "client", F.col("ts").alias("sent"), F.col("address").alias("expected"))
    got = probes.select(F.col("token").alias("got"), "spoofed", F.col("ts").alias("received"), F.col("address").alias("ip"))
    sent, got = timed(sent, "sent", timeout), timed(got, "received", timeout)
    in_time = F.expr(f"token = got AND received >= sent AND received <= sent + INTERVAL {timeout}")
    return sent.join(got, in_time).select(
        "token", "client", "sent", "received", "spoofed", "ip", (F.col("ip") == F.col("expected")).alias("addr_matches")
    )
