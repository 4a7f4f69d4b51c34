"""Streams over the driver tables, run to the end and read back."""

from pyspark.sql import functions as F

from netloom.functions.times import hour_of
from netloom.plans import lan_queries, packet_queries
from netloom.plans.client_queries import SQL_SESSIONS
from netloom.plans.limit_queries import SQL_BUCKETS, SQL_NUMBERED
from netloom.plans.probe_queries import SQL_SPOOF
from netloom.plans.registry import Tables, query, wall_clock
from netloom.plans.views import VIEWS
from netloom.session import scratch_folder
from netloom.streaming import jobs, stateful


class StreamTables(Tables):
    """Driver tables as file streams; views over one of them stay streams."""

    def __call__(self, name):
        if name in VIEWS:
            return wall_clock(self.sql(VIEWS[name]))
        schema = self.spark.read.parquet(f"{self.folder}/{name}*.parquet").schema
        # The glob makes the single file a stream of files.
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}*.parquet")


def streamed(t):
    return StreamTables(t.spark, t.folder)


def run(t, stream, name, keys=None, mode="update"):
    """Run a stream over all its input and read what it wrote."""
    out, state = scratch_folder(t.spark, name), scratch_folder(t.spark, f"{name}-state")
    jobs.write_batches(stream, out, state, mode)
    if keys is None:
        return t.spark.read.schema(stream.schema).parquet(out).drop("batch")
    return jobs.read_latest(t.spark, out, keys)


def run_to_end(t, source, build, column, name, each=None, marker=None):
    """Run a stream over all its input, close what is open, and read what it wrote."""
    out, state = scratch_folder(t.spark, name), scratch_folder(t.spark, f"{name}-state")
    jobs.write_to_end(source, build, column, out, state, each=each, marker=marker)
    return t.spark.read.schema(build(source).schema).parquet(out).drop("batch")


@query("t01_stream_packet_counts", packet_queries.SQL_COUNTS.format(start="date_trunc('hour', ts)"))
def stream_counts(t):
    stream = jobs.stream_packet_counts(packet_queries.layered(streamed(t)), "1 hour", servers=(packet_queries.SERVER,))
    return run(t, stream, "counts", ["start", "client", "type"])


@query("t04_stream_flows", f"WITH {packet_queries.SQL_PACKETS} SELECT time_bucket(INTERVAL '1 day', ts) AS start, client, {packet_queries.SQL_FLOWS}")
def stream_flows(t):
    stream = jobs.stream_flows(packet_queries.layered(streamed(t)), "1 day")
    return run(t, stream, "flows", ["start", *packet_queries.packets.FLOW_KEY])


@query(
    "t04_stream_flow_sessions",
    f"""WITH {packet_queries.SQL_SESSIONS}, cl AS (SELECT * FROM se)
    SELECT start, client, {packet_queries.SQL_FLOWS.replace('FROM pk', 'FROM cl')}""",
)
def stream_sessions_of_flows(t):
    build = lambda rows: jobs.stream_flow_sessions(rows, "6 hours")
    return run_to_end(t, packet_queries.layered(streamed(t)), build, "ts", "flow-sessions", marker=jobs.FLOW_MARKER)


@query(
    "t02_stream_peaks",
    f"""WITH {packet_queries.SQL_PACKETS}, w AS (SELECT unnest([1, 2, 6]) AS h),
    s AS (SELECT client, CAST(h * 3600000000 AS BIGINT) AS win_len, make_timestamp(epoch_us(ts) // (h * 3600000000) * (h * 3600000000)) AS start,
     SUM(CASE WHEN direction = 'in' THEN length ELSE 0 END) AS i, SUM(CASE WHEN direction = 'in' THEN 0 ELSE length END) AS o FROM pk, w GROUP BY 1, 2, 3)
    SELECT date_trunc('day', start) AS timestamp, client, win_len, CAST(MAX(i) AS BIGINT) AS in_max, CAST(MAX(o) AS BIGINT) AS out_max FROM s GROUP BY 1, 2, 3""",
)
def stream_peaks(t):
    build = lambda rows: jobs.stream_peaks(rows, "1 day", packet_queries.HOURS)
    return run_to_end(t, packet_queries.layered(streamed(t)), build, "ts", "peaks")


@query(
    "t12_stream_closed_hours",
    """WITH wm AS (SELECT date_trunc('millisecond', MAX(timestamp)) - INTERVAL '90 minutes' AS mark FROM t_refused)
    SELECT date_trunc('hour', timestamp) AS since, client, reason, COUNT(*) AS count FROM t_refused, wm WHERE date_trunc('hour', timestamp) + INTERVAL '1 hour' <= mark GROUP BY 1, 2, 3""",
)
def stream_closed(t):
    stream = jobs.stream_closed_hours(streamed(t)("t_refused"), ["client", "reason"], [F.count(F.lit(1)).alias("count")])
    return run(t, stream, "refused-hours", mode="append")


@query(
    "t09_stream_snapshots",
    """WITH a AS (SELECT user_id AS client, event_id AS id, value, time_bucket(INTERVAL '1 hour', ts) AS snapshot, ts FROM events),
    ok AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY snapshot, client ORDER BY ts DESC, id DESC) AS rn FROM a WHERE ts <= snapshot + INTERVAL '20 minutes')
    SELECT snapshot, client, id, value FROM ok WHERE rn = 1""",
)
def stream_snapshots(t):
    answers = streamed(t)("events").select(
        F.col("user_id").alias("client"), F.col("event_id").alias("id"), "value", F.col("ts").alias("received"), F.col("ts").alias("stamp")
    )
    stream = jobs.stream_snapshots(answers, "1 hour", 1200)
    return run(t, stream, "snapshots", ["snapshot", "client"]).select("snapshot", "client", "id", "value")


BUCKET_KEYS = ["timestamp", "client", "pos"]
SQL_HOURLY_BUCKETS = """SELECT date_trunc('hour', ts) AS timestamp, user_id AS client, CAST(event_id % 40 AS INTEGER) AS pos, COUNT(*) * 2 AS in_time, CAST(SUM(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS in_bytes,
    COUNT(*) AS out_time, CAST(SUM(event_id) AS BIGINT) AS out_bytes FROM events GROUP BY 1, 2, 3"""


def partial_buckets(events):
    return events.select(
        hour_of("ts").alias("timestamp"), F.col("user_id").alias("client"), (F.col("event_id") % 40).cast("int").alias("pos"),
        F.lit(2).alias("in_time"), F.round(F.col("value") * 1000).cast("long").alias("in_bytes"),
        F.lit(1).alias("out_time"), F.col("event_id").alias("out_bytes"),
    )


@query("t13_stream_hourly_buckets", SQL_HOURLY_BUCKETS)
def stream_buckets(t):
    target = scratch_folder(t.spark, "buckets")
    jobs.stream_hourly_buckets(partial_buckets(streamed(t)("events")), target, scratch_folder(t.spark, "buckets-state"))
    return jobs.read_latest(t.spark, target, BUCKET_KEYS)


@query("t13_compacted_buckets", SQL_HOURLY_BUCKETS)
def compacted_buckets(t):
    """Events arrive in four parts, by time; the stream takes up each and its folders are compacted after it."""
    spark, source = t.spark, scratch_folder(t.spark, "arrivals")
    target, state = scratch_folder(spark, "buckets"), scratch_folder(spark, "buckets-state")
    span = t.sql("SELECT min(ts) AS low, max(ts) AS high FROM {events}").first()
    cuts = [span.low + (span.high - span.low) * k / 4 for k in range(5)] if span.low else []
    events = t("events").select("event_id", "user_id", "ts", "value")
    for low, high in zip(cuts, cuts[1:]):
        part = (F.col("ts") >= F.lit(low)) & ((F.col("ts") < F.lit(high)) | (F.lit(high) == F.lit(span.high)))
        events.where(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        jobs.stream_hourly_buckets(partial_buckets(stream), target, state)
        jobs.compact_batches(spark, target, BUCKET_KEYS, "timestamp", "2 hours")
    return jobs.read_latest(spark, target, BUCKET_KEYS)


@query(
    "t17_stream_spoof_pairs",
    f"""WITH {SQL_SPOOF} SELECT tk.token, tk.client, tk.ts AS sent, pk.ts AS received, pk.spoofed, pk.address AS ip, pk.address = tk.address AS addr_matches
    FROM tk JOIN pk ON pk.token = tk.token AND pk.ts BETWEEN tk.ts AND tk.ts + INTERVAL '20 minutes'""",
)
def stream_pairs(t):
    s = streamed(t)
    tokens = s.sql("SELECT event_id AS token, user_id AS client, ts, concat('192.0.2.', CAST(user_id % 3 AS STRING)) AS address FROM {events}")
    probes = s.sql("SELECT event_id - 5 AS token, event_id % 2 = 0 AS spoofed, ts, concat('192.0.2.', CAST(user_id % 3 AS STRING)) AS address FROM {events}")
    return run(t, jobs.stream_spoof_pairs(tokens, probes, "20 minutes"), "pairs", mode="append")


@query(
    "t18_stream_lan_summary",
    f"""WITH {lan_queries.SQL_FRAMES}, su AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS start, {lan_queries.SQL_LAN_SUMS} GROUP BY ALL),
    rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY start, src ORDER BY u_count DESC, proto, dst, port) AS rn FROM su)
    SELECT start, CASE WHEN rn <= 3 THEN proto ELSE 'both' END AS proto, src, CASE WHEN rn <= 3 THEN dst ELSE 'other' END AS dst,
    CASE WHEN rn <= 3 THEN port ELSE 'all' END AS port, {lan_queries.COUNTER_SUMS} FROM rk GROUP BY 1, 2, 3, 4, 5""",
)
def stream_lan(t):
    build = lambda rows: jobs.stream_lan_summary(rows, "6 hours")
    return run_to_end(t, lan_queries.frames(streamed(t)), build, "ts", "lan", jobs.fold_lan(3), jobs.LAN_MARKER)


@query(
    "t14_process_once",
    "SELECT session_id, COUNT(*) AS commands FROM t_ssh_commands GROUP BY 1",
)
def process_once(t):
    """Two runs with one checkpoint: the second finds nothing new."""
    out, state = scratch_folder(t.spark, "commands"), scratch_folder(t.spark, "commands-state")
    for _ in range(2):
        jobs.write_batches(streamed(t)("t_ssh_commands"), out, state, "append")
    return t.spark.read.parquet(out).groupBy("session_id").agg(F.count(F.lit(1)).alias("commands"))


@query(
    "t07_stream_login_bursts",
    f"""WITH RECURSIVE {SQL_NUMBERED},
    al AS (SELECT server, remote, n, timestamp FROM nu WHERE n = 5
     UNION ALL SELECT al.server, al.remote, x.n, x.timestamp FROM al JOIN LATERAL
     (SELECT MIN(n) AS n, MIN(timestamp) AS timestamp FROM nu WHERE nu.server = al.server AND nu.remote = al.remote AND nu.n >= al.n + 5 AND nu.timestamp >= al.timestamp + INTERVAL '2 days') x ON x.n IS NOT NULL)
    SELECT al.server, al.remote, nu.id, nu.timestamp FROM al JOIN nu ON nu.server = al.server AND nu.remote = al.remote AND nu.n = al.n""",
)
def stream_bursts(t):
    stateful.use_rocksdb(t.spark)
    build = lambda rows: stateful.stream_login_bursts(rows, holdback_us=2 * 86_400_000_000)
    return run_to_end(t, streamed(t)("t_fake_logs"), build, "timestamp", "bursts", marker=jobs.LOGIN_MARKER)


@query("t08_stream_rate_limit", SQL_BUCKETS.replace("id, cost, cost <", "id, cost <"))
def stream_limited(t):
    stateful.use_rocksdb(t.spark)
    messages = streamed(t)("events").select(
        (F.col("user_id") % 20).alias("client"), F.col("event_id").alias("id"), "ts", (1 + F.col("event_id") % 7).alias("cost")
    )
    return run_to_end(t, messages, lambda rows: stateful.stream_rate_limit(rows, 3, 3600), "ts", "limited")


@query(
    "t15_stream_client_sessions",
    f"""WITH {SQL_SESSIONS.strip()} SELECT client, start, "end", ended FROM se WHERE NOT open""",
)
def stream_sessions(t):
    stateful.use_rocksdb(t.spark)
    return run_to_end(t, streamed(t)("t_activities"), stateful.stream_client_sessions, "timestamp", "sessions", marker=jobs.SESSION_MARKER)


@query("t05_stream_refused", packet_queries.SQL_ATTEMPTS)
def stream_refused(t):
    stateful.use_rocksdb(t.spark)
    events = packet_queries.connection_events(streamed(t))
    return run_to_end(t, events, lambda rows: stateful.stream_refused(rows, 12 * 3_600_000_000), "ts", "refused")
