"""Due work, sampling groups and late packets."""

from pyspark.sql import functions as F

from netloom.functions import net
from netloom.operators import selection
from netloom.plans import packet_queries
from netloom.plans.registry import query
from netloom.plans.stream_queries import StreamTables
from netloom.session import scratch_folder
from netloom.streaming import jobs


@query(
    "o05_due_requests",
    """SELECT event_id AS id, ts + INTERVAL '1 hour' * (event_id % 48) AS due FROM events WHERE user_id % 3 > 0
    AND ts + INTERVAL '1 hour' * (event_id % 48) < TIMESTAMP '2024-01-20' ORDER BY 2, 1 LIMIT 25""",
)
def due(t):
    requests = t("events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 3 > 0).alias("active"), F.col("ts").alias("lastrun"),
        F.make_dt_interval(hours=(F.col("event_id") % 48).cast("int")).alias("interval"),
    )
    return selection.due_requests(requests, "2024-01-20 00:00:00", 25).select("id", "due")


@query(
    "o06_assign_groups",
    "SELECT id AS client, concat('rand-', level, '-', id % level + 1) AS name FROM t_clients, (SELECT unnest([2, 4, 8, 16, 32]) AS level)",
)
def groups(t):
    return selection.assign_groups(t("t_clients"), hashed=False)


@query(
    "x02_ip_family",
    "SELECT id, CASE WHEN id % 2 = 0 THEN 6 ELSE 4 END AS family FROM t_packets",
)
def families(t):
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("2001:db8::"), F.col("client").cast("string"))).otherwise(F.col("addr_remote"))
    return t("t_packets").select("id", net.ip_family(text).alias("family"))


@query(
    "x04_unmap_v4",
    "SELECT id, CASE WHEN id % 3 = 0 THEN concat('2001:db8::', 1 + client % 9) ELSE addr_remote END AS plain FROM t_packets",
)
def unmapped(t):
    text = (
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("2001:db8::"), (1 + F.col("client") % 9).cast("string")))
        .when(F.col("id") % 3 == 1, F.concat(F.lit("::ffff:"), "addr_remote"))
        .otherwise(F.col("addr_remote"))
    )
    return t("t_packets").select("id", net.ip_text(net.unmap_v4(net.ip_bin(text))).alias("plain"))


SQL_LATE = f"""WITH {packet_queries.SQL_PACKETS}, w AS (SELECT unnest([1, 2, 6]) AS h),
 wm AS (SELECT date_trunc('millisecond', MAX(ts)) - INTERVAL '20 seconds' AS mark FROM pk),
 s AS (SELECT client, CAST(h * 3600000000 AS BIGINT) AS win_len, make_timestamp(epoch_us(ts) // (h * 3600000000) * (h * 3600000000)) AS start,
  SUM(CASE WHEN direction = 'in' THEN length ELSE 0 END) AS i, SUM(CASE WHEN direction = 'in' THEN 0 ELSE length END) AS o FROM pk, w
  WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2, 3)
 SELECT date_trunc('day', start) AS timestamp, client, win_len, CAST(MAX(i) AS BIGINT) AS in_max, CAST(MAX(o) AS BIGINT) AS out_max FROM s, wm
 WHERE date_trunc('day', start) + INTERVAL '1 day' <= mark GROUP BY 1, 2, 3"""


@query("t03_late_packets", SQL_LATE)
def late(t):
    """The second half of the packets comes first; the first half is then too late and dropped."""
    source, out, state = (scratch_folder(t.spark, f"late-{part}") for part in ("in", "out", "state"))
    events = t("events")
    for i, part in enumerate(("ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00'", "ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'")):
        events.where(part).write.parquet(f"{source}/events-{i}.parquet")
        stream = packet_queries.layered(StreamTables(t.spark, source))
        jobs.write_batches(jobs.stream_peaks(stream, "1 day", packet_queries.HOURS), out, state, "append")
    return t.spark.read.parquet(out).drop("batch")
