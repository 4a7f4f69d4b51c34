"""Constraints, incremental archives, retention and upserts."""

from pyspark.sql import functions as F

from netloom.operators import archive, constraints, groups
from netloom.plans.client_queries import SQL_HISTORY, history
from netloom.plans.group_queries import cells, histograms
from netloom.plans.registry import query
from netloom.schemas import SPEED_EDGES_KBIT

NOW = "2024-02-01 00:00:00"


@query(
    "s02_check_rows",
    """SELECT 'min_to_avg' AS rule, concat(client, '/', request) AS key FROM t_pings WHERE avg % 50 = 0 AND avg > 0
    UNION ALL SELECT 'replies_have_times', concat(client, '/', request) FROM t_pings WHERE received = 1 AND avg IS NOT NULL AND avg % 2 = 0""",
)
def broken_pings(t):
    pings = t("t_pings").select(
        "client", "request", F.when((F.col("received") == 1) & (F.col("avg") % 2 == 0), 0).otherwise(F.col("received")).alias("received"),
        "avg", F.when(F.col("avg") % 50 == 0, F.col("avg") + 1).otherwise(F.col("avg")).alias("min"), F.col("avg").alias("max"),
    )
    # Zero averages stay sound.
    pings = pings.withColumn("min", F.when(F.col("avg") == 0, 0).otherwise(F.col("min")))
    return constraints.check_constraints(pings, "pings", key=("client", "request"))


@query(
    "s02_check_references",
    """SELECT 'unique' AS rule, concat(client, '/', in_group) AS key FROM (SELECT client, CASE WHEN in_group < 100 THEN 1 ELSE in_group END AS in_group FROM t_members) GROUP BY client, in_group HAVING COUNT(*) > 1
    UNION ALL SELECT 'client in clients', concat(client, '/', CASE WHEN in_group < 100 THEN 1 ELSE in_group END) FROM t_members WHERE client NOT IN (SELECT id FROM t_clients WHERE id % 7 > 0)""",
)
def broken_members(t):
    members = t("t_members").withColumn("in_group", F.when(F.col("in_group") < 100, 1).otherwise(F.col("in_group")))
    return constraints.check_constraints(
        members, "group_members", key=("client", "in_group"), parents={"clients": t("t_clients").where("id % 7 > 0")}
    )


# The archives of counts and refusals, and the rules that they break.
SQL_ARCHIVES = """c AS (SELECT k.timestamp, m.in_group, k.type, MIN(k.count) AS count_min, AVG(k.count) AS count_avg, MAX(k.count) AS count_max,
  MIN(k.size) AS size_min, AVG(k.size) AS size_avg, MAX(k.size) AS size_max FROM t_counts k JOIN t_members m ON m.client = k.client GROUP BY 1, 2, 3),
 a AS (SELECT address, remote_port, reason, date_trunc('hour', timestamp) AS since, COUNT(*) AS conn_count, COUNT(DISTINCT client) AS client_count FROM t_refused GROUP BY 1, 2, 3, 4)"""
SQL_BROKEN = """SELECT 'count_spread' AS rule, concat_ws('/', timestamp, in_group, type) AS key FROM {counted} WHERE NOT (count_min <= count_avg AND count_avg <= count_max)
 UNION ALL SELECT 'size_spread', concat_ws('/', timestamp, in_group, type) FROM {counted} WHERE NOT (size_min <= size_avg AND size_avg <= size_max)
 UNION ALL SELECT 'clients', concat_ws('/', address, remote_port, since) FROM {refused} WHERE client_count > conn_count"""


def _archives(t):
    return groups.counts_by_group(t("t_counts"), t("t_members")), groups.refused_by_addr(t("t_refused"))


def _violations(counted, refused):
    return constraints.check_constraints(counted, "count_stats", key=("timestamp", "in_group", "type")).unionByName(
        constraints.check_constraints(refused, "refused_addrs", key=("address", "remote_port", "since"))
    )


@query("s02_sound_tables", f"WITH {SQL_ARCHIVES} {SQL_BROKEN.format(counted='c', refused='a')}")
def sound(t):
    """The produced archives satisfy their own rules."""
    return _violations(*_archives(t))


@query(
    "s02_damaged_tables",
    f"""WITH {SQL_ARCHIVES}, dc AS (SELECT * REPLACE (CASE WHEN type = 1 THEN count_min - 1 ELSE count_max END AS count_max) FROM c),
    da AS (SELECT * REPLACE (CASE WHEN remote_port = 22 THEN client_count + 1 ELSE client_count END AS client_count) FROM a)
    {SQL_BROKEN.format(counted='dc', refused='da')}""",
)
def damaged_archives(t):
    """The same archives with a wrong maximum and a client too many."""
    counted, refused = _archives(t)
    most = F.when(F.col("type") == 1, F.col("count_min") - 1).otherwise(F.col("count_max"))
    clients = F.when(F.col("remote_port") == 22, F.col("client_count") + 1).otherwise(F.col("client_count"))
    return _violations(counted.withColumn("count_max", most), refused.withColumn("client_count", clients))


@query("t10_incremental", "SELECT * FROM t_refused WHERE timestamp > (SELECT MAX(timestamp) FROM t_refused WHERE timestamp < TIMESTAMP '2024-01-20')")
def newer(t):
    source = t("t_refused")
    return archive.incremental(source, source.where("timestamp < TIMESTAMP_NTZ '2024-01-20 00:00:00'"), "timestamp")


@query("t11_recompute_last", "SELECT CAST(timestamp AS DATE) AS date, activity, client, COUNT(*) AS count FROM t_activities GROUP BY 1, 2, 3")
def recomputed(t):
    """A target whose last day is partial, brought up to date."""
    rows = t("t_activities").withColumn("date", F.to_date("timestamp"))
    target = groups.activity_daily(rows.where("timestamp < TIMESTAMP_NTZ '2024-01-20 09:00:00'"))
    return archive.recompute_last(rows, target, "date", groups.activity_daily)


SQL_ATTEMPTS = """lg AS (SELECT timestamp, server, remote, CASE WHEN id % 5 > 0 THEN concat('user', CAST(client AS VARCHAR)) END AS name,
 CASE WHEN id % 7 > 0 THEN concat('pw', CAST(id % 50 AS VARCHAR)) END AS password, remote_port FROM t_fake_logs WHERE event = 'login'),
ok AS (SELECT * FROM lg WHERE name IS NOT NULL AND password IS NOT NULL),
md AS (SELECT MAX(CAST(timestamp AS DATE)) AS day FROM ok WHERE timestamp < TIMESTAMP '2024-01-20 09:00:00')"""


@query(
    "a41_credential_attempts",
    f"""WITH {SQL_ATTEMPTS} SELECT timestamp, server, remote, name, password, remote_port FROM ok, md WHERE CAST(timestamp AS DATE) >= day
    UNION ALL SELECT timestamp, server, remote, name, 'archived', remote_port FROM ok, md WHERE CAST(timestamp AS DATE) < day""",
)
def attempts(t):
    """Rows of an older archive are marked, those of its newest day are stale and vanish."""
    logs = t("t_fake_logs").withColumns({
        "name": F.when(F.col("id") % 5 > 0, F.concat(F.lit("user"), F.col("client").cast("string"))).cast("binary"),
        "password": F.when(F.col("id") % 7 > 0, F.concat(F.lit("pw"), (F.col("id") % 50).cast("string"))).cast("binary"),
    })
    old = logs.where("event = 'login' AND name IS NOT NULL AND password IS NOT NULL AND timestamp < TIMESTAMP_NTZ '2024-01-20 09:00:00'")
    target = old.withColumn("password", F.lit("archived").cast("binary"))
    archived = archive.credential_attempts(logs, target)
    return archived.withColumns({c: F.col(c).cast("string") for c in ("name", "password")})


@query("t12_closed_until", "SELECT * FROM t_firewall_log WHERE time < (SELECT MAX(time) - INTERVAL '3 hours' FROM t_firewall_log)")
def closed(t):
    return archive.closed_until(t("t_firewall_log"), "time", "3 hours")


@query("t12_closed_hours", "SELECT timestamp, client, in_max FROM t_bandwidth WHERE timestamp < TIMESTAMP '2024-01-20 10:00:00' - INTERVAL '90 minutes'")
def closed_hours(t):
    return archive.closed_until(t("t_bandwidth"), "timestamp", "90 minutes", "2024-01-20 10:00:00").select("timestamp", "client", "in_max")


@query("t12_reopen_from", "SELECT date_trunc('hour', MAX(timestamp) - INTERVAL '90 minutes') AS since FROM t_refused")
def reopened(t):
    return archive.reopen_from(t("t_refused"), "timestamp", "90 minutes")


@query(
    "s13_merge_add",
    """SELECT ip, kind, CAST(SUM(cnt) AS BIGINT) AS cnt, COALESCE(arg_max(date, date) FILTER (WHERE date > DATE '2024-01-15'), MAX(date)) AS date FROM t_incidents GROUP BY 1, 2""",
)
def upserted(t):
    rows = t("t_incidents")
    build = lambda df: df.groupBy("ip", "kind").agg(F.sum("cnt").alias("cnt"), F.max("date").alias("date"))
    old = build(rows.where("date <= DATE '2024-01-15'"))
    new = build(rows.where("date > DATE '2024-01-15'"))
    return archive.merge_add(old, new, ["ip", "kind"], ["cnt"], ["date"])


@query("s14_purge_activities", f"SELECT * FROM t_activities WHERE timestamp >= date_trunc('day', TIMESTAMP '{NOW}' - INTERVAL '10 days')")
def purged(t):
    return archive.purge({"activities": t("t_activities")}, NOW, 10)["activities"]


@query(
    "s14_purge_plugin_history",
    f"""WITH {SQL_HISTORY} SELECT * FROM hi WHERE timestamp >= TIMESTAMP '{NOW}' - INTERVAL '3 days'
    UNION ALL SELECT DISTINCT hi.client, TIMESTAMP '{NOW}', hi.name, hi.version FROM hi JOIN (SELECT client, name, MAX(timestamp) AS m FROM hi GROUP BY 1, 2) l
    ON l.client = hi.client AND l.name = hi.name AND l.m = hi.timestamp""",
)
def purged_history(t):
    return archive.purge({"plugin_history": history(t)}, NOW, 3)["plugin_history"]


@query("s14_purge_flows", f"SELECT id, start_in, start_out FROM t_biflows WHERE COALESCE(start_in, start_out) >= date_trunc('day', TIMESTAMP '{NOW}' - INTERVAL '10000 days')")
def purged_flows(t):
    return archive.purge({"biflows": t("t_biflows")}, NOW, 10000)["biflows"].select("id", "start_in", "start_out")


@query(
    "t13_hourly_buckets",
    """SELECT timestamp, client, pos, CAST(SUM(in_time) AS BIGINT) * 2 AS in_time, CAST(SUM(in_bytes) AS BIGINT) * 2 AS in_bytes,
    CAST(SUM(out_time) AS BIGINT) * 2 AS out_time, CAST(SUM(out_bytes) AS BIGINT) * 2 AS out_bytes FROM t_speed GROUP BY 1, 2, 3""",
)
def accumulated(t):
    current = histograms(t)
    partial = current.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 20 MINUTES"))
    return cells(archive.hourly_buckets(current, partial), ["timestamp", "client"])


@query(
    "t13_bucket_positions",
    "SELECT event_id, CAST(event_id % 40 AS INTEGER) AS pos FROM events WHERE event_id % 41 < 40 AND event_id % 3 > 0",
)
def positions(t):
    edges = F.array(*[F.lit(e) for e in SPEED_EDGES_KBIT])
    kbit = F.when((F.col("event_id") % 41 == 40) | (F.col("event_id") % 3 == 0), 0).otherwise(
        F.get(edges, (F.col("event_id") % 40).cast("int"))
    )
    rows = t("events").select("event_id", kbit.alias("kbit"))
    return archive.bucket_arrays(rows, SPEED_EDGES_KBIT).select("event_id", "pos")


@query(
    "t09_assemble_snapshots",
    """WITH a AS (SELECT user_id AS client, event_id AS id, value, time_bucket(INTERVAL '1 hour', ts) AS snapshot, ts FROM events),
    ok AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY snapshot, client ORDER BY ts DESC, id DESC) AS rn FROM a WHERE ts <= snapshot + INTERVAL '20 minutes')
    SELECT snapshot, client, id, value FROM ok WHERE rn = 1""",
)
def snapshots(t):
    answers = t("events").select(
        F.col("user_id").alias("client"), F.col("event_id").alias("id"), "value", F.col("ts").alias("received"), F.col("ts").alias("stamp")
    )
    return archive.assemble_snapshots(answers, 3600, 1200).select("snapshot", "client", "id", "value")
