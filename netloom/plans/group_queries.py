"""Archive statistics per group."""

from pyspark.sql import functions as F

from netloom.operators import groups
from netloom.plans.registry import query


@query(
    "j02_by_group",
    "SELECT a.id, a.client, a.timestamp, a.activity, m.in_group FROM t_activities a JOIN t_members m ON a.client = m.client",
)
def expanded(t):
    return groups.by_group(t("t_activities"), t("t_members"))


@query(
    "j03_archive_facts",
    "SELECT * FROM t_firewall_log WHERE router_id IN (SELECT client FROM t_members)",
)
def archive_facts(t):
    log = t("t_firewall_log").withColumn("client", F.col("router_id"))
    return groups.archive_with_groups(log, t("t_members"))[0].drop("client")


@query(
    "j03_archive_bridge",
    """SELECT f.id, m.in_group FROM t_firewall_log f JOIN t_members m ON f.router_id = m.client
    WHERE m.name NOT LIKE 'rand-%' AND m.name <> 'all'""",
)
def archive_bridge(t):
    log = t("t_firewall_log").withColumn("client", F.col("router_id"))
    return groups.archive_with_groups(log, t("t_members"))[1]


query("f19_interesting_groups", "SELECT * FROM t_members WHERE name NOT LIKE 'rand-%' AND name <> 'all'")(
    lambda t: t("t_members").where(groups.interesting_group(F.col("name")))
)


@query(
    "a02_counts_by_group",
    """SELECT c.timestamp, m.in_group, c.type, COUNT(*) AS client_count,
    CAST(SUM(count) AS BIGINT) AS count_sum, round(AVG(count), 4) AS count_avg, round(STDDEV_SAMP(count), 4) AS count_dev,
    MIN(count) AS count_min, MAX(count) AS count_max,
    CAST(SUM(size) AS BIGINT) AS size_sum, round(AVG(size), 4) AS size_avg, round(STDDEV_SAMP(size), 4) AS size_dev,
    CAST(MIN(size) AS BIGINT) AS size_min, CAST(MAX(size) AS BIGINT) AS size_max
    FROM t_counts c JOIN t_members m ON c.client = m.client GROUP BY 1, 2, 3""",
)
def counts(t):
    out = groups.counts_by_group(t("t_counts"), t("t_members"))
    rounded = {c: F.round(c, 4) for c in out.columns if c.endswith(("_avg", "_dev"))}
    return out.withColumns(rounded)


@query(
    "a03_activity_daily",
    "SELECT CAST(timestamp AS DATE) AS date, activity, client, COUNT(*) AS count FROM t_activities GROUP BY 1, 2, 3",
)
def activity(t):
    return groups.activity_daily(t("t_activities"))


def pings(t):
    return t("t_pings").withColumns({"min": F.expr("avg div 2"), "max": F.col("avg") * 2})


@query(
    "a04_ping_stats",
    """SELECT p.batch, p.request, m.in_group, CAST(SUM(received) AS BIGINT) AS received, COUNT(*) AS asked,
    COUNT(ip) AS resolved, MIN(avg // 2) AS min, MAX(avg * 2) AS max,
    CAST(SUM(avg * received) // NULLIF(SUM(received), 0) AS BIGINT) AS avg
    FROM t_pings p JOIN t_members m ON p.client = m.client GROUP BY 1, 2, 3""",
)
def ping_stats(t):
    return groups.ping_stats(pings(t), t("t_members"))


@query(
    "a05_ping_ip_hist",
    """SELECT p.request, p.batch, m.in_group, p.ip, COUNT(DISTINCT p.client) AS clients
    FROM t_pings p JOIN t_members m ON p.client = m.client GROUP BY 1, 2, 3, 4""",
)
def ping_ips(t):
    return groups.ping_ip_hist(t("t_pings"), t("t_members"))


@query(
    "a06_cert_hist",
    """SELECT c.batch, c.request, m.in_group, c.value, COUNT(c.client) AS count
    FROM t_certs c JOIN t_members m ON c.client = m.client WHERE c.id % 3 = 0 GROUP BY 1, 2, 3, 4""",
)
def certs(t):
    return groups.cert_hist(t("t_certs").withColumn("ord", F.col("id") % 3), t("t_members"))


@query(
    "a07_bandwidth_by_group",
    """SELECT b.timestamp, m.in_group, b.win_len,
    round(MIN(1e6 * in_max / win_len), 3) AS in_min, round(MAX(1e6 * in_max / win_len), 3) AS in_max,
    round(AVG(1e6 * in_max / win_len), 3) AS in_avg, round(STDDEV_POP(1e6 * in_max / win_len), 3) AS in_dev,
    round(MIN(1e6 * out_max / win_len), 3) AS out_min, round(MAX(1e6 * out_max / win_len), 3) AS out_max,
    round(AVG(1e6 * out_max / win_len), 3) AS out_avg, round(STDDEV_POP(1e6 * out_max / win_len), 3) AS out_dev
    FROM t_bandwidth b JOIN t_members m ON b.client = m.client GROUP BY 1, 2, 3""",
)
def bandwidth(t):
    out = groups.bandwidth_by_group(t("t_bandwidth"), t("t_members"))
    return out.withColumns({c: F.round(c, 3) for c in out.columns if c.startswith(("in_m", "in_a", "in_d", "out_"))})


def histograms(t):
    return groups.dense_arrays(
        t("t_speed"), ["timestamp", "client"], "pos", groups.SPEED_ARRAYS
    )


@query(
    "a08_bandwidth_avg",
    """SELECT timestamp, client, CAST(SUM(in_bytes) // SUM(in_time) AS BIGINT) AS bps_in,
    CAST(SUM(out_bytes) // SUM(out_time) AS BIGINT) AS bps_out
    FROM t_speed GROUP BY 1, 2 HAVING SUM(in_time) > 0 AND SUM(out_time) > 0""",
)
def speeds(t):
    return groups.bandwidth_avg(histograms(t))


def cells(df, keys):
    """One row per non-zero cell, so that arrays compare as plain rows."""
    return (
        df.select(*keys, F.posexplode(F.arrays_zip(*groups.SPEED_ARRAYS)).alias("pos", "cell"))
        .select(*keys, "pos", "cell.*")
        .where("in_time <> 0 OR in_bytes <> 0 OR out_time <> 0 OR out_bytes <> 0")
    )


SQL_CELLS = """CAST(SUM(in_time) AS BIGINT) AS in_time, CAST(SUM(in_bytes) AS BIGINT) AS in_bytes,
 CAST(SUM(out_time) AS BIGINT) AS out_time, CAST(SUM(out_bytes) AS BIGINT) AS out_bytes"""


@query("x26_dense_arrays", f"SELECT timestamp, client, pos, {SQL_CELLS} FROM t_speed GROUP BY 1, 2, 3")
def dense(t):
    return cells(histograms(t), ["timestamp", "client"])


@query(
    "a09_array_sum",
    f"""SELECT * FROM (SELECT s.timestamp, m.in_group, s.pos, {SQL_CELLS}
    FROM t_speed s JOIN t_members m ON s.client = m.client GROUP BY 1, 2, 3)
    JOIN (SELECT s.timestamp, m.in_group, COUNT(DISTINCT s.client) AS clients
    FROM t_speed s JOIN t_members m ON s.client = m.client GROUP BY 1, 2) USING (timestamp, in_group)""",
)
def sums(t):
    return cells(groups.bandwidth_sums(histograms(t), t("t_members")), ["timestamp", "in_group", "clients"])


@query(
    "a15_refused_by_addr",
    """SELECT address, remote_port, reason, date_trunc('hour', timestamp) AS since,
    date_trunc('hour', timestamp) + INTERVAL '1 hour' AS until,
    COUNT(*) AS conn_count, COUNT(DISTINCT client) AS client_count FROM t_refused GROUP BY ALL""",
)
def refused_addresses(t):
    return groups.refused_by_addr(t("t_refused"))


@query(
    "a16_refused_by_client",
    """SELECT client, reason, date_trunc('hour', timestamp) AS since,
    date_trunc('hour', timestamp) + INTERVAL '1 hour' AS until, COUNT(*) AS count FROM t_refused GROUP BY ALL""",
)
def refused_clients(t):
    return groups.refused_by_client(t("t_refused"))


@query(
    "a18_spoof_counts",
    """SELECT s.batch, m.in_group, COUNT(CASE WHEN NOT spoofed THEN TRUE END) AS reachable,
    COUNT(CASE WHEN spoofed AND addr_matches THEN TRUE END) AS spoofable
    FROM t_spoof s JOIN t_members m ON s.client = m.client GROUP BY 1, 2""",
)
def spoof(t):
    return groups.spoof_counts(t("t_spoof"), t("t_members"))


@query(
    "a22_nat_counts",
    """SELECT m.in_group, o.batch, COUNT(CASE WHEN v4 = 'D' THEN 1 END) AS v4_direct, COUNT(CASE WHEN v4 = 'N' THEN 1 END) AS v4_nat,
    COUNT(CASE WHEN v6 = 'D' THEN 1 END) AS v6_direct, COUNT(CASE WHEN v6 = 'N' THEN 1 END) AS v6_nat, COUNT(*) AS total
    FROM t_nat_obs o JOIN t_members m ON o.client = m.client GROUP BY 1, 2""",
)
def nat(t):
    return groups.nat_counts(t("t_nat_obs"), t("t_members"))


@query(
    "a23_firewall_hits",
    """SELECT remote_address, COUNT(DISTINCT router_id) AS routers, COUNT(*) AS packets
    FROM t_firewall_log WHERE direction = 'I' AND remote_address IN (SELECT DISTINCT address FROM t_addr_store)
    GROUP BY 1 HAVING COUNT(DISTINCT router_id) > 5 AND COUNT(*) > 20""",
)
def hits(t):
    return groups.firewall_hits(t("t_firewall_log"), t("t_addr_store"), 5, 20)
