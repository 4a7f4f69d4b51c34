"""Reputation histories and local network summaries."""

from pyspark.sql import functions as F

from netloom.operators import lan, reputation
from netloom.plans.registry import query

SQL_REPUTATION = """SELECT ip, kind, date, CAST(SUM(cnt) AS BIGINT) AS cnt FROM t_incidents WHERE ip NOT LIKE '10.%' GROUP BY 1, 2, 3"""


@query("a24_reputation", SQL_REPUTATION)
def documents(t):
    """The documents, exploded again so that they compare as rows."""
    return reputation.exploded(reputation.reputation(t("t_incidents")))


@query(
    "a24_reputation_json",
    f"""WITH c AS ({SQL_REPUTATION}),
    k AS (SELECT ip, kind, string_agg(concat('"', date, '":', cnt), ',' ORDER BY date) AS days FROM c GROUP BY 1, 2)
    SELECT ip, concat('{{', string_agg(concat('"', kind, '":{{', days, '}}'), ',' ORDER BY kind), '}}') AS data FROM k GROUP BY 1""",
)
def json_documents(t):
    return reputation.to_json(reputation.reputation(t("t_incidents")))


@query("x27_json_round_trip", SQL_REPUTATION)
def round_trip(t):
    return reputation.exploded(reputation.from_json(reputation.to_json(reputation.reputation(t("t_incidents")))))


@query(
    "a26_merge_reputation",
    """SELECT ip, kind, date, CAST(SUM(cnt) AS BIGINT) AS cnt FROM (SELECT * FROM t_incidents WHERE date >= DATE '2024-01-10'
    UNION ALL SELECT * FROM t_incidents WHERE date <= DATE '2024-01-20') WHERE ip NOT LIKE '10.%' GROUP BY 1, 2, 3""",
)
def merged(t):
    rows = t("t_incidents")
    old = reputation.reputation(rows.where("date <= DATE '2024-01-20'"))
    new = reputation.reputation(rows.where("date >= DATE '2024-01-10'"))
    return reputation.exploded(reputation.merge_reputation(old, new))


@query("a27_compact", "SELECT ip, date, kind, CAST(SUM(cnt) AS BIGINT) AS cnt FROM t_incidents GROUP BY 1, 2, 3")
def compacted(t):
    return reputation.compact(t("t_incidents"))


SQL_V6 = """SELECT concat('2001:db8:', CAST(user_id % 9 AS STRING), ':', CAST(1 + event_id % 5 AS STRING), '::', CAST(1 + event_id % 50 AS STRING)) AS ip,
 CAST(ts AS DATE) AS date, 1 + event_id % 3 AS cnt, CASE WHEN event_id % 2 = 0 THEN 'ssh' ELSE 'telnet' END AS kind FROM """


@query(
    "a25_reputation_v6_nets",
    f"""WITH v AS ({SQL_V6} events),
    n AS (SELECT * FROM v UNION ALL SELECT concat(split_part(ip, '::', 1), '::/64'), date, cnt, kind FROM v)
    SELECT ip, kind, date, CAST(SUM(cnt) AS BIGINT) AS cnt FROM n GROUP BY 1, 2, 3""",
)
def v6_nets(t):
    return reputation.histories(t.sql(SQL_V6 + "{events}"), v6_nets=True)


SQL_LAN = """lf AS (SELECT proto, src, dst, port, hour, u_count, u_size, u_size - 40 * u_count AS u_dsize, u_count % 5 AS d_count, u_count % 5 * 100 AS d_size, u_count % 5 * 60 AS d_dsize,
 CASE WHEN u_count % 3 = 0 THEN 'none' ELSE concat('h', CAST(u_count % 4 AS VARCHAR)) END AS resolved FROM t_lan_flows)"""
COUNTER_SUMS = ", ".join(f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in lan.COUNTERS)


def flows(t):
    u = F.col("u_count")
    return t("t_lan_flows").select(
        "proto", "src", "dst", "port", "hour", "u_count", "u_size",
        (F.col("u_size") - 40 * u).alias("u_dsize"),
        (u % 5).alias("d_count"), (u % 5 * 100).alias("d_size"), (u % 5 * 60).alias("d_dsize"),
        F.when(u % 3 == 0, "none").otherwise(F.concat(F.lit("h"), (u % 4).cast("string"))).alias("resolved"),
    )


@query(
    "a30_lan_merge",
    f"""WITH {SQL_LAN} SELECT proto, src, dst, port, {COUNTER_SUMS},
    COALESCE(string_agg(DISTINCT NULLIF(resolved, 'none'), ',' ORDER BY NULLIF(resolved, 'none')), '') AS names FROM lf GROUP BY 1, 2, 3, 4""",
)
def merged_lan(t):
    rows = flows(t).drop("hour")
    halves = [rows.where("u_count <= 25"), rows.where("u_count > 25")]
    return lan.lan_merge(*halves).withColumn("names", F.concat_ws(",", "names"))


@query("a31_lan_rollup", f"WITH {SQL_LAN} SELECT date_trunc('month', hour) AS time, proto, src, dst, port, {COUNTER_SUMS} FROM lf GROUP BY 1, 2, 3, 4, 5")
def rolled_up(t):
    hourly = flows(t).withColumnRenamed("hour", "time")
    daily = lan.lan_rollup(hourly, "day")
    return lan.lan_rollup(daily, "month")


@query(
    "a31_keep_last",
    f"WITH {SQL_LAN} SELECT hour AS time, proto, src, dst, port, u_count FROM lf WHERE hour >= (SELECT MIN(h) FROM (SELECT DISTINCT hour AS h FROM lf ORDER BY 1 DESC LIMIT 12))",
)
def kept(t):
    hourly = flows(t).select(F.col("hour").alias("time"), "proto", "src", "dst", "port", "u_count")
    return lan.keep_last(hourly, 12)


SQL_TOPK = f"""{SQL_LAN}, su AS (SELECT proto, src, dst, port, {COUNTER_SUMS} FROM lf GROUP BY 1, 2, 3, 4),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY src ORDER BY u_count DESC, proto, dst, port) AS rn FROM su)"""


def summary(t):
    return flows(t).groupBy(*lan.KEY).agg(*[F.sum(c).alias(c) for c in lan.COUNTERS])


@query(
    "w05_topk_with_other",
    f"""WITH {SQL_TOPK} SELECT CASE WHEN rn <= 20 THEN proto ELSE 'both' END AS proto, src, CASE WHEN rn <= 20 THEN dst ELSE 'other' END AS dst,
    CASE WHEN rn <= 20 THEN port ELSE 'all' END AS port, {COUNTER_SUMS} FROM rk GROUP BY 1, 2, 3, 4""",
)
def folded(t):
    return lan.topk_with_other(summary(t), 20)


@query("o02_lan_report", f"WITH {SQL_TOPK} SELECT * EXCLUDE (rn) FROM rk ORDER BY src, u_count DESC, proto, dst, port")
def report(t):
    return lan.lan_report(summary(t))


# Packets with MAC addresses: a few multicast ones (first byte odd).
SQL_FRAMES = """fr AS (SELECT ts, direction, app_protocol AS proto, addr_remote, CAST(port_remote AS BIGINT) AS port_remote, length, 20 + id % 20 AS hdr_length,
 CASE WHEN id % 13 = 0 THEN '01:00:5e:00:00:01' ELSE concat('02:00:00:00:00:', CAST(10 + client % 20 AS VARCHAR)) END AS mac_local, '02:00:00:00:00:01' AS mac_remote FROM t_packets)"""


def frames(t):
    mac = F.concat(F.lit("02:00:00:00:00:"), (10 + F.col("client") % 20).cast("string"))
    return t("t_packets").select(
        "ts", "direction", F.col("app_protocol").alias("proto"), "addr_remote",
        F.col("port_remote").cast("long").alias("port_remote"), "length", (20 + F.col("id") % 20).alias("hdr_length"),
        F.when(F.col("id") % 13 == 0, "01:00:5e:00:00:01").otherwise(mac).alias("mac_local"),
        F.lit("02:00:00:00:00:01").alias("mac_remote"),
    )


SQL_LAN_SUMS = """CASE proto WHEN 'T' THEN 'TCP' ELSE 'UDP' END AS proto, mac_local AS src, addr_remote AS dst, CAST(port_remote AS VARCHAR) AS port,
 COUNT(*) FILTER (WHERE direction = 'in') AS d_count, CAST(COALESCE(SUM(length) FILTER (WHERE direction = 'in'), 0) AS BIGINT) AS d_size,
 CAST(COALESCE(SUM(length - hdr_length) FILTER (WHERE direction = 'in'), 0) AS BIGINT) AS d_dsize,
 COUNT(*) FILTER (WHERE direction = 'out') AS u_count, CAST(COALESCE(SUM(length) FILTER (WHERE direction = 'out'), 0) AS BIGINT) AS u_size,
 CAST(COALESCE(SUM(length - hdr_length) FILTER (WHERE direction = 'out'), 0) AS BIGINT) AS u_dsize
 FROM fr WHERE proto IN ('T', 'U') AND mac_local NOT LIKE '01:%'"""


@query("a29_lan_summary", f"WITH {SQL_FRAMES} SELECT {SQL_LAN_SUMS} GROUP BY 1, 2, 3, 4")
def summed(t):
    return lan.lan_summary(frames(t))


@query(
    "t18_lan_by_window",
    f"""WITH {SQL_FRAMES}, su AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS start, {SQL_LAN_SUMS} GROUP BY ALL),
    rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY start, src ORDER BY u_count DESC, proto, dst, port) AS rn FROM su)
    SELECT start, CASE WHEN rn <= 3 THEN proto ELSE 'both' END AS proto, src, CASE WHEN rn <= 3 THEN dst ELSE 'other' END AS dst,
    CASE WHEN rn <= 3 THEN port ELSE 'all' END AS port, {COUNTER_SUMS} FROM rk GROUP BY 1, 2, 3, 4, 5""",
)
def windowed(t):
    from netloom.functions.times import bin_start

    start = bin_start("ts", 6 * 3600 * 1_000_000).alias("start")
    return lan.topk_with_other(lan.lan_summary(frames(t), window=start), 3, keys=("start", "src"))


@query("f10_unicast_mac", f"WITH {SQL_FRAMES} SELECT * FROM fr WHERE mac_local NOT LIKE '01:%'")
def unicast(t):
    from netloom.functions.net import p_unicast_mac

    return frames(t).where(p_unicast_mac("mac_local"))
