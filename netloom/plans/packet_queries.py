"""Packet counters, flows, bandwidth, refused connections and predicates."""

from pyspark.sql import functions as F

from netloom.functions import net, predicates, scalars
from netloom.functions.times import bin_start, hour_of
from netloom.operators import groups, packets
from netloom.plans.registry import query
from netloom.schemas import COUNT_TYPES, SPEED_EDGES_KBIT

SERVER = "198.51.100.3"
DAY_US = 86_400_000_000


def layered(t):
    return t("t_packets").withColumns(
        {
            "layer": F.when(F.col("id") % 29 == 0, "?").otherwise("I"),
            "tunnel": F.col("client") % 16 == 0,
            "direction": F.when(F.col("id") % 31 == 0, "unknown").otherwise(F.col("direction")),
        }
    )


SQL_PACKETS = """pk AS (SELECT * REPLACE (CASE WHEN id % 31 = 0 THEN 'unknown' ELSE direction END AS direction),
 CASE WHEN id % 29 = 0 THEN '?' ELSE 'I' END AS layer, client % 16 = 0 AS tunnel FROM t_packets)"""
# The conditions again, in SQL, by counter name.
SQL_CONDITIONS = {
    "All": "TRUE",
    "IPv4": "layer = 'I' AND ip_protocol = 4",
    "IPv6": "layer = 'I' AND ip_protocol = 6 AND NOT tunnel",
    "In": "direction = 'in'",
    "Out": "direction = 'out'",
    "TCP": "layer = 'I' AND app_protocol = 'T'",
    "UDP": "layer = 'I' AND app_protocol = 'U'",
    "ICMP": "layer = 'I' AND app_protocol IN ('i', 'I')",
    "Low port": "layer = 'I' AND direction <> 'unknown' AND port_remote BETWEEN 1 AND 1024",
    "SYN": "layer = 'I' AND app_protocol = 'T' AND tcp_flags & 2 > 0",
    "FIN": "layer = 'I' AND app_protocol = 'T' AND tcp_flags & 1 > 0",
    "SYN+ACK": "layer = 'I' AND app_protocol = 'T' AND tcp_flags & 18 = 18",
    "ACK": "layer = 'I' AND app_protocol = 'T' AND tcp_flags & 16 > 0",
    "PUSH": "layer = 'I' AND app_protocol = 'T' AND tcp_flags & 8 > 0",
    "SERVER": f"layer = 'I' AND direction <> 'unknown' AND addr_remote = '{SERVER}' AND port_remote <> 22",
    "V6TUNNEL": "layer = 'I' AND ip_protocol = 6 AND tunnel",
}
SQL_COUNTS = f"WITH {SQL_PACKETS} " + " UNION ALL ".join(
    f"""SELECT {{start}} AS start, client, '{name}' AS type, COUNT(*) FILTER (WHERE {SQL_CONDITIONS[name]}) AS count,
    CAST(COALESCE(SUM(length) FILTER (WHERE {SQL_CONDITIONS[name]}), 0) AS BIGINT) AS size FROM pk GROUP BY 1, 2"""
    for name in COUNT_TYPES
)


@query("a01_packet_counts", SQL_COUNTS.format(start="date_trunc('hour', ts)"))
def counts(t):
    return packets.packet_counts(layered(t), hour_of("ts"), (SERVER,))


SQL_FLOWS = """ip_protocol, app_protocol, addr_local, addr_remote, port_local, port_remote,
 COUNT(*) FILTER (WHERE direction = 'in') AS count_in, COUNT(*) FILTER (WHERE direction = 'out') AS count_out,
 CAST(COALESCE(SUM(length) FILTER (WHERE direction = 'in'), 0) AS BIGINT) AS size_in, CAST(COALESCE(SUM(length) FILTER (WHERE direction = 'out'), 0) AS BIGINT) AS size_out,
 MIN(ts) FILTER (WHERE direction = 'in') AS start_in, MIN(ts) FILTER (WHERE direction = 'out') AS start_out,
 MAX(ts) FILTER (WHERE direction = 'in') AS stop_in, MAX(ts) FILTER (WHERE direction = 'out') AS stop_out,
 COALESCE(bool_or(direction = 'in' AND app_protocol = 'T' AND tcp_flags & 18 = 2), FALSE) AS seen_start_in, COALESCE(bool_or(direction = 'out' AND app_protocol = 'T' AND tcp_flags & 18 = 2), FALSE) AS seen_start_out,
 COALESCE(bool_or(direction = 'in' AND app_protocol = 'T' AND tcp_flags & 1 = 1), FALSE) AS seen_end_in, COALESCE(bool_or(direction = 'out' AND app_protocol = 'T' AND tcp_flags & 1 = 1), FALSE) AS seen_end_out,
 COALESCE(bool_or(app_protocol = 'T' AND tcp_flags & 4 = 4), FALSE) AS seen_rst
 FROM pk WHERE layer = 'I' AND direction <> 'unknown' AND app_protocol IN ('T', 'U') GROUP BY ALL"""


@query("a28_assemble_flows", f"WITH {SQL_PACKETS} SELECT client, {SQL_FLOWS}")
def flows(t):
    return packets.assemble_flows(layered(t))


@query("f21_min_packets", f"WITH {SQL_PACKETS}, fl AS (SELECT client, {SQL_FLOWS}) SELECT * FROM fl WHERE count_in + count_out >= 5")
def big_flows(t):
    return packets.assemble_flows(layered(t), min_packets=5)


@query("t04_windowed_flows", f"WITH {SQL_PACKETS} SELECT time_bucket(INTERVAL '1 day', ts) AS start, client, {SQL_FLOWS}")
def windowed_flows(t):
    return packets.assemble_flows(layered(t), window=bin_start("ts", DAY_US))


SQL_GAP = "INTERVAL '6 hours'"
# Flows that end after a silence; `ends` is the time of a session's last packet.
SQL_SESSIONS = f"""{SQL_PACKETS},
 ok AS (SELECT * FROM pk WHERE layer = 'I' AND direction <> 'unknown' AND app_protocol IN ('T', 'U')),
 mk AS (SELECT *, ts - LAG(ts) OVER fl > {SQL_GAP} AS opens FROM ok
  WINDOW fl AS (PARTITION BY client, ip_protocol, app_protocol, addr_local, addr_remote, port_local, port_remote ORDER BY ts, id)),
 nu AS (SELECT *, SUM(CASE WHEN opens THEN 1 ELSE 0 END) OVER
  (PARTITION BY client, ip_protocol, app_protocol, addr_local, addr_remote, port_local, port_remote ORDER BY ts, id) AS n FROM mk),
 se AS (SELECT *, MIN(ts) OVER s AS start, MAX(ts) OVER s AS ends FROM nu
  WINDOW s AS (PARTITION BY client, ip_protocol, app_protocol, addr_local, addr_remote, port_local, port_remote, n))"""


@query("t04_flow_sessions", f"WITH {SQL_SESSIONS} SELECT start, client, {SQL_FLOWS.replace('FROM pk', 'FROM se')}")
def flow_sessions(t):
    sessions = packets.assemble_flows(layered(t), window=F.session_window("ts", "6 hours"))
    return sessions.withColumn("start", F.col("start.start"))


HOURS = (3_600_000_000, 7_200_000_000, 21_600_000_000)


def bulky(t):
    """Packets a thousand times as long, so that speeds reach many buckets."""
    return layered(t).withColumn("length", F.col("length") * 20_000_000)


@query(
    "t02_peak_bandwidth",
    f"""WITH {SQL_PACKETS}, w AS (SELECT unnest([1, 2, 6]) AS h),
    s AS (SELECT client, CAST(h * 3600000000 AS BIGINT) AS win_len, make_timestamp(epoch_us(ts) // (h * 3600000000) * (h * 3600000000)) AS start,
    SUM(CASE WHEN direction = 'in' THEN length ELSE 0 END) AS i, SUM(CASE WHEN direction = 'in' THEN 0 ELSE length END) AS o FROM pk, w GROUP BY 1, 2, 3)
    SELECT date_trunc('day', start) AS timestamp, client, win_len, CAST(MAX(i) AS BIGINT) AS in_max, CAST(MAX(o) AS BIGINT) AS out_max FROM s GROUP BY 1, 2, 3""",
)
def peaks(t):
    return packets.peak_bandwidth(layered(t), DAY_US, HOURS)


SQL_EDGES = "[" + ", ".join(str(k * 1000 // 8) for k in SPEED_EDGES_KBIT) + "]"


@query(
    "x22_speed_bucket",
    f"""SELECT event_id, CAST(CASE WHEN v > 125000000 THEN NULL ELSE len(list_filter({SQL_EDGES}, lambda e: e < v)) END AS INTEGER) AS pos
    FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 50 AS BIGINT) * 31250 ELSE CAST(round(value * value * value) AS BIGINT) END AS v FROM events)""",
)
def buckets(t):
    value = F.round(F.col("value") * F.col("value") * F.col("value")).cast("long")
    speed = F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 50 * 31250).otherwise(value)
    return t("events").select("event_id", scalars.speed_bucket(speed).alias("pos"))


@query(
    "a33_speed_histogram",
    f"""WITH {SQL_PACKETS},
    s AS (SELECT client, date_trunc('hour', ts) AS start, SUM(CASE WHEN direction = 'in' THEN length * 20000000 ELSE 0 END) AS i,
     SUM(CASE WHEN direction = 'in' THEN 0 ELSE length * 20000000 END) AS o FROM pk GROUP BY 1, 2),
    r AS (SELECT client, unnest(generate_series(MIN(start), MAX(start), INTERVAL '1 hour')) AS start FROM s GROUP BY 1),
    d AS (SELECT r.client, date_trunc('day', r.start) AS timestamp, COALESCE(i, 0) AS i, COALESCE(o, 0) AS o FROM r LEFT JOIN s ON s.client = r.client AND s.start = r.start),
    b AS (SELECT client, timestamp, 'in' AS side, i AS bytes FROM d UNION ALL SELECT client, timestamp, 'out', o FROM d),
    p AS (SELECT *, CAST(len(list_filter({SQL_EDGES}, lambda e: e < bytes // 3600)) AS INTEGER) AS pos FROM b WHERE bytes // 3600 <= 125000000)
    SELECT timestamp, client, pos, COUNT(*) FILTER (WHERE side = 'in') * 3600 AS in_time, CAST(COALESCE(SUM(bytes) FILTER (WHERE side = 'in'), 0) AS BIGINT) AS in_bytes,
    COUNT(*) FILTER (WHERE side = 'out') * 3600 AS out_time, CAST(COALESCE(SUM(bytes) FILTER (WHERE side = 'out'), 0) AS BIGINT) AS out_bytes FROM p GROUP BY 1, 2, 3""",
)
def histogram(t):
    return packets.speed_histogram(bulky(t), 3_600_000_000, "day")


def connection_events(t):
    """Few connections with many packets, so that attempts hold several events."""
    rows = t("t_packets").withColumns(
        {
            "layer": F.lit("I"),
            "direction": F.when(F.col("id") % 4 < 2, "in").otherwise("out"),
            "client": F.col("client") % 10, "port_local": F.col("port_local") % 3, "port_remote": F.lit(22),
            "addr_remote": F.lit("198.51.100.1"),
        }
    )
    return packets.connection_events(rows)


SQL_ATTEMPTS = """WITH RECURSIVE ev AS (SELECT client % 10 AS client, '198.51.100.1' AS address, port_local % 3 AS local_port, 22 AS remote_port, ts,
 CASE WHEN id % 4 >= 2 AND tcp_flags & 18 = 2 THEN 'syn' WHEN id % 4 < 2 AND tcp_flags & 18 = 18 THEN 'ack' WHEN id % 4 < 2 AND tcp_flags & 4 = 4 THEN 'nak' END AS kind
 FROM t_packets WHERE app_protocol = 'T' AND kind IS NOT NULL),
st AS (SELECT client, local_port, MIN(ts) AS s FROM ev GROUP BY 1, 2
 UNION ALL SELECT st.client, st.local_port, (SELECT MIN(ts) FROM ev WHERE ev.client = st.client AND ev.local_port = st.local_port AND ev.ts > st.s + INTERVAL '12 hours') AS s2
 FROM st WHERE s2 IS NOT NULL),
att AS (SELECT ev.*, st.s FROM ev JOIN st ON ev.client = st.client AND ev.local_port = st.local_port AND ev.ts BETWEEN st.s AND st.s + INTERVAL '12 hours'),
de AS (SELECT client, address, local_port, remote_port, s, MIN(ts) FILTER (WHERE kind = 'syn') AS syn, MIN(ts) FILTER (WHERE kind = 'ack') AS ack, MIN(ts) FILTER (WHERE kind = 'nak') AS nak FROM att GROUP BY 1, 2, 3, 4, 5)
SELECT client, address, local_port, remote_port, s AS timestamp, CASE WHEN nak IS NULL THEN 'T' ELSE 'P' END AS reason FROM de
WHERE syn IS NOT NULL AND (ack IS NULL OR (nak < ack AND ack > greatest(syn, nak)))"""


@query("t05_classify_refused", SQL_ATTEMPTS)
def refused(t):
    return packets.classify_refused(connection_events(t), 12 * 3_600_000_000)


SQL_WARNINGS = """WITH RECURSIVE od AS (SELECT id % 3 AS client, id, ts, 'layer' AS kind FROM t_packets WHERE id % 7 = 0
        UNION ALL SELECT id % 3, id, ts, 'direction' FROM t_packets WHERE id % 5 = 0 UNION ALL SELECT id % 3, id, ts, 'pppoe' FROM t_packets WHERE id % 11 = 0),
        st AS (SELECT client, kind, MIN(ts) AS s FROM od GROUP BY 1, 2 UNION ALL
         SELECT st.client, st.kind, (SELECT MIN(ts) FROM od WHERE od.client = st.client AND od.kind = st.kind AND od.ts > st.s + INTERVAL '24 hours') AS s2 FROM st WHERE s2 IS NOT NULL),
        nu AS (SELECT od.*, st.s, ROW_NUMBER() OVER (PARTITION BY od.client, od.kind, st.s ORDER BY od.ts, od.id) AS n
         FROM od JOIN st ON od.client = st.client AND od.kind = st.kind AND od.ts BETWEEN st.s AND st.s + INTERVAL '24 hours')
        SELECT client, kind, s AS start, ts FROM nu WHERE n = 10"""


def odd_packets(t):
    return t("t_packets").select(
        (F.col("id") % 3).alias("client"), "id", "ts",
        F.when(F.col("id") % 7 == 0, "?").otherwise("E").alias("layer"),
        F.when(F.col("id") % 5 == 0, "unknown").otherwise("in").alias("direction"),
        F.when(F.col("id") % 11 == 0, "P").otherwise("I").alias("app_protocol"),
    )


@query("f24_capture_warnings", SQL_WARNINGS)
def warnings(t):
    return packets.capture_warnings(odd_packets(t), DAY_US)


def kept(name, where, build):
    """A predicate query: ids of the packets it keeps."""
    query(name, f"WITH {SQL_PACKETS} SELECT id, addr_remote, port_remote FROM pk WHERE {where}")(
        lambda tables: layered(tables).where(build()).select("id", "addr_remote", "port_remote")
    )


P = predicates
kept("f01_true", "TRUE", P.p_true)
kept("f01_false", "FALSE", P.p_false)
kept("f02_not", "NOT port_remote IN (22, 23)", lambda: P.p_not(P.p_port("remote", (22, 23))))
kept("f03_and", "port_remote = 22 AND addr_remote = '198.51.100.3'", lambda: P.p_and(P.p_port("remote", (22,)), P.p_ip("remote", ("198.51.100.3",))))
kept("f03_and_empty", "TRUE", P.p_and)
kept("f04_or", "port_remote = 22 OR addr_remote = '198.51.100.3'", lambda: P.p_or(P.p_port("remote", (22,)), P.p_ip("remote", ("198.51.100.3",))))
kept("f04_or_empty", "FALSE", P.p_or)
kept("f05_local_ip", "addr_local IN ('192.168.1.1', '192.168.1.2')", lambda: P.p_ip("local", ("192.168.1.1", "192.168.1.2")))
kept("f06_local_port", "port_local IN (40001, 40099)", lambda: P.p_port("local", (40001, 40099)))
kept("f08_cidr", "CAST(split_part(addr_remote, '.', 4) AS INTEGER) BETWEEN 8 AND 15", lambda: P.p_cidr("remote", "198.51.100.8", 29))
kept("f08_other_family", "FALSE", lambda: P.p_cidr("remote", "2001:db8::", 32))
kept("f11_trackable", "direction <> 'unknown' AND layer = 'I' AND app_protocol IN ('T', 'U')", P.p_trackable)


@query(
    "f07_addr_set",
    """WITH en AS (SELECT DISTINCT concat('198.51.100.', CAST(user_id % 4 AS VARCHAR)) AS address, CASE WHEN user_id % 2 = 0 THEN 22 END AS port FROM events)
    SELECT id, EXISTS (SELECT 1 FROM en WHERE en.address = addr_remote AND (en.port IS NULL OR en.port = port_remote)) AS in_set FROM t_packets""",
)
def in_set(t):
    entries = t.sql(
        "SELECT DISTINCT concat('198.51.100.', CAST(user_id % 4 AS STRING)) AS address, CASE WHEN user_id % 2 = 0 THEN 22 END AS port FROM {events}"
    )
    return predicates.p_addr_set(t("t_packets"), "remote", entries).select("id", "in_set")


@query("f12_public_ip", "SELECT ip, kind FROM t_incidents WHERE ip NOT LIKE '10.%'")
def public(t):
    return t("t_incidents").where(net.p_public_ip("ip")).select("ip", "kind")


@query("f13_public_ip_legacy", "SELECT ip, kind FROM t_incidents WHERE ip NOT LIKE '10.%'")
def public_legacy(t):
    return t("t_incidents").where(net.p_public_ip("ip", legacy=True)).select("ip", "kind")


@query("f14_private_text", "SELECT id, addr_local LIKE '192.168.%' AS local_private, addr_remote LIKE '10.%' AS remote_private FROM t_packets")
def private(t):
    return t("t_packets").select(
        "id", net.p_private_text("addr_local").alias("local_private"), net.p_private_text("addr_remote").alias("remote_private")
    )


@query(
    "f15_flag_forbidden",
    """SELECT id, remote, CASE WHEN remote LIKE '198.18.3.%' THEN 'own' WHEN remote LIKE '10.%' THEN 'private' END AS why FROM t_fake_logs""",
)
def forbidden(t):
    logs = t("t_fake_logs").select("id", "remote")
    own = logs.where("remote LIKE '198.18.3.%'").select(F.col("remote").alias("address")).distinct()
    return predicates.flag_forbidden(logs, own)


@query("f16_fresh", "SELECT event_id FROM events WHERE event_id % 7 = 0 OR user_id * 1000000 <= 86400000")
def fresh(t):
    from netloom.functions.times import fresh as is_fresh

    clock = F.lit(10**12)
    stamp = F.when(F.col("event_id") % 7 == 0, 0).otherwise(clock - F.col("user_id") * 1_000_000)
    return t("events").where(is_fresh(clock, stamp)).select("event_id")


@query("f17_current_snapshot", "SELECT id FROM t_activities WHERE timestamp >= date_trunc('hour', timestamp) + INTERVAL '30 minutes'")
def current(t):
    last = hour_of("timestamp") + F.expr("INTERVAL 30 MINUTES")
    return t("t_activities").where(predicates.p_current_snapshot(F.col("timestamp"), last)).select("id")


@query("f18_drop_oversized", "SELECT id FROM t_biflows WHERE client NOT IN (SELECT client FROM t_biflows GROUP BY 1 HAVING COUNT(*) > 1200)")
def oversized(t):
    return predicates.drop_oversized(t("t_biflows"), ["client"], 1200).select("id")


@query("f20_login", "SELECT id FROM t_fake_logs WHERE event = 'login'")
def logins(t):
    return t("t_fake_logs").where(predicates.p_login()).select("id")


@query("f22_redact_credentials", "SELECT id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS password, server FROM t_fake_logs")
def redacted(t):
    logs = t("t_fake_logs").select("id", F.col("remote").alias("name"), F.col("event").alias("password"), "server")
    return predicates.redact_credentials(logs, keep=False)


@query(
    "x01_ip_canon",
    "SELECT ip, ip AS canon, 4 AS family, printf('%02x%02x%02x%02x', CAST(split_part(ip,'.',1) AS INT), CAST(split_part(ip,'.',2) AS INT), CAST(split_part(ip,'.',3) AS INT), CAST(split_part(ip,'.',4) AS INT)) AS hexed FROM t_incidents",
)
def canon(t):
    return t("t_incidents").select(
        "ip", net.ip_canon("ip").alias("canon"), net.ip_family("ip").alias("family"), scalars.hex_text(net.ip_bin("ip")).alias("hexed")
    )


SQL_V6_FORMS = """concat('2001:DB8:', CAST(user_id AS STRING), ':0:0:', CAST(event_id % 9 AS STRING), '::', CAST(1 + event_id % 50 AS STRING))"""


@query(
    "x01_ip_canon_v6",
    # The written groups are 2001:db8:u:0:0:e:0:x; the longest run of zeros depends on u and e.
    """WITH p AS (SELECT event_id, user_id AS u, event_id % 9 AS e, 1 + event_id % 50 AS x FROM events)
    SELECT event_id, concat('2001:DB8:', u, ':0:0:', e, '::', x) AS ip,
    CASE WHEN u = 0 AND e = 0 THEN concat('2001:db8::', x) WHEN u = 0 THEN concat('2001:db8::', e, ':0:', x)
     WHEN e = 0 THEN concat('2001:db8:', u, '::', x) ELSE concat('2001:db8:', u, '::', e, ':0:', x) END AS canon,
    CASE WHEN u = 0 THEN '2001:db8::' ELSE concat('2001:db8:', u, '::') END AS net FROM p""",
)
def canon_v6(t):
    rows = t.sql(f"SELECT event_id, {SQL_V6_FORMS} AS ip FROM {{events}}")
    return rows.select("event_id", "ip", net.ip_canon("ip").alias("canon"), net.ip_net("ip", 64).alias("net"))


@query(
    "x03_ip_text_v6_mapped",
    "SELECT id, addr_remote, addr_remote AS unmapped, concat('::ffff:', addr_remote) AS mapped FROM t_packets",
)
def mapped(t):
    rows = t("t_packets").withColumn("v6", F.concat(F.lit("::FFFF:"), "addr_remote"))
    return rows.select(
        "id", "addr_remote",
        net.ip_text(net.unmap_v4(net.ip_bin("v6"))).alias("unmapped"), net.ip_canon("v6").alias("mapped"),
    )


@query("x05_ip_net", "SELECT id, concat('198.51.100.', CAST(CAST(split_part(addr_remote, '.', 4) AS INT) // 8 * 8 AS VARCHAR)) AS net FROM t_packets")
def networks(t):
    return t("t_packets").select("id", net.ip_net("addr_remote", 29).alias("net"))


@query("x06_mac_text", "SELECT event_id, regexp_replace(printf('%012x', event_id), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') AS mac FROM events")
def macs(t):
    raw = F.unhex(F.lpad(F.hex("event_id"), 12, "0"))
    return t("events").select("event_id", net.mac_text(raw).alias("mac"))


@query(
    "x07_endpoint",
    "SELECT id, CASE direction WHEN 'in' THEN addr_remote ELSE addr_local END AS src, CASE direction WHEN 'in' THEN addr_local ELSE addr_remote END AS dst, addr_local AS local_end, addr_remote AS remote_end FROM t_packets",
)
def ends(t):
    inbound = F.col("direction") == "in"
    framed = t("t_packets").select(
        "id", "direction",
        F.when(inbound, F.col("addr_remote")).otherwise(F.col("addr_local")).alias("src"),
        F.when(inbound, F.col("addr_local")).otherwise(F.col("addr_remote")).alias("dst"),
    )
    return framed.select("id", "src", "dst", scalars.endpoint("local").alias("local_end"), scalars.endpoint("remote").alias("remote_end"))


@query("x09_flag_bits", "SELECT id, tcp_flags & 2 <> 0 AS syn, tcp_flags & 16 <> 0 AS ack, tcp_flags & 5 <> 0 AS fin_or_rst FROM t_packets")
def flags(t):
    b = scalars.bit
    return t("t_packets").select("id", b("tcp_flags", 2).alias("syn"), b("tcp_flags", 16).alias("ack"), b("tcp_flags", 5).alias("fin_or_rst"))


@query("x11_abs_time", "SELECT event_id, CASE WHEN event_id % 9 > 0 THEN ts - INTERVAL '1 millisecond' * (1000000 - event_id % 9 * 777) END AS t FROM events")
def absolute(t):
    from netloom.functions.times import to_abs_time

    return t("events").select("event_id", to_abs_time(F.col("ts"), F.lit(1_000_000), F.col("event_id") % 9 * 777).alias("t"))


@query(
    "x14_owner_class",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Akamai' WHEN 1 THEN 'Google' WHEN 2 THEN 'Facebook' WHEN 3 THEN 'Microsoft' END AS owner FROM events",
)
def owners(t):
    names = t.sql(
        """SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('AKAMAI-', CAST(user_id AS STRING)) WHEN 1 THEN 'GOOGLE'
        WHEN 2 THEN concat('HKG', CAST(user_id AS STRING)) WHEN 3 THEN 'MICROSOFT-1BLK-X' ELSE concat('GOOGLE-', CAST(user_id AS STRING)) END AS netname FROM {events}"""
    )
    return names.select("event_id", scalars.owner_class(F.col("netname")).alias("owner"))


@query(
    "x15_time_parts",
    "SELECT event_id, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS hour, epoch_us(ts) AS us, CAST(round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 6e7, 0) AS BIGINT) AS minutes, ts + INTERVAL '90 minutes' AS later FROM events",
)
def time_parts(t):
    from netloom.functions.times import micros, minutes_since

    return t("events").select(
        "event_id", F.to_date("ts").alias("day"), hour_of("ts").alias("hour"), micros("ts").alias("us"),
        minutes_since("ts", "2024-02-01").alias("minutes"), (F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("later"),
    )


@query("x20_saturate", "SELECT event_id, least(event_id * 1000000, 2147483647) AS small, event_id AS large FROM events")
def saturated(t):
    return t("events").select(
        "event_id", scalars.saturate(F.col("event_id") * 1_000_000, 31).alias("small"), scalars.saturate("event_id", 63).alias("large")
    )


@query(
    "x21_rates",
    "SELECT timestamp, client, win_len, round(1e6 * in_max / win_len, 4) AS bytes_s, round(8 * in_max / win_len, 4) AS mbit, CAST(in_max * 8 // 1000 AS BIGINT) AS kbit, CAST(in_max * 1000 // 8 AS BIGINT) AS b FROM t_bandwidth",
)
def rates(t):
    return t("t_bandwidth").select(
        "timestamp", "client", "win_len",
        F.round(scalars.rate("in_max", "win_len"), 4).alias("bytes_s"), F.round(scalars.mbits("in_max", "win_len"), 4).alias("mbit"),
        scalars.bytes_to_kbit("in_max").alias("kbit"), scalars.kbit_to_bytes("in_max").alias("b"),
    )


@query(
    "x23_icmp_reason",
    """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN
    CASE event_id % 15 WHEN 0 THEN 'N' WHEN 6 THEN 'N' WHEN 1 THEN 'H' WHEN 7 THEN 'H' WHEN 3 THEN 'P' WHEN 9 THEN 'A' WHEN 10 THEN 'A' WHEN 13 THEN 'A' WHEN 4 THEN NULL ELSE 'O' END
    ELSE CASE event_id % 15 WHEN 0 THEN 'N' WHEN 1 THEN 'A' WHEN 3 THEN 'H' WHEN 4 THEN 'P' ELSE 'O' END END AS reason FROM events""",
)
def reasons(t):
    family = F.when(F.col("user_id") % 2 == 0, 4).otherwise(6)
    return t("events").select("event_id", scalars.icmp_reason(family, F.col("event_id") % 15).alias("reason"))


@query("x28_hex", "SELECT event_id, lower(hex(event_type)) AS hexed, event_type AS back FROM events")
def hexed(t):
    text = scalars.hex_text("event_type")
    return t("events").select("event_id", text.alias("hexed"), scalars.hex_bytes(text).cast("string").alias("back"))


@query(
    "g03_set_entries",
    "SELECT id, CASE id % 3 WHEN 0 THEN addr_remote WHEN 1 THEN concat(addr_remote, '/24') ELSE concat(addr_remote, ',', port_remote) END AS entry FROM t_packets",
)
def entries(t):
    kind = F.get(F.array(F.lit("ip"), F.lit("net"), F.lit("ip,port")), (F.col("id") % 3).cast("int"))
    return t("t_packets").select("id", net.format_set_entry(kind, "addr_remote", "port_remote", F.lit(24)).alias("entry"))


@query(
    "x08_set_items",
    "SELECT id, addr_remote AS ip, CASE WHEN id % 3 > 0 THEN 'tcp' END AS proto, CASE WHEN id % 3 > 0 THEN port_remote END AS port, CASE WHEN id % 2 = 0 THEN 24 END AS prefix FROM t_packets",
)
def items(t):
    text = F.concat(
        "addr_remote",
        F.when(F.col("id") % 2 == 0, "/24").otherwise("/32"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit(",tcp:"), "port_remote")).otherwise(""),
    )
    return t("t_packets").select("id", net.parse_set_item(text).alias("i")).select("id", "i.*")


@query(
    "a40_capture_stats",
    """WITH c AS (SELECT user_id AS client, event_id % 3 AS iface, CASE WHEN event_id % 2 = 0 THEN 'in' ELSE 'out' END AS direction, date_trunc('day', ts) AS snapshot, event_id AS captured, event_id // 10 AS dropped, event_id // 100 AS dropped_driver FROM events),
    s AS (SELECT client, iface, snapshot, MAX(captured) AS captured, MAX(dropped) AS dropped, MAX(dropped_driver) AS dropped_driver FROM c GROUP BY 1, 2, 3, direction),
    b AS (SELECT client, iface, snapshot, CAST(SUM(captured) AS BIGINT) AS captured, CAST(SUM(dropped) AS BIGINT) AS dropped, CAST(SUM(dropped_driver) AS BIGINT) AS dropped_driver FROM s GROUP BY 1, 2, 3)
    SELECT client, snapshot, iface, least(captured - LAG(captured, 1, 0) OVER w, 2147483647) AS captured, least(dropped - LAG(dropped, 1, 0) OVER w, 2147483647) AS dropped, least(dropped_driver - LAG(dropped_driver, 1, 0) OVER w, 2147483647) AS dropped_driver
    FROM b WINDOW w AS (PARTITION BY client, iface ORDER BY snapshot)""",
)
def captures(t):
    counters = t.sql(
        """SELECT user_id AS client, event_id % 3 AS iface, date_trunc('day', ts) AS snapshot, MAX(event_id) AS captured, MAX(event_id div 10) AS dropped, MAX(event_id div 100) AS dropped_driver
        FROM {events} GROUP BY user_id, event_id % 3, date_trunc('day', ts), event_id % 2"""
    )
    return groups.capture_stats(counters.withColumn("snapshot", F.col("snapshot").cast("timestamp_ntz")))


@query(
    "w07_counter_delta",
    "SELECT user_id, event_id, event_id - LAG(event_id, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events",
)
def deltas(t):
    from netloom.operators.ordering import counter_delta

    rows = t("events").withColumn("delta", F.col("event_id"))
    out = counter_delta(rows, ["user_id"], ["ts", "event_id"], hour_of("ts"), ["delta"])
    return out.select("user_id", "event_id", "delta")


@query(
    "w07_counter_delta_nulls",
    """WITH e AS (SELECT CASE WHEN event_id % 7 > 0 THEN user_id END AS user_id, event_id, ts FROM events)
    SELECT user_id, event_id, event_id - LAG(event_id, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM e""",
)
def deltas_of_nulls(t):
    from netloom.operators.ordering import counter_delta

    user = F.when(F.col("event_id") % 7 > 0, F.col("user_id"))
    rows = t("events").withColumns({"user_id": user, "delta": F.col("event_id")})
    out = counter_delta(rows, ["user_id"], ["ts", "event_id"], hour_of("ts"), ["delta"])
    return out.select("user_id", "event_id", "delta")
