"""Packet and alarm queries at the default lengths, over times a thousand times as dense."""

from pyspark.sql import functions as F

from netloom.functions import net
from netloom.functions.times import from_micros, micros
from netloom.operators import limits, packets
from netloom.plans import limit_queries, packet_queries
from netloom.plans.registry import query

DENSE = 1000


def dense(df, column="ts"):
    """Times since the epoch divided, so that seconds hold what hours held."""
    return df.withColumn(column, from_micros(F.floor(micros(column) / DENSE)))


def dense_sql(column="ts"):
    return f"make_timestamp(epoch_us({column}) // {DENSE})"


SQL_DENSE = f"{packet_queries.SQL_PACKETS}, dp AS (SELECT * REPLACE ({dense_sql()} AS ts) FROM pk)"


@query(
    "t02_default_peaks",
    f"""WITH {SQL_DENSE}, w AS (SELECT CAST(unnest({list(packets.WINDOW_LENGTHS)}) AS BIGINT) AS n),
    s AS (SELECT client, n AS win_len, make_timestamp(epoch_us(ts) // n * n) AS start,
     SUM(CASE WHEN direction = 'in' THEN length ELSE 0 END) AS i, SUM(CASE WHEN direction = 'in' THEN 0 ELSE length END) AS o FROM dp, w GROUP BY 1, 2, 3)
    SELECT make_timestamp(epoch_us(start) // 900000000 * 900000000) AS timestamp, client, win_len,
     CAST(MAX(i) AS BIGINT) AS in_max, CAST(MAX(o) AS BIGINT) AS out_max FROM s GROUP BY 1, 2, 3""",
)
def peaks(t):
    return packets.peak_bandwidth(dense(packet_queries.layered(t)), 900_000_000)


@query(
    "a33_default_histogram",
    f"""WITH {SQL_DENSE},
    s AS (SELECT client, epoch_us(ts) // 2000000 AS k, SUM(CASE WHEN direction = 'in' THEN length * 20000 ELSE 0 END) AS i,
     SUM(CASE WHEN direction = 'in' THEN 0 ELSE length * 20000 END) AS o FROM dp GROUP BY 1, 2),
    r AS (SELECT client, unnest(range(MIN(k), MAX(k) + 1)) AS k FROM s GROUP BY 1),
    d AS (SELECT r.client, date_trunc('hour', make_timestamp(r.k * 2000000)) AS timestamp, COALESCE(i, 0) AS i, COALESCE(o, 0) AS o
     FROM r LEFT JOIN s ON s.client = r.client AND s.k = r.k),
    b AS (SELECT client, timestamp, 'in' AS side, i AS bytes FROM d UNION ALL SELECT client, timestamp, 'out', o FROM d),
    p AS (SELECT *, CAST(len(list_filter({packet_queries.SQL_EDGES}, lambda e: e < bytes // 2)) AS INTEGER) AS pos FROM b WHERE bytes // 2 <= 125000000)
    SELECT timestamp, client, pos, COUNT(*) FILTER (WHERE side = 'in') * 2 AS in_time, CAST(COALESCE(SUM(bytes) FILTER (WHERE side = 'in'), 0) AS BIGINT) AS in_bytes,
    COUNT(*) FILTER (WHERE side = 'out') * 2 AS out_time, CAST(COALESCE(SUM(bytes) FILTER (WHERE side = 'out'), 0) AS BIGINT) AS out_bytes FROM p GROUP BY 1, 2, 3""",
)
def histogram(t):
    rows = dense(packet_queries.layered(t)).withColumn("length", F.col("length") * 20_000)
    return packets.speed_histogram(rows)


SQL_REFUSED = packet_queries.SQL_ATTEMPTS.replace("local_port, 22 AS remote_port, ts,", f"local_port, 22 AS remote_port, {dense_sql()} AS ts,")


@query("t05_default_refused", SQL_REFUSED.replace("INTERVAL '12 hours'", "INTERVAL '30 seconds'"))
def refused(t):
    return packets.classify_refused(dense(packet_queries.connection_events(t)))


@query("f24_default_warnings", packet_queries.SQL_WARNINGS.replace("id, ts, 'layer'", f"id, {dense_sql()} AS ts, 'layer'")
       .replace("id, ts, 'direction'", f"id, {dense_sql()}, 'direction'").replace("id, ts, 'pppoe'", f"id, {dense_sql()}, 'pppoe'")
       .replace("INTERVAL '24 hours'", "INTERVAL '15 minutes'"))
def warnings(t):
    return packets.capture_warnings(dense(packet_queries.odd_packets(t)))


SQL_DENSE_LOGS = limit_queries.SQL_BURSTS.replace("FROM t_fake_logs", f"FROM (SELECT * REPLACE ({dense_sql('timestamp')} AS timestamp) FROM t_fake_logs)")


@query("t07_default_bursts", SQL_DENSE_LOGS.replace("INTERVAL '2 days'", "INTERVAL '120 seconds'"))
def bursts(t):
    return limits.login_bursts(dense(t("t_fake_logs"), "timestamp"))


# Addresses that tell the two lists of public ranges apart: (address, public, public by the older list).
SAMPLES = (
    ("10.1.2.3", False, False), ("172.20.0.1", False, False), ("172.32.0.1", True, True), ("192.168.7.7", False, False),
    ("127.0.0.1", False, True), ("192.0.2.9", False, True), ("198.51.100.9", False, True), ("203.0.113.9", False, True),
    ("169.254.1.1", False, True), ("224.0.0.5", False, False), ("255.255.255.255", False, True), ("0.0.0.0", False, True),
    ("8.8.4.4", True, True), ("2001:db8::1", True, True), ("::1", False, True), ("::", False, True), ("ff02::1", False, True),
    ("f002::1", True, False), ("not an address", False, False),
)


def _pick(values) -> str:
    cases = " ".join(f"WHEN {k} THEN {str(v).upper() if isinstance(v, bool) else repr(v)}" for k, v in enumerate(values))
    return f"CASE event_id % {len(SAMPLES)} {cases} END"


def _public(name: str, place: int, legacy: bool):
    @query(name, f"SELECT event_id, {_pick([s[0] for s in SAMPLES])} AS ip FROM events WHERE {_pick([s[place] for s in SAMPLES])}")
    def public(t):
        rows = t.sql(f"SELECT event_id, {_pick([s[0] for s in SAMPLES])} AS ip FROM {{events}}")
        return rows.where(net.p_public_ip("ip", legacy=legacy))


_public("f12_public_ranges", 1, False)
_public("f13_public_ranges_legacy", 2, True)
