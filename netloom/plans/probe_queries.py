"""Ping, certificate and spoofing probes."""

from pyspark.sql import functions as F

from netloom.functions import tls
from netloom.operators import probes
from netloom.plans.registry import query




def rtts(t):
    return t.sql(
        """SELECT event_id AS id, array(CASE WHEN event_id % 12 = 0 THEN 2147483647L ELSE CAST(round(value * 100) AS BIGINT) END,
        CASE WHEN event_id % 3 = 0 THEN 2147483647L ELSE event_id END,
        CASE WHEN event_id % 6 = 0 THEN 2147483647L ELSE user_id END) AS rtts FROM {events}"""
    )


@query(
    "a32_ping_reduce",
    """WITH r AS (SELECT event_id AS id, unnest([CASE WHEN event_id % 12 = 0 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END, CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id END]) AS x FROM events)
    SELECT id, COUNT(x) AS received, MIN(x) AS min, MAX(x) AS max, CAST(SUM(x) // NULLIF(COUNT(x), 0) AS BIGINT) AS avg FROM r GROUP BY id""",
)
def reduced(t):
    return probes.ping_reduce(rtts(t))


@query(
    "f23_valid_rtts",
    "SELECT event_id AS id, 3 - CAST(event_id % 12 = 0 AS INTEGER) - CAST(event_id % 3 = 0 AS INTEGER) - CAST(event_id % 6 = 0 AS INTEGER) AS replies FROM events",
)
def replies(t):
    return rtts(t).select("id", F.size(probes.valid_rtts(F.col("rtts"))).alias("replies"))


@query(
    "w01_minority_ips",
    """WITH c AS (SELECT request, batch, ip, CASE WHEN contains(ip, ':') THEN 6 ELSE 4 END AS family, COUNT(*) AS count
    FROM t_pings WHERE ip IS NOT NULL GROUP BY 1, 2, 3),
    w AS (SELECT *, SUM(count) OVER g AS total, COUNT(*) OVER g AS n FROM c WINDOW g AS (PARTITION BY request, batch, family))
    SELECT host, ip, batch, family, count, CAST(total AS DOUBLE) / (n * n) AS "limit" FROM w JOIN t_ping_requests r ON r.id = w.request
    WHERE count < CAST(total AS DOUBLE) / (n * n)""",
)
def minority(t):
    return probes.minority_ips(t("t_pings"), t("t_ping_requests"))


@query(
    "w02_cert_changes",
    """WITH v AS (SELECT DISTINCT request, batch, value FROM t_certs),
    b AS (SELECT request, batch, LAG(batch) OVER (PARTITION BY request ORDER BY batch) AS previous FROM (SELECT DISTINCT request, batch FROM v))
    SELECT b.request, b.batch, b.previous, v.value, 'added' AS change FROM b JOIN v ON v.request = b.request AND v.batch = b.batch
    WHERE b.previous IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v o WHERE o.request = b.request AND o.batch = b.previous AND o.value = v.value)
    UNION ALL SELECT b.request, b.batch, b.previous, v.value, 'removed' FROM b JOIN v ON v.request = b.request AND v.batch = b.previous
    WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.request = b.request AND o.batch = b.batch AND o.value = v.value)""",
)
def changes(t):
    return probes.cert_changes(t("t_certs"))


@query(
    "a37_weak_ciphers",
    """SELECT c.cipher, concat(r.host, ':', r.port) AS endpoint, c.batch, COUNT(*) AS count FROM t_certs c JOIN t_cert_requests r ON r.id = c.request
    WHERE c.cipher IN ('RC4-MD5', 'DES-CBC3-SHA') GROUP BY c.request, 1, 2, 3""",
)
def weak_ciphers(t):
    return probes.weak_ciphers(t("t_certs"), t("t_cert_requests"))


@query(
    "a37_weak_protocols",
    """SELECT c.proto, concat(r.host, ':', r.port) AS endpoint, c.batch, COUNT(*) AS count FROM t_certs c JOIN t_cert_requests r ON r.id = c.request
    WHERE c.proto NOT IN ('TLSv1', 'TLSv1.1', 'TLSv1.2') GROUP BY c.request, 1, 2, 3""",
)
def weak_protocols(t):
    return probes.weak_protocols(t("t_certs"), t("t_cert_requests"))


@query(
    "a38_multi_value",
    """SELECT host, port, cipher, clients FROM (SELECT r.host, r.port, c.cipher, COUNT(DISTINCT c.client) AS clients,
    COUNT(*) OVER (PARTITION BY r.host, r.port) AS n FROM t_certs c JOIN t_cert_requests r ON r.id = c.request GROUP BY 1, 2, 3) WHERE n > 1""",
)
def several(t):
    return probes.multi_value(t("t_certs"), t("t_cert_requests"), "cipher")


# Names in the fixture are "www.hN.example.org.", "*.hN.example.org" or a stranger.
@query(
    "a39_cert_name_mismatch",
    """SELECT c.request, r.host, r.port, c.value, c.name, c.client, c.batch, COUNT(*) AS count
    FROM t_certs c JOIN t_cert_requests r ON r.id = c.request
    WHERE rtrim(c.name, '.') <> r.host AND c.name <> concat('*', substr(r.host, 4)) GROUP BY 1, 2, 3, 4, 5, 6, 7""",
)
def mismatched(t):
    return probes.cert_name_mismatch(t("t_certs"), t("t_cert_requests"))


@query(
    "x12_cipher_weak",
    "SELECT id, cipher, cipher IN ('RC4-MD5', 'DES-CBC3-SHA') AS weak FROM t_certs",
)
def weak(t):
    return t("t_certs").select("id", "cipher", tls.cipher_weak(F.col("cipher")).alias("weak"))


@query(
    "x13_cert_name_matches",
    """SELECT c.id, r.id AS asked, rtrim(c.name, '.') = r.host OR c.name = concat('*', substr(r.host, 4)) AS matches
    FROM t_certs c JOIN t_cert_requests r ON r.id = (c.request + c.id) % 5""",
)
def matches(t):
    asked = t("t_cert_requests").withColumnRenamed("id", "asked").withColumn("host", F.upper("host"))
    certs = t("t_certs").withColumn("asked", ((F.col("request") + F.col("id")) % 5).cast("int"))
    return certs.join(asked, "asked").select(
        "id", "asked", tls.cert_name_matches(F.col("name"), F.col("host")).alias("matches")
    )


@query("x25_is_full", "SELECT id, length(concat(value, name, cipher)) > 40 AS full_cert FROM t_certs")
def full(t):
    return t("t_certs").select("id", tls.is_full(F.concat("value", "name", "cipher")).alias("full_cert"))


# Tokens: events by id; packets: the events 5 ids later, carrying that token.
SQL_SPOOF = """tk AS (SELECT event_id AS token, user_id AS client, ts, concat('192.0.2.', CAST(user_id % 3 AS VARCHAR)) AS address FROM events),
pk AS (SELECT event_id - 5 AS token, event_id % 2 = 0 AS spoofed, ts, concat('192.0.2.', CAST(user_id % 3 AS VARCHAR)) AS address FROM events)"""


@query(
    "t17_pair_spoof",
    f"""WITH {SQL_SPOOF} SELECT tk.token, tk.client, tk.ts AS sent, pk.ts AS received, pk.spoofed, pk.address AS ip, pk.address = tk.address AS addr_matches
    FROM tk JOIN pk ON pk.token = tk.token AND pk.ts BETWEEN tk.ts AND tk.ts + INTERVAL '20 minutes'""",
)
def paired(t):
    tokens = t.sql("SELECT event_id AS token, user_id AS client, ts, concat('192.0.2.', CAST(user_id % 3 AS STRING)) AS address FROM {events}")
    packets = t.sql("SELECT event_id - 5 AS token, event_id % 2 = 0 AS spoofed, ts, concat('192.0.2.', CAST(user_id % 3 AS STRING)) AS address FROM {events}")
    return probes.pair_spoof(tokens, packets, "20 minutes")
