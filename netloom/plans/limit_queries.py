"""Login alarms and rate limits."""

from pyspark.sql import functions as F

from netloom.operators import limits
from netloom.plans.registry import query

SQL_NUMBERED = """nu AS (SELECT server, remote, id, timestamp, ROW_NUMBER() OVER (PARTITION BY server, remote ORDER BY timestamp, id) AS n
 FROM t_fake_logs WHERE event = 'login')"""


SQL_BURSTS = f"""WITH RECURSIVE {SQL_NUMBERED},
    al AS (SELECT server, remote, n, timestamp FROM nu WHERE n = 5
     UNION ALL SELECT al.server, al.remote, x.n, x.timestamp FROM al JOIN LATERAL
     (SELECT MIN(n) AS n, MIN(timestamp) AS timestamp FROM nu WHERE nu.server = al.server AND nu.remote = al.remote AND nu.n >= al.n + 5 AND nu.timestamp >= al.timestamp + INTERVAL '2 days') x ON x.n IS NOT NULL)
    SELECT al.server, al.remote, nu.id, nu.timestamp, al.n FROM al JOIN nu ON nu.server = al.server AND nu.remote = al.remote AND nu.n = al.n"""


@query("t07_login_bursts", SQL_BURSTS)
def bursts(t):
    return limits.login_bursts(t("t_fake_logs"), holdback_us=2 * 86_400_000_000)


@query("t07_first_bursts", f"WITH {SQL_NUMBERED} SELECT server, remote, id, timestamp FROM nu WHERE n = 5")
def first(t):
    return limits.first_bursts(t("t_fake_logs"))


# A walk over the messages of a client: tokens after each, by recursion.
SQL_BUCKETS = """WITH RECURSIVE m AS (SELECT user_id % 20 AS client, event_id AS id, ts, 1 + event_id % 7 AS cost, epoch_us(ts) // 3600000000 AS tick,
     ROW_NUMBER() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT client, n, id, tick, cost, CAST(15 AS BIGINT) AS had, CASE WHEN cost < 15 THEN 15 - cost ELSE 15 END AS rest FROM m WHERE n = 1
     UNION ALL SELECT m.client, m.n, m.id, m.tick, m.cost, least(15, w.rest + 3 * (m.tick - w.tick)),
     CASE WHEN m.cost < least(15, w.rest + 3 * (m.tick - w.tick)) THEN least(15, w.rest + 3 * (m.tick - w.tick)) - m.cost ELSE least(15, w.rest + 3 * (m.tick - w.tick)) END
     FROM w JOIN m ON m.client = w.client AND m.n = w.n + 1)
    SELECT client, id, cost, cost < had AS accepted FROM w"""


@query("t08_rate_limit", SQL_BUCKETS)
def limited(t):
    messages = t("events").select(
        (F.col("user_id") % 20).alias("client"), F.col("event_id").alias("id"), "ts", (1 + F.col("event_id") % 7).alias("cost")
    )
    return limits.rate_limit(messages, inflow=3, interval_s=3600, chunk_refills=12).drop("ts")


# Messages of clients without a number are one client's.
@query(
    "t08_rate_limit_nulls",
    SQL_BUCKETS.replace("user_id % 20", "CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id % 20 END")
    .replace("m.client = w.client", "m.client IS NOT DISTINCT FROM w.client"),
)
def limited_nulls(t):
    client = F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 20)
    messages = t("events").select(client.alias("client"), F.col("event_id").alias("id"), "ts", (1 + F.col("event_id") % 7).alias("cost"))
    return limits.rate_limit(messages, inflow=3, interval_s=3600, chunk_refills=12).drop("ts")


# Half and quarter tokens, exact in doubles; a message costs at most 3.5 of 15.
@query(
    "t08_rate_limit_fractions",
    SQL_BUCKETS.replace("1 + event_id % 7 AS cost", "CAST((1 + event_id % 14) AS DOUBLE) / 4 AS cost").replace("CAST(15 AS BIGINT)", "CAST(15 AS DOUBLE)")
    .replace("15 - cost ELSE 15 END", "15 - cost ELSE CAST(15 AS DOUBLE) END"),
)
def limited_fractions(t):
    cost = (1 + F.col("event_id") % 14).cast("double") / 4
    messages = t("events").select((F.col("user_id") % 20).alias("client"), F.col("event_id").alias("id"), "ts", cost.alias("cost"))
    return limits.rate_limit(messages, inflow=3, interval_s=3600, chunk_refills=12).drop("ts")
