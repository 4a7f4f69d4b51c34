"""Lookups, tagging and synchronisation."""

from pyspark.sql import functions as F

from netloom.operators import joins
from netloom.plans.registry import query
from netloom.plans.score_queries import SQL_LIST, listed


@query(
    "j01_resolve_ids",
    """SELECT a.id, a.client, a.timestamp, CASE a.activity WHEN 'login' THEN 5 WHEN 'logout' THEN 6 WHEN 'counts' THEN 6 WHEN 'flow' THEN 4 END AS activity_id
    FROM t_activities a WHERE a.activity <> 'fake'""",
)
def resolved(t):
    kinds = t("t_activity_types").where("name <> 'fake'").select("name", F.length("name").alias("id"))
    return joins.resolve_ids(t("t_activities"), kinds, "activity")


@query(
    "j04_cross_lookup",
    """SELECT c.id AS client, length(y.name) AS type FROM t_clients c, t_activity_types y
    WHERE c.name = (SELECT MAX(name) FROM t_clients) AND y.name = 'counts'""",
)
def crossed(t):
    clients = t("t_clients")
    top = clients.join(clients.agg(F.max("name").alias("name")), "name", "left_semi")
    kinds = t("t_activity_types").select("name", F.length("name").cast("long").alias("id"))
    # The client name is data here, so it is passed as the one row that holds it.
    return joins.cross_lookup(top.withColumn("name", F.lit("top")), kinds, "top", "counts")


SQL_TAGS = """ru AS (SELECT MIN(l_orderkey * 10 + l_linenumber) AS line, concat('set', CAST(l_partkey % 7 AS VARCHAR)) AS tag,
 concat('198.51.', CAST(l_partkey % 4 AS VARCHAR), '.', CAST(l_partkey % 90 AS VARCHAR)) AS ip, CASE WHEN l_linenumber < 3 THEN 21 + l_linenumber END AS port
 FROM lineitem WHERE l_partkey % 3 = 0 AND l_linenumber < 4 GROUP BY 2, 3, 4),
bl AS (SELECT DISTINCT 'telnet' AS server, concat('198.51.', CAST(l_partkey % 4 AS VARCHAR), '.', CAST(l_partkey % 200 AS VARCHAR)) AS remote FROM lineitem WHERE l_partkey % 17 = 0)"""


def tag_inputs(t):
    rules = t.sql(
        """SELECT MIN(l_orderkey * 10 + l_linenumber) AS line, concat('set', CAST(l_partkey % 7 AS STRING)) AS tag,
        concat('198.51.', CAST(l_partkey % 4 AS STRING), '.', CAST(l_partkey % 90 AS STRING)) AS ip, CASE WHEN l_linenumber < 3 THEN 21 + l_linenumber END AS port
        FROM {lineitem} WHERE l_partkey % 3 = 0 AND l_linenumber < 4 GROUP BY 2, 3, 4"""
    )
    black = t.sql(
        """SELECT DISTINCT 'telnet' AS server, concat('198.51.', CAST(l_partkey % 4 AS STRING), '.', CAST(l_partkey % 200 AS STRING)) AS remote
        FROM {lineitem} WHERE l_partkey % 17 = 0"""
    )
    return rules, black


@query(
    "j13_tag_flows",
    f"""WITH {SQL_TAGS},
    pt AS (SELECT ip, port, arg_max(tag, line) AS tag FROM ru WHERE port IS NOT NULL GROUP BY 1, 2),
    it AS (SELECT ip, COALESCE(arg_max(tag, line) FILTER (WHERE port IS NULL), arg_min(tag, line) FILTER (WHERE port IS NOT NULL)) AS tag FROM ru GROUP BY 1)
    SELECT f.id, f.ip_remote, f.port_remote, COALESCE(pt.tag, CASE WHEN bl.server IS NOT NULL THEN concat('fake-', bl.server) END, it.tag, '?') AS tag
    FROM t_biflows f LEFT JOIN pt ON pt.ip = f.ip_remote AND pt.port = f.port_remote LEFT JOIN it ON it.ip = f.ip_remote LEFT JOIN bl ON bl.remote = f.ip_remote""",
)
def tagged(t):
    rules, black = tag_inputs(t)
    return joins.tag_flows(t("t_biflows").select("id", "ip_remote", "port_remote"), rules, black)


SQL_SSH = """se AS (SELECT id, start_time, start_time + INTERVAL '1 minute' * (id % 7) AS end_time, login, concat('p', CAST(client AS VARCHAR)) AS password,
 remote, 1000 + client AS remote_port FROM t_ssh_sessions),
us AS (SELECT * FROM se WHERE id IN (SELECT session_id FROM t_ssh_commands)),
me AS (SELECT start_time, login, password, MIN(id) AS session, MAX(end_time) AS end_time, arg_min(remote, id) AS remote, arg_min(remote_port, id) AS remote_port FROM us GROUP BY 1, 2, 3)"""


def ssh_inputs(t):
    sessions = t("t_ssh_sessions").select(
        "id", "start_time",
        (F.col("start_time") + F.expr("INTERVAL 1 MINUTE") * (F.col("id") % 7)).alias("end_time"),
        "login", F.concat(F.lit("p"), F.col("client").cast("string")).alias("password"),
        "remote", (1000 + F.col("client")).alias("remote_port"),
    )
    return sessions, t("t_ssh_commands")


@query("j15_ssh_archive_sessions", f"WITH {SQL_SSH} SELECT * FROM me")
def archive_sessions(t):
    return joins.ssh_archive(*ssh_inputs(t))[0]


@query(
    "j15_ssh_archive_commands",
    f"""WITH {SQL_SSH} SELECT me.session, c.ts, c.success FROM t_ssh_commands c JOIN us ON us.id = c.session_id
    JOIN me ON me.start_time = us.start_time AND me.login = us.login AND me.password = us.password""",
)
def archive_commands(t):
    return joins.ssh_archive(*ssh_inputs(t))[1]


@query("j17_insert_new", "SELECT DISTINCT client, name, version FROM t_plugins_active a WHERE NOT EXISTS (SELECT 1 FROM t_plugins_known k WHERE k.name = a.name AND k.version = a.version)")
def new_rows(t):
    target = t("t_plugins_known").where("version IS NOT NULL").withColumn("version", F.col("version").cast("long"))
    rows = t("t_plugins_active").select("client", "name", "version").distinct()
    return joins.insert_new(target, rows, ["name", "version"])


SQL_SYNC = """sr AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS tag FROM customer),
tg AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 50 = 0 THEN 'stale' WHEN c_custkey % 60 = 0 THEN NULL ELSE c_mktsegment END AS tag
 FROM customer WHERE c_custkey % 7 <> 0)"""


def sync_inputs(t):
    source = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("tag"))
    target = t.sql(
        """SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 50 = 0 THEN 'stale' WHEN c_custkey % 60 = 0 THEN NULL ELSE c_mktsegment END AS tag
        FROM {customer} WHERE c_custkey % 7 <> 0"""
    )
    return source, target


@query("j18_sync_missing", f"WITH {SQL_SYNC} SELECT * FROM sr WHERE id NOT IN (SELECT id FROM tg)")
def missing(t):
    return joins.sync_config(*sync_inputs(t), "id")[0]


@query("j18_sync_mismatched", f"WITH {SQL_SYNC} SELECT sr.id FROM sr JOIN tg ON sr.id = tg.id WHERE sr.name IS DISTINCT FROM tg.name OR sr.tag IS DISTINCT FROM tg.tag")
def mismatched(t):
    return joins.sync_config(*sync_inputs(t), "id")[1]


@query(
    "j19_enrich_cached",
    """WITH ca AS (SELECT concat('198.51.', CAST(event_id % 3 AS VARCHAR), '.', CAST(event_id % 100 AS VARCHAR)) AS dst, ts AS timestamp,
     CASE WHEN event_id % 4 = 0 THEN 'none' ELSE concat('host', CAST(user_id AS VARCHAR)) END AS value FROM events),
    la AS (SELECT dst, arg_max(value, timestamp) AS name FROM ca WHERE timestamp >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '7 days' GROUP BY 1)
    SELECT f.src, f.dst, f.port, f.proto, f.u_count, NULLIF(la.name, 'none') AS name FROM t_lan_flows f LEFT JOIN la ON la.dst = f.dst""",
)
def enriched(t):
    cache = t.sql(
        """SELECT concat('198.51.', CAST(event_id % 3 AS STRING), '.', CAST(event_id % 100 AS STRING)) AS dst, ts AS timestamp,
        CASE WHEN event_id % 4 = 0 THEN 'none' ELSE concat('host', CAST(user_id AS STRING)) END AS value FROM {events}"""
    )
    flows = t("t_lan_flows").select("src", "dst", "port", "proto", "u_count")
    return joins.enrich_cached(flows, cache, "dst", "7 days", "2024-01-31 00:00:00")


@query(
    "s06_export_blacklist",
    f"WITH {SQL_LIST.strip()} SELECT server, remote, clients, score, mode FROM listed WHERE remote NOT LIKE '10.%' ORDER BY server, remote",
)
def exported_blacklist(t):
    from netloom.sources.exports import blacklist_rows

    omit = t("t_fake_logs").where("remote LIKE '10.%'").select(F.col("remote").alias("address")).distinct()
    return blacklist_rows(listed(t), omit)
