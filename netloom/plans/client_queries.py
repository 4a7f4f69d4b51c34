"""Client sessions, boards, plug-ins."""

from pyspark.sql import functions as F

from netloom import schemas
from netloom.functions import times
from netloom.operators import clients, ordering
from netloom.plans.registry import query

NOW = "2024-02-01 00:00:00"

SQL_SESSIONS = f"""
lo AS (SELECT client, timestamp, activity, id, LEAD(timestamp) OVER (PARTITION BY client ORDER BY timestamp, id) AS nxt,
 LEAD(activity) OVER (PARTITION BY client ORDER BY timestamp, id) AS nxt_activity
 FROM t_activities WHERE activity IN ('login', 'logout')),
se AS (SELECT client, timestamp AS start, COALESCE(nxt, TIMESTAMP '{NOW}') AS "end", nxt IS NULL AS open,
 CASE WHEN nxt IS NULL THEN 'open' WHEN nxt_activity = 'login' THEN 'relogin' ELSE 'logout' END AS ended
 FROM lo WHERE activity = 'login')"""


@query("w04_sessions", f'WITH {SQL_SESSIONS.strip()} SELECT client, start, "end", open FROM se')
def sessions(t):
    return clients.sessions(t("t_activities"), NOW)


SQL_NULL_SESSIONS = SQL_SESSIONS.strip().replace("t_activities", "(SELECT * REPLACE (CASE WHEN id % 7 > 0 THEN client END AS client) FROM t_activities)")


@query("w04_sessions_nulls", f'WITH {SQL_NULL_SESSIONS} SELECT client, start, "end", open FROM se')
def sessions_of_nulls(t):
    client = F.when(F.col("id") % 7 > 0, F.col("client"))
    return clients.sessions(t("t_activities").withColumn("client", client), NOW)


@query("t15_client_sessions", f'WITH {SQL_SESSIONS.strip()} SELECT client, start, "end", ended FROM se')
def client_sessions(t):
    return clients.client_sessions(t("t_activities"), NOW)


@query(
    "a34_uptime_report",
    f"""WITH {SQL_SESSIONS.strip()},
    d AS (SELECT client, (epoch_us("end") - epoch_us(start)) / 1e6 AS s FROM se)
    SELECT client, COUNT(*) AS sessions, round(MIN(s), 3) AS min, round(MAX(s), 3) AS max, round(AVG(s), 3) AS avg, round(MEDIAN(s), 3) AS median FROM d GROUP BY client
    UNION ALL SELECT NULL, COUNT(*), round(MIN(s), 3), round(MAX(s), 3), round(AVG(s), 3), round(MEDIAN(s), 3) FROM d""",
)
def uptime(t):
    report = clients.uptime_report(t("t_activities"), NOW).drop("everyone")
    return report.withColumns({c: F.round(c, 3) for c in ("min", "max", "avg", "median")})


SQL_BOARD = """la AS (SELECT client, timestamp, activity FROM
 (SELECT *, ROW_NUMBER() OVER (PARTITION BY client ORDER BY timestamp DESC, id DESC) AS rn FROM t_activities) WHERE rn = 1)"""


@query("j05_last_activity", f"WITH {SQL_BOARD} SELECT c.*, la.timestamp, la.activity FROM t_clients c LEFT JOIN la ON c.id = la.client")
def last(t):
    return clients.last_activity(t("t_clients"), t("t_activities"))


@query(
    "o01_online_board",
    f"""WITH {SQL_BOARD} SELECT c.name, c.tag, c.devel_note, la.timestamp, la.activity
    FROM t_clients c LEFT JOIN la ON c.id = la.client ORDER BY c.tag, c.devel_note, c.name""",
)
def board(t):
    ordered = clients.last_activity(t("t_clients"), t("t_activities"))
    return ordered.select("name", "tag", "devel_note", "timestamp", "activity").orderBy(
        F.asc_nulls_last("tag"), "devel_note", "name"
    )


@query(
    "a35_online_counts",
    f"""WITH {SQL_BOARD} SELECT CASE WHEN activity IS NULL OR activity = 'logout' THEN 'offline'
    WHEN timestamp <= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL '1 hour' THEN 'stuck' ELSE 'online' END AS status, COUNT(*) AS clients
    FROM t_clients c LEFT JOIN la ON c.id = la.client GROUP BY 1""",
)
def online(t):
    return clients.online_counts(t("t_clients"), t("t_activities"), "2024-01-30 12:00:00")


@query(
    "w03_latest",
    """SELECT name, client, version, hash, active FROM (SELECT *, ROW_NUMBER() OVER
    (PARTITION BY name ORDER BY client DESC, version DESC, hash DESC) AS rn FROM t_plugins_active) WHERE rn = 1""",
)
def latest(t):
    return ordering.latest(t("t_plugins_active"), ["name"], "client", "version", "hash")


@query(
    "j08_wildcard_join",
    """SELECT a.*, k.name AS known_name, CAST(k.version AS INTEGER) AS known_version, k.hash AS known_hash, k.status AS known_status
    FROM t_plugins_active a LEFT JOIN t_plugins_known k ON a.name = k.name AND a.version = COALESCE(k.version, a.version)
    AND a.hash = COALESCE(k.hash, a.hash)""",
)
def wildcard(t):
    return clients.wildcard_join(t("t_plugins_active"), t("t_plugins_known"), ["name"], ["version", "hash"])


@query(
    "j08_allowed_plugins",
    """SELECT a.*, EXISTS (SELECT 1 FROM t_plugins_known k WHERE k.name = a.name AND k.status = 'allowed'
    AND (k.version IS NULL OR k.version = a.version) AND (k.hash IS NULL OR k.hash = a.hash)) AS allowed FROM t_plugins_active a""",
)
def allowed(t):
    return clients.allowed_plugins(t("t_plugins_active"), t("t_plugins_known"))


SQL_CENSUS = """SELECT COALESCE(a.name, k.name) AS name, COALESCE(a.hash, k.hash) AS hash, COALESCE(a.version, k.version) AS version,
 COUNT(a.name) AS clients, CAST(SUM(CAST(a.active AS INTEGER)) AS BIGINT) AS active, MAX(k.note) AS note,
 CASE MAX(CASE k.status WHEN 'allowed' THEN 1 WHEN 'obsolete' THEN 2 WHEN 'disabled' THEN 3 END) WHEN 1 THEN 'allowed' WHEN 2 THEN 'obsolete' WHEN 3 THEN 'disabled' END AS status
 FROM t_plugins_active a FULL JOIN (SELECT *, concat('note ', name) AS note FROM t_plugins_known) k
 ON a.name = k.name AND a.version = COALESCE(k.version, a.version) AND a.hash = COALESCE(k.hash, a.hash) GROUP BY 1, 2, 3"""


def known_with_notes(t):
    return t("t_plugins_known").withColumn("note", F.concat(F.lit("note "), "name"))


@query("a36_plugin_census", SQL_CENSUS)
def census(t):
    return clients.plugin_census(t("t_plugins_active"), known_with_notes(t))


@query(
    "j06_plugin_full_join",
    SQL_CENSUS.replace("SELECT COALESCE", "SELECT name, hash, version, note FROM (SELECT COALESCE", 1) + ") WHERE clients = 0",
)
def unused(t):
    report = clients.plugin_census(t("t_plugins_active"), known_with_notes(t))
    return report.where(F.col("clients") == 0).select("name", "hash", "version", "note")


SQL_ACTIVITY = f"""
ac AS (SELECT a.*, ty.name AS tname, ty.plugin FROM t_activities a JOIN t_activity_types ty ON a.activity = ty.name),
gl AS (SELECT client, round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(MAX(timestamp))) / 6e7, 0) AS last,
 MAX(CASE WHEN tname = 'login' THEN timestamp END) AS login, MAX(CASE WHEN tname = 'logout' THEN timestamp END) AS logout FROM ac GROUP BY client),
jo AS (SELECT cl.name, CAST(gl.last AS BIGINT) AS last, gl.login, gl.logout, COALESCE(ac.plugin, ap.name) AS plugin, ac.timestamp, ap.hash, ap.version, kp.status, ap.active, ac.tname, ac.plugin AS aplugin
 FROM ac FULL JOIN t_plugins_active ap ON ap.client = ac.client AND ap.name = ac.plugin
 LEFT JOIN t_plugins_known kp ON ap.name = kp.name AND ap.version = COALESCE(kp.version, ap.version) AND ap.hash = COALESCE(kp.hash, ap.hash)
 RIGHT JOIN t_clients cl ON cl.id = COALESCE(ac.client, ap.client) LEFT JOIN gl ON cl.id = gl.client
 WHERE ac.tname IS NULL OR ac.plugin IS NOT NULL)
SELECT name, plugin, MIN(last) AS last, MIN(login) AS login, CAST(round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(MIN(login))) / 6e7, 0) AS BIGINT) AS login_time,
 MIN(logout) AS logout, CAST(round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(MIN(logout))) / 6e7, 0) AS BIGINT) AS logout_time,
 CAST(round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(MAX(timestamp))) / 6e7, 0) AS BIGINT) AS plug_last, MIN(hash) AS hash, MIN(version) AS version,
 CASE MIN(CASE status WHEN 'allowed' THEN 1 WHEN 'obsolete' THEN 2 WHEN 'disabled' THEN 3 END) WHEN 1 THEN 'allowed' WHEN 2 THEN 'obsolete' WHEN 3 THEN 'disabled' END AS status,
 BOOL_AND(active) AS active FROM jo GROUP BY name, plugin"""


def activity_board(t):
    return clients.plugin_activity(
        t("t_clients"), t("t_activities"), t("t_activity_types"), t("t_plugins_active"), t("t_plugins_known"), NOW
    )


query("a17_plugin_activity", f"WITH {SQL_ACTIVITY.strip()}")(activity_board)

# Plug-in reports: one per client and day, derived from the events.
SQL_HISTORY = """hi AS (SELECT DISTINCT user_id AS client, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS timestamp,
 CASE event_type WHEN 'click' THEN 'Count' WHEN 'view' THEN 'Flow' WHEN 'error' THEN 'Spoof' ELSE 'Fake' END AS name,
 CAST(1 + (EXTRACT(DAY FROM ts) // 7) % 3 AS BIGINT) AS version FROM events)"""


def history(t):
    return t.sql(
        """SELECT DISTINCT user_id AS client, CAST(CAST(ts AS DATE) AS TIMESTAMP_NTZ) AS timestamp,
        CASE event_type WHEN 'click' THEN 'Count' WHEN 'view' THEN 'Flow' WHEN 'error' THEN 'Spoof' ELSE 'Fake' END AS name,
        CAST(1 + (EXTRACT(DAY FROM ts) div 7) % 3 AS BIGINT) AS version FROM {events}"""
    )


@query(
    "u11_plugin_changes",
    f"""WITH {SQL_HISTORY},
    rp AS (SELECT client, timestamp, LAG(timestamp) OVER (PARTITION BY client ORDER BY timestamp) AS prev FROM (SELECT DISTINCT client, timestamp FROM hi))
    SELECT r.client, r.timestamp, h.name, CAST(NULL AS BIGINT) AS old_version, h.version, 'activated' AS change
    FROM rp r JOIN hi h ON r.client = h.client AND r.timestamp = h.timestamp
    WHERE NOT EXISTS (SELECT 1 FROM hi p WHERE p.client = r.client AND p.timestamp = r.prev AND p.name = h.name)
    UNION ALL SELECT r.client, r.timestamp, p.name, p.version, NULL, 'deactivated'
    FROM rp r JOIN hi p ON r.client = p.client AND r.prev = p.timestamp
    WHERE NOT EXISTS (SELECT 1 FROM hi h WHERE h.client = r.client AND h.timestamp = r.timestamp AND h.name = p.name)
    UNION ALL SELECT r.client, r.timestamp, h.name, p.version, h.version, 'version'
    FROM rp r JOIN hi h ON r.client = h.client AND r.timestamp = h.timestamp
    JOIN hi p ON p.client = r.client AND p.timestamp = r.prev AND p.name = h.name WHERE p.version <> h.version""",
)
def changes(t):
    return clients.plugin_changes(history(t))


@query(
    "t15_logout_history",
    f"""WITH {SQL_HISTORY},
    lo AS (SELECT DISTINCT client, timestamp FROM t_activities WHERE activity = 'logout'),
    lr AS (SELECT lo.client, lo.timestamp, MAX(hi.timestamp) AS report FROM lo JOIN hi ON hi.client = lo.client AND hi.timestamp <= lo.timestamp GROUP BY 1, 2)
    SELECT DISTINCT lr.client, hi.name, lr.timestamp, FALSE AS active FROM lr JOIN hi ON hi.client = lr.client AND hi.timestamp = lr.report""",
)
def logout_rows(t):
    return clients.logout_history(t("t_activities"), history(t))


@query(
    "x16_age_text",
    f"""WITH a AS (SELECT id, CAST(round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(timestamp)) / 6e7, 0) AS BIGINT) % 6000 AS m FROM t_activities)
    SELECT id, CASE WHEN m > 2880 THEN concat(m // 1440, 'd') WHEN m > 240 THEN concat(m // 60, 'h') ELSE concat(m, 'm') END AS age FROM a""",
)
def ages(t):
    minutes = times.minutes_since("timestamp", NOW) % 6000
    return t("t_activities").select("id", times.age_text(minutes).alias("age"))


@query(
    "x17_days_hours",
    f"""WITH {SQL_SESSIONS.strip()} SELECT client, start, (epoch_us("end") - epoch_us(start)) // 86400000000 AS days,
    ((epoch_us("end") - epoch_us(start)) // 3600000000) % 24 AS hours FROM se""",
)
def day_lengths(t):
    seconds = (times.micros("end") - times.micros("start")) / 1e6
    split = clients.sessions(t("t_activities"), NOW).select("client", "start", times.days_hours(seconds).alias("d"))
    return split.select("client", "start", "d.days", "d.hours")


@query(
    "x18_status",
    f"""WITH a AS (SELECT id, CAST(round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(timestamp)) / 6e7, 0) AS BIGINT) % 1500 AS m, client FROM t_activities)
    SELECT id, CASE WHEN m <= 30 THEN 'fresh' WHEN m <= 60 THEN 'recent' WHEN m <= 720 THEN 'old' ELSE 'missing' END AS age_class FROM a""",
)
def classes(t):
    minutes = times.minutes_since("timestamp", NOW) % 1500
    return t("t_activities").select("id", clients.activity_class(minutes).alias("age_class"))


@query(
    "x18_plugin_class",
    """SELECT a.client, a.name, CASE WHEN a.active THEN 'normal' WHEN k.status = 'allowed' THEN 'inactive' WHEN k.status IS NULL THEN 'unknown' ELSE 'blocked' END AS class
    FROM t_plugins_active a LEFT JOIN t_plugins_known k ON a.name = k.name AND a.version = COALESCE(k.version, a.version)
    AND a.hash = COALESCE(k.hash, a.hash)""",
)
def plugin_classes(t):
    return wildcard(t).select(
        "client", "name", clients.plugin_class(F.col("active"), F.col("known_status")).alias("class")
    )


@query("x19_enum_rank", "SELECT server, mode, CASE mode WHEN 'soft' THEN 1 ELSE 2 END AS rank, f.n FROM t_limits JOIN (SELECT server, COUNT(*) AS n FROM t_fake_logs GROUP BY 1) f USING (server)")
def ranks(t):
    logs = t("t_fake_logs").groupBy("server").agg(F.count(F.lit(1)).alias("n"))
    limits = schemas.limits(t.spark)
    return limits.join(logs, "server").select(
        "server", "mode", schemas.enum_rank(F.col("mode"), "blacklist_mode").alias("rank"), "n"
    )


@query(
    "x24_version_of",
    "SELECT id, (epoch_us(timestamp) // 30000000) % 2147483648 AS version FROM t_activities",
)
def versions(t):
    return t("t_activities").select("id", times.version_of("timestamp").alias("version"))
