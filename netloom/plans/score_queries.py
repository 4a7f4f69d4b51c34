"""Queries over honeypot logs and SSH sessions."""

from pyspark.sql import functions as F

from netloom import schemas
from netloom.operators import score
from netloom.plans.registry import query

SQL_SCORES = """
fs AS (SELECT l.server, l.remote, l.client, CAST(SUM(s.score) AS BIGINT) AS score
 FROM t_fake_logs l JOIN t_scores s ON l.server = s.server AND l.event = s.event GROUP BY ALL),
ss AS (SELECT 'ssh_honey' AS server, s.remote, s.client,
 CAST(COUNT(DISTINCT s.id) * 25 + COUNT(*) * 5 AS BIGINT) AS score
 FROM t_ssh_sessions s JOIN t_ssh_commands c ON c.session_id = s.id GROUP BY s.remote, s.client)"""
SQL_REMOTES = SQL_SCORES + """,
sums AS (SELECT server, remote, client, SUM(score) AS score
 FROM (SELECT * FROM fs UNION SELECT * FROM ss) GROUP BY ALL HAVING SUM(score) >= 100),
remotes AS (SELECT server, remote, CAST(SUM(score) AS BIGINT) AS score, COUNT(*) AS clients FROM sums GROUP BY ALL)"""
SQL_LIST = SQL_REMOTES + """,
listed AS (SELECT r.server, r.remote, MAX(r.clients) AS clients, MAX(r.score) AS score,
 CASE WHEN bool_or(l.mode = 'hard') THEN 'hard' ELSE 'soft' END AS mode
 FROM remotes r JOIN t_limits l ON r.server = l.server AND r.score >= l.score AND r.clients >= l.clients
 GROUP BY r.server, r.remote)"""


def fake(t):
    return score.fake_scores(t("t_fake_logs"), schemas.scores(t.spark))


def ssh(t):
    return score.ssh_scores(t("t_ssh_sessions"), t("t_ssh_commands"))


def all_scores(t):
    return score.concat_scores([fake(t), ssh(t)])


def listed(t):
    return score.blacklist(all_scores(t), schemas.limits(t.spark))


query("a10_fake_scores", f"WITH {SQL_SCORES.strip()} SELECT * FROM fs")(fake)
query("a12_ssh_scores", f"WITH {SQL_SCORES.strip()} SELECT * FROM ss")(ssh)
query(
    "u01_score_union",
    f"WITH {SQL_SCORES.strip()} SELECT * FROM fs UNION SELECT * FROM ss",
)(all_scores)


@query("a13_blacklist_remotes", f"WITH {SQL_REMOTES.strip()} SELECT * FROM remotes")
def remotes(t):
    return score.blacklist_remotes(all_scores(t))


@query(
    "j09_apply_limits",
    f"""WITH {SQL_REMOTES.strip()}
    SELECT r.*, l.clients AS min_clients, l.score AS min_score, l.mode FROM remotes r
    JOIN t_limits l ON r.server = l.server WHERE r.score >= l.score AND r.clients >= l.clients""",
)
def reached_limits(t):
    return score.apply_limits(remotes(t), schemas.limits(t.spark))


query("a14_blacklist", f"WITH {SQL_LIST.strip()} SELECT * FROM listed")(listed)

# The fixture logs hold no local address; one is derived from the client.
SQL_BAD = SQL_LIST + """,
lg AS (SELECT *, concat('192.168.', CAST(client AS VARCHAR), '.1') AS local FROM t_fake_logs),
se AS (SELECT *, concat('192.168.', CAST(client AS VARCHAR), '.1') AS local, CAST(1024 + id % 60000 AS BIGINT) AS remote_port,
 start_time + INTERVAL '5 minutes' AS end_time FROM t_ssh_sessions),
ports(server, port) AS (VALUES ('telnet',23),('ssh_honey',22),('http',80),('telnet_alt',2323),
 ('squid_http_proxy',3128),('http_proxy',8080),('polipo_http_proxy',8123)),
anyc AS (SELECT l.server, l.remote, l.remote_port, l.local, MIN(p.port) AS local_port,
 MIN(l.timestamp) AS start_time_utc, MAX(l.timestamp) AS end_time_utc,
 COUNT(*) FILTER (WHERE event = 'login') AS login_attempts, MIN(b.clients) AS clients_total
 FROM lg l JOIN listed b ON b.server = l.server AND b.remote = l.remote JOIN ports p ON p.server = l.server
 WHERE b.mode = 'hard' AND l.remote_port IS NOT NULL GROUP BY l.server, l.remote, l.remote_port, l.local),
sshc AS (SELECT 'ssh_honey' AS server, s.remote, s.remote_port, s.local, 22 AS local_port,
 s.start_time AS start_time_utc, s.end_time AS end_time_utc, CAST(1 AS BIGINT) AS login_attempts, b.clients AS clients_total
 FROM se s JOIN listed b ON b.remote = s.remote WHERE b.server = 'ssh_honey' AND b.mode = 'hard')"""


def local_of(df):
    return df.withColumn("local", F.concat(F.lit("192.168."), F.col("client").cast("string"), F.lit(".1")))


def ssh_with_ends(t):
    return (
        local_of(t("t_ssh_sessions"))
        .withColumn("remote_port", 1024 + F.col("id") % 60000)
        .withColumn("end_time", F.col("start_time") + F.expr("INTERVAL 5 MINUTES"))
    )


@query("a11_bad_connections", f"WITH {SQL_BAD.strip()} SELECT * FROM anyc UNION SELECT * FROM sshc")
def bad(t):
    return score.bad_connections(
        local_of(t("t_fake_logs")), listed(t), schemas.fake_servers(t.spark), ssh_with_ends(t)
    )


@query("j16_bad_fake_connections", f"WITH {SQL_BAD.strip()} SELECT * FROM anyc")
def bad_fake(t):
    return score.bad_fake_connections(
        local_of(t("t_fake_logs")), listed(t), schemas.fake_servers(t.spark)
    )


@query(
    "a19_fake_attackers",
    """SELECT CAST(timestamp AS DATE) AS date, server, remote,
    COUNT(*) FILTER (WHERE event = 'login') AS logins, COUNT(*) FILTER (WHERE event = 'connect') AS connects
    FROM t_fake_logs GROUP BY 1, 2, 3""",
)
def attackers(t):
    return score.fake_attackers(t("t_fake_logs"))


@query(
    "a20_fake_server_activity",
    """SELECT CAST(timestamp AS DATE) AS date, server, client,
    COUNT(*) FILTER (WHERE event = 'login') AS logins, COUNT(*) FILTER (WHERE event = 'connect') AS connects
    FROM t_fake_logs GROUP BY 1, 2, 3""",
)
def server_activity(t):
    return score.fake_server_activity(t("t_fake_logs"))


@query(
    "a21_ssh_attempts",
    "SELECT CAST(start_time AS DATE) AS date, remote, COUNT(*) AS attempts FROM t_ssh_sessions GROUP BY 1, 2",
)
def attempts(t):
    return score.ssh_attempts(t("t_ssh_sessions"))


@query(
    "t16_incremental_scores",
    """SELECT l.server, l.remote, l.client, CAST(SUM(s.score) AS BIGINT) AS score
    FROM t_fake_logs l JOIN t_scores s ON l.server = s.server AND l.event = s.event GROUP BY ALL""",
)
def cached_and_fresh(t):
    logs, weights = t("t_fake_logs"), schemas.scores(t.spark)
    cache = score.score_cache(logs, weights, "2024-01-20 00:00:00")
    return score.incremental_scores(logs, cache, weights)
