"""Input views derived from the driver tables.

Each view is one SQL text that Spark and DuckDB both run, so a query and its
reference SQL start from equal rows. `{name}` marks a driver table.
"""

from netloom.schemas import LIMITS, SCORES


def _values(rows, *names: str) -> str:
    """Constant rows as a query text."""
    return f"SELECT * FROM (VALUES {', '.join(map(repr, rows))}) AS v({', '.join(names)})"


VIEWS = {
    "t_members": """
SELECT client, in_group, name FROM (
 SELECT DISTINCT user_id AS client, CAST(0 AS BIGINT) AS in_group, 'all' AS name FROM {events}
 UNION ALL SELECT DISTINCT user_id, 1 + user_id % 5, concat('site-', CAST(1 + user_id % 5 AS STRING)) FROM {events}
 UNION ALL SELECT DISTINCT user_id, 100 + user_id % 2, concat('rand-2-', CAST(1 + user_id % 2 AS STRING)) FROM {events}) g""",
    "t_activities": """
SELECT event_id AS id, user_id AS client, ts AS timestamp,
 CASE event_type WHEN 'signup' THEN 'login' WHEN 'error' THEN 'logout' WHEN 'click' THEN 'counts' WHEN 'view' THEN 'flow' ELSE 'fake' END AS activity FROM {events}""",
    "t_counts": """
SELECT date_trunc('hour', ts) AS timestamp, user_id AS client, 1 + event_id % 4 AS type,
 COUNT(*) AS count, SUM(CAST(round(value*100) AS BIGINT)) AS size FROM {events} GROUP BY 1,2,3""",
    "t_fake_logs": """
SELECT event_id AS id, event_id % 9 AS client, ts AS timestamp,
 CASE user_id % 6 WHEN 0 THEN 'telnet' WHEN 1 THEN 'telnet_alt' WHEN 2 THEN 'http' WHEN 3 THEN 'squid_http_proxy' WHEN 4 THEN 'http_proxy' ELSE 'polipo_http_proxy' END AS server,
 CASE event_type WHEN 'signup' THEN 'login' WHEN 'purchase' THEN 'login' WHEN 'error' THEN 'disconnect' ELSE 'connect' END AS event,
 concat(CASE WHEN user_id % 10 = 0 THEN '10.0.' ELSE '198.18.' END, CAST(user_id % 7 AS STRING), '.', CAST(1 + user_id % 200 AS STRING)) AS remote,
 CAST(1024 + event_id % 60000 AS BIGINT) AS remote_port FROM {events}""",
    "t_refused": """
SELECT event_id AS id, user_id AS client, ts AS timestamp, concat('203.0.113.', CAST(event_id % 50 AS STRING)) AS address,
 CASE event_id % 4 WHEN 0 THEN 22 WHEN 1 THEN 23 WHEN 2 THEN 443 ELSE 3389 END AS remote_port, substr('TPHNAO', CAST(1 + event_id % 6 AS INT), 1) AS reason FROM {events} WHERE event_type = 'error'""",
    "t_pings": """
SELECT user_id % 4 AS request, date_trunc('day', ts) AS batch, user_id AS client,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('192.0.2.', CAST(CASE WHEN event_id % 37 = 0 THEN 200 + event_id % 3 ELSE event_id % 3 END AS STRING)) END AS ip,
 CAST(event_id % 6 AS BIGINT) AS received, CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(round(value*100) AS BIGINT) END AS avg FROM {events}""",
    "t_packets": """
SELECT event_id AS id, user_id AS client, ts, CASE WHEN event_id % 2 = 0 THEN 'in' ELSE 'out' END AS direction,
 40 + CAST(round(value*10) AS BIGINT) AS length, CASE WHEN user_id % 8 = 0 THEN 6 ELSE 4 END AS ip_protocol,
 CASE WHEN event_id % 10 < 6 THEN 'T' WHEN event_id % 10 < 9 THEN 'U' ELSE 'i' END AS app_protocol,
 concat('192.168.1.', CAST(user_id % 250 AS STRING)) AS addr_local, concat('198.51.100.', CAST(user_id % 20 AS STRING)) AS addr_remote,
 40000 + user_id % 100 AS port_local, CASE event_id % 4 WHEN 0 THEN 22 WHEN 1 THEN 23 WHEN 2 THEN 443 ELSE 8080 END AS port_remote,
 CASE WHEN event_id % 10 < 6 THEN CAST(event_id % 64 AS INT) ELSE 0 END AS tcp_flags FROM {events}""",
    "t_biflows": """
SELECT l_orderkey*10 + l_linenumber AS id, l_suppkey % 50 AS client, concat('198.51.', CAST(l_partkey % 4 AS STRING), '.', CAST(l_partkey % 200 AS STRING)) AS ip_remote,
 CASE l_linenumber WHEN 1 THEN 22 WHEN 2 THEN 23 WHEN 3 THEN 443 ELSE 8080 END AS port_remote, CASE WHEN l_returnflag='R' THEN 'U' ELSE 'T' END AS proto,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE l_shipdate END AS start_in, l_shipdate + INTERVAL '1 hour' AS start_out,
 CAST(round(l_extendedprice) AS BIGINT) AS size_in, CAST(l_quantity AS BIGINT) AS count_in FROM {lineitem}""",
    "t_addr_store": """
SELECT CASE WHEN user_id % 2 = 0 THEN 'addresses' ELSE 'set_a' END AS store, CASE WHEN event_id < 3000 THEN 1 ELSE 2 END AS epoch, event_id AS version, value < 60 AS is_add,
 concat('203.0.', CAST(user_id % 3 AS STRING), '.', CAST(user_id % 100 AS STRING)) AS address FROM {events}""",
    "t_ssh_sessions": """
SELECT o_orderkey AS id, o_custkey % 9 AS client, o_orderdate AS start_time, concat('198.18.', CAST(o_custkey % 5 AS STRING), '.', CAST(o_custkey % 40 AS STRING)) AS remote, o_orderpriority AS login FROM {orders}""",
    "t_ssh_commands": """
SELECT l_orderkey AS session_id, l_shipdate AS ts, l_returnflag = 'R' AS success FROM {lineitem}""",
    "t_certs": """
SELECT MIN(event_id) AS id, user_id % 5 AS request, user_id AS client, CAST(ts AS DATE) AS batch,
 CASE MIN(event_id) % 5 WHEN 0 THEN 'RC4-MD5' WHEN 1 THEN 'ECDHE-RSA-AES128-GCM-SHA256' WHEN 2 THEN 'DHE-RSA-AES256-SHA' WHEN 3 THEN 'DES-CBC3-SHA' ELSE 'AES256-SHA' END AS cipher,
 CASE MIN(event_id) % 4 WHEN 0 THEN 'SSLv3' ELSE 'TLSv1.2' END AS proto,
 concat('fp', CAST(user_id % 5 AS STRING), '-', CAST((EXTRACT(DAY FROM CAST(ts AS DATE)) + user_id % 5) % 10 AS STRING)) AS value,
 CASE WHEN user_id % 11 = 0 THEN 'other.example.net' WHEN user_id % 3 = 0 THEN concat('*.h', CAST(user_id % 5 AS STRING), '.example.org') ELSE concat('www.h', CAST(user_id % 5 AS STRING), '.example.org.') END AS name
 FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "t_lan_flows": """
SELECT CASE WHEN l_returnflag='R' THEN 'UDP' ELSE 'TCP' END AS proto, concat('02:00:00:00:00:', CAST(10 + l_suppkey % 20 AS STRING)) AS src,
 concat('198.51.', CAST(l_partkey % 3 AS STRING), '.', CAST(l_partkey % 150 AS STRING)) AS dst, CAST(CASE l_linenumber WHEN 1 THEN 22 WHEN 2 THEN 443 ELSE 80 END AS STRING) AS port,
 CAST(l_quantity AS BIGINT) AS u_count, CAST(round(l_extendedprice) AS BIGINT) AS u_size, date_trunc('hour', l_shipdate) AS hour FROM {lineitem}""",
    "t_spoof": """
SELECT event_id AS id, user_id AS client, CAST(ts AS DATE) AS batch, event_id % 3 = 0 AS spoofed, event_id % 6 = 0 AS addr_matches FROM {events}""",
    "t_scores": _values(SCORES, "server", "event", "score"),
    "t_limits": _values(LIMITS, "server", "clients", "score", "mode"),
    "t_incidents": """
SELECT concat(CASE WHEN user_id % 10 = 0 THEN '10.0.' ELSE '198.18.' END, CAST(user_id % 7 AS STRING), '.', CAST(1 + user_id % 200 AS STRING)) AS ip,
 CAST(ts AS DATE) AS date, 1 + event_id % 3 AS cnt, CASE WHEN event_id % 2 = 0 THEN 'ssh' ELSE 'telnet' END AS kind FROM {events}""",
    "t_firewall_log": """
SELECT l_orderkey*10 + l_linenumber AS id, l_suppkey % 30 AS router_id, l_shipdate AS time, CASE WHEN l_linestatus = 'O' THEN 'I' ELSE 'O' END AS direction,
 concat('203.0.', CAST(l_partkey % 3 AS STRING), '.', CAST(l_partkey % 100 AS STRING)) AS remote_address, CAST(l_quantity AS BIGINT) AS count FROM {lineitem}""",
    "t_nat_obs": """
SELECT user_id AS client, CAST(ts AS DATE) AS batch, substr('DN0', CAST(1 + MIN(event_id) % 3 AS INT), 1) AS v4, substr('0DN', CAST(1 + MIN(event_id) % 3 AS INT), 1) AS v6 FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "t_plugins_active": """
SELECT DISTINCT user_id AS client, CASE event_type WHEN 'click' THEN 'Count' WHEN 'view' THEN 'Flow' ELSE 'Fake' END AS name, CAST(1 + user_id % 3 AS BIGINT) AS version,
 concat('h', CAST(user_id % 4 AS STRING)) AS hash, user_id % 5 <> 0 AS active FROM {events}""",
    "t_plugins_known": """
SELECT * FROM (VALUES ('Count',NULL,'h0','allowed'),('Count',2,NULL,'obsolete'),('Flow',1,'h1','allowed'),('Flow',NULL,'h2','disabled'),('Fake',NULL,NULL,'allowed'),('Spoof',1,'h9','allowed')) AS k(name,version,hash,status)""",
    "t_clients": """
SELECT DISTINCT c_custkey AS id, c_name AS name, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS tag, concat('note ', CAST(c_nationkey AS STRING)) AS devel_note FROM {customer}""",
    "t_activity_types": """
SELECT * FROM (VALUES ('login',NULL),('logout',NULL),('counts','Count'),('flow','Flow'),('fake','Fake')) AS a(name,plugin)""",
    "t_bandwidth": """
SELECT date_trunc('hour', ts) AS timestamp, user_id AS client, 500000 * (1 + event_id % 3) AS win_len,
 MAX(CASE WHEN event_id % 2 = 0 THEN CAST(round(value*1000) AS BIGINT) ELSE 0 END) AS in_max, MAX(CASE WHEN event_id % 2 = 1 THEN CAST(round(value*1000) AS BIGINT) ELSE 0 END) AS out_max
 FROM {events} GROUP BY date_trunc('hour', ts), user_id, event_id % 3""",
    "t_speed": """
SELECT date_trunc('hour', ts) AS timestamp, user_id AS client, CAST(event_id % 40 AS INT) AS pos, COUNT(*) * 2 AS in_time, SUM(CAST(round(value*1000) AS BIGINT)) AS in_bytes,
 SUM(event_id % 3) AS out_time, SUM(CAST(round(value*500) AS BIGINT)) AS out_bytes FROM {events} GROUP BY date_trunc('hour', ts), user_id, event_id % 40""",
    "t_ping_requests": """
SELECT * FROM (VALUES (0,'a.example.org'),(1,'b.example.org'),(2,'c.example.org'),(3,'d.example.org')) AS r(id,host)""",
    "t_cert_requests": """
SELECT * FROM (VALUES (0,'www.h0.example.org',443),(1,'www.h1.example.org',443),(2,'www.h2.example.org',993),(3,'www.h3.example.org',443),(4,'www.h4.example.org',465)) AS r(id,host,port)""",
}
