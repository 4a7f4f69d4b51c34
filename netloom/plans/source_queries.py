"""Readers, writers and exports."""

from pyspark.sql import functions as F

from netloom import schemas
from netloom.operators import reputation
from netloom.plans.lan_queries import SQL_REPUTATION
from netloom.plans.registry import query
from netloom.plans.score_queries import SQL_BAD, bad, bad_fake
from netloom.session import scratch_folder
from netloom.sources import exports, tables


@query("s01_read_table", "SELECT * FROM t_incidents")
def table(t):
    path = scratch_folder(t.spark, "incidents-table")
    tables.write_table(t("t_incidents"), path)
    return tables.read_table(t.spark, "incidents", path)


@query("s03_read_incidents", "SELECT * FROM t_incidents")
def incidents(t):
    path = scratch_folder(t.spark, "incidents")
    tables.write_incidents(t("t_incidents"), path)
    return tables.read_incidents(t.spark, path)


@query("s04_write_incidents", "SELECT kind, COUNT(*) AS n, CAST(SUM(cnt) AS BIGINT) AS total FROM t_incidents GROUP BY 1")
def written(t):
    path = scratch_folder(t.spark, "incidents-zip")
    t("t_incidents").select("ip", "date", "cnt", "kind").write.option("compression", "bzip2").csv(path)
    return tables.read_incidents(t.spark, path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("total"))


@query("s07_reputation_files", SQL_REPUTATION)
def reputation_files(t):
    path = scratch_folder(t.spark, "reputation")
    tables.write_reputation(reputation.reputation(t("t_incidents")), path)
    return reputation.exploded(tables.read_reputation(t.spark, path))


SQL_EXPORT = f"""WITH {SQL_BAD.strip()}, un AS ({{rows}}),
 al AS (SELECT * REPLACE (CASE WHEN remote_port % 2 = 0 THEN concat('198.51.100.', remote_port % 200) ELSE local END AS local) FROM un)
 SELECT server, CAST(COALESCE(end_time_utc, start_time_utc) AS DATE) AS day, remote, remote_port, local, local_port, start_time_utc AS start, end_time_utc AS "end"
 FROM al WHERE local NOT LIKE '192.168.%' AND remote NOT LIKE '10.%'"""


def public(connections):
    """Some connections with a public local address."""
    address = F.concat(F.lit("198.51.100."), (F.col("remote_port") % 200).cast("string"))
    return connections.withColumn("local", F.when(F.col("remote_port") % 2 == 0, address).otherwise(F.col("local")))


def omitted(t):
    return t("t_fake_logs").where("remote LIKE '10.%'").select(F.col("remote").alias("address")).distinct()


@query("s05_export_rows", SQL_EXPORT.format(rows="SELECT * FROM anyc UNION SELECT * FROM sshc"))
def export_rows(t):
    return exports.bad_connection_rows(public(bad(t)), omitted(t))


@query("s05_export_bad_connections", SQL_EXPORT.format(rows="SELECT * FROM anyc"))
def exported(t):
    path = scratch_folder(t.spark, "bad-connections")
    exports.export_bad_connections(public(bad_fake(t)), omitted(t), path)
    schema = (
        "remote string, remote_port long, local string, local_port int, start timestamp_ntz, end timestamp_ntz, server string, day date"
    )
    return t.spark.read.schema(schema).option("header", True).csv(path)


@query("s08_address_list", "SELECT DISTINCT remote AS address FROM t_fake_logs WHERE id % 5 > 0")
def address_list(t):
    text = t.sql(
        """SELECT CASE id % 5 WHEN 0 THEN concat('# ', remote) WHEN 1 THEN concat('  ', remote, '\\t# seen') WHEN 2 THEN concat(remote, ' ') ELSE remote END AS value
        FROM {t_fake_logs} UNION ALL SELECT '' FROM {t_fake_logs} WHERE id < 3"""
    )
    return tables.parse_address_list(text)


@query(
    "s09_set_rules",
    """SELECT id, concat('set', id % 3) AS "set", addr_remote AS ip, CASE WHEN id % 4 = 1 THEN 'udp' END AS proto, CASE WHEN id % 4 = 1 THEN port_remote END AS port,
    CASE WHEN id % 4 = 2 THEN 24 END AS prefix FROM t_packets WHERE id % 7 > 0""",
)
def set_rules(t):
    item = (
        F.when(F.col("id") % 4 == 1, F.concat("addr_remote", F.lit(",udp:"), "port_remote"))
        .when(F.col("id") % 4 == 2, F.concat("addr_remote", F.lit("/24")))
        .when(F.col("id") % 4 == 3, F.concat("addr_remote", F.lit("/32")))
        .otherwise(F.col("addr_remote"))
    )
    rule = F.concat(F.lit("add set"), (F.col("id") % 3).cast("string"), F.lit(" "), item)
    text = F.when(F.col("id") % 7 == 0, F.lit("create set0 hash:ip")).otherwise(rule)
    return tables.parse_set_rules(t("t_packets").select("id", text.alias("value")))


@query("s03_rejected", "SELECT event_id, 'damaged or incomplete line' AS reason FROM events WHERE event_id % 5 = 0 OR event_id % 7 = 0")
def rejected_incidents(t):
    """Every fifth line has a date that is none, every seventh has no kind."""
    path = scratch_folder(t.spark, "damaged-incidents")
    t.sql(
        """SELECT concat('198.51.100.1,', CASE WHEN event_id % 5 = 0 THEN 'x' ELSE '2024-01-01' END, ',', event_id,
        CASE WHEN event_id % 7 = 0 THEN '' ELSE ',scan' END) AS value FROM {events}"""
    ).write.text(path)
    number = F.regexp_extract("raw", r"^[^,]*,[^,]*,(\d+)", 1).cast("long")
    return tables.rejected_incidents(t.spark, path).select(number.alias("event_id"), "reason")


@query(
    "s07_rejected",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'unreadable document' WHEN 1 THEN 'unreadable date' WHEN 2 THEN 'unreadable count' ELSE 'kind without days' END AS reason
    FROM events WHERE event_id % 5 < 4""",
)
def rejected_reputation(t):
    """Of five lines one is cut off, one has a bad date, one a bad count and one a kind without days."""
    path = damaged_reputation(t)
    number = F.substring_index("ip", ".", -1).cast("long")
    return tables.rejected_reputation(t.spark, path).select(number.alias("event_id"), "reason")


@query(
    "s07_damaged_reputation",
    """SELECT concat('a.', event_id) AS ip, 'scan' AS kind, DATE '2024-01-02' AS date, event_id AS cnt FROM events WHERE event_id % 5 > 0""",
)
def readable_reputation(t):
    return reputation.exploded(tables.read_reputation(t.spark, damaged_reputation(t)))


def damaged_reputation(t):
    path = scratch_folder(t.spark, "damaged-reputation")
    n = F.col("event_id")
    ends = {0: "", 1: ',"2024-13-01":4}}', 2: ',"2024-01-03":"many"}}', 3: '},"probe":null}', 4: '},"probe":{}}'}
    end = F.element_at(F.create_map(*[F.lit(x) for pair in ends.items() for x in pair]), (n % 5).cast("int"))
    t("events").select(F.concat(F.lit("a."), n, F.lit('\t{"scan":{"2024-01-02":'), n, end).alias("value")).write.text(path)
    return path


@query("s08_rejected", "SELECT event_id, 'no address' AS reason FROM events WHERE event_id % 4 IN (1, 2)")
def rejected_addresses(t):
    text = t.sql(
        """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '# none' WHEN 1 THEN 'host.example.org # name' WHEN 2 THEN '198.51.100.256' ELSE '2001:db8::1' END AS value FROM {events}"""
    )
    return tables.rejected_address_list(text).select("event_id", "reason")


@query("s10_rejected", "SELECT concat('h', event_id) AS raw, 'no address' AS reason FROM events WHERE event_id % 3 = 0")
def rejected_greylist(t):
    path = scratch_folder(t.spark, "damaged-greylist")
    t.sql("SELECT CASE WHEN event_id % 3 = 0 THEN concat('h', event_id) ELSE '198.51.100.7' END AS ip, user_id FROM {events}").write.option("header", True).csv(path)
    return tables.rejected_greylist(t.spark, path)


def damaged_rules(t):
    return t.sql(
        """SELECT event_id, concat('add s 198.51.100.', event_id % 250, CASE event_id % 6 WHEN 0 THEN ',tcp:99999999999' WHEN 1 THEN ',tcp:http' WHEN 2 THEN '/99'
        WHEN 3 THEN ',udp:53' WHEN 4 THEN '/24' ELSE '' END) AS value FROM {events}"""
    )


@query("s09_rejected", "SELECT event_id, 'unreadable item' AS reason FROM events WHERE event_id % 6 < 3")
def rejected_rules(t):
    return tables.rejected_set_rules(damaged_rules(t)).select("event_id", "reason")


@query(
    "s09_damaged_rules",
    """SELECT event_id, 's' AS "set", concat('198.51.100.', event_id % 250) AS ip, CASE WHEN event_id % 6 = 3 THEN 'udp' END AS proto,
    CASE WHEN event_id % 6 = 3 THEN CAST(53 AS INTEGER) END AS port, CASE WHEN event_id % 6 = 4 THEN CAST(24 AS INTEGER) END AS prefix FROM events WHERE event_id % 6 >= 3""",
)
def readable_rules(t):
    return tables.parse_set_rules(damaged_rules(t))


@query(
    "s12_rejected",
    "SELECT event_id FROM events WHERE event_id % 5 = 0",
)
def rejected_lan(t):
    text = t.sql("SELECT event_id, concat('TCP,a,b,443,', CASE WHEN event_id % 5 = 0 THEN '1.2.3' ELSE '9007199254740993' END, ',1,1,1,1,1') AS value FROM {events}")
    return tables.rejected_lan_flows(text).select("event_id")


@query("s10_greylist", "SELECT ip AS address FROM t_incidents")
def greylist(t):
    path = scratch_folder(t.spark, "greylist")
    t("t_incidents").write.option("header", True).csv(path)
    return tables.read_greylist(t.spark, path)


@query(
    "s12_lan_flows",
    """SELECT event_id, 'TCP' AS proto, CASE WHEN event_id % 6 = 0 THEN 'UNDEFINED' ELSE '02:00:00:00:00:01' END AS src, concat('198.51.100.', user_id) AS dst, '443' AS port,
    event_id AS d_count, event_id * 2 AS d_size, event_id AS d_dsize, user_id AS u_count, user_id * 3 AS u_size, user_id AS u_dsize,
    CASE WHEN event_id % 3 = 0 THEN 'none' ELSE concat('h', user_id, '.example.org') END AS resolved FROM events WHERE event_id % 5 > 0""",
)
def lan_flows(t):
    text = t.sql(
        """SELECT event_id, concat('TCP,', CASE WHEN event_id % 6 = 0 THEN '!' ELSE '02:00:00:00:00:01' END, ',198.51.100.', user_id, ',443,', event_id, ',',
        CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(event_id * 2 AS STRING) END, ',', event_id, ',', user_id, ',', user_id * 3, ',', user_id,
        CASE WHEN event_id % 3 = 0 THEN '' ELSE concat(',h', user_id, '.example.org') END) AS value FROM {events}"""
    )
    return tables.parse_lan_flows(text)


@query(
    "s15_fw_log",
    """SELECT id, 'telnet' AS suffix, addr_remote AS src, addr_local AS dst, 'TCP' AS proto, port_remote AS dport, concat(addr_remote, ',TCP:', port_remote, ',', addr_local) AS item
    FROM t_packets WHERE id % 3 > 0""",
)
def fw_log(t):
    text = t.sql(
        """SELECT id, CASE WHEN id % 3 = 0 THEN 'usb 1-1: new device' ELSE concat('kern.warn kernel: fake-open-telnet: IN=eth1 OUT= SRC=', addr_remote, ' DST=', addr_local,
        ' LEN=44 PROTO=TCP SPT=40000 DPT=', port_remote, ' WINDOW=1024') END AS value FROM {t_packets}"""
    )
    return tables.parse_fw_log(text)


@query("s15_rejected", "SELECT id FROM t_packets WHERE id % 4 < 3")
def rejected_fw(t):
    """Lines with a port that is none, without a port, and with one that is too large."""
    text = t.sql(
        """SELECT id, concat('kernel: fake-open-telnet: IN=eth1 OUT= SRC=', addr_remote, ' DST=', addr_local, ' PROTO=TCP DPT=',
        CASE id % 4 WHEN 0 THEN 'x' WHEN 1 THEN '' WHEN 2 THEN '99999999999' ELSE '23' END) AS value FROM {t_packets}"""
    )
    return tables.rejected_fw_log(text).select("id")


@query("s11_dump_activities", "SELECT c.name, a.timestamp, a.activity FROM t_activities a JOIN t_clients c ON c.id = a.client ORDER BY 2, 1, 3")
def dumped_activities(t):
    return exports.dump_activities(t("t_activities"), t("t_clients"))


@query(
    "s11_dump_counts",
    """SELECT k.timestamp, c.name, y.name AS type_name, k.count, CAST(k.size AS BIGINT) AS size FROM t_counts k JOIN t_clients c ON c.id = k.client
    JOIN (VALUES (1, 'All'), (2, 'IPv4'), (3, 'IPv6'), (4, 'In')) y(id, name) ON y.id = k.type ORDER BY 1, 2, y.id""",
)
def dumped_counts(t):
    kinds = schemas.seed(
        t.spark, [(i + 1, name, i) for i, name in enumerate(schemas.COUNT_TYPES)], "id long, name string, ord int"
    )
    return exports.dump_counts(t("t_counts"), t("t_clients"), kinds)


@query(
    "s11_dump_capture_stats",
    "SELECT c.name, e.ts AS timestamp, e.event_id % 3 AS interface, e.event_id AS captured, e.user_id AS dropped, e.event_id % 2 AS dropped_driver FROM events e JOIN t_clients c ON c.id = e.user_id ORDER BY 2, 1, 3",
)
def dumped_captures(t):
    stats = t.sql("SELECT user_id AS client, ts AS timestamp, event_id % 3 AS interface, event_id AS captured, user_id AS dropped, event_id % 2 AS dropped_driver FROM {events}")
    return exports.dump_capture_stats(stats, t("t_clients"))


@query("s16_export_csv", "SELECT success, session_id, ts FROM t_ssh_commands")
def csv_export(t):
    path = scratch_folder(t.spark, "export")
    columns = ["success", "session_id", "ts"]
    exports.export_csv(t("t_ssh_commands"), columns, path)
    return t.spark.read.schema("success boolean, session_id long, ts timestamp_ntz").option("header", True).csv(path)


@query(
    "s17_anonymize",
    "SELECT id, client, sha256(concat('pepper', remote)) AS remote, login FROM t_ssh_sessions",
)
def anonymous(t):
    return exports.anonymize(t("t_ssh_sessions").drop("start_time"), ["remote"], "pepper")
