"""Readers and writers on real files."""

import bz2
import gzip
from datetime import date

from conftest import values

from netloom import schemas
from netloom.operators import reputation
from netloom.sources import exports, tables


def test_incident_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1.2.3.4,2024-01-01,3,ssh\n")
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b"1.2.3.4,2024-01-02,1,telnet\n"))
    (tmp_path / "c.csv.bz2").write_bytes(bz2.compress(b"8.8.8.8,2024-01-02,2,ssh\n"))
    got = tables.read_incidents(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv.gz", "c.csv.bz2")])
    assert values(got) == [
        ("1.2.3.4", date(2024, 1, 1), 3, "ssh"), ("1.2.3.4", date(2024, 1, 2), 1, "telnet"), ("8.8.8.8", date(2024, 1, 2), 2, "ssh"),
    ]


def test_reputation_lines(spark, tmp_path):
    (tmp_path / "r").write_text('1.2.3.4\t{"ssh":{"2024-01-01":3}}\n')
    old = tables.read_reputation(spark, str(tmp_path / "r"))
    new = reputation.reputation(spark.createDataFrame([("1.2.3.4", date(2024, 1, 1), 2, "ssh"), ("10.0.0.1", date(2024, 1, 1), 2, "ssh")], schemas.TABLES["incidents"]))
    tables.write_reputation(reputation.merge_reputation(old, new), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text == '1.2.3.4\t{"ssh":{"2024-01-01":5}}\n'


def test_address_and_rule_files(spark, tmp_path):
    (tmp_path / "list").write_text("8.8.8.8\n# comment\n\n 1.1.1.1 # name\n8.8.8.8\n")
    assert values(tables.read_address_list(spark, str(tmp_path / "list"))) == [("1.1.1.1",), ("8.8.8.8",)]
    (tmp_path / "rules").write_text("create s hash:ip\nadd s 1.1.1.1\nadd s 1.1.1.2,tcp:22\n# no\n\nadd t 10.0.0.0/8\nadd t ::1/128\n")
    got = tables.read_set_rules(spark, str(tmp_path / "rules"))
    assert values(got, "set", "ip", "port", "prefix") == sorted(
        [("s", "1.1.1.1", None, None), ("s", "1.1.1.2", 22, None), ("t", "10.0.0.0", None, 8), ("t", "::1", None, None)], key=repr
    )
    (tmp_path / "grey.csv").write_text("Address,Why\n1.1.1.1,x\n2.2.2.2,y\n")
    assert values(tables.read_greylist(spark, str(tmp_path / "grey.csv"))) == [("1.1.1.1",), ("2.2.2.2",)]


def test_lan_file(spark, tmp_path):
    lines = [
        "TCP,02:00:00:00:00:01,198.51.100.1,443,1,2,3,4,5,6,host.example.org",
        "UDP,02:00:00:00:00:01,2001:db8::1,53,1,2,3,4,5,6",
        "TCP,02:00:00:00:00:01,198.51.100.1,443,1,2,x,4,5,6,late",
        "TCP,02:00:00:00:00:01,198.51.100.1,443,1,2",
        "both,02:00:00:00:00:01,other,all,1.000000,2.000000,3.000000,4.000000,5.000000,6.000000,none",
    ]
    (tmp_path / "lan").write_text("\n".join(lines) + "\n")
    got = tables.read_lan_flows(spark, str(tmp_path / "lan"))
    assert values(got, "proto", "port", "d_count", "u_dsize", "resolved") == [
        ("TCP", "443", 1, 6, "host.example.org"), ("UDP", "53", 1, 6, "none"), ("both", "all", 1, 6, "none"),
    ]


def test_tables_keep_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda i, day: (i, 1, f"2024-01-0{day} 10:00:00", 1)
    build = lambda data: spark.createDataFrame(data, "id long, client long, timestamp string, activity int").selectExpr(
        "id", "client", "CAST(timestamp AS TIMESTAMP_NTZ) AS timestamp", "CAST(activity AS SHORT) AS activity"
    )
    tables.write_table(build([row(1, 1), row(2, 2)]), path, "timestamp")
    tables.write_table(build([row(3, 2)]), path, "timestamp")
    assert values(tables.read_table(spark, "activities", path), "id") == [(1,), (3,)]


def test_blacklist_file(spark, tmp_path):
    listed = spark.createDataFrame([("telnet", "b", 4, 500, "hard"), ("http", "a", 3, 300, "soft"), ("http", "omit", 3, 300, "soft")], "server string, remote string, clients long, score long, mode string")
    exports.export_blacklist(listed, spark.createDataFrame([("omit",)], "address string"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [line for line in text.splitlines() if not line.startswith("server")] == ["http,a,3,300,soft", "telnet,b,4,500,hard"]


def test_every_schema_parses(spark):
    for ddl in schemas.TABLES.values():
        assert spark.createDataFrame([], ddl).columns


def test_reputation_lines_are_read_or_rejected(spark, tmp_path):
    lines = [
        '198.51.100.1\t{"scan":{"2024-01-01":3,"x":1},"ssh":{"2024-01-02":"many","2024-01-03":4}}',
        '198.51.100.2\t{"scan":5}',
        "198.51.100.3\t[1]",
        "198.51.100.4",
        '\t{"scan":{"2024-01-01":3}}',
        "198.51.100.5\t{}",
        '198.51.100.6\t{"scan":{"2024-01-01":99999999999999999999}}',
    ]
    path = str(tmp_path / "r")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    good = {(r.ip, r.kind, str(r.date), r.cnt) for r in reputation.exploded(tables.read_reputation(spark, path)).collect()}
    assert good == {("198.51.100.1", "scan", "2024-01-01", 3), ("198.51.100.1", "ssh", "2024-01-03", 4)}
    bad = sorted((r.ip or "", r.reason) for r in tables.rejected_reputation(spark, path).collect())
    assert ("198.51.100.1", "unreadable date") in bad and ("198.51.100.1", "unreadable count") in bad
    assert [reason for ip, reason in bad if ip == ""] == ["no address"]
    assert {ip[-1] for ip, _ in bad if ip} == set("12346")


def test_address_lists_are_read_or_rejected(spark, tmp_path):
    lines = ["198.51.100.1 # seen", "", "# none", "2001:db8::1", "host.example.org", "198.51.100.1"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert {r.address for r in tables.parse_address_list(df).collect()} == {"198.51.100.1", "2001:db8::1"}
    assert [r.value for r in tables.rejected_address_list(df).collect()] == ["host.example.org"]
    spark.createDataFrame([("198.51.100.1", 1), (None, 2), ("x", 3)], "ip string, n int").write.option("header", True).csv(str(tmp_path / "g"))
    assert [r.address for r in tables.read_greylist(spark, str(tmp_path / "g")).collect()] == ["198.51.100.1"]
    assert sorted(r.raw or "" for r in tables.rejected_greylist(spark, str(tmp_path / "g")).collect()) == ["", "x"]
