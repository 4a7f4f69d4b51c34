"""Rules at their edges, on hand-made rows."""

import random
import struct
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from conftest import values
from pyspark.sql import functions as F

from netloom import schemas
from netloom.functions import predicates, scalars, times, tls
from netloom.operators import archive, chains, clients, groups, joins, lan, ordering, packets, probes, reputation, score, sets
from netloom.sources import codecs, frames, tables

T0 = datetime(2024, 1, 1)


def test_speed_buckets(rows):
    edges = [k * 1000 // 8 for k in schemas.SPEED_EDGES_KBIT]
    assert len(edges) == 40
    data = [(0, 0)] + [(e, i) for i, e in enumerate(edges)] + [(e + 1, i + 1 if i < 39 else None) for i, e in enumerate(edges)]
    got = rows(data, "v long, want int").select("want", scalars.speed_bucket(F.col("v")).alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_cipher_names(rows):
    data = [
        ("ECDHE-RSA-AES128-GCM-SHA256", False), ("DHE-RSA-AES256-SHA", False), ("AES256-SHA", False), ("AES128-SHA256", False),
        ("RC4-MD5", True), ("DES-CBC3-SHA", True), ("ECDHE-ECDSA-DES-CBC3-SHA", True), ("AES256-MD5", True),
        ("AES128", None), ("TLS_AES_128_GCM_SHA256", None), ("AES256-SHA-EXTRA", None),
    ]
    got = rows(data, "c string, want boolean").select("c", "want", tls.cipher_weak(F.col("c")).alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_certificate_names(rows):
    data = [
        ("www.example.org", "www.example.org", True), ("www.example.org.", "www.example.org", True), ("*.example.org", "www.example.org", True),
        ("*.example.org", "a.b.example.org", False), ("*.*.example.org", "a.b.example.org", True), ("WWW.Example.ORG", "www.example.org", True),
        ("other.org\nwww.example.org", "www.example.org", True), ("other.org\nthird.org", "www.example.org", False), ("example.org", "www.example.org", False),
        ("*.example.org", "www.example.org.", True),
    ]
    got = rows(data, "n string, h string, want boolean").select("n", "h", "want", tls.cert_name_matches(F.col("n"), F.col("h")).alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_ages(rows):
    data = [(2881, "2d"), (2880, "48h"), (241, "4h"), (240, "240m"), (0, "0m")]
    got = rows(data, "m long, want string").select("want", times.age_text(F.col("m")).alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_icmp_codes(rows):
    v4 = {0: "N", 6: "N", 1: "H", 7: "H", 3: "P", 9: "A", 10: "A", 13: "A", 4: None}
    v6 = {0: "N", 1: "A", 3: "H", 4: "P"}
    data = [(4, c, v4.get(c, "O")) for c in range(16)] + [(6, c, v6.get(c, "O")) for c in range(8)]
    got = rows(data, "f int, c int, want string").select("want", scalars.icmp_reason("f", "c").alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_ping_reduce(rows):
    lost = 2**31 - 1
    data = [(1, [lost, lost]), (2, [5, lost, 8]), (3, []), (4, [lost - 1])]
    got = probes.ping_reduce(rows(data, "id long, rtts array<long>"))
    assert values(got) == [(1, 0, None, None, None), (2, 2, 5, 8, 6), (3, 0, None, None, None), (4, 1, lost - 1, lost - 1, lost - 1)]


def packet(**changes):
    base = {
        "client": 1, "ts": T0, "direction": "in", "length": 100, "layer": "I", "ip_protocol": 4, "app_protocol": "T",
        "addr_remote": "198.51.100.1", "port_remote": 5000, "tcp_flags": 0, "tunnel": False,
    }
    return tuple({**base, **changes}.values())


PACKET = (
    "client long, ts timestamp_ntz, direction string, length long, layer string, ip_protocol int, app_protocol string, "
    "addr_remote string, port_remote int, tcp_flags int, tunnel boolean"
)


def counters(rows, **changes):
    df = rows([packet(**changes)], PACKET)
    counted = packets.packet_counts(df, times.hour_of("ts"), ("198.51.100.1",))
    return {r.type for r in counted.collect() if r["count"]}


def test_packet_counters(rows):
    plain = {"All", "In", "IPv4", "TCP", "SERVER"}
    assert counters(rows) == plain
    for mask, extra in ((1, {"FIN"}), (2, {"SYN"}), (8, {"PUSH"}), (16, {"ACK"}), (18, {"SYN", "ACK", "SYN+ACK"}), (4, set())):
        assert counters(rows, tcp_flags=mask) == plain | extra
    assert counters(rows, port_remote=1024) == plain | {"Low port"}
    assert counters(rows, port_remote=1025) == plain
    assert counters(rows, port_remote=0) == plain
    assert counters(rows, port_remote=22) == {"All", "In", "IPv4", "TCP", "Low port"}
    assert counters(rows, ip_protocol=6, tunnel=True) == {"All", "In", "TCP", "SERVER", "V6TUNNEL"}
    assert counters(rows, direction="unknown") == {"All", "IPv4", "TCP"}
    assert counters(rows, layer="E", app_protocol="A") == {"All", "In"}
    assert counters(rows, app_protocol="i", addr_remote="x") == {"All", "In", "IPv4", "ICMP"}


def test_blacklist_thresholds(rows, spark):
    # 4 clients at 125 are hard, 3 at 100 soft; 99 does not count.
    data = [("telnet", "a", c, 125) for c in range(4)] + [("telnet", "b", c, 100) for c in range(3)] + [("telnet", "c", c, 99) for c in range(9)]
    got = score.blacklist(rows(data, "server string, remote string, client long, score long"), schemas.limits(spark))
    assert values(got) == [("telnet", "a", 4, 500, "hard"), ("telnet", "b", 3, 300, "soft")]


def test_equal_scores_collapse(rows):
    part = rows([("telnet", "a", 1, 60)], "server string, remote string, client long, score long")
    assert score.concat_scores([part, part]).count() == 1
    assert score.concat_scores([part, part], distinct=False).count() == 2


def test_sessions(rows):
    at = lambda m: T0 + timedelta(minutes=m)
    data = [(1, 1, at(0), "logout"), (2, 1, at(1), "login"), (3, 1, at(2), "login"), (4, 1, at(3), "logout"), (5, 1, at(9), "login"), (6, 1, at(9), "flow")]
    df = rows(data, "id long, client long, timestamp timestamp_ntz, activity string")
    got = clients.client_sessions(df, "2024-01-01 01:00:00")
    assert values(got) == [(1, at(1), at(2), "relogin"), (1, at(2), at(3), "logout"), (1, at(9), at(60), "open")]
    report = {r.client: (r.sessions, r.median) for r in clients.uptime_report(df, "2024-01-01 01:00:00").collect()}
    assert report == {1: (3, 60.0), None: (3, 60.0)}


LOG = "store string, epoch int, version long, is_add boolean, address string"


def test_versioned_sets(rows):
    log = rows(
        [
            ("s", 1, 1, True, "old"), ("s", 2, 1, True, "a"), ("s", 2, 2, True, "b"), ("s", 2, 3, False, "a"), ("s", 2, 4, True, "a"),
            ("s", 2, 5, False, "b"), ("s", 2, 6, False, "ghost"), ("s", 2, 7, True, "a"), ("t", 1, 1, True, "x"),
        ],
        LOG,
    )
    assert values(sets.set_content(log)) == [("s", "a"), ("t", "x")]
    assert values(sets.set_versions(log)) == [("s", 2, 7), ("t", 1, 1)]
    assert values(sets.version_diff(log, "s", 2, 2, 5)) == [("a", True), ("b", False)]
    assert values(sets.version_diff(log, "s", 2, 0, 5, full=True)) == [("a", True)]
    problems = values(sets.audit_changes(log, bucket_size=2), "address", "version", "problem")
    assert problems == [("a", 7, "repeated add"), ("ghost", 6, "absent removal")]
    replica = rows([("b",), ("c",)], "address string")
    assert values(sets.apply_diff(replica, sets.version_diff(log, "s", 2, 2, 5))) == [("a",), ("c",)]
    assert values(sets.apply_diff(replica, sets.version_diff(log, "s", 2, 0, 5, full=True), full=True)) == [("a",)]


def test_update_kinds(rows):
    data = [(None, None, "full"), (1, 9, "full"), (2, 7, "none"), (2, 6, "incremental"), (2, 8, "resync")]
    got = rows(data, "e int, v long, want string").select("want", sets.update_kind(F.col("e"), F.col("v"), F.lit(2), F.lit(7)).alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_set_sizes(rows):
    content = rows([(name, i) for name, n in (("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5)) for i in range(n)], "store string, address long")
    declared = rows([(n, 0, 0) for n in ("one", "two", "three", "four", "five")] + [("none", 8, 32)], "name string, maxsize long, hashsize long")
    got = {r.name: (r.maxsize, r.hashsize) for r in sets.set_sizes(declared, content).collect()}
    assert got == {"one": (2, 8), "two": (2, 8), "three": (4, 16), "four": (4, 16), "five": (8, 32), "none": (8, 32)}


def test_tags(rows):
    rules = rows(
        [(1, "p", "1.1.1.1", 22), (2, "q", "1.1.1.1", 23), (3, "g", "2.2.2.2", None), (4, "h", "2.2.2.2", 22), (5, "l", "2.2.2.2", None), (6, "z", "3.3.3.3", 80)],
        "line long, tag string, ip string, port int",
    )
    black = rows([("telnet", "3.3.3.3"), ("http", "4.4.4.4")], "server string, remote string")
    flows = rows(
        [(1, "1.1.1.1", 22), (2, "1.1.1.1", 99), (3, "2.2.2.2", 22), (4, "2.2.2.2", 99), (5, "3.3.3.3", 80), (6, "3.3.3.3", 81), (7, "4.4.4.4", 1), (8, "5.5.5.5", 1)],
        "id long, ip_remote string, port_remote int",
    )
    got = joins.tag_flows(flows, rules, black)
    assert dict(values(got, "id", "tag")) == {
        1: "p", 2: "p", 3: "h", 4: "l", 5: "z", 6: "fake-telnet", 7: "fake-http", 8: "?",
    }


def test_top_k_folds_the_rest(rows):
    ddl = "proto string, src string, dst string, port string, d_count long, d_size long, d_dsize long, u_count long, u_size long, u_dsize long"
    data = [("TCP", "m", f"d{i}", "80", 1, 1, 1, 10 - i, 1, 1) for i in range(5)] + [("both", "m", "other", "all", 7, 7, 7, 100, 7, 7)]
    data += [("TCP", "n", "d", "80", 1, 1, 1, 1, 1, 1), ("TCP", "m", "d3x", "80", 1, 1, 1, 7, 1, 1)]
    got = values(lan.topk_with_other(rows(data, ddl), 4), "src", "dst", "u_count")
    # d3 and d3x tie at rank four; the key decides.
    assert got == [("m", "d0", 10), ("m", "d1", 9), ("m", "d2", 8), ("m", "d3", 7), ("m", "other", 113), ("n", "d", 1)]


def test_array_sum_of_missing_groups(rows):
    data = [("g", 1, [1] * 40, [2] * 40, [3] * 40, [4] * 40), ("g", 2, [10] * 40, [0] * 40, [0] * 40, [0] * 40)]
    df = rows(data, "k string, client long, in_time array<long>, in_bytes array<long>, out_time array<long>, out_bytes array<long>")
    (row,) = groups.array_sum(df, ["k"], groups.SPEED_ARRAYS).collect()
    assert row.in_time == [11] * 40 and row.in_bytes == [2] * 40 and row.clients == 2


def test_sums_of_arrays_take_the_room_of_their_cells(rows):
    names = groups.SPEED_ARRAYS
    df = rows(
        [("g", 0, 1, 2, 3, 4), ("g", 39, 5, 6, 7, None), ("g", 39, 1, 1, 1, 1), ("g", 40, 9, 9, 9, 9), ("g", None, 9, 9, 9, 9), ("h", 3, None, 0, 0, 0), (None, 77, 1, 1, 1, 1)],
        "k string, pos int, in_time long, in_bytes long, out_time long, out_bytes long",
    )
    dense = groups.dense_arrays(df, ["k"], "pos", names)
    made = {r.k: r for r in dense.collect()}
    assert made["g"].in_time == [1] + [0] * 38 + [6] and made["g"].out_bytes == [4] + [0] * 38 + [1]
    assert made["h"].in_time == [0, 0, 0, None] + [0] * 36 and made["h"].in_bytes == [0] * 40
    assert made[None].in_time == [0] * 40
    both = groups.array_sum(dense.unionByName(dense.where("k = 'g'")), ["k"], names)
    added = {r.k: r for r in both.collect()}
    assert added["g"].clients == 2 and added["g"].in_time == [2] + [0] * 38 + [12]
    assert added["h"].in_time == made["h"].in_time and added[None].in_bytes == [0] * 40
    # No aggregate keeps a sum for every place of every array.
    for table in (dense, both):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert max(line.count("sum(") for line in plan.splitlines()) <= len(names) + 1


def test_predicates_without_parts(rows):
    df = rows([(1,)], "x int")
    assert df.where(predicates.p_and()).count() == 1
    assert df.where(predicates.p_or()).count() == 0


def test_truncated_and_foreign_messages(rows):
    record = struct.pack("!BIIQQHHQQQQ", 0, 1, 2, 3, 4, 5, 6, 0, 999_000, 0, 999_500) + bytes([10, 0, 0, 1, 192, 0, 2, 1])
    v6 = struct.pack("!BIIQQHHQQQQ", 1 | 2 | 64, 1, 2, 2**64 - 1, 4, 5, 6, 0, 0, 0, 0) + b"\0" * 15 + b"\1" + b"\x20\x01\x0d\xb8" + b"\0" * 11 + b"\2"
    head = struct.pack("!IQ", 7, 1_000_000)
    stale = struct.pack("!BIIQQHHQQQQ", 0, 1, 2, 3, 4, 5, 6, 1, 0, 0, 0) + bytes(8)
    old = struct.pack("!IQ", 7, 90_000_000) + stale + record.replace(struct.pack("!Q", 999_000), struct.pack("!Q", 89_000_000)).replace(struct.pack("!Q", 999_500), struct.pack("!Q", 89_000_000))
    data = [("mixed", head + record + v6), ("cut", head + record[:-1]), ("other", struct.pack("!IQ", 8, 1) + record), ("empty", head), ("stale", old)]
    df = rows([(c, T0, bytearray(p)) for c, p in data], "client string, received timestamp_ntz, payload binary")
    got = codecs.decode_flows(df, conf_id=7, max_records=2)
    assert values(got, "client", "ip_remote", "proto", "seen_rst", "size_in", "start_out") == sorted(
        [
            ("mixed", "192.0.2.1", "T", False, 3, T0 - timedelta(seconds=1)),
            ("mixed", "2001:db8::2", "U", True, 2**63 - 1, None),
            ("stale", "192.0.2.1", "T", False, 3, T0 - timedelta(seconds=1000)),
        ],
        key=repr,
    )
    assert codecs.decode_flows(df, conf_id=7, max_records=1).where("client = 'mixed'").count() == 0


def test_fake_log_versions(rows, spark):
    v1 = struct.pack("!IBBBc", 5000, 5, 0, 1, b"T") + bytes([1, 2, 3, 4]) + b"\2" + struct.pack("!L", 2) + b"no"
    v6 = struct.pack("!IBBBcH", 0, 0, 1, 0, b"S", 99) + b"\0" * 15 + b"\1" + b"\0" * 16
    df = rows([(1, T0, bytearray(v1))], "client long, received timestamp_ntz, payload binary")
    got = codecs.decode_fake_logs(df, version=1, servers=schemas.fake_servers(spark))
    assert values(got, "timestamp", "event", "remote", "local", "remote_port", "server", "reason") == [
        (T0 - timedelta(seconds=5), "login", "1.2.3.4", None, None, "telnet", "no")
    ]
    df = rows([(1, T0, bytearray(v6))], "client long, received timestamp_ntz, payload binary")
    assert codecs.decode_fake_logs(df).count() == 0
    assert values(codecs.decode_fake_logs(df, logins_only=False), "remote", "local", "remote_port", "event") == [("::1", "::", 99, "connect")]
    assert codecs.decode_fake_logs(df, logins_only=False, max_bytes=10).count() == 0


def test_frames():
    udp = bytes([0, 53, 0x9C, 0x40, 0, 8, 0, 0])
    ip6 = bytes([0x60, 0, 0, 0, 0, 8, 17, 64]) + b"\0" * 15 + b"\1" + b"\0" * 15 + b"\2" + udp
    tunnel = bytes([0x45, 0, 0, 0, 0, 0, 0, 0, 64, 41, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2]) + ip6
    macs = bytes(range(12))
    found = frames.frame_layers(1, macs + b"\x08\x00" + tunnel)
    assert [(x["layer"], x["app_protocol"]) for x in found] == [("E", "I"), ("I", "6"), ("I", "U")]
    assert found[-1]["port_src"] == 53 and found[-1]["port_dst"] == 40000 and found[-1]["src"] == "::1"
    assert found[-1]["hdr_length"] == 48
    assert frames.frame_layers(1, macs + b"\x08\x06")[0]["app_protocol"] == "A"
    assert frames.frame_layers(1, macs + b"\x88\x63")[0]["app_protocol"] == "P"
    assert frames.frame_layers(1, macs[:5])[0]["app_protocol"] is None
    assert frames.frame_layers(999, macs)[0]["layer"] == "?"
    cooked = bytes(2) + bytes(2) + b"\0\6" + macs[:6] + bytes(2) + b"\x08\x00" + tunnel
    assert [x["layer"] for x in frames.frame_layers(113, cooked)] == ["S", "I", "I"]
    short = bytes([0x45, 0, 0, 0, 0, 0, 0, 0, 64, 6, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2]) + b"\0\1\0\2"
    assert frames.frame_layers(101, short)[0]["app_protocol"] == "?"
    assert frames.frame_layers(101, b"\x45\0")[0]["ip_protocol"] == 0


def test_changed_certificates(rows):
    data = [(1, T0, "a"), (1, T0, "b"), (1, T0 + timedelta(1), "b"), (1, T0 + timedelta(1), "b"), (1, T0 + timedelta(2), "a"), (2, T0, "x")]
    got = probes.cert_changes(rows(data, "request long, batch timestamp_ntz, value string"))
    assert values(got, "batch", "value", "change") == [
        (T0 + timedelta(1), "a", "removed"), (T0 + timedelta(2), "a", "added"), (T0 + timedelta(2), "b", "removed"),
    ]


def test_sampling_groups(spark):
    from netloom.operators.selection import assign_groups

    members = assign_groups(spark.range(4000), seed=5)
    assert members.count() == 4000 * 5
    sizes = {r.name: r["count"] for r in members.groupBy("name").count().collect()}
    assert len(sizes) == 2 + 4 + 8 + 16 + 32
    assert all(sizes[f"rand-2-{i}"] > 1800 for i in (1, 2)) and all(sizes[f"rand-32-{i}"] > 70 for i in range(1, 33))
    assert values(members) == values(assign_groups(spark.range(4000), seed=5))


def test_messages_larger_than_a_batch(rows):
    n = 20_005
    record = struct.pack("!QcBHH", 1000, b"P", 4, 1, 2) + bytes([192, 0, 2, 1])
    head = struct.pack("!Q", 2000)
    data = [("big", T0, bytearray(head + record * n)), ("none", T0, bytearray(head)), ("small", T0, bytearray(head + record))]
    got = codecs.decode_refused(rows(data, "client string, received timestamp_ntz, payload binary").coalesce(1))
    assert values(got.groupBy("client").count()) == [("big", n), ("small", 1)]
    assert values(got.select("timestamp").distinct()) == [(T0 - timedelta(seconds=1),)]


def test_damaged_messages_do_not_end_the_job(rows):
    good = struct.pack("!QI", 5, 0) + struct.pack("!34Q", *[2**53 + 1] * 34)
    bad = [struct.pack("!QI", 2**63 + 1, 0) + good[12:], good[:9], None]
    df = rows([(1, bytearray(good))] + [(2, None if b is None else bytearray(b)) for b in bad], "client long, payload binary")
    kept = codecs.decode_counts(df).collect()
    assert [(r.client, r.type, r.count_, r.size) for r in rows_named(kept)] == [(1, i, 2**53 + 1, 2**53 + 1) for i in range(17)]
    rejected = codecs.decode_counts(df, rejected=True).collect()
    assert [r.client for r in rejected] == [2, 2, 2] and rejected[0].reason == "stamp out of range"
    assert codecs.decode_captures(df, rejected=True).count() == 3
    wide = struct.pack("!4Q", 2**63 + 1, 0, 0, 0)
    assert codecs.decode_bandwidth(rows([(1, bytearray(wide))], "client long, payload binary")).count() == 0


def rows_named(found):
    """Rows of counters; `count` is a method of a row."""
    return [SimpleNamespace(client=r["client"], type=r["type"], count_=r["count"], size=r["size"]) for r in found]


def test_unreadable_text(rows):
    items = ["1.2.3.4,tcp:http", "1.2.3.4,tcp:99999999999", "1.2.3.4/33", "2001:db8::1/64,udp:53"]
    lines = rows([(f"add s {item}",) for item in items], "value string")
    assert values(tables.parse_set_rules(lines)) == [("s", "2001:db8::1", "udp", 53, 64)]
    assert tables.rejected_set_rules(lines).count() == 3
    log = "kernel: fake-open-telnet: DPT=23 PROTO=TCP DST=192.0.2.1 SRC=198.51.100.1"
    lines = rows([(log,), (log.replace("23", "x"),), (log.replace("23", ""),), ("other",)], "value string")
    assert values(tables.parse_fw_log(lines)) == [("telnet", "198.51.100.1", "192.0.2.1", "TCP", 23, "198.51.100.1,TCP:23,192.0.2.1")]
    assert tables.rejected_fw_log(lines).count() == 2
    flow = "TCP,a,b,443,9007199254740993,.5,1.9,1,1,1"
    lines = rows([(flow,), (flow.replace("1.9", "1.2.3"),), ("TCP",)], "value string")
    assert values(tables.parse_lan_flows(lines), "d_count", "d_size", "d_dsize") == [(9007199254740993, 0, 1)]
    assert tables.rejected_lan_flows(lines).count() == 2


def test_reputation_of_damaged_rows(rows):
    df = rows([("8.8.8.8", None, 3, "scan"), ("8.8.8.8", datetime(2024, 1, 1).date(), 3, None), ("8.8.8.8", datetime(2024, 1, 1).date(), 4, "scan")], "ip string, date date, cnt long, kind string")
    docs = reputation.reputation(df)
    assert [r["cnt"] for r in reputation.exploded(docs).collect()] == [4]
    odd = rows([("8.8.8.8", {"scan": {"x": 1, "2024-01-01": 2}})], f"ip string, data {reputation.DOCUMENT}")
    assert [r["cnt"] for r in reputation.exploded(odd).collect()] == [2]


def test_null_keys_are_keys(rows):
    data = [(None, T0 + timedelta(seconds=s), s) for s in (0, 5, 4000, 4005)]
    df = rows(data, "k string, ts timestamp_ntz, id long")
    hour = F.date_trunc("hour", "ts")
    assert [r.n for r in ordering.ranked(df, ["k"], ["ts"], hour, "n").orderBy("id").collect()] == [1, 2, 3, 4]
    starts = chains.greedy_windows(df, ["k"], "ts", 10_000_000).orderBy("id").collect()
    assert [(r.start - T0).seconds for r in starts] == [0, 0, 4000, 4000]
    got = ordering.exact_median(df.withColumn("us", F.col("id")), ["k"], "us").collect()
    assert [(r.k, r.median) for r in got] == [(None, 2002.5)]


def test_uptime_of_unknown_clients(rows):
    data = [(1, None, T0, "login"), (2, None, T0 + timedelta(minutes=1), "logout"), (3, -1, T0, "login"), (4, -1, T0 + timedelta(minutes=3), "logout")]
    df = rows(data, "id long, client long, timestamp timestamp_ntz, activity string")
    got = values(clients.uptime_report(df, "2024-01-02 00:00:00"), "everyone", "client", "sessions", "max")
    assert got == [(False, -1, 1, 180.0), (False, None, 1, 60.0), (True, None, 2, 180.0)]


def test_remainder_row(rows):
    ddl = "proto string, src string, dst string, port string, " + ", ".join(f"{c} long" for c in lan.COUNTERS)
    data = [("TCP", None, f"d{i}", "1", i, i, i, i, i, i) for i in range(5)] + [(None, "s", "d", "1", *[1] * 6)]
    got = values(lan.topk_with_other(rows(data, ddl), 2), "src", "dst", "u_count")
    assert got == [("s", "d", 1), (None, "d3", 3), (None, "d4", 4), (None, "other", 3)]


def test_jdbc_reads_are_split(spark):
    with pytest.raises(ValueError, match="numPartitions"):
        tables.read_table(spark, "incidents", jdbc={"url": "jdbc:none", "partitionColumn": "id", "lowerBound": "0", "upperBound": "9"})


def test_repeated_names_give_one_pair(rows):
    names = rows([(1, "a"), (2, "a"), (3, "b")], "id long, name string")
    assert values(joins.cross_lookup(names, names, "a", "b")) == [(1, 3)]
    assert joins.cross_lookup(names, names, "a", "none").count() == 0


def test_credential_attempts(rows):
    ddl = "timestamp timestamp_ntz, server string, remote string, name binary, password binary, remote_port int, event string"
    at = lambda day, hour=0: datetime(2024, 1, day, hour)
    logs = rows(
        [
            (at(1), "s", "a", b"u", b"p", 1, "login"),
            (at(2), "s", "b", b"u", b"\xff\x00", 2, "login"),
            (at(2, 5), "s", "c", None, b"p", 3, "login"),
            (at(3), "s", "d", b"u", None, 4, "login"),
            (at(3), "s", "e", b"u", b"p", 5, "connect"),
            (at(3), None, None, b"", b"", None, "login"),
        ],
        ddl,
    )
    target = rows([(at(1), "s", "old", b"u", b"p", 1, "login"), (at(2, 1), "s", "stale", b"u", b"p", 1, "login")], ddl)
    ports = lambda df: sorted((r.remote or "", bytes(r.password)) for r in df.collect())
    assert ports(archive.credential_attempts(logs, target)) == [("", b""), ("b", b"\xff\x00"), ("old", b"p")]
    assert ports(archive.credential_attempts(logs, target.limit(0))) == [("", b""), ("a", b"p"), ("b", b"\xff\x00")]
    assert ports(archive.credential_attempts(logs, target, keep=False)) == [("old", b"p")]


def test_good_and_rejected_messages_are_all(rows):
    """Messages cut at every length, and of random bytes: each is decoded or rejected, never both, never lost."""
    rnd = random.Random(9)
    flow = struct.pack("!IQ", 7, 10**12) + struct.pack("!BIIQQHHQQQQ4s4s", 4, 1, 2, 3, 4, 5, 6, 10**12, 0, 0, 0, b"\1\2\3\4", b"\5\6\7\x08")
    flow += struct.pack("!BIIQQHHQQQQ16s16s", 1, 1, 2, 2**64 - 1, 4, 5, 6, 0, 0, 0, 10**12, b"\0" * 15 + b"\1", b"\x20\1" + b"\0" * 14)
    refused = struct.pack("!Q", 10**12) + struct.pack("!QcBHH4s", 10**12 - 5, b"P", 4, 1, 2, b"\1\2\3\4") + struct.pack("!QcBHH16s", 10**12, b"T", 6, 1, 2, b"\0" * 16)
    band = struct.pack("!2Q3Q1Q5Q", 5, 1, 1, 2, 3, 1, 1, 2, 3, 4, 5)
    counts = struct.pack("!QI3I4I", 5, 1, 1, 2, 3, 9, 8, 7, 6)
    decoders = {
        codecs.decode_flows: flow, codecs.decode_refused: refused, codecs.decode_bandwidth: band,
        codecs.decode_bandwidth_buckets: band, codecs.decode_counts: counts, codecs.decode_captures: counts,
    }
    for decode, whole in decoders.items():
        payloads = [None, whole, *[whole[:n] for n in range(len(whole))], *[rnd.randbytes(rnd.randint(0, 90)) for _ in range(60)]]
        df = rows([(i, T0, p) for i, p in enumerate(payloads)], "client long, received timestamp_ntz, payload binary")
        rejected = {r.client: r.reason for r in decode(df, rejected=True).collect()}
        found = {r.client for r in decode(df).collect()}
        assert rejected[0] == "message is missing" and 1 in found and not found & set(rejected)
        assert all(rejected.values()) and len(rejected) > 20
    got = codecs.decode_flows(rows([(1, T0, flow)], "client long, received timestamp_ntz, payload binary"))
    assert values(got, "ip_local", "ip_remote", "size_in", "seen_start_in") == [("1.2.3.4", "5.6.7.8", 3, True), ("::1", "2001::", 2**63 - 1, False)]
