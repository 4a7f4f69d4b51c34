"""Declared table schemas, ordered enumerations and seed dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Table schemas as DDL. Times are UTC wall clocks without a zone unless the
# record itself carries one; addresses are canonical text.
TABLES = {
    "clients": "id long, name string, tag string, devel_note string, asnum int",
    "groups": "id long, name string",
    "group_members": "client long, in_group long",
    "activity_types": "id short, name string, plugin string",
    "activities": "id long, client long, timestamp timestamp_ntz, activity short",
    "known_plugins": "name string, version int, hash string, status string, introduced timestamp_ntz, note string",
    "active_plugins": "client long, name string, updated timestamp_ntz, version int, hash string, libname string, active boolean",
    "plugin_history": "id long, client long, name string, timestamp timestamp_ntz, version int, hash string, active boolean",
    "count_types": "id short, name string, description string, ord int",
    "count_snapshots": "id long, timestamp timestamp_ntz, client long",
    "counts": "snapshot long, type short, count long, size long",
    "bandwidth": "timestamp timestamp_ntz, client long, win_len long, in_max long, out_max long",
    "bandwidth_stats": "timestamp timestamp_ntz, client long, in_time array<long>, in_bytes array<long>, out_time array<long>, out_bytes array<long>",
    "capture_stats": "snapshot long, interface short, captured long, dropped long, dropped_driver long",
    "ping_requests": "id long, host string, proto string, amount int, size int, active boolean, lastrun timestamp_ntz, interval interval day to second",
    "pings": "id long, request long, batch timestamp_ntz, client long, timestamp timestamp_ntz, ip string, received int, min long, max long, avg long",
    "biflows": "id long, client long, ip_local string, ip_remote string, port_local int, port_remote int, proto string, start_in timestamp_ntz, start_out timestamp_ntz, stop_in timestamp_ntz, stop_out timestamp_ntz, size_in long, size_out long, count_in long, count_out long, seen_start_in boolean, seen_start_out boolean, seen_end_in boolean, seen_end_out boolean, seen_rst boolean, tag string, tagged_on timestamp_ntz",
    "cert_requests": "id long, host string, port int, starttls string, want_cert boolean, want_chain boolean, want_details boolean, want_params boolean, active boolean, lastrun timestamp_ntz, interval interval day to second",
    "certs": "id long, request long, client long, batch timestamp_ntz, timestamp timestamp_ntz, proto string, cipher string",
    "cert_chains": "cert long, ord int, is_full boolean, value string, name string, expiry timestamp_ntz",
    "address_log": "store string, epoch int, version long, is_add boolean, address string",
    "fwup_sets": "name string, type string, maxsize long, hashsize long",
    "fake_logs": "id long, client long, timestamp timestamp_ntz, event string, remote string, local string, remote_port int, server string, name binary, password binary, reason string, method binary, host binary, uri binary",
    "ssh_sessions": "id long, long_id string, client long, start_time timestamp, end_time timestamp, login binary, password binary, remote string, remote_port int, local string",
    "ssh_commands": "id long, session_id long, ts timestamp, success boolean, command binary, archived boolean",
    "spoof": "id long, client long, batch timestamp_ntz, spoofed boolean, addr_matches boolean, received timestamp_ntz, ip string",
    "refused": "id long, client long, timestamp timestamp_ntz, address string, local_port int, remote_port int, reason string",
    "firewall_log": "id long, router_id long, time timestamp, direction string, remote_address string, remote_port int, local_port int, rule_id string, protocol string, count long, tcp_flags int",
    "incidents": "ip string, date date, cnt long, kind string",
    "lan_flows": "proto string, src string, dst string, port string, d_count long, d_size long, d_dsize long, u_count long, u_size long, u_dsize long, resolved string",
}

# Order of the enumerations, lowest first.
ENUM_ORDER = {
    "blacklist_mode": ("soft", "hard"),
    "fake_log_type": ("connect", "disconnect", "lost", "extra", "timeout", "login"),
    "plugin_status": ("allowed", "obsolete", "disabled"),
}

# The 16 packet counters in wire order.
COUNT_TYPES = (
    "All", "IPv4", "IPv6", "In", "Out", "TCP", "UDP", "ICMP", "Low port",
    "SYN", "FIN", "SYN+ACK", "ACK", "PUSH", "SERVER", "V6TUNNEL",
)

# Honeypot servers as (name, code, server, port).
FAKE_SERVERS = (
    ("telnet", "T", "telnet", 23),
    ("SSH honeypot", "S", "ssh_honey", 22),
    ("http", "H", "http", 80),
    ("telnet alternative", "t", "telnet_alt", 2323),
    ("Squid HTTP proxy", "P", "squid_http_proxy", 3128),
    ("HTTP proxy/HTTP alt", "h", "http_proxy", 8080),
    ("Polipo HTTP proxy", "p", "polipo_http_proxy", 8123),
)

# Activity types as (name, plugin).
ACTIVITY_TYPES = (
    ("login", None),
    ("logout", None),
    ("buckets", "Buckets"),
    ("counts", "Count"),
    ("pings", "Sniff"),
    ("bandwidth", "Bandwidth"),
    ("certs", "Sniff"),
    ("flow", "Flow"),
    ("spoof", "Spoof"),
    ("refused", "Refused"),
    ("fake", "Fake"),
)

# STARTTLS protocols by id.
STARTTLS = ("", "smtp", "pop3", "imap", "ftp", "xmpp")

# Score of one event as (server, event, score).
SCORES = (
    ("telnet", "connect", 4),
    ("telnet", "login", 20),
    ("telnet_alt", "connect", 4),
    ("telnet_alt", "login", 20),
    ("http", "connect", 10),
    ("http", "login", 10),
    ("squid_http_proxy", "connect", 10),
    ("squid_http_proxy", "login", 10),
    ("http_proxy", "connect", 10),
    ("http_proxy", "login", 10),
    ("polipo_http_proxy", "connect", 10),
    ("polipo_http_proxy", "login", 10),
)

# Thresholds as (server, clients, score, mode).
LIMITS = (
    ("telnet", 4, 500, "hard"),
    ("telnet", 3, 300, "soft"),
    ("telnet", 2, 1000, "soft"),
    ("telnet_alt", 4, 500, "hard"),
    ("telnet_alt", 3, 300, "soft"),
    ("telnet_alt", 2, 1000, "soft"),
    ("http", 4, 500, "hard"),
    ("http", 3, 300, "soft"),
    ("http", 2, 1000, "soft"),
    ("http_proxy", 4, 500, "hard"),
    ("http_proxy", 3, 300, "soft"),
    ("http_proxy", 2, 1000, "soft"),
    ("squid_http_proxy", 4, 500, "hard"),
    ("squid_http_proxy", 3, 300, "soft"),
    ("squid_http_proxy", 2, 1000, "soft"),
    ("polipo_http_proxy", 4, 500, "hard"),
    ("polipo_http_proxy", 3, 300, "soft"),
    ("polipo_http_proxy", 2, 1000, "soft"),
    ("ssh_honey", 3, 300, "soft"),
    ("ssh_honey", 4, 500, "hard"),
)

# Upper edge of the 40 speed buckets in kbit/s.
SPEED_EDGES_KBIT = (
    [250, 500, 750]
    + list(range(1_000, 20_000, 1_000))
    + list(range(20_000, 100_000, 10_000))
    + list(range(100_000, 1_000_001, 100_000))
)


def seed(spark: SparkSession, rows, ddl: str) -> DataFrame:
    """A constant dimension; its size is fixed by the tables above.

    Inline values have a known size, so joins with them need no shuffle.
    """
    literal = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    lines = ", ".join(f"({', '.join(map(literal, row))})" for row in rows)
    columns = [field.split() for field in ddl.split(", ")]
    typed = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in columns)
    return spark.sql(f"SELECT {typed} FROM VALUES {lines} AS t({', '.join(name for name, _ in columns)})")


def scores(spark: SparkSession) -> DataFrame:
    return seed(spark, SCORES, "server string, event string, score int")


def limits(spark: SparkSession) -> DataFrame:
    return seed(spark, LIMITS, "server string, clients int, score int, mode string")


def fake_servers(spark: SparkSession) -> DataFrame:
    return seed(spark, FAKE_SERVERS, "name string, code string, server string, port int")


def enum_rank(value: Column, enum: str) -> Column:
    """Position of an enumeration value, so MAX follows the declared order."""
    names = F.array(*[F.lit(n) for n in ENUM_ORDER[enum]])
    return F.nullif(F.array_position(names, value), F.lit(0)).cast("int")


def enum_name(rank: Column, enum: str) -> Column:
    """Inverse of `enum_rank`."""
    names = F.array(*[F.lit(n) for n in ENUM_ORDER[enum]])
    return F.get(names, rank - 1)
