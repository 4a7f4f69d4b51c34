"""Frames that Spark builds from the events, decoded again; registered handlers."""

from pyspark.sql import functions as F

from netloom.functions.times import hour_of
from netloom.operators import packets, registry
from netloom.plans import codec_queries as payloads
from netloom.plans.codec_queries import be, eid, uid, v4
from netloom.plans.registry import query
from netloom.sources import codecs, frames


def ip4(protocol: int, body, src, dst):
    return F.concat(be(0x45, 1), be(0, 1), be(20 + F.length(body), 2), be(0, 4), be(64, 1), be(protocol, 1), be(0, 2), src, dst, body)


def frame(t):
    """TCP, UDP and ICMP by event id, some tagged, some inside another packet."""
    inward = eid() % 2 == 0
    here, there = v4(192, 168, 1, uid() % 250), v4(198, 51, 100, uid() % 20)
    src, dst = F.when(inward, there).otherwise(here), F.when(inward, here).otherwise(there)
    near, far = be(40000 + uid() % 100, 2), be(eid() % 2000, 2)
    ports = F.concat(F.when(inward, far).otherwise(near), F.when(inward, near).otherwise(far))
    fill = F.unhex(F.expr("repeat('61', CAST(event_id % 30 AS INT))"))
    tcp = F.concat(ports, be(0, 8), be(0x50, 1), be(eid() % 64, 1), be(0, 6), fill)
    udp = F.concat(ports, be(8, 2), be(0, 2), fill)
    icmp = F.concat(be(8, 1), be(0, 7), fill)
    kind = eid() % 10
    packet = F.when(kind < 6, ip4(6, tcp, src, dst)).when(kind < 9, ip4(17, udp, src, dst)).otherwise(ip4(1, icmp, src, dst))
    packet = F.when(eid() % 7 == 0, ip4(4, packet, v4(10, 0, 0, 1), v4(10, 0, 0, 2))).otherwise(packet)
    tag = F.when(eid() % 3 == 0, F.concat(be(0x88A8, 2), be(9, 2), be(0x8100, 2), be(5, 2))).otherwise(F.lit(b""))
    ethernet = F.concat(be(2, 6), be(4, 6), tag, be(0x0800, 2), packet)
    return t("events").select(
        uid().alias("client"), eid().alias("id"), "ts", F.when(inward, "in").otherwise("out").alias("direction"),
        F.lit(1).alias("datalink"), ethernet.alias("frame"),
    )


SQL_FRAMES = """f AS (SELECT user_id AS client, event_id AS id, ts, CASE WHEN event_id % 2 = 0 THEN 'in' ELSE 'out' END AS direction,
 CASE WHEN event_id % 10 < 6 THEN 'T' WHEN event_id % 10 < 9 THEN 'U' ELSE 'i' END AS app_protocol,
 14 + CASE WHEN event_id % 3 = 0 THEN 8 ELSE 0 END + CASE WHEN event_id % 7 = 0 THEN 20 ELSE 0 END + 20 + CASE WHEN event_id % 10 < 6 THEN 20 ELSE 8 END + event_id % 30 AS length FROM events)"""


@query(
    "s24_decode_packets",
    f"""WITH {SQL_FRAMES} SELECT client, id, ts, direction, length, 'I' AS layer, CAST(CASE app_protocol WHEN 'T' THEN 40 WHEN 'U' THEN 28 ELSE 20 END AS BIGINT) AS hdr_length,
    4 AS ip_protocol, app_protocol, CAST(CASE WHEN app_protocol = 'T' THEN id % 64 ELSE 0 END AS INTEGER) AS tcp_flags, id % 7 = 0 AS tunnel,
    concat('192.168.1.', client % 250) AS addr_local, concat('198.51.100.', client % 20) AS addr_remote,
    CAST(CASE WHEN app_protocol = 'i' THEN 0 ELSE 40000 + client % 100 END AS INTEGER) AS port_local, CAST(CASE WHEN app_protocol = 'i' THEN 0 ELSE id % 2000 END AS INTEGER) AS port_remote FROM f""",
)
def decoded(t):
    return frames.innermost(frames.decode_packets(frame(t)))


@query(
    "s24_vlan_layers",
    "SELECT event_id AS id, CAST(CASE WHEN event_id % 7 = 0 THEN 3 ELSE 2 END AS INTEGER) AS layers, CAST(CASE WHEN event_id % 3 = 0 THEN 5 ELSE 0 END AS INTEGER) AS vlan, '00:00:00:00:00:04' AS src FROM events",
)
def layers(t):
    outer = F.element_at("layers", 1)
    rows = frames.decode_packets(frame(t))
    return rows.select("id", F.size("layers").alias("layers"), outer["vlan"].alias("vlan"), outer["src"].alias("src"))


@query(
    "s24_rejected",
    "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'message is missing' ELSE 'link type is missing' END AS reason FROM events WHERE event_id % 5 = 0 OR event_id % 7 = 0",
)
def rejected_frames(t):
    rows = frame(t).withColumns({
        "frame": F.when(F.col("id") % 5 > 0, F.col("frame")), "datalink": F.when(F.col("id") % 7 > 0, F.col("datalink")),
    })
    return frames.decode_packets(rows, rejected=True).select("id", "reason")


@query(
    "s24_cut_frames",
    f"""WITH {SQL_FRAMES}, o AS (SELECT *, 14 + CASE WHEN id % 3 = 0 THEN 8 ELSE 0 END AS link, id % 60 AS kept FROM f),
    p AS (SELECT id, link, least(kept, length) AS kept, length - CASE app_protocol WHEN 'T' THEN 20 ELSE 8 END - id % 30 AS inner_end FROM o)
    SELECT id, CAST(1 + CASE WHEN kept < link THEN 0 WHEN id % 7 > 0 OR kept < link + 20 THEN 1 ELSE 2 END AS INTEGER) AS layers,
    CASE WHEN kept < link THEN 0 WHEN id % 7 = 0 AND kept >= link + 20 THEN kept - link - 20 ELSE CAST(kept - link AS BIGINT) END AS inner_length,
    kept >= inner_end AS whole FROM p""",
)
def cut_frames(t):
    """Frames cut at a length by event id: how deep they can be read."""
    cut = frame(t).withColumn("frame", F.expr("substring(frame, 1, CAST(id % 60 AS INT))"))
    inner = F.element_at("layers", -1)
    depth = F.size("layers")
    return frames.decode_packets(cut).select(
        "id", depth.alias("layers"),
        F.when(depth == 1, F.lit(0).cast("long")).otherwise(inner["length"]).alias("inner_length"),
        (inner["src"].contains("168") | inner["dst"].contains("168")).alias("whole"),
    ).withColumn("whole", F.coalesce("whole", F.lit(False)))


@query(
    "s25_decode_icmp_nak",
    """SELECT user_id AS client, event_id AS id, concat('203.0.113.', event_id % 50) AS address, CAST(40000 + user_id AS INTEGER) AS local_port, CAST(event_id % 1000 AS INTEGER) AS remote_port,
    CASE event_id % 15 WHEN 0 THEN 'N' WHEN 6 THEN 'N' WHEN 1 THEN 'H' WHEN 7 THEN 'H' WHEN 3 THEN 'P' WHEN 9 THEN 'A' WHEN 10 THEN 'A' WHEN 13 THEN 'A' ELSE 'O' END AS reason
    FROM events WHERE event_id % 4 > 0 AND event_id % 15 <> 4""",
)
def naks(t):
    return frames.decode_icmp_nak(icmp_bodies(t))


def icmp_bodies(t):
    """Unreachable messages by event id; every fourth quotes a UDP packet."""
    ports = F.concat(be(40000 + uid(), 2), be(eid() % 1000, 2), be(0, 4))
    protocol = F.when(eid() % 4 == 0, 17).otherwise(6)
    quote = F.concat(
        be(0x45, 1), be(0, 3), be(0, 4), be(64, 1), be(protocol, 1), be(0, 2), v4(192, 168, 1, 1), v4(203, 0, 113, eid() % 50), ports
    )
    body = F.concat(be(3, 1), be(eid() % 15, 1), be(0, 6), quote)
    return t("events").select(uid().alias("client"), eid().alias("id"), F.lit("i").alias("app_protocol"), body.alias("body"))


@query(
    "s25_rejected",
    """SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN 'message is cut off' WHEN event_id % 4 = 0 THEN 'quoted packet is not TCP' ELSE 'code is no refusal' END AS reason
    FROM events WHERE event_id % 11 = 0 OR event_id % 4 = 0 OR event_id % 15 = 4""",
)
def rejected_naks(t):
    cut = F.when(F.col("id") % 11 == 0, F.expr("substring(body, 1, 5)")).otherwise(F.col("body"))
    return frames.decode_icmp_nak(icmp_bodies(t).withColumn("body", cut), rejected=True).select("id", "reason")


@query(
    "g01_analyzer",
    f"WITH {SQL_FRAMES} SELECT date_trunc('hour', ts) AS start, client, COUNT(*) AS count, CAST(SUM(length) AS BIGINT) AS size FROM f GROUP BY 1, 2",
)
def analysed(t):
    registry.register_analyzer(
        "all packets",
        lambda df: packets.packet_counts(df, hour_of("ts")).where("type = 'All'").drop("type"),
    )
    return registry.analyze(decoded(t), "all packets")


@query(
    "g02_decoder",
    f"""WITH {payloads.SQL_RECORDS} SELECT user_id AS client, 1700000000 + event_id AS stamp, CAST(500000 * (k + 1) AS BIGINT) AS win_len, event_id * 100 + k AS in_max, event_id * 50 AS out_max FROM r WHERE event_id % 2 = 0""",
)
def routed(t):
    registry.register_decoder("Bandwidth", codecs.decode_bandwidth)
    payload = F.when(eid() % 2 == 0, payloads.bandwidth_payload()).otherwise(be(0, 8))
    name = F.when(eid() % 2 == 0, "Bandwidth").otherwise("Other")
    rows = t("events").select(uid().alias("client"), name.alias("plugin"), payload.alias("payload"))
    return registry.route(rows, "Bandwidth")
