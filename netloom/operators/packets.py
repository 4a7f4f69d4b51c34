"""Packet statistics: counters, flows, bandwidth and refused connections.

Packets are rows of the innermost layer: client, ts, direction (in, out,
unknown), length (of the outermost packet), layer, ip_protocol (4 or 6),
app_protocol (T, U, i, I, ...), addr_local, addr_remote, port_local,
port_remote, tcp_flags and tunnel (inside another IP packet).
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.predicates import p_trackable
from netloom.functions.scalars import speed_bucket
from netloom.functions.times import bin_start, from_micros, micros, trunc_to
from netloom.operators.chains import greedy_windows
from netloom.operators.ordering import ranked
from netloom.schemas import COUNT_TYPES

# TCP flag bits.
FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16
# Window lengths in microseconds, and the one that feeds speeds.
WINDOW_LENGTHS = (500_000, 1_000_000, 2_000_000, 5_000_000, 10_000_000)
SPEED_WINDOW = 2_000_000
LOW_PORT = 1024  # Fixed value: remote ports up to here are low.


def flag(c: Column, bit: int) -> Column:
    return c.bitwiseAND(F.lit(bit)) != 0


def count_conditions(servers=()) -> dict[str, Column]:
    """The 16 overlapping packet properties by counter name.

    `servers` lists the addresses of the collection service (a setting).
    """
    ip = F.col("layer") == "I"
    tcp = ip & (F.col("app_protocol") == "T")
    known = ip & F.col("direction").isin("in", "out")
    v6 = ip & (F.col("ip_protocol") == 6)
    tcp_flag = lambda bit: tcp & flag(F.col("tcp_flags"), bit)
    conditions = (
        F.lit(True),
        ip & (F.col("ip_protocol") == 4),
        v6 & ~F.col("tunnel"),
        F.col("direction") == "in",
        F.col("direction") == "out",
        tcp,
        ip & (F.col("app_protocol") == "U"),
        ip & F.col("app_protocol").isin("i", "I"),
        known & F.col("port_remote").between(1, LOW_PORT),
        tcp_flag(SYN),
        tcp_flag(FIN),
        tcp_flag(SYN) & tcp_flag(ACK),
        tcp_flag(ACK),
        tcp_flag(PSH),
        known & (F.col("addr_remote").isin(*servers) if servers else F.lit(False)) & (F.col("port_remote") != 22),
        v6 & F.col("tunnel"),
    )
    return dict(zip(COUNT_TYPES, conditions))


def packet_counts(packets: DataFrame, window: Column, servers=()) -> DataFrame:
    """Packets and bytes per window, client and counter: one aggregation, then unpivoted."""
    conditions = count_conditions(servers)
    sums = []
    for i, condition in enumerate(conditions.values()):
        sums += [
            F.count_if(condition).alias(f"c{i}"),
            F.sum(F.when(condition, F.col("length")).otherwise(0)).alias(f"s{i}"),
        ]
    wide = packets.groupBy(window.alias("start"), "client").agg(*sums)
    cells = F.array(*[
        F.struct(F.lit(name).alias("type"), F.col(f"c{i}").alias("count"), F.col(f"s{i}").alias("size"))
        for i, name in enumerate(conditions)
    ])
    return wide.select("start", "client", F.inline(cells))


FLOW_KEY = ["client", "ip_protocol", "app_protocol", "addr_local", "addr_remote", "port_local", "port_remote"]


def assemble_flows(packets: DataFrame, min_packets: int = 1, window: Column | None = None) -> DataFrame:
    """Two-way flow records per client and 6-tuple (and window)."""
    keys = [*FLOW_KEY] + ([window.alias("start")] if window is not None else [])
    tcp = F.col("app_protocol") == "T"
    seen = lambda condition: F.coalesce(F.bool_or(condition), F.lit(False))
    opening = tcp & flag(F.col("tcp_flags"), SYN) & ~flag(F.col("tcp_flags"), ACK)
    closing = tcp & flag(F.col("tcp_flags"), FIN)
    sums = []
    for side in ("in", "out"):
        here = F.col("direction") == side
        sums += [
            F.count_if(here).alias(f"count_{side}"),
            F.sum(F.when(here, F.col("length")).otherwise(0)).alias(f"size_{side}"),
            F.min(F.when(here, F.col("ts"))).alias(f"start_{side}"),
            F.max(F.when(here, F.col("ts"))).alias(f"stop_{side}"),
            seen(here & opening).alias(f"seen_start_{side}"),
            seen(here & closing).alias(f"seen_end_{side}"),
        ]
    sums.append(seen(tcp & flag(F.col("tcp_flags"), RST)).alias("seen_rst"))
    flows = packets.where(p_trackable()).groupBy(*keys).agg(*sums)
    return min_packets_filter(flows, min_packets)


def min_packets_filter(flows: DataFrame, n: int) -> DataFrame:
    """Flows with at least `n` packets in both directions together."""
    return flows.where(F.col("count_in") + F.col("count_out") >= n)


def window_sums(packets: DataFrame, lengths=WINDOW_LENGTHS) -> DataFrame:
    """Bytes in and out per client and window of every length, epoch-aligned.

    Packets are summed once in bins of the greatest common length; the longer
    windows add up those bins. Anything that is not inbound counts as outbound.
    """
    base = gcd(*lengths)
    inbound = F.col("direction") == "in"
    bins = packets.groupBy("client", bin_start("ts", base).alias("bin")).agg(
        F.sum(F.when(inbound, F.col("length")).otherwise(0)).alias("in_bytes"),
        F.sum(F.when(inbound, 0).otherwise(F.col("length"))).alias("out_bytes"),
    )
    us = micros("bin")
    length = F.col("win_len")
    return (
        bins.withColumn("win_len", F.explode(F.array(*[F.lit(n).cast("long") for n in lengths])))
        .groupBy("client", "win_len", from_micros(us - F.pmod(us, length)).alias("start"))
        .agg(F.sum("in_bytes").alias("in_bytes"), F.sum("out_bytes").alias("out_bytes"))
    )


def peak_bandwidth(packets: DataFrame, interval_us: int, lengths=WINDOW_LENGTHS) -> DataFrame:
    """Most bytes in one window of each length, per client and reporting interval."""
    return (
        window_sums(packets, lengths)
        .groupBy(bin_start("start", interval_us).alias("timestamp"), "client", "win_len")
        .agg(F.max("in_bytes").alias("in_max"), F.max("out_bytes").alias("out_max"))
    )


def speed_histogram(packets: DataFrame, window_us: int = SPEED_WINDOW, unit: str = "hour") -> DataFrame:
    """Seconds and bytes per speed bucket, client and hour.

    Rows are (timestamp, client, pos, in_time, in_bytes, out_time, out_bytes).
    Windows without traffic between a client's first and last one count as the
    lowest speed; speeds above the last edge are left out.
    """
    seconds = window_us // 1_000_000
    sums = window_sums(packets, (window_us,)).withColumn("timestamp", trunc_to(unit, "start"))
    sides = F.inline(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(f"{side}_bytes").alias("bytes")) for side in ("in", "out")
    ]))
    cells = (
        sums.select("timestamp", "client", "start", sides)
        .withColumn("pos", speed_bucket(F.expr(f"bytes div {seconds}")))
        .groupBy("timestamp", "client", "pos", "side")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("start").alias("first"), F.max("start").alias("last"))
    )
    # One row per client and unit with traffic; its list is bounded by the speed buckets.
    cell = F.struct("pos", "side", (F.col("n") * seconds).alias("time"), "bytes")
    units = cells.groupBy("timestamp", "client").agg(
        F.collect_list(F.when(F.col("pos").isNotNull(), cell)).alias("cells"),
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.sum(F.when(F.col("side") == "in", F.col("n")).otherwise(0)).alias("present"),
    )
    order, step = Window.partitionBy("client").orderBy("timestamp"), F.expr(f"INTERVAL 1 {unit}")
    units = units.withColumns({"before": F.lag("timestamp").over(order), "after": F.lead("timestamp").over(order)})
    # A unit stands for itself and the silent ones up to the next.
    alone = F.col("after").isNull() | F.col("timestamp").isNull()
    silent = F.sequence(F.col("timestamp"), F.col("after") - step, step)
    units = units.withColumn("at", F.explode(F.when(alone, F.array("timestamp")).otherwise(silent)))
    own = F.col("at").eqNullSafe(F.col("timestamp"))
    begin = F.when(own & F.col("before").isNull(), micros("first")).otherwise(micros("at"))
    end = F.when(own & F.col("after").isNull(), micros("last")).otherwise(micros(F.col("at") + step) - window_us)
    units = units.withColumns({"begin": begin, "end": end, "own": own})
    missing = F.expr(f"((end - begin) div {window_us} + 1 - IF(own, present, 0)) * {seconds}")
    none = F.slice("cells", 1, 0)
    lowest = F.array(*[
        F.struct(F.lit(0).cast("int").alias("pos"), F.lit(side).alias("side"), F.col("missing").alias("time"), F.lit(0).cast("long").alias("bytes"))
        for side in ("in", "out")
    ])
    filled = units.withColumn("missing", missing).select(
        F.col("at").alias("timestamp"), "client",
        F.inline(F.concat(F.when(F.col("own"), F.col("cells")).otherwise(none), F.when(F.col("missing") > 0, lowest).otherwise(none))),
    )
    amount = lambda side, c: F.sum(F.when(F.col("side") == side, F.col(c)).otherwise(0))
    return filled.groupBy("timestamp", "client", "pos").agg(
        amount("in", "time").alias("in_time"), amount("in", "bytes").alias("in_bytes"),
        amount("out", "time").alias("out_time"), amount("out", "bytes").alias("out_bytes"),
    )


CONNECTION = ["client", "address", "local_port", "remote_port"]
ATTEMPT_TIMEOUT = 30_000_000  # Fixed value: microseconds until an attempt is decided.


def connection_events(packets: DataFrame) -> DataFrame:
    """Opening, accepting and refusing packets of TCP connections."""
    tcp = (F.col("app_protocol") == "T") & (F.col("layer") == "I")
    flags = F.col("tcp_flags")
    inbound, outbound = F.col("direction") == "in", F.col("direction") == "out"
    kind = (
        F.when(tcp & outbound & flag(flags, SYN) & ~flag(flags, ACK), "syn")
        .when(tcp & inbound & flag(flags, SYN) & flag(flags, ACK), "ack")
        .when(tcp & inbound & flag(flags, RST), "nak")
    )
    return packets.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "client", F.col("addr_remote").alias("address"), F.col("port_local").alias("local_port"),
        F.col("port_remote").alias("remote_port"), "ts", "kind",
        F.when(F.col("kind") == "nak", "P").alias("reason"),
    )


def classify_refused(events: DataFrame, timeout_us: int = ATTEMPT_TIMEOUT) -> DataFrame:
    """Connection attempts that were opened and not accepted, with the reason.

    `events` has the connection, ts, kind (syn, ack, nak) and reason of a nak.
    An attempt spans the time-out from its first event. It is decided when both
    an opening and an answer are there; what follows is ignored. A refusal after
    the time-out has the reason 'T'.
    """
    attempts = greedy_windows(events, CONNECTION, "ts", timeout_us, "timestamp")
    # One struct is the key: its equality takes NULL for a value like any other.
    attempts = attempts.select(F.struct(*CONNECTION, "timestamp").alias("_a"), "ts", "kind", "reason")
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("ts")))
    decided = attempts.groupBy("_a").agg(
        first("syn").alias("syn"), first("ack").alias("ack"), first("nak").alias("nak"),
        F.min_by("reason", F.when(F.col("kind") == "nak", F.col("ts"))).alias("first_reason"),
    ).where(F.col("syn").isNotNull())
    refused = decided.where(
        F.col("ack").isNull() | (F.col("nak").isNotNull() & (F.col("ack") > F.greatest("syn", "nak")))
    )
    # Refusals that came before the opening: the last of them names the reason.
    early = (
        attempts.where(F.col("kind") == "nak").drop("kind")
        .join(refused.where(F.col("nak") <= F.col("syn")).select("_a", "syn"), "_a")
        .where(F.col("ts") <= F.col("syn"))
        .groupBy("_a")
        .agg(F.max_by("reason", "ts").alias("early_reason"))
    )
    reason = F.coalesce("early_reason", "first_reason", F.lit("T"))
    return refused.join(early, "_a", "left").select("_a.*", reason.alias("reason"))


ODD_WINDOW = 15 * 60 * 1_000_000  # Fixed value: microseconds between warnings.
ODD_PACKETS = 10  # Fixed value: odd packets that raise a warning.


def capture_warnings(packets: DataFrame, window_us: int = ODD_WINDOW, count: int = ODD_PACKETS) -> DataFrame:
    """The packet that makes a capture suspicious, once per kind and window.

    Windows start at the first odd packet. `packets` has client, id, ts,
    layer, direction and app_protocol.
    """
    kinds = F.array_compact(F.array(
        F.when(F.col("layer") == "?", "layer"),
        F.when(~F.col("direction").isin("in", "out"), "direction"),
        F.when(F.col("app_protocol") == "P", "pppoe"),
    ))
    odd = packets.select("client", "id", "ts", F.explode(kinds).alias("kind"))
    windows = greedy_windows(odd, ["client", "kind"], "ts", window_us)
    numbered = ranked(windows, ["client", "kind", "start"], ["ts", "id"], bin_start("ts", 60_000_000), "n")
    return numbered.where(F.col("n") == count).select("client", "kind", "start", "ts")
