"""Per-group archive statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.scalars import saturate
from netloom.functions.times import hour_of
from netloom.operators.ordering import counter_delta

BUCKETS = 40  # Fixed value: speed buckets per histogram.
SPEED_ARRAYS = ("in_time", "in_bytes", "out_time", "out_bytes")


def interesting_group(name: Column) -> Column:
    """Neither a random sampling group nor the group of all clients."""
    return ~name.like("rand-%") & (name != "all")


def by_group(df: DataFrame, members: DataFrame) -> DataFrame:
    """One row per fact and group of its client.

    No broadcast hint: memberships grow with the clients, so the planner picks
    the join from their measured size.
    """
    return df.join(members.select("client", "in_group"), "client")


def archive_with_groups(facts: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of known clients, and the bridge from facts to interesting groups."""
    kept = facts.join(members.select("client"), "client", "left_semi")
    groups = members.where(interesting_group(F.col("name"))).select("client", "in_group")
    bridge = facts.select("id", "client").join(groups, "client").select("id", "in_group")
    return kept, bridge


def counts_by_group(counts: DataFrame, members: DataFrame) -> DataFrame:
    """Spread of counts and sizes over the clients of a group."""
    stats = []
    for name in ("count", "size"):
        value = F.col(name)
        stats += [
            F.sum(value).alias(f"{name}_sum"),
            F.avg(value).alias(f"{name}_avg"),
            F.stddev_samp(value).alias(f"{name}_dev"),
            F.min(value).alias(f"{name}_min"),
            F.max(value).alias(f"{name}_max"),
        ]
    return (
        by_group(counts, members)
        .groupBy("timestamp", "in_group", "type")
        .agg(F.count(F.lit(1)).alias("client_count"), *stats)
    )


def activity_daily(activities: DataFrame) -> DataFrame:
    return activities.groupBy(F.to_date("timestamp").alias("date"), "activity", "client").agg(
        F.count(F.lit(1)).alias("count")
    )


def ping_stats(pings: DataFrame, members: DataFrame) -> DataFrame:
    """Replies and the reply-weighted mean per (batch, request, group)."""
    replies = F.sum("received")
    weighted = F.sum(F.col("avg") * F.col("received"))
    return (
        by_group(pings, members)
        .groupBy("batch", "request", "in_group")
        .agg(
            replies.alias("received"),
            F.count(F.lit(1)).alias("asked"),
            F.count("ip").alias("resolved"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            weighted.alias("weighted"),
        )
        .withColumn("avg", F.expr("weighted div nullif(received, 0)"))
        .drop("weighted")
    )


def ping_ip_hist(pings: DataFrame, members: DataFrame) -> DataFrame:
    """Clients per resolved address; an unresolved name keeps its NULL row.

    Duplicates go before the group expansion, so the join and the second
    shuffle carry one row per client and address, and the count is plain.
    """
    seen = pings.select("request", "batch", "client", "ip").distinct()
    return (
        by_group(seen, members)
        .groupBy("request", "batch", "in_group", "ip")
        .agg(F.count(F.lit(1)).alias("clients"))
    )


def cert_hist(certs: DataFrame, members: DataFrame) -> DataFrame:
    """Answers per host certificate."""
    hosts = certs.where(F.col("ord") == 0)
    per_client = hosts.groupBy("batch", "request", "client", "value").agg(F.count(F.lit(1)).alias("n"))
    return (
        by_group(per_client, members)
        .groupBy("batch", "request", "in_group", "value")
        .agg(F.sum("n").alias("count"))
    )


def bandwidth_by_group(bandwidth: DataFrame, members: DataFrame) -> DataFrame:
    """Peak bytes per second of the clients of a group, per window length."""
    per_second = lambda c: F.col(c) * F.lit(1e6) / F.col("win_len")
    stats = []
    for side in ("in", "out"):
        value = per_second(f"{side}_max")
        stats += [
            F.min(value).alias(f"{side}_min"),
            F.max(value).alias(f"{side}_max"),
            F.avg(value).alias(f"{side}_avg"),
            F.stddev_pop(value).alias(f"{side}_dev"),
        ]
    return by_group(bandwidth, members).groupBy("timestamp", "in_group", "win_len").agg(*stats)


def array_total(c: str) -> Column:
    """Sum of an array of longs."""
    return F.aggregate(F.col(c), F.lit(0).cast("long"), lambda a, x: a + x)


def bandwidth_avg(stats: DataFrame) -> DataFrame:
    """Mean bytes per second of each (hour, client) that saw time in both directions."""
    totals = stats.select("timestamp", "client", *[array_total(c).alias(c) for c in SPEED_ARRAYS])
    return totals.where((F.col("in_time") > 0) & (F.col("out_time") > 0)).select(
        "timestamp", "client",
        F.expr("in_bytes div in_time").alias("bps_in"),
        F.expr("out_bytes div out_time").alias("bps_out"),
    )


def _cell_sums(cells: DataFrame, keys, columns, size: int) -> DataFrame:
    """Arrays of `size` sums per key, from rows with `_pos` and `_rows`, and the sum of `_rows` as `clients`.

    Sums are held per (key, position), so a key takes the room of its cells, not of
    all places of all arrays; at most `size` + 1 of them meet to become its arrays.
    A row without `_pos` adds to no cell. A cell is zero where a row of the key
    gives it nothing, and NULL when all rows give it NULL.
    """
    sums = [F.sum(c).alias(c) for c in columns]
    summed = cells.groupBy(*keys, "_pos").agg(F.sum("_rows").alias("_rows"), F.count(F.lit(1)).alias("_n"), *sums)
    cell = F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_n", *columns))
    listed = summed.groupBy(*keys).agg(
        F.sum("_rows").alias("clients"), F.array_sort(F.collect_list(cell)).alias("_cells")
    )
    arrays = []
    for c in columns:
        zero = f"CAST(0 AS {summed.schema[c].dataType.simpleString()})"
        gap = f"array_repeat({zero}, x._pos - coalesce(get(_cells, i - 1)._pos, -1) - 1)"
        value = f"array(if(x._n < clients, coalesce(x.{c}, {zero}), x.{c}))"
        rest = f"array_repeat({zero}, {size - 1} - coalesce(get(_cells, size(_cells) - 1)._pos, -1))"
        arrays.append(f"flatten(array_append(transform(_cells, (x, i) -> concat({gap}, {value})), {rest})) AS {c}")
    return listed.selectExpr(*keys, "clients", *arrays)


def array_sum(df: DataFrame, keys, columns, size: int = BUCKETS) -> DataFrame:
    """Element-wise sum of fixed-size arrays; cells of zeros alone are not moved."""
    places = df.select(*keys, *columns, F.explode(F.sequence(F.lit(-1), F.lit(size - 1))).alias("_place"))
    zeros = " AND ".join(f"get({c}, _place) <=> 0" for c in columns)
    # Place -1 counts the row itself.
    cells = places.where(f"_place < 0 OR NOT ({zeros})").selectExpr(
        *keys, "nullif(_place, -1) AS _pos", "if(_place < 0, 1, 0) AS _rows",
        *[f"if(_place < 0, NULL, get({c}, _place)) AS {c}" for c in columns],
    )
    return _cell_sums(cells, keys, columns, size)


def bandwidth_sums(stats: DataFrame, members: DataFrame) -> DataFrame:
    """Histogram of a group: element-wise sums over its clients."""
    return array_sum(by_group(stats, members), ["timestamp", "in_group"], SPEED_ARRAYS)


def dense_arrays(df: DataFrame, keys, pos: str, columns, size: int = BUCKETS) -> DataFrame:
    """Fixed-size arrays from (key, position, value) rows; missing positions are zero."""
    place = f"try_cast({pos} AS INT)"
    cells = df.selectExpr(
        *keys, f"CASE WHEN {pos} = {place} AND {place} BETWEEN 0 AND {size - 1} THEN {place} END AS _pos", "1 AS _rows", *columns
    )
    return _cell_sums(cells, keys, columns, size).drop("clients")


def refused_by_addr(refused: DataFrame) -> DataFrame:
    """Refused connections and distinct clients per (address, port, reason, hour)."""
    keys = ["address", "remote_port", "reason", "since"]
    per_client = (
        refused.withColumn("since", hour_of("timestamp"))
        .groupBy(*keys, "client")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_client.groupBy(*keys).agg(
        F.sum("n").alias("conn_count"), F.count(F.lit(1)).alias("client_count")
    ).withColumn("until", F.col("since") + F.expr("INTERVAL 1 HOUR"))


def refused_by_client(refused: DataFrame) -> DataFrame:
    """Refused connections per (client, reason, hour)."""
    return (
        refused.groupBy("client", "reason", hour_of("timestamp").alias("since"))
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("until", F.col("since") + F.expr("INTERVAL 1 HOUR"))
    )


def spoof_counts(spoof: DataFrame, members: DataFrame) -> DataFrame:
    """Clients reached by the plain probe, and by the spoofed one with its address intact."""
    return (
        by_group(spoof, members)
        .groupBy("batch", "in_group")
        .agg(
            F.count_if(~F.col("spoofed")).alias("reachable"),
            F.count_if(F.col("spoofed") & F.col("addr_matches")).alias("spoofable"),
        )
    )


def nat_counts(observations: DataFrame, members: DataFrame) -> DataFrame:
    """Direct and translated clients per family ('D' direct, 'N' translated, '0' none)."""
    seen = lambda c, v: F.count_if(F.col(c) == v)
    return (
        by_group(observations, members)
        .groupBy("in_group", "batch")
        .agg(
            seen("v4", "D").alias("v4_direct"),
            seen("v4", "N").alias("v4_nat"),
            seen("v6", "D").alias("v6_direct"),
            seen("v6", "N").alias("v6_nat"),
            F.count(F.lit(1)).alias("total"),
        )
    )


def firewall_hits(log: DataFrame, addresses: DataFrame | None, min_routers: int, min_packets: int) -> DataFrame:
    """Addresses blocked inbound on more than `min_routers` routers and `min_packets` packets."""
    hits = log.where(F.col("direction") == "I")
    if addresses is not None:
        hits = hits.join(
            addresses.select(F.col("address").alias("remote_address")), "remote_address", "left_semi"
        )
    per_router = hits.groupBy("remote_address", "router_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_router.groupBy("remote_address")
        .agg(F.count(F.lit(1)).alias("routers"), F.sum("n").alias("packets"))
        .where((F.col("routers") > min_routers) & (F.col("packets") > min_packets))
    )


CAPTURE_COUNTERS = ("captured", "dropped", "dropped_driver")


def capture_stats(counters: DataFrame) -> DataFrame:
    """Packets captured and dropped since the last snapshot, per client and interface.

    `counters` are cumulative per (client, iface, snapshot) and direction.
    """
    both = counters.groupBy("client", "iface", "snapshot").agg(
        *[F.sum(c).alias(c) for c in CAPTURE_COUNTERS]
    )
    deltas = counter_delta(both, ["client", "iface"], ["snapshot"], F.trunc("snapshot", "month"), CAPTURE_COUNTERS)
    return deltas.withColumns({c: saturate(c, 31) for c in CAPTURE_COUNTERS})
