"""Local network traffic summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.net import drop_subnets, p_unicast_mac
from netloom.functions.times import trunc_to
from netloom.operators.ordering import first_k

KEY = ["proto", "src", "dst", "port"]
COUNTERS = ["d_count", "d_size", "d_dsize", "u_count", "u_size", "u_dsize"]
OTHER = {"proto": "both", "dst": "other", "port": "all"}  # Fixed values: the remainder row.
SOURCE_LIMIT = 6000  # Fixed value: items kept per source.
KEEP_FILES = {"minute": 96, "hour": 60, "month": 12}  # Fixed values: history kept per level.


def lan_summary(packets: DataFrame, subnets: DataFrame | None = None, window=None) -> DataFrame:
    """Traffic per (proto, source MAC, remote address, remote port) and direction.

    `packets` has direction, proto (T/U), mac_local, mac_remote, addr_remote,
    port_remote, length and hdr_length; `window` adds a time column to the key.
    """
    wanted = packets.where(
        F.col("direction").isin("in", "out")
        & F.col("proto").isin("T", "U")
        & p_unicast_mac("mac_local")
        & p_unicast_mac("mac_remote")
    )
    if subnets is not None:
        wanted = drop_subnets(wanted, "addr_remote", subnets)
    payload = F.col("length") - F.col("hdr_length")
    sums = []
    for letter, side in (("d", "in"), ("u", "out")):
        here = F.col("direction") == side
        sums += [
            F.count_if(here).alias(f"{letter}_count"),
            F.coalesce(F.sum(F.when(here, F.col("length"))), F.lit(0)).alias(f"{letter}_size"),
            F.coalesce(F.sum(F.when(here, payload)), F.lit(0)).alias(f"{letter}_dsize"),
        ]
    keys = [
        F.when(F.col("proto") == "T", "TCP").otherwise("UDP").alias("proto"),
        F.col("mac_local").alias("src"),
        F.col("addr_remote").alias("dst"),
        F.col("port_remote").cast("string").alias("port"),
    ]
    return wanted.groupBy(*([window] if window is not None else []), *keys).agg(*sums)


def lan_merge(*summaries: DataFrame) -> DataFrame:
    """Sum of summaries by key, with the set of resolved names (never 'none')."""
    union = summaries[0]
    for more in summaries[1:]:
        union = union.unionByName(more)
    name = F.nullif(F.col("resolved"), F.lit("none"))
    return union.groupBy(*KEY).agg(
        *[F.sum(c).alias(c) for c in COUNTERS],
        F.array_sort(F.collect_set(name)).alias("names"),
    )


def lan_rollup(df: DataFrame, level: str, time: str = "time", counters=COUNTERS) -> DataFrame:
    """Sums per calendar unit and key."""
    return df.groupBy(trunc_to(level, time).alias(time), *KEY).agg(*[F.sum(c).alias(c) for c in counters])


def keep_last(df: DataFrame, n: int, time: str = "time") -> DataFrame:
    """Rows of the last `n` time steps present.

    The steps are a handful of calendar units; the cut-off is found among the
    distinct steps and joined back as one row.
    """
    steps = df.select(time).distinct().orderBy(F.desc(time)).limit(n)
    cutoff = steps.agg(F.min(time).alias("_cutoff"))
    return df.crossJoin(F.broadcast(cutoff)).where(F.col(time) >= F.col("_cutoff")).drop("_cutoff")  # one row


def topk_with_other(df: DataFrame, k: int = SOURCE_LIMIT, keys=("src",), counters=COUNTERS) -> DataFrame:
    """The `k` busiest items per source by upload count; the rest in one row.

    Ties are broken by the item's key. An existing remainder row takes no rank.
    """
    is_other = F.lit(True)
    for c, v in OTHER.items():
        is_other = is_other & F.col(c).eqNullSafe(v)
    top = first_k(df.where(~is_other), list(keys), [F.desc("u_count"), "proto", "dst", "port"], k)
    # The remainder is everything less the top: no row of the tail is ranked for it.
    all_rows = df.select(*keys, *[F.lit(v).alias(c) for c, v in OTHER.items()], F.lit(1).alias("_rows"), *counters)
    moved = top.withColumn("_rows", F.explode(F.array(F.lit(1), F.lit(-1)))).select(
        *keys,
        *[F.when(F.col("_rows") > 0, F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in OTHER.items()],
        "_rows", *[(F.col(c) * F.col("_rows")).alias(c) for c in counters],
    )
    whole = all_rows.unionByName(moved).groupBy(*keys, *OTHER)
    sums = whole.agg(F.sum("_rows").alias("_rows"), *[F.sum(c).alias(c) for c in counters])
    return sums.where("_rows > 0").drop("_rows")


def lan_report(df: DataFrame) -> DataFrame:
    """Items of each source, busiest first."""
    return df.orderBy("src", F.desc("u_count"), "proto", "dst", "port")
