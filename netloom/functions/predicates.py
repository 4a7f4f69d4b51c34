"""Packet and record predicates to combine into filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.net import in_cidr


def p_true() -> Column:
    return F.lit(True)


def p_false() -> Column:
    return F.lit(False)


def p_not(p: Column) -> Column:
    return ~p


def p_and(*ps: Column) -> Column:
    """All of the predicates; true for none."""
    return reduce(lambda a, b: a & b, ps, F.lit(True))


def p_or(*ps: Column) -> Column:
    """Any of the predicates; false for none."""
    return reduce(lambda a, b: a | b, ps, F.lit(False))


def p_ip(side: str, addresses) -> Column:
    """The local or remote address is one of a few."""
    return F.col(f"addr_{side}").isin(*addresses)


def p_port(side: str, ports) -> Column:
    """The local or remote port is one of a few."""
    return F.col(f"port_{side}").isin(*ports)


def p_cidr(side: str, network: str, prefix: int) -> Column:
    """The local or remote address lies in a range of its family."""
    return in_cidr(f"addr_{side}", network, prefix)


def p_addr_set(df: DataFrame, side: str, entries: DataFrame, flag: str = "in_set") -> DataFrame:
    """Flag rows whose address, or address and port, is an entry of a named set.

    `entries` has address and port (NULL for any port). The set may be large:
    two equality joins, whose strategy the planner picks by size.
    """
    address, port = f"addr_{side}", f"port_{side}"
    anywhere = entries.where(F.col("port").isNull()).select(
        F.col("address").alias(address), F.lit(True).alias("_any")
    ).distinct()
    exact = entries.where(F.col("port").isNotNull()).select(
        F.col("address").alias(address), F.col("port").alias(port), F.lit(True).alias("_exact")
    ).distinct()
    return (
        df.join(anywhere, address, "left")
        .join(exact, [address, port], "left")
        .withColumn(flag, F.coalesce("_any", "_exact", F.lit(False)))
        .drop("_any", "_exact")
    )


def p_trackable() -> Column:
    """IP packets of a known direction that carry TCP or UDP."""
    return (
        F.col("direction").isin("in", "out")
        & (F.col("layer") == "I")
        & F.col("ip_protocol").isin(4, 6)
        & F.col("app_protocol").isin("T", "U")
    )


def p_login() -> Column:
    """Honeypot events that are kept on ingest."""
    return F.col("event") == "login"


def p_current_snapshot(stamp: Column, last: Column) -> Column:
    """Answers that do not belong to an earlier snapshot."""
    return stamp >= last


def redact_credentials(df: DataFrame, keep: bool) -> DataFrame:
    """Without names and passwords, unless they are to be kept."""
    if keep:
        return df
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in ("name", "password")})


def drop_oversized(df: DataFrame, message, limit: int) -> DataFrame:
    """Rows of messages with at most `limit` records.

    Sizes come from an aggregate and return by a join, so one huge message is
    counted map-side instead of being gathered in one window.
    """
    sizes = df.groupBy(*message).agg(F.count(F.lit(1)).alias("_records"))
    return df.join(sizes.where(F.col("_records") <= limit).select(*message), message, "left_semi")


def flag_forbidden(df: DataFrame, own: DataFrame, column: str = "remote") -> DataFrame:
    """Why a remote must not be reported: an own router, a private address, or NULL."""
    from netloom.functions.net import p_private_text

    mine = own.select(F.col("address").alias(column), F.lit(True).alias("_own")).distinct()
    why = F.when(F.col("_own"), "own").when(p_private_text(column), "private")
    return df.join(mine, column, "left").withColumn("why", why).drop("_own")
