"""Lookups, tagging and table synchronisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.times import now_literal


def resolve_ids(df: DataFrame, dim: DataFrame, key: str, name: str = "name", id_column: str = "id") -> DataFrame:
    """Replace a name column by the id of its dimension row; unknown names go."""
    ids = dim.select(F.col(name).alias(key), F.col(id_column).alias(f"{key}_id"))
    return df.join(ids, key).drop(key)


def cross_lookup(clients: DataFrame, types: DataFrame, client: str, kind: str) -> DataFrame:
    """The pair of ids of one client name and one type name, no row if either is unknown.

    A repeated name stands for its smallest id, so each side is one row.
    """
    one = clients.where(F.col("name") == client).agg(F.min("id").alias("client"))
    two = types.where(F.col("name") == kind).agg(F.min("id").alias("type"))
    return one.crossJoin(F.broadcast(two)).dropna()  # one row with one row


def exclude(df: DataFrame, omit: DataFrame, column: str, omit_column: str = "address") -> DataFrame:
    """Rows whose `column` is not listed."""
    listed = omit.select(F.col(omit_column).alias(column)).distinct()
    return df.join(listed, column, "left_anti")


def tag_rules(rules: DataFrame, blacklist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags per (ip, port) and per ip.

    `rules` has line (its order), tag, ip, port. For an ip, a blacklist entry
    wins, then the last port-less rule, then the first rule with a port.
    """
    by_port = (
        rules.where(F.col("port").isNotNull())
        .groupBy("ip", "port")
        .agg(F.max_by("tag", "line").alias("port_tag"))
    )
    plain = F.col("port").isNull()
    from_rules = rules.groupBy("ip").agg(
        F.coalesce(
            F.max_by("tag", F.when(plain, F.col("line"))),
            F.min_by("tag", F.when(~plain, F.col("line"))),
        ).alias("rule_tag")
    )
    from_list = blacklist.groupBy(F.col("remote").alias("ip")).agg(
        F.concat(F.lit("fake-"), F.max("server")).alias("list_tag")
    )
    by_ip = from_rules.join(from_list, "ip", "full").select(
        "ip", F.coalesce("list_tag", "rule_tag").alias("ip_tag")
    )
    return by_port, by_ip


def tag_flows(flows: DataFrame, rules: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Flows with the tag of their remote end; '?' when nothing matches.

    The distinct remote ends are tagged, in two joins, and the flows take the
    tag in one more, so a remote with most of the flows costs one tagged row.
    Adaptive execution splits a skewed key of that last join.
    """
    by_port, by_ip = tag_rules(rules, blacklist)
    ends = flows.select(F.col("ip_remote").alias("ip"), F.col("port_remote").alias("port")).distinct()
    tagged = (
        ends.join(by_port, ["ip", "port"], "left")
        .join(by_ip, "ip", "left")
        .select(
            F.col("ip").alias("ip_remote"), F.col("port").alias("port_remote"),
            F.coalesce("port_tag", "ip_tag").alias("tag"),
        )
        .where(F.col("tag").isNotNull())
    )
    return flows.join(tagged, ["ip_remote", "port_remote"], "left").withColumn(
        "tag", F.coalesce("tag", F.lit("?"))
    )


SESSION_KEY = ["start_time", "login", "password"]


def ssh_archive(sessions: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Archived sessions and their commands.

    Sessions with equal start, login and password are one; the lowest id names
    it, the latest end closes it, and every session with commands counts.
    """
    used = sessions.join(commands.select(F.col("session_id").alias("id")), "id", "left_semi")
    merged = used.groupBy(*SESSION_KEY).agg(
        F.min("id").alias("session"),
        F.max("end_time").alias("end_time"),
        F.min_by("remote", "id").alias("remote"),
        F.min_by("remote_port", "id").alias("remote_port"),
    )
    ids = used.select("id", *SESSION_KEY).join(merged.select("session", *SESSION_KEY), SESSION_KEY)
    archived = commands.join(ids.select(F.col("id").alias("session_id"), "session"), "session_id").drop("session_id")
    return merged, archived


def insert_new(target: DataFrame, rows: DataFrame, keys) -> DataFrame:
    """Rows whose key is not in the target yet."""
    return rows.join(target.select(*keys), keys, "left_anti")


def sync_config(source: DataFrame, target: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows to add to the target, and keys whose content differs."""
    rest = [c for c in source.columns if c != key]
    missing = insert_new(target, source, [key])
    other = target.select(key, *[F.col(c).alias(f"_{c}") for c in rest])
    differs = reduce(
        lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in rest], F.lit(False)
    )
    mismatched = source.join(other, key).where(differs).select(key)
    return missing, mismatched


def enrich_cached(df: DataFrame, cache: DataFrame, key: str, ttl: str, now, name: str = "name") -> DataFrame:
    """Add the cached name of a key; expired entries and 'none' give NULL."""
    valid = cache.where(F.col("timestamp") >= now_literal(now) - F.expr(f"INTERVAL {ttl}"))
    names = valid.groupBy(key).agg(F.max_by(F.col("value"), F.col("timestamp")).alias(name))
    return df.join(names, key, "left").withColumn(name, F.nullif(F.col(name), F.lit("none")))
