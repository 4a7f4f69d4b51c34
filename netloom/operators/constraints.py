"""Constraint violations as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Row rules by table, as SQL conditions that must hold; NULL passes.
CHECKS = {
    "pings": {
        "received_not_negative": "received >= 0",
        "min_to_avg": "min <= avg",
        "avg_to_max": "avg <= max",
        "replies_have_times": "(received = 0) = (avg IS NULL)",
    },
    "biflows": {
        "proto": "proto IN ('T', 'U')",
        "port_local": "port_local BETWEEN 0 AND 65535",
        "port_remote": "port_remote BETWEEN 0 AND 65535",
        "in_order": "start_in <= stop_in",
        "out_order": "start_out <= stop_out",
    },
    "refused": {"remote_port": "remote_port BETWEEN 0 AND 65535"},
    "ssh_sessions": {"order": "start_time <= end_time", "remote_port": "remote_port BETWEEN 0 AND 65535"},
    "count_stats": {"count_spread": "count_min <= count_avg AND count_avg <= count_max", "size_spread": "size_min <= size_avg AND size_avg <= size_max"},
    "refused_addrs": {"clients": "client_count <= conn_count", "span": "since < until"},
    "fake_attackers": {"not_negative": "logins >= 0 AND connects >= 0"},
}

# Columns that must be unique together, by table.
UNIQUE = {
    "group_members": ["client", "in_group"],
    "address_log": ["store", "epoch", "version", "address"],
    "scores": ["server", "event"],
}

# References as (column, table, column), by table.
REFERENCES = {
    "group_members": [("client", "clients", "id")],
    "activities": [("client", "clients", "id")],
    "refused": [("client", "clients", "id")],
    "biflows": [("client", "clients", "id")],
    "pings": [("client", "clients", "id")],
    "ssh_commands": [("session_id", "ssh_sessions", "id")],
}


def check_constraints(df: DataFrame, table: str, key=("id",), parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """Violations of a table's rules as (rule, key); an empty result is a sound table.

    All row rules run in one pass. `parents` gives the tables references point to.
    """
    key_text = lambda columns: F.concat_ws("/", *[F.col(c).cast("string") for c in columns])
    found = []
    rules = {n: r for n, r in CHECKS.get(table, {}).items()}
    if rules:
        broken = F.array_compact(F.array(*[F.when(~F.expr(rule), F.lit(name)) for name, rule in rules.items()]))
        found.append(df.select(F.explode(broken).alias("rule"), key_text(key).alias("key")))
    if table in UNIQUE:
        columns = UNIQUE[table]
        repeated = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        found.append(repeated.select(F.lit("unique").alias("rule"), key_text(columns).alias("key")))
    for column, parent, parent_column in REFERENCES.get(table, []):
        if parents and parent in parents:
            known = parents[parent].select(F.col(parent_column).alias(column)).distinct()
            lost = df.where(F.col(column).isNotNull()).join(known, column, "left_anti")
            found.append(lost.select(F.lit(f"{column} in {parent}").alias("rule"), key_text(key).alias("key")))
    if not found:
        raise ValueError(f"no rules are declared for {table}")
    return reduce(DataFrame.unionByName, found)
