"""Honeypot scoring: event scores, the blacklist and its bad connections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.schemas import enum_name, enum_rank

SCORE_KEYS = ("server", "remote", "client")
MIN_CLIENT_SCORE = 100  # Fixed value: a client's score counts from here on.


def fake_scores(logs: DataFrame, scores: DataFrame) -> DataFrame:
    """Score per (server, remote, client).

    Events are counted before they meet the weights, so the shuffle carries one
    row per (key, event) and map task, whatever one remote sends.
    """
    counted = logs.groupBy(*SCORE_KEYS, "event").agg(F.count(F.lit(1)).alias("events"))
    return (
        counted.join(scores, ["server", "event"])
        .groupBy(*SCORE_KEYS)
        .agg(F.sum(F.col("events") * F.col("score")).cast("long").alias("score"))
    )


def ssh_scores(sessions: DataFrame, commands: DataFrame) -> DataFrame:
    """25 per session with commands and 5 per command, per (remote, client).

    Commands are counted per session first: the join then sees one row per
    session and the distinct count of sessions is a plain count.
    """
    per_session = commands.groupBy("session_id").agg(F.count(F.lit(1)).alias("commands"))
    return (
        sessions.select("id", "remote", "client")
        .join(per_session, F.col("id") == F.col("session_id"))
        .groupBy("remote", "client")
        .agg((F.count(F.lit(1)) * 25 + F.sum("commands") * 5).alias("score"))
        .select(F.lit("ssh_honey").alias("server"), "remote", "client", "score")
    )


def concat_scores(parts: list[DataFrame], distinct: bool = True) -> DataFrame:
    """Union of score sources; equal rows collapse when `distinct`."""
    columns = [*SCORE_KEYS, "score"]
    union = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
    return union.distinct() if distinct else union


def blacklist_remotes(scores: DataFrame, minimum: int = MIN_CLIENT_SCORE) -> DataFrame:
    """Score and client count per (server, remote) over clients that reach `minimum`."""
    per_client = (
        scores.groupBy(*SCORE_KEYS).agg(F.sum("score").alias("score")).where(F.col("score") >= minimum)
    )
    return per_client.groupBy("server", "remote").agg(
        F.sum("score").alias("score"), F.count(F.lit(1)).alias("clients")
    )


def apply_limits(remotes: DataFrame, limits: DataFrame) -> DataFrame:
    """Every limit a remote reaches (score and client thresholds of its server)."""
    bounds = limits.select(
        "server",
        F.col("clients").alias("min_clients"),
        F.col("score").alias("min_score"),
        "mode",
    )
    reached = (F.col("score") >= F.col("min_score")) & (F.col("clients") >= F.col("min_clients"))
    return remotes.join(bounds, "server").where(reached)


def blacklist(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """Remotes over a limit, with the strictest mode reached."""
    return (
        apply_limits(blacklist_remotes(scores), limits)
        .groupBy("server", "remote")
        .agg(
            F.max("clients").alias("clients"),
            F.max("score").alias("score"),
            F.max(enum_rank(F.col("mode"), "blacklist_mode")).alias("rank"),
        )
        .select(
            "server", "remote", "clients", "score",
            enum_name(F.col("rank"), "blacklist_mode").alias("mode"),
        )
    )


def bad_fake_connections(logs: DataFrame, listed: DataFrame, servers: DataFrame) -> DataFrame:
    """Connections of hard-listed remotes per (server, remote, remote_port, local).

    The list selects the events before they are grouped: the groups are almost
    as many as the events, the listed remotes are few.
    """
    hard = listed.where(F.col("mode") == "hard").select("server", "remote", F.col("clients").alias("total"))
    ports = servers.select("server", F.col("port").alias("local_port"))
    return (
        logs.where(F.col("remote_port").isNotNull())
        .join(hard, ["server", "remote"])
        .groupBy("server", "remote", "remote_port", "local")
        .agg(
            F.min("timestamp").alias("start_time_utc"),
            F.max("timestamp").alias("end_time_utc"),
            F.count_if(F.col("event") == "login").alias("login_attempts"),
            F.min("total").alias("clients_total"),
        )
        .join(ports, "server")
        .select(
            "server", "remote", "remote_port", "local", "local_port",
            "start_time_utc", "end_time_utc", "login_attempts", "clients_total",
        )
    )


def bad_ssh_connections(sessions: DataFrame, listed: DataFrame) -> DataFrame:
    """Every session of a remote that is hard-listed for SSH."""
    hard = listed.where((F.col("server") == "ssh_honey") & (F.col("mode") == "hard")).select(
        "remote", F.col("clients").alias("total")
    )
    return sessions.join(hard, "remote").select(
        F.lit("ssh_honey").alias("server"),
        "remote", "remote_port", "local",
        F.lit(22).alias("local_port"),
        F.col("start_time").alias("start_time_utc"),
        F.col("end_time").alias("end_time_utc"),
        F.lit(1).cast("long").alias("login_attempts"),
        F.col("total").alias("clients_total"),
    )


def bad_connections(logs, listed, servers, sessions) -> DataFrame:
    """Distinct union of the honeypot and SSH bad connections."""
    hard = listed.where(F.col("mode") == "hard")
    return (
        bad_fake_connections(logs, hard, servers)
        .unionByName(bad_ssh_connections(sessions, hard))
        .distinct()
    )


def fake_attackers(logs: DataFrame) -> DataFrame:
    """Logins and connects per (date, server, remote)."""
    return logs.groupBy(F.to_date("timestamp").alias("date"), "server", "remote").agg(
        F.count_if(F.col("event") == "login").alias("logins"),
        F.count_if(F.col("event") == "connect").alias("connects"),
    )


def fake_server_activity(logs: DataFrame) -> DataFrame:
    """Logins and connects per (date, server, client)."""
    return logs.groupBy(F.to_date("timestamp").alias("date"), "server", "client").agg(
        F.count_if(F.col("event") == "login").alias("logins"),
        F.count_if(F.col("event") == "connect").alias("connects"),
    )


def ssh_attempts(sessions: DataFrame) -> DataFrame:
    """Sessions per (day, remote)."""
    return sessions.groupBy(F.to_date("start_time").alias("date"), "remote").agg(
        F.count(F.lit(1)).alias("attempts")
    )


def score_cache(logs: DataFrame, scores: DataFrame, now, age: str = "1 hour") -> DataFrame:
    """Scores of events older than `age`, with the newest timestamp they cover."""
    old = logs.where(F.col("timestamp") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {age}"))
    counted = old.groupBy(*SCORE_KEYS, "event").agg(
        F.count(F.lit(1)).alias("events"), F.max("timestamp").alias("timestamp")
    )
    return (
        counted.join(scores, ["server", "event"])
        .groupBy(*SCORE_KEYS)
        .agg(
            F.sum(F.col("events") * F.col("score")).cast("long").alias("score"),
            F.max("timestamp").alias("timestamp"),
        )
    )


def incremental_scores(logs: DataFrame, cache: DataFrame, scores: DataFrame) -> DataFrame:
    """Cached scores plus the scores of events newer than the cache."""
    newest = cache.agg(F.max("timestamp").alias("cached_until"))
    fresh = logs.crossJoin(F.broadcast(newest)).where(  # one row
        F.col("cached_until").isNull() | (F.col("timestamp") > F.col("cached_until"))
    )
    parts = [cache, fake_scores(fresh, scores)]
    return (
        concat_scores(parts, distinct=False)
        .groupBy(*SCORE_KEYS)
        .agg(F.sum("score").alias("score"))
    )
