"""Client sessions, online boards and plug-in reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.times import hour_of, micros, minutes_since, now_literal, trunc_to
from netloom.operators.ordering import carry_forward, exact_median, latest, neighbour
from netloom.schemas import enum_name, enum_rank

LOGGED = ("login", "logout")


def sessions(activities: DataFrame, now) -> DataFrame:
    """Each login with its end: the client's next login or logout, or `now`."""
    logged = activities.where(F.col("activity").isin(*LOGGED)).select("id", "client", "timestamp", "activity")
    paired = neighbour(
        logged, ["client"], ["timestamp", "id"], trunc_to("day", "timestamp"), {"next": "timestamp"}
    )
    return paired.where(F.col("activity") == "login").select(
        "client",
        F.col("timestamp").alias("start"),
        F.coalesce("next", now_literal(now)).alias("end"),
        F.col("next").isNull().alias("open"),
    )


def uptime_report(activities: DataFrame, now) -> DataFrame:
    """Shortest, longest, mean and median session per client, and of all.

    `everyone` marks the row of all sessions, whose client is NULL; sessions
    without a client have a row of their own.
    """
    spans = sessions(activities, now)
    nobody = F.lit(None).cast(spans.schema["client"].dataType).alias("client")
    who = F.array(F.struct(F.lit(False).alias("everyone"), "client"), F.struct(F.lit(True).alias("everyone"), nobody))
    lengths = spans.select(F.explode(who).alias("who"), (micros("end") - micros("start")).alias("us"))
    stats = lengths.groupBy("who").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.min("us").alias("min"),
        F.max("us").alias("max"),
        F.avg("us").alias("avg"),
    )
    report = stats.join(exact_median(lengths, ["who"], "us"), "who")
    seconds = {c: F.col(c) / 1e6 for c in ("min", "max", "avg", "median")}
    return report.withColumns(seconds).select("who.*", "sessions", *seconds)


def client_sessions(activities: DataFrame, now) -> DataFrame:
    """Sessions with how they ended: logout, a new login, or still open at `now`."""
    logged = activities.where(F.col("activity").isin(*LOGGED)).select("id", "client", "timestamp", "activity")
    paired = neighbour(
        logged, ["client"], ["timestamp", "id"], trunc_to("day", "timestamp"),
        {"next": "timestamp", "next_activity": "activity"},
    )
    ended = F.when(F.col("next").isNull(), "open").when(F.col("next_activity") == "login", "relogin")
    return paired.where(F.col("activity") == "login").select(
        "client",
        F.col("timestamp").alias("start"),
        F.coalesce("next", now_literal(now)).alias("end"),
        ended.otherwise("logout").alias("ended"),
    )


def logout_history(activities: DataFrame, history: DataFrame) -> DataFrame:
    """Inactive plug-in rows that a logout adds: one per plug-in of the last report before it."""
    reports = history.select("client", "timestamp").distinct().select(
        "client", "timestamp", F.lit(0).alias("kind"), F.col("timestamp").alias("report")
    )
    logouts = activities.where(F.col("activity") == "logout").select("client", "timestamp").distinct().select(
        "client", "timestamp", F.lit(1).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("report")
    )
    linked = carry_forward(
        reports.unionByName(logouts), ["client"], ["timestamp", "kind"],
        trunc_to("day", "timestamp"), "report", "last_report",
    ).where((F.col("kind") == 1) & F.col("last_report").isNotNull())
    listed = history.select("client", F.col("timestamp").alias("last_report"), "name").distinct()
    return linked.join(listed, ["client", "last_report"]).select(
        "client", "name", "timestamp", F.lit(False).alias("active")
    )


def last_activity(clients: DataFrame, activities: DataFrame) -> DataFrame:
    """Every client with its latest activity, if any; equal times go to the later id."""
    newest = latest(activities.select("client", "timestamp", "activity", "id"), ["client"], "timestamp", "id")
    return clients.join(newest.drop("id").withColumnRenamed("client", "_client"), F.col("id") == F.col("_client"), "left").drop("_client")


def status(activity: Column, last: Column, now, stuck_after: str = "1 hour") -> Column:
    """online, stuck (silent too long while logged in) or offline."""
    silent = last <= now_literal(now) - F.expr(f"INTERVAL {stuck_after}")
    return (
        F.when(activity.isNull() | (activity == "logout"), "offline")
        .when(silent, "stuck")
        .otherwise("online")
    )


def online_counts(clients: DataFrame, activities: DataFrame, now) -> DataFrame:
    """Clients per status."""
    board = last_activity(clients, activities)
    return board.groupBy(status(F.col("activity"), F.col("timestamp"), now).alias("status")).agg(
        F.count(F.lit(1)).alias("clients")
    )


def activity_class(minutes: Column) -> Column:
    """Freshness class of a last activity (fixed limits 30, 60 and 720 minutes)."""
    return (
        F.when(minutes.isNull(), "missing")
        .when(minutes <= 30, "fresh")
        .when(minutes <= 60, "recent")
        .when(minutes <= 720, "old")
        .otherwise("missing")
    )


def plugin_class(active: Column, plugin_status: Column) -> Column:
    """State class of a plug-in of a client."""
    return (
        F.when(active.isNull() | active, "normal")
        .when(plugin_status == "allowed", "inactive")
        .when(plugin_status.isNull(), "unknown")
        .otherwise("blocked")
    )


def wildcard_join(left: DataFrame, right: DataFrame, keys, wild, how: str = "left") -> DataFrame:
    """Join on `keys`, where a NULL in a `wild` column of `right` matches anything.

    `right` brings its columns under the prefix `known_`. Only the distinct
    combinations of `left` meet the rules, so a name that holds most rows does
    not multiply the rule matching; the matches return by an equality join.
    """
    combos = left.select(*keys, *wild).distinct()
    rules = right.select(*[F.col(c).alias(f"known_{c}") for c in right.columns])
    condition = [combos[k] == rules[f"known_{k}"] for k in keys] + [
        rules[f"known_{w}"].isNull() | (rules[f"known_{w}"] == combos[w]) for w in wild
    ]
    matched = combos.join(rules, condition, "inner")
    if how == "matches":
        return matched
    back = matched.select(
        *[F.col(c).alias(f"_{c}") for c in (*keys, *wild)], *rules.columns
    )
    same = [left[c].eqNullSafe(back[f"_{c}"]) for c in (*keys, *wild)]
    return left.join(back, same, how).drop(*[f"_{c}" for c in (*keys, *wild)])


def allowed_plugins(active: DataFrame, known: DataFrame) -> DataFrame:
    """Whether each reported plug-in matches a rule that allows it."""
    joined = wildcard_join(active, known, ["name"], ["version", "hash"])
    return joined.groupBy(*active.columns).agg(
        F.coalesce(F.bool_or(F.col("known_status") == "allowed"), F.lit(False)).alias("allowed")
    )


def plugin_census(active: DataFrame, known: DataFrame) -> DataFrame:
    """Clients per (plug-in, hash, version), with known plug-ins nobody runs.

    The reports are counted per combination first; rules match combinations.
    """
    combo = ["name", "version", "hash"]
    counted = active.groupBy(*combo).agg(
        F.count(F.lit(1)).alias("clients"), F.count_if("active").alias("active")
    )
    matched = wildcard_join(counted, known, ["name"], ["version", "hash"])
    used = matched.select(
        *combo, "clients", "active",
        F.col("known_note").alias("note"),
        enum_rank(F.col("known_status"), "plugin_status").alias("rank"),
    )
    hit = matched.where(F.col("known_name").isNotNull()).select(
        *[F.col(f"known_{c}").alias(f"hit_{c}") for c in combo]
    ).distinct()
    unused = known.join(hit, [known[c].eqNullSafe(hit[f"hit_{c}"]) for c in combo], "left_anti").select(
        "name", F.col("version").cast("long").alias("version"), "hash",
        F.lit(0).cast("long").alias("clients"), F.lit(None).cast("long").alias("active"),
        "note", enum_rank(F.col("status"), "plugin_status").alias("rank"),
    )
    return (
        used.unionByName(unused)
        .groupBy("name", "hash", "version")
        .agg(
            F.sum("clients").alias("clients"),
            F.sum("active").alias("active"),
            F.max("note").alias("note"),
            F.max("rank").alias("rank"),
        )
        .select(
            "name", "hash", "version", "clients", "active", "note",
            enum_name(F.col("rank"), "plugin_status").alias("status"),
        )
    )


def plugin_activity(clients, activities, types, active, known, now) -> DataFrame:
    """Activity board: per client and plug-in, ages in minutes and plug-in state.

    Activities are reduced to one row per (client, type) before any join.
    """
    reduced = (
        activities.where(F.col("activity") != "firewall")
        .groupBy("client", "activity")
        .agg(F.max("timestamp").alias("timestamp"))
        .join(types.select(F.col("name").alias("activity"), "plugin"), "activity")
    )
    at = lambda name: F.max(F.when(F.col("activity") == name, F.col("timestamp")))
    overall = reduced.groupBy("client").agg(
        F.max("timestamp").alias("last_at"), at("login").alias("login"), at("logout").alias("logout")
    )
    per_plugin = (
        reduced.where(F.col("plugin").isNotNull())
        .groupBy("client", "plugin")
        .agg(F.max("timestamp").alias("plug_at"))
    )
    states = (
        wildcard_join(active, known, ["name"], ["version", "hash"])
        .groupBy("client", F.col("name").alias("plugin"))
        .agg(
            F.min("hash").alias("hash"),
            F.min("version").alias("version"),
            F.min(enum_rank(F.col("known_status"), "plugin_status")).alias("rank"),
            F.bool_and("active").alias("active"),
        )
    )
    board = per_plugin.join(states, ["client", "plugin"], "full")
    return (
        clients.select(F.col("id").alias("client"), "name")
        .join(board, "client", "left")
        .join(overall, "client", "left")
        .where(F.col("plugin").isNotNull() | F.col("last_at").isNull())
        .select(
            "name", "plugin",
            minutes_since("last_at", now).alias("last"),
            "login", minutes_since("login", now).alias("login_time"),
            "logout", minutes_since("logout", now).alias("logout_time"),
            minutes_since("plug_at", now).alias("plug_last"),
            "hash", "version",
            enum_name(F.col("rank"), "plugin_status").alias("status"),
            "active",
        )
    )


def plugin_changes(history: DataFrame) -> DataFrame:
    """Plug-in changes between consecutive reports of a client.

    A report is the set of (name, version) pairs with one (client, timestamp);
    each pair is compared with the report before and after, by joins on the
    report's own key, so no report or client is gathered in one row.
    """
    reports = history.select("client", "timestamp").distinct()
    bucket = hour_of("timestamp")
    linked = neighbour(reports, ["client"], ["timestamp"], bucket, {"previous": "timestamp"}, ahead=False)
    items = history.select("client", "timestamp", "name", "version").distinct()
    before = items.select(
        "client", F.col("timestamp").alias("previous"), "name", F.col("version").alias("old_version")
    )
    steps = linked.where(F.col("previous").isNotNull())
    new = steps.join(items, ["client", "timestamp"])
    old = steps.join(before, ["client", "previous"])
    both = new.join(old.select("client", "timestamp", "name", "old_version"), ["client", "timestamp", "name"], "full")
    change = (
        F.when(F.col("version").isNull(), "deactivated")
        .when(F.col("old_version").isNull(), "activated")
        .when(F.col("version") != F.col("old_version"), "version")
    )
    first = (
        linked.where(F.col("previous").isNull())
        .join(items, ["client", "timestamp"])
        .select("client", "timestamp", "name", F.lit(None).cast("long").alias("old_version"), "version", F.lit("activated").alias("change"))
    )
    changed = both.withColumn("change", change).where(F.col("change").isNotNull())
    return first.unionByName(changed.select("client", "timestamp", "name", "old_version", "version", "change"))
