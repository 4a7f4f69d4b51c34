"""Versioned address sets: content, differences, replicas and rule lists.

A change log has the columns store, epoch, version, is_add, address. A new
epoch starts a set afresh; inside it the last operation per address counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.net import addr_port
from netloom.operators.groups import firewall_hits
from netloom.operators.ordering import neighbour

ADDRESS = ["store", "address"]


def _last_operation(log: DataFrame, keys) -> DataFrame:
    """Last operation per address."""
    return log.groupBy(*keys).agg(
        F.max("version").alias("version"), F.max_by("is_add", "version").alias("is_add")
    )


def set_versions(log: DataFrame) -> DataFrame:
    """Newest epoch and its newest version per set; one aggregate, no window."""
    top = F.max(F.struct("epoch", "version")).alias("top")
    return log.groupBy("store").agg(top).select("store", "top.epoch", "top.version")


def set_content(log: DataFrame, name: str | None = None) -> DataFrame:
    """Addresses in each set (or in one) now.

    The last operation is taken per (epoch, address); the epochs that are not
    the newest of their set go by a semi join with one row per set.
    """
    wanted = log if name is None else log.where(F.col("store") == name)
    epochs = wanted.groupBy("store").agg(F.max("epoch").alias("epoch"))
    last = _last_operation(wanted, ["store", "epoch", "address"])
    return last.where("is_add").join(epochs, ["store", "epoch"], "left_semi").select("store", "address")


def set_diff(current: DataFrame, wanted: DataFrame, epoch: Column, version: Column, keep: DataFrame | None = None) -> DataFrame:
    """Change log that turns `current` into `wanted` (columns store, address).

    Addresses in `keep` (still seen on the firewalls) are not removed. Both sides
    meet in one aggregate, so each is read once.
    """
    sides = wanted.select(*ADDRESS, F.lit(True).alias("wanted")).unionByName(current.select(*ADDRESS, F.lit(False).alias("wanted")))
    changed = sides.groupBy(*ADDRESS).agg(F.min("wanted").alias("only_wanted"), F.max("wanted").alias("is_add"))
    changes = changed.where(F.col("only_wanted") == F.col("is_add"))
    if keep is not None:
        kept = keep.select("address", F.lit(False).alias("is_add"))
        changes = changes.join(kept, ["address", "is_add"], "left_anti")
    return changes.select("store", epoch.alias("epoch"), version.alias("version"), "is_add", "address")


def still_active(log: DataFrame, candidates: DataFrame, routers: int, packets: int) -> DataFrame:
    """Removal candidates that enough firewalls still block."""
    return firewall_hits(log, candidates, routers, packets).select(F.col("remote_address").alias("address"))


def version_diff(log: DataFrame, name: str, epoch: int, since: int, until: int, full: bool = False) -> DataFrame:
    """Operations that lead from version `since` to `until`; a full diff has additions only."""
    span = log.where(
        (F.col("store") == name) & (F.col("epoch") == epoch)
        & (F.col("version") > since) & (F.col("version") <= until)
    )
    last = _last_operation(span, ["address"])
    return (last.where("is_add") if full else last).select("address", "is_add")


def update_kind(have_epoch: Column, have_version: Column, epoch: Column, version: Column) -> Column:
    """What a replica needs: nothing, an incremental diff, a full one, or a resync.

    A version behind its own epoch's replica can only come from a lost history.
    """
    return (
        F.when(have_epoch.isNull() | (have_epoch != epoch), "full")
        .when(have_version == version, "none")
        .when(have_version < version, "incremental")
        .otherwise("resync")
    )


def apply_diff(replica: DataFrame, diff: DataFrame, full: bool = False) -> DataFrame:
    """Replica (column address) after a diff; a full diff replaces the content."""
    added = diff.where("is_add").select("address")
    if full:
        return added
    touched = diff.select("address")
    return replica.select("address").join(touched, "address", "left_anti").unionByName(added)


def audit_changes(log: DataFrame, bucket_size: int = 1_000_000) -> DataFrame:
    """Operations without effect: adding a present address, removing an absent one."""
    keys = ["store", "epoch", "address"]
    bucket = F.floor(F.col("version") / bucket_size)
    linked = neighbour(log, keys, ["version"], bucket, {"was": "is_add"}, ahead=False)
    present = F.coalesce("was", F.lit(False))
    return linked.where(F.col("is_add") == present).select(
        *keys, "version", F.when(F.col("is_add"), "repeated add").otherwise("absent removal").alias("problem")
    )


def set_sizes(sets: DataFrame, content: DataFrame) -> DataFrame:
    """Sets (name, maxsize, hashsize) with sizes raised to hold their content.

    A set that is too small gets the next power of two, at least two, and a
    hash four times as large.
    """
    needed = content.groupBy(F.col("store").alias("name")).agg(F.count(F.lit(1)).alias("needed"))
    power = F.greatest(F.lit(1), F.ceil(F.log2("needed"))).cast("int")
    size = F.call_function("shiftleft", F.lit(1).cast("long"), power)
    small = F.col("maxsize") < F.col("needed")
    return sets.join(needed, "name", "left").select(
        "name",
        F.when(small, size).otherwise(F.col("maxsize")).alias("maxsize"),
        F.when(small, size * 4).otherwise(F.col("hashsize")).alias("hashsize"),
        F.coalesce(small, F.lit(False)).alias("raised"),
    )


def wanted_addresses(rules: DataFrame, plain: list[DataFrame], omit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Addresses wanted by set rules and address lists, and address ranges apart.

    `rules` has ip, port and prefix; each list in `plain` has address. Omitted
    addresses go, and so do port rules that a port-less rule covers.
    """
    ranges = rules.where(F.col("prefix").isNotNull()).select(F.col("ip").alias("address"), "prefix").distinct()
    exact = rules.where(F.col("prefix").isNull()).select(F.col("ip").alias("address"), "port")
    for more in plain:
        exact = exact.unionByName(more.select("address", F.lit(None).cast("int").alias("port")))
    exact = exact.distinct().join(omit.select("address"), "address", "left_anti")
    everywhere = exact.where(F.col("port").isNull())
    with_port = exact.where(F.col("port").isNotNull()).join(
        everywhere.select("address"), "address", "left_anti"
    )
    return everywhere.unionByName(with_port), ranges


def flattened(exact: DataFrame) -> DataFrame:
    """Set items as text, one distinct row each: `ip`, `ip:port` or `[v6]:port`."""
    return exact.select(addr_port("address", "port").alias("address")).distinct()


# Entries per rule text, so no row has to hold a whole list.
RULE_LENGTH = 1000


def flatten_rules(exact: DataFrame, per_rule: int = RULE_LENGTH) -> DataFrame:
    """Rule texts per port: sorted addresses in rules of about `per_rule` entries.

    One text for all addresses would gather them in one task; the addresses of
    a port are spread over as many rules as their number asks for, and a match
    on any rule of the port is a match on the list.
    """
    ports = exact.groupBy("port").agg(F.ceil(F.count(F.lit(1)) / per_rule).alias("rules"))
    part = F.pmod(F.crc32("address"), F.col("rules"))
    joined = exact.join(ports.withColumnRenamed("port", "_port"), F.col("port").eqNullSafe(F.col("_port")))
    listed = F.concat_ws(",", F.sort_array(F.collect_set("address")))
    return joined.groupBy("port", part.alias("part")).agg(F.count(F.lit(1)).alias("entries"), listed.alias("items"))
