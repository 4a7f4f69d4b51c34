"""Ping, certificate and spoofing probe results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.net import ip_family
from netloom.functions.tls import cert_name_matches, cipher_weak

NO_REPLY = 2**31 - 1  # Fixed value: round-trip times from here on mean "no reply".
STRONG_PROTOCOLS = ("TLSv1", "TLSv1.1", "TLSv1.2")  # Fixed values: accepted versions.


def valid_rtts(rtts: Column) -> Column:
    """Round-trip times of probes that were answered."""
    return F.filter(rtts, lambda x: x < NO_REPLY)


def ping_reduce(df: DataFrame, column: str = "rtts") -> DataFrame:
    """Replies, shortest, longest and integer mean time of each probe."""
    answered = df.withColumn("_ok", valid_rtts(F.col(column)))
    total = F.aggregate("_ok", F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        answered.withColumn("received", F.size("_ok").cast("long"))
        .withColumn("min", F.array_min("_ok"))
        .withColumn("max", F.array_max("_ok"))
        .withColumn("_sum", total)
        .withColumn("avg", F.expr("_sum div nullif(received, 0)"))
        .drop(column, "_ok", "_sum")
    )


def minority_ips(pings: DataFrame, requests: DataFrame) -> DataFrame:
    """Addresses seen less often than total / n**2 in their batch and family.

    Answers are counted per address first; the totals come from a second
    aggregate over those counts, joined back, so no batch is windowed whole.
    """
    group = ["request", "batch", "family"]
    per_ip = (
        pings.where(F.col("ip").isNotNull())
        .groupBy("request", "batch", "ip")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("family", ip_family("ip"))
    )
    totals = per_ip.groupBy(*group).agg(
        F.sum("count").alias("total"), F.count(F.lit(1)).alias("ips")
    )
    names = requests.select(F.col("id").cast("long").alias("request"), "host")
    limit = F.col("total") / (F.col("ips") * F.col("ips"))
    return (
        per_ip.join(totals, group)
        .withColumn("limit", limit)
        .where(F.col("count") < F.col("limit"))
        .join(names, "request")
        .select("host", "ip", "batch", "family", "count", "limit")
    )


def cert_changes(certs: DataFrame) -> DataFrame:
    """Certificates added or removed between consecutive batches of a request."""
    values = certs.select("request", "batch", "value").distinct()
    batches = values.select("request", "batch").distinct()
    # One row per request and batch: bounded by the number of probe rounds.
    order = Window.partitionBy("request").orderBy("batch")
    steps = batches.withColumn("previous", F.lag("batch").over(order)).where(F.col("previous").isNotNull())
    now = steps.join(values, ["request", "batch"])
    then = steps.join(
        values.withColumnRenamed("batch", "previous"), ["request", "previous"]
    ).select("request", "batch", "previous", "value")
    keys = ["request", "batch", "previous", "value"]
    added = now.select(*keys).join(then, keys, "left_anti").withColumn("change", F.lit("added"))
    removed = then.join(now.select(*keys), keys, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def _answers(certs: DataFrame, requests: DataFrame, *columns: str) -> DataFrame:
    """Answers per request and batch, with host and port."""
    hosts = requests.select(F.col("id").cast("long").alias("request"), "host", "port")
    return (
        certs.groupBy("request", "batch", *columns)
        .agg(F.count(F.lit(1)).alias("count"))
        .join(hosts, "request")
    )


def weak_ciphers(certs: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers per batch over weak ciphers; ciphers that do not parse are left out."""
    answers = _answers(certs, requests, "cipher")
    return answers.where(cipher_weak(F.col("cipher"))).select(
        "cipher", F.concat_ws(":", "host", F.col("port").cast("string")).alias("endpoint"), "batch", "count"
    )


def weak_protocols(certs: DataFrame, requests: DataFrame, strong=STRONG_PROTOCOLS) -> DataFrame:
    """Answers per batch over protocols outside the accepted list."""
    answers = _answers(certs, requests, "proto")
    return answers.where(~F.col("proto").isin(*strong)).select(
        "proto", F.concat_ws(":", "host", F.col("port").cast("string")).alias("endpoint"), "batch", "count"
    )


def multi_value(certs: DataFrame, requests: DataFrame, column: str) -> DataFrame:
    """Endpoints that answered with several values of `column`, with clients per value."""
    hosts = requests.select(F.col("id").cast("long").alias("request"), "host", "port")
    per_value = (
        certs.select("request", "client", column)
        .distinct()
        .join(hosts, "request")
        .groupBy("host", "port", column)
        .agg(F.countDistinct("client").alias("clients"))
    )
    several = (
        per_value.groupBy("host", "port")
        .agg(F.count(F.lit(1)).alias("values"))
        .where(F.col("values") > 1)
    )
    return per_value.join(several.select("host", "port"), ["host", "port"], "left_semi")


def cert_name_mismatch(certs: DataFrame, requests: DataFrame) -> DataFrame:
    """Host certificates whose names do not cover the requested host, per client and batch.

    Names are matched once per distinct (request, certificate); the report is
    one row per client and batch rather than a list in one row.
    """
    hosts = requests.select(F.col("id").cast("long").alias("request"), "host", "port")
    seen = certs.groupBy("request", "value", "name", "client", "batch").agg(F.count(F.lit(1)).alias("count"))
    wrong = (
        seen.select("request", "value", "name")
        .distinct()
        .join(hosts, "request")
        .where(~F.coalesce(cert_name_matches(F.col("name"), F.col("host")), F.lit(False)))
    )
    names = F.split("name", "\n")
    label = F.when(
        F.size(names) > 1,
        F.concat(F.get(names, 0), F.lit(" and "), (F.size(names) - 1).cast("string"), F.lit(" others")),
    ).otherwise(F.col("name"))
    wrong = wrong.select(
        "host", "port", label.alias("label"),
        *[F.col(c).alias(f"_{c}") for c in ("request", "value", "name")],
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("request", "value", "name")]
    return seen.join(wrong, same).select(
        "request", "host", "port", "value", F.col("label").alias("name"), "client", "batch", "count"
    )


def pair_spoof(tokens: DataFrame, packets: DataFrame, timeout: str = "60 seconds") -> DataFrame:
    """Spoofed and plain packets matched to the token they carry, in time only."""
    sent = tokens.select("token", "client", F.col("ts").alias("sent"), F.col("address").alias("expected"))
    got = packets.select("token", "spoofed", F.col("ts").alias("received"), F.col("address").alias("ip"))
    in_time = (F.col("received") >= F.col("sent")) & (
        F.col("received") <= F.col("sent") + F.expr(f"INTERVAL {timeout}")
    )
    return (
        sent.join(got, "token")
        .where(in_time)
        .select(
            "token", "client", "sent", "received", "spoofed", "ip",
            (F.col("ip") == F.col("expected")).alias("addr_matches"),
        )
    )
