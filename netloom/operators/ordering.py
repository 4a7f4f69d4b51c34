"""Latest rows, neighbours and ranks that do not gather a hot key in one task.

A plain window sends all rows of a key to one task. The helpers here cut a key
into buckets along its order (an hour, a range of versions): rows are windowed
per (key, bucket), and one summary row per bucket carries values across. The
result equals the plain window. The key columns travel as one struct, whose
equality takes NULL for a value like any other, as a window does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _keyed(df: DataFrame, keys, bucket: Column) -> DataFrame:
    """Add the keys as `_k` and the bucket as `_bucket`."""
    return df.withColumns({"_k": F.struct(*keys), "_bucket": bucket})


def earlier_rows(order: str) -> WindowSpec:
    """The rows of the same `_k` before this one."""
    return Window.partitionBy("_k").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def latest(df: DataFrame, keys, *order: Column | str) -> DataFrame:
    """The row with the greatest `order` per key; an aggregate, combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, "best.*")


def _bucket_edges(keyed: DataFrame, order, values, first: bool) -> DataFrame:
    """First (or last) values of every (_k, _bucket).

    The leading order column alone is a plain minimum or maximum, which the
    hash aggregate can combine without sorting.
    """
    bucketed = keyed.groupBy("_k", "_bucket")
    if values == [order[0]]:
        edge = (F.min if first else F.max)(order[0])
        return bucketed.agg(edge.alias(order[0])).select("_k", "_bucket", F.struct(order[0]).alias("_edge"))
    pick = F.min_by if first else F.max_by
    return bucketed.agg(pick(F.struct(*values), F.struct(*order)).alias("_edge"))


def neighbour(df: DataFrame, keys, order, bucket: Column, values: dict[str, str], ahead: bool = True) -> DataFrame:
    """Add columns of the next (`ahead`) or previous row in the order of a key.

    `values` maps a new column to the column it is taken from. `bucket` must
    not decrease along `order`.
    """
    sources = list(dict.fromkeys(values.values()))
    inside = Window.partitionBy("_k", "_bucket").orderBy(*order)
    across = Window.partitionBy("_k").orderBy("_bucket")
    shift = F.lead if ahead else F.lag
    keyed = _keyed(df, keys, bucket)
    edges = _bucket_edges(keyed, order, sources, first=ahead).select(
        "_k", "_bucket", shift("_edge").over(across).alias("_far")
    )
    near = keyed.withColumn("_near", shift(F.struct(*sources)).over(inside))
    found = F.coalesce("_near", "_far")
    joined = near.join(edges, ["_k", "_bucket"], "left").withColumn("_found", found)
    return joined.select(
        *df.columns, *[F.col(f"_found.{source}").alias(name) for name, source in values.items()]
    )


def ranked(df: DataFrame, keys, order, bucket: Column, name: str = "rank") -> DataFrame:
    """Row number in the order of a key: the rank in the bucket plus earlier buckets."""
    inside = Window.partitionBy("_k", "_bucket").orderBy(*order)
    before = Window.partitionBy("_k").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucketed = _keyed(df, keys, bucket)
    sizes = (
        bucketed.groupBy("_k", "_bucket")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_k", "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    )
    return (
        bucketed.withColumn("_rank", F.row_number().over(inside))
        .join(sizes, ["_k", "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_rank"))
        .drop("_k", "_bucket", "_before", "_rank")
    )


def top_k(df: DataFrame, keys, order, k: int, salts: int = 32) -> DataFrame:
    """Mark the first `k` rows of each key with `in_top`, exactly.

    Only rows among the first `k` of their salt can be among the first `k` of
    the key, so the second ranking sees at most `k * salts` rows of a key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    local = salted.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
    ).drop("_salt")
    final = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ahead = local.where(F.col("_local") <= k).withColumn("in_top", final <= k)
    behind = local.where(F.col("_local") > k).withColumn("in_top", F.lit(False))
    return ahead.unionByName(behind).drop("_local")


def first_k(df: DataFrame, keys, order, k: int, salts: int = 32) -> DataFrame:
    """Only the first `k` rows of each key, by the two rankings of `top_k`.

    Both rankings keep no more than `k` rows of a group, so the rows behind are
    neither sorted whole nor shuffled twice.
    """
    best = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    for parts in ([*keys, "_salt"], list(keys)):
        rank = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
        best = best.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
    return best.drop("_salt")


def counter_delta(df: DataFrame, keys, order, bucket: Column, counters) -> DataFrame:
    """Increase of cumulative counters since the previous row; the first row counts whole."""
    with_last = neighbour(df, keys, order, bucket, {f"_last_{c}": c for c in counters}, ahead=False)
    return with_last.withColumns(
        {c: F.col(c) - F.coalesce(f"_last_{c}", F.lit(0)) for c in counters}
    ).drop(*[f"_last_{c}" for c in counters])


def carry_forward(df: DataFrame, keys, order, bucket: Column, value: str, name: str) -> DataFrame:
    """Latest non-null `value` up to and including the row, in the order of a key."""
    inside = Window.partitionBy("_k", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_k").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucketed = _keyed(df, keys, bucket)
    lasts = (
        bucketed.groupBy("_k", "_bucket")
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
        .select("_k", "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_far"))
    )
    return (
        bucketed.withColumn("_near", F.last(value, ignorenulls=True).over(inside))
        .join(lasts, ["_k", "_bucket"], "left")
        .withColumn(name, F.coalesce("_near", "_far"))
        .drop("_k", "_bucket", "_near", "_far")
    )


# Fixed steps of the median search over microseconds: hours, seconds, exact.
HOUR, SECOND = 3_600_000_000, 1_000_000


def _narrowed(targets: DataFrame, cells: DataFrame, keys, within, cell: str) -> DataFrame:
    """Targets (keys, within, _rank) moved into the cell their rank falls in."""
    order = Window.partitionBy(*keys, *within).orderBy(cell)
    upto = cells.withColumn("_upto", F.sum("_c").over(order))
    start = F.col("_upto") - F.col("_c")
    inside = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= start)
    return (
        targets.join(upto, [*keys, *within])
        .where(inside)
        .select(*keys, cell, (F.col("_rank") - start).alias("_rank"))
    )


def exact_median(df: DataFrame, columns, value: str) -> DataFrame:
    """Exact median of a column of microseconds per key, without sorting a key in one task.

    The two middle ranks are narrowed to an hour, to a second and to a value.
    Counts per second serve the first two steps, so the rows are read twice. A
    window sees the hours of a key, the seconds of an hour or the values of a
    second, never the rows.
    """
    keys = ["_k"]
    rows = df.select(F.struct(*columns).alias("_k"), F.col(value).alias("_v"), F.floor(F.col(value) / SECOND).alias("_second"))
    seconds = (
        rows.groupBy(*keys, "_second").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_hour", F.floor(F.col("_second") / (HOUR // SECOND)))
    )
    hours = seconds.groupBy(*keys, "_hour").agg(F.sum("_c").alias("_c"))
    middle = F.explode(F.array_distinct(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2"))))
    targets = hours.groupBy(*keys).agg(F.sum("_c").alias("_n")).select(*keys, "_n", middle.alias("_rank"))
    targets = _narrowed(targets.drop("_n"), hours, keys, [], "_hour")
    targets = _narrowed(targets, seconds, keys, ["_hour"], "_second")
    values = (
        rows.join(targets.select(*keys, "_second").distinct(), [*keys, "_second"], "left_semi")
        .groupBy(*keys, "_second", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    found = _narrowed(targets, values, keys, ["_second"], "_v")
    return found.groupBy(*keys).agg(F.avg("_v").alias("median")).select("_k.*", "median")
