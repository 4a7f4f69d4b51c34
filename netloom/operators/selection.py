"""Due work and sampling groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.times import now_literal

SAMPLE_LEVELS = (2, 4, 8, 16, 32)  # Fixed values: numbers of random groups.


def due_requests(requests: DataFrame, now, n: int) -> DataFrame:
    """The `n` active requests that have been due longest (a top-n, not a full sort)."""
    due = F.col("lastrun") + F.col("interval")
    return (
        requests.withColumn("due", due)
        .where(F.col("active") & (F.col("due") < now_literal(now)))
        .orderBy("due", "id")
        .limit(n)
    )


def assign_groups(clients: DataFrame, levels=SAMPLE_LEVELS, seed: int = 0, hashed: bool = True) -> DataFrame:
    """One random group per client and level, named `rand-<level>-<number>`.

    The group is a function of client, level and seed, so that a client keeps
    it. Without `hashed` it is the client number modulo the level.
    """
    level = F.explode(F.array(*[F.lit(n) for n in levels])).alias("level")
    spread = F.xxhash64("client", "level", F.lit(seed)) if hashed else F.col("client")
    number = F.pmod(spread, F.col("level")) + 1
    return clients.select(F.col("id").alias("client"), level).select(
        "client",
        F.concat(F.lit("rand-"), F.col("level").cast("string"), F.lit("-"), number.cast("string")).alias("name"),
    )
