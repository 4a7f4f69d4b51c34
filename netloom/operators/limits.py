"""Alarms and rate limits whose state depends on earlier events."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.times import from_micros, hour_of, micros
from netloom.operators.chains import chained
from netloom.operators.ordering import earlier_rows, ranked
from netloom.session import stored

BURST_KEY = ["server", "remote"]
MAX_ATTEMPTS = 5  # Fixed value: logins that raise an alarm.
HOLDBACK_US = 120_000_000  # Fixed value: microseconds of silence after an alarm.
CAPACITY_FACTOR = 5  # Fixed value: a full bucket holds this many refills.


def login_bursts(logs: DataFrame, attempts: int = MAX_ATTEMPTS, holdback_us: int = HOLDBACK_US, keys=BURST_KEY) -> DataFrame:
    """Logins that raise an alarm: the n-th since the last alarm, after its silence.

    The alarm after login i is the later of login i + n and the first login after
    the silence, so alarms form a chain. `n` is the number of a login in its key.
    """
    keys = list(keys)
    logins = logs.where((F.col("event") == "login") & F.col("timestamp").isNotNull())
    points = logins.select(F.struct(*keys).alias("_k"), micros("timestamp").alias("_t"), "id")
    chunks = chained(points, holdback_us, attempts, "id")
    before = F.coalesce(F.sum(F.size("rows")).over(earlier_rows("_chunk")), F.lit(0)).cast("long")
    placed = chunks.withColumn("_before", before).select("_k", "_before", "rows", F.explode("hits").alias("_i"))
    hit = F.element_at("rows", F.col("_i") + 1)
    return placed.select(
        "_k.*", hit["id"].alias("id"), from_micros(hit["_t"]).alias("timestamp"),
        (F.col("_before") + F.col("_i") + 1).alias("n"),
    )


def first_bursts(logs: DataFrame, attempts: int = MAX_ATTEMPTS, keys=BURST_KEY) -> DataFrame:
    """The first alarm of each key: its n-th login."""
    logins = logs.where(F.col("event") == "login").select(*keys, "id", "timestamp")
    numbered = ranked(logins, list(keys), ["timestamp", "id"], hour_of("timestamp"), "n")
    return numbered.where(F.col("n") == attempts).drop("n")


# Refills per chunk: a chunk is the unit of work of the rate limiter.
CHUNK_REFILLS = 60


class _Map:
    """Tokens after some messages as a function of the tokens before, on [0, full].

    The function is piecewise. A piece ends at (and with) the tokens `upto`, and
    its values go from `low` (not with it) to `high`: as fast as the tokens, or
    not at all where they are equal. A message cuts the pieces whose values its
    cost divides, a refill those that it fills up; equal neighbours join, so a
    filled bucket is one piece.
    """

    def __init__(self, full, kind):
        self.full = full
        self.upto, self.low, self.high = (np.array([x], kind) for x in (full, 0, full))

    def _cut(self, value, above: np.ndarray) -> np.ndarray:
        """Cut the pieces with values on both sides of `value`; `above` marks those that end above it."""
        where = np.flatnonzero(above & (self.low < value))
        if not len(where):
            return above
        self.upto = np.insert(self.upto, where, self.upto[where] - (self.high[where] - value))
        self.high = np.insert(self.high, where, value)
        self.low = np.insert(self.low, where + 1, value)
        return self.high > value

    def refill(self, tokens) -> None:
        self.low, self.high = self.low + tokens, self.high + tokens
        over = self.high > self.full
        if over.any():
            self._cut(self.full, over)
            self.low, self.high = np.minimum(self.low, self.full), np.minimum(self.high, self.full)
            flat = self.low == self.high
            last = np.append(~(flat[1:] & flat[:-1] & (self.high[1:] == self.high[:-1])), True)
            self.upto, self.low, self.high = self.upto[last], self.low[last], self.high[last]

    def pay(self, cost) -> None:
        accepted = self.high > cost
        if accepted.any():
            accepted = self._cut(cost, accepted)
            np.subtract(self.low, cost, out=self.low, where=accepted)
            np.subtract(self.high, cost, out=self.high, where=accepted)

    def pieces(self) -> list[dict]:
        columns = zip(self.upto.tolist(), self.low.tolist(), self.high.tolist())
        return [{"upto": u, "low": a, "high": b} for u, a, b in columns]


def _value(pieces: list[dict], tokens):
    piece = next(p for p in pieces if tokens <= p["upto"])
    return piece["high"] - (piece["upto"] - tokens if piece["low"] != piece["high"] else 0)


def rate_limit(messages: DataFrame, inflow: int, interval_s: int, factor: int = CAPACITY_FACTOR, chunk_refills: int = CHUNK_REFILLS) -> DataFrame:
    """Flag messages (client, id, ts, cost) a token bucket accepts.

    A bucket starts full at inflow * factor tokens, gains `inflow` every
    `interval_s` (epoch-aligned) and pays the cost of a message that is less
    than its content. Costs are whole or not; NULL is a client like any other. A
    message without a cost or time is not accepted and costs nothing.

    The messages of a (client, time chunk) are one task's work and become a
    piecewise linear function of the tokens before them. The functions of a
    client are applied in order, anew wherever the bucket is surely full again,
    and each chunk is replayed with its now known tokens. The work does not depend
    on the capacity, and no task holds more of a client than a chunk's messages
    and one function per chunk.
    """
    full = inflow * factor
    interval_us = interval_s * 1_000_000
    whole = messages.schema["cost"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    number, kind = ("bigint", np.int64) if whole else ("double", np.float64)
    valid = F.col("cost").isNotNull() & F.col("ts").isNotNull()
    row = F.struct(*[F.col(f"`{c}`") for c in messages.columns])
    message = F.struct(
        F.floor(micros("ts") / interval_us).alias("tick"), micros("ts").alias("us"), F.col("id"),
        F.col("cost").cast(number).alias("cost"), row.alias("row"),
    )
    grouped = messages.where(valid).groupBy(
        F.struct("client").alias("_k"), F.floor(micros("ts") / (interval_us * chunk_refills)).alias("_chunk")
    ).agg(F.sort_array(F.collect_list(message)).alias("rows"))

    pieces = f"array<struct<upto: {number}, low: {number}, high: {number}>>"

    @F.arrow_udf(pieces)
    def contract(ticks: pa.Array, costs: pa.Array) -> pa.Array:
        out = []
        for times, prices in zip(ticks.to_pylist(), costs.to_pylist()):
            tokens, before = _Map(full, kind), times[0]
            for tick, cost in zip(times, prices):
                if tick > before:
                    tokens.refill((tick - before) * inflow)
                    before = tick
                tokens.pay(cost)
            out.append(tokens.pieces())
        value = pa.int64() if whole else pa.float64()
        return pa.array(out, pa.list_(pa.struct([("upto", value), ("low", value), ("high", value)])))

    @F.arrow_udf(f"array<{number}>")
    def walk(parts: pa.Array) -> pa.Array:
        """Tokens at the first message of each chunk; the bucket is full at the first of them."""
        out = []
        for chunks in parts.to_pylist():
            tokens, tick, found = full, None, []
            for chunk in chunks:
                if tick is not None:
                    tokens = min(tokens + (chunk["first"] - tick) * inflow, full)
                found.append(tokens)
                tokens, tick = _value(chunk["pieces"], tokens), chunk["last"]
            out.append(found)
        return pa.array(out, pa.list_(pa.int64() if whole else pa.float64()))

    @F.arrow_udf("array<boolean>")
    def replay(ticks: pa.Array, costs: pa.Array, tokens: pa.Array) -> pa.Array:
        out = []
        for times, prices, left in zip(ticks.to_pylist(), costs.to_pylist(), tokens.to_pylist()):
            before, flags = times[0], []
            for tick, cost in zip(times, prices):
                left, before = min(left + (tick - before) * inflow, full), tick
                flags.append(cost < left)
                left -= cost if cost < left else 0
            out.append(flags)
        return pa.array(out, pa.list_(pa.bool_()))

    chunks, _ = stored(grouped, "limit-chunks")
    slim = chunks.select(
        "_k", "_chunk", contract("rows.tick", "rows.cost").alias("pieces"),
        F.element_at("rows.tick", 1).alias("first"), F.element_at("rows.tick", -1).alias("last"),
    )
    order = Window.partitionBy("_k").orderBy("_chunk")
    # After so long a silence the bucket is full, whatever it held.
    idle = (F.col("first") - F.lag("last").over(order)) * inflow >= full
    runs = slim.withColumn("_full", F.when(idle, 1).otherwise(0)).withColumn("_run", F.sum("_full").over(order))
    parts = F.sort_array(F.collect_list(F.struct("_chunk", "first", "last", "pieces"))).alias("parts")
    walked = runs.groupBy("_k", "_run").agg(parts).select("_k", "parts", walk("parts").alias("tokens"))
    known = walked.select("_k", F.inline(F.arrays_zip(F.col("parts._chunk").alias("_chunk"), F.col("tokens").alias("tokens"))))
    flagged = chunks.join(known, ["_k", "_chunk"]).select(
        "rows", replay("rows.tick", "rows.cost", "tokens").alias("flags")
    )
    each = flagged.select(F.inline(F.arrays_zip(F.col("rows.row").alias("row"), F.col("flags").alias("accepted"))))
    rest = messages.where(~valid).select(row.alias("row"), F.lit(False).alias("accepted"))
    return each.unionByName(rest).select("row.*", "accepted")
