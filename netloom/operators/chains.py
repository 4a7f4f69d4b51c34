"""Greedy runs: each hit is the first row that its predecessor releases.

Time-outs that start at a first packet, and alarms that silence themselves, are
chains through the rows of a key: after a hit, the next one is the first row at
least `count` rows and `hold` microseconds further on. Walking them row by row
would put a key in one task. Here the rows of a (key, time chunk) are one task's
work, and a chunk is contracted to a short table: for each row at which a chain
can enter it (one of the first `count`, or within `hold` of its start), what the
chain's last hit in the chunk asks of the next row. Tables of neighbouring chunks
are composed into blocks, the blocks of a key are walked once, and each chunk is
then replayed from its now known entry. All of that is one plan; nothing loops.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.times import from_micros, micros
from netloom.session import stored

CHUNK_HOLDS = 8  # holds per chunk: a chain has so many hits in it at most, and one more
BLOCK_CHUNKS = 256
NEVER = -(1 << 62)  # the time that a chain without a hit asks for

# Rows of a chunk, and of those at which a chain can enter it: the time, and what
# the next row must reach, as a place counted from the chunk's start and a time.
TABLE = "struct<size: bigint, t: array<bigint>, m: array<bigint>, u: array<bigint>>"
STATES = "array<struct<m: bigint, u: bigint>>"


class _Flat:
    """Sorted times of many chunks as one ascending array: every chunk gets a span of its own."""

    def __init__(self, times: pa.Array, chunk_us: int, hold_us: int):
        flat = times.flatten().to_numpy(zero_copy_only=False)
        self.ends = np.cumsum(times.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        self.starts = self.ends - np.diff(self.ends, prepend=0)
        self.row = np.repeat(np.arange(len(times)), self.ends - self.starts)
        self.span = chunk_us + hold_us + 1
        self.base = flat[self.starts] // chunk_us * chunk_us
        self.t, self.hold = flat, hold_us
        self.flat = self.row * self.span + flat - self.base[self.row]

    def first(self, row: np.ndarray, us: np.ndarray) -> np.ndarray:
        """Place of the first time of the chunk that is not before `us`; the chunk's end if there is none."""
        at = np.clip(us - self.base[row], 0, self.span - 1)
        return np.searchsorted(self.flat, row * self.span + at)

    def hits(self, place: np.ndarray, count: int):
        """The chains from `place` on inside their chunks: yields (which chains, their places) hit by hit."""
        which = np.arange(len(place))
        while len(which):
            yield which, place
            row = self.row[place]
            place = np.maximum(place + count, self.first(row, self.t[place] + self.hold))
            inside = place < self.ends[row]
            which, place = which[inside], place[inside]


def _contractor(chunk_us: int, hold_us: int, count: int):
    @F.arrow_udf(TABLE)
    def contract(times: pa.Array) -> pa.Array:
        chunks = _Flat(times, chunk_us, hold_us)
        rows = np.arange(len(times))
        size = chunks.ends - chunks.starts
        soon = chunks.first(rows, chunks.base + hold_us) - chunks.starts
        entries = np.minimum(size, np.maximum(count, soon + 1))
        bounds = np.cumsum(np.append(0, entries))
        place = np.repeat(chunks.starts - bounds[:-1], entries) + np.arange(bounds[-1])
        last = place.copy()
        for which, at in chunks.hits(place, count):
            last[which] = at
        offsets = pa.array(bounds, pa.int32())
        asked = last - np.repeat(chunks.starts, entries) + count
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (chunks.t[place], asked, chunks.t[last] + hold_us)]
        return pa.StructArray.from_arrays([pa.array(size), *lists], names=["size", "t", "m", "u"])

    return contract


def _composer(count: int):
    @F.arrow_udf(TABLE)
    def compose(parts: pa.Array) -> pa.Array:
        """The table of a block from the tables of its chunks."""
        out = []
        for tables in parts.to_pylist():
            before, t = 0, []
            m, u = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for table in tables:
                own = [np.array(table[c], np.int64) for c in "tmu"]
                enter = np.maximum(m - before, np.searchsorted(own[0], u))
                inside = enter < len(own[0])
                m[inside] = before + own[1][enter[inside]]
                u[inside] = own[2][enter[inside]]
                taken = len(own[0]) if not before else min(len(own[0]), max(0, count - before))
                t += table["t"][:taken]
                m, u = np.append(m, before + own[1][:taken]), np.append(u, own[2][:taken])
                before += table["size"]
            out.append({"size": before, "t": t, "m": m.tolist(), "u": u.tolist()})
        kind = pa.list_(pa.int64())
        return pa.array(out, pa.struct([("size", pa.int64()), ("t", kind), ("m", kind), ("u", kind)]))

    return compose


def _walked(parts: pa.Array, m: pa.Array, u: pa.Array) -> pa.Array:
    """What the chain asks for at the start of each of the tables, which it enters asking for m and u."""
    out = []
    for tables, rank, time in zip(parts.to_pylist(), m.to_pylist(), u.to_pylist()):
        states = []
        for table in tables:
            states.append({"m": rank, "u": time})
            enter = max(rank, bisect_left(table["t"], time))
            if enter < len(table["t"]):
                rank, time = table["m"][enter], table["u"][enter]
            rank -= table["size"]
        out.append(states)
    return pa.array(out, pa.list_(pa.struct([("m", pa.int64()), ("u", pa.int64())])))


def _replayer(chunk_us: int, hold_us: int, count: int):
    @F.arrow_udf("array<int>")
    def replay(times: pa.Array, m: pa.Array, u: pa.Array) -> pa.Array:
        """Places of the hits of each chunk."""
        chunks = _Flat(times, chunk_us, hold_us)
        rows = np.arange(len(times))
        rank, time = (c.to_numpy(zero_copy_only=False) for c in (m, u))
        start = np.maximum(chunks.starts + np.maximum(rank, 0), chunks.first(rows, np.maximum(time, chunks.base)))
        entered = np.flatnonzero(start < chunks.ends)
        found = [(entered[which], at) for which, at in chunks.hits(start[entered], count)]
        row = np.concatenate([r for r, _ in found] or [rows[:0]])
        at = np.concatenate([p for _, p in found] or [rows[:0]])
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(times))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((at - chunks.starts[row]).astype(np.int32)))

    return replay


def chained(points: DataFrame, hold_us: int, count: int = 1, *extra: str) -> DataFrame:
    """Chunks (_k, _chunk, rows, hits, m, u) of the chains through the points of every key.

    `points` has the key struct `_k` and microseconds `_t`. A chain hits the first
    row that is the `count`-th at least, then always the first row `count` rows
    and `hold_us` after its last hit. `rows` are the chunk's rows in order (with
    `extra` columns, which also break ties; else each time once), `hits` the
    places of hits among them, and m, u what the chain asks for at the chunk's
    start (u is NEVER before the first hit). A task holds the rows of a key in
    one chunk of CHUNK_HOLDS * hold_us.
    """
    chunk_us = CHUNK_HOLDS * max(hold_us, 1)
    gathered = F.collect_list(F.struct("_t", *extra)) if extra else F.collect_set(F.struct("_t"))
    rows = points.where(F.col("_t").isNotNull()).groupBy("_k", F.floor(F.col("_t") / chunk_us).alias("_chunk")).agg(
        F.sort_array(gathered).alias("rows")
    )
    chunks, _ = stored(rows.withColumn("table", _contractor(chunk_us, hold_us, count)("rows._t")), "chain-chunks")
    order = Window.partitionBy("_k").orderBy("_chunk")
    slim = chunks.select("_k", "_chunk", "table", F.element_at("rows._t", 1).alias("_first"), F.element_at("rows._t", -1).alias("_last"))
    # Behind a silence of `hold_us` the next row is a hit whatever came before.
    apart = F.col("_first") - F.lag("_last").over(order) >= hold_us if count == 1 else F.lit(False)
    slim = slim.withColumn("_cut", F.when(apart, 1).otherwise(0)).withColumn("_run", F.sum("_cut").over(order))
    together = F.count(F.lit(1)).over(Window.partitionBy("_k", "_run"))
    slim = slim.withColumn("_n", together).where("_n > 1")

    def part(name: str) -> Column:
        return F.sort_array(F.collect_list(F.struct(name, "table.*"))).alias("parts")

    def entered(df: DataFrame, name: str, m: Column, u: Column, *keep: str) -> DataFrame:
        states = F.arrow_udf(_walked, STATES)("parts", m, u)
        pairs = F.arrays_zip(F.col(f"parts.{name}").alias(name), states.alias("state"))
        return df.select("_k", *keep, F.explode(pairs).alias("p")).select("_k", *keep, f"p.{name}", "p.state.m", "p.state.u")

    blocks = slim.groupBy("_k", "_run", F.floor(F.col("_chunk") / BLOCK_CHUNKS).alias("_block")).agg(part("_chunk"))
    tables = blocks.withColumn("table", _composer(count)("parts"))
    whole = tables.groupBy("_k", "_run").agg(part("_block"))
    at_block = entered(whole, "_block", F.lit(count - 1).cast("long"), F.lit(NEVER).cast("long"), "_run")
    at_chunk = entered(blocks.join(at_block, ["_k", "_run", "_block"]), "_chunk", F.col("m"), F.col("u"))
    known = chunks.drop("table").join(at_chunk, ["_k", "_chunk"], "left").select(
        "_k", "_chunk", "rows",
        F.coalesce("m", F.lit(count - 1)).cast("long").alias("m"), F.coalesce("u", F.lit(NEVER)).cast("long").alias("u"),
    )
    return known.withColumn("hits", _replayer(chunk_us, hold_us, count)("rows._t", "m", "u"))


def greedy_windows(events: DataFrame, keys, ts: str, length_us: int, start: str = "start") -> DataFrame:
    """Add the start of each event's window.

    A window opens at the first event after the previous window's length has
    passed, per key (NULL is a key). An event without a time has no window.
    """
    hold_us = length_us + 1
    chunk_us = CHUNK_HOLDS * hold_us
    timed = events.withColumns({"_t": micros(ts), "_k": F.struct(*keys)})
    timed = timed.withColumn("_chunk", F.floor(F.col("_t") / chunk_us))
    opened = F.transform("hits", lambda i: F.element_at("rows._t", i + 1))
    carried = F.when(F.col("u") > NEVER, F.array(F.col("u") - hold_us)).otherwise(F.array().cast("array<bigint>"))
    starts = chained(timed.select("_k", "_t"), hold_us).select("_k", "_chunk", F.concat(carried, opened).alias("_starts"))
    joined = timed.join(starts, ["_k", "_chunk"], "left")
    latest = F.array_max(F.filter("_starts", lambda s: s <= F.col("_t")))
    return joined.withColumn(start, from_micros(latest)).drop("_t", "_k", "_chunk", "_starts")
