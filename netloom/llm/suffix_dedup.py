"""Repeated byte strings by longest-previous-factor arrays over buckets of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import dropped, slices, written
from netloom.llm.exact_dedup import _views
from netloom.llm.sentencepiece_codec import mixed

LENGTH = 200  # bytes of a repeated string
GRAM = 32  # bytes of the strings whose smallest hash names a window's bucket
BUCKET = 2000  # distinct runs that one bucket's suffix order holds; larger buckets go window by window
PIECE = 250_000  # bytes handled at once inside a task; the arrays beside them take about a hundred times as much
_BASE = np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 24) - 1)
FIRST, NONE = "first", "none"


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64 and their inverses."""
    size = PIECE + LENGTH
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    ups = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _BASE))))
    downs = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, inverse))))
    return ups, downs


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def runs_of(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of neighbouring windows of a byte string that fall into one bucket.

    A window of `length` bytes belongs to the bucket named by the smallest hash
    of its `gram`-byte strings, so equal windows share a bucket wherever they
    are. A run ends where the place of that string changes (of equal hashes the
    first counts), so equal windows of one text are in different runs. Returns
    bucket, hash of the bytes a run covers, first window, windows.
    """
    ups, downs = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * ups[: len(data)], out=sums[1:])
    grams = mixed((sums[gram:] - sums[:-gram]) * downs[: len(data) - gram + 1])
    # Low bits hold the place, so the minimum tells it; a piece has fewer than 2^24 places.
    placed = grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64)
    low = _sliding_minimum(placed, length - gram + 1)
    starts = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    sizes = np.diff(np.append(starts, len(low)))
    ends = starts + sizes + length - 1
    content = mixed((sums[ends] - sums[starts]) * downs[starts] + mixed(sizes.astype(np.uint64)))
    return grams[(low[starts] & _PLACE).astype(np.int64)].view(np.int64), content.view(np.int64), starts, sizes


RUNS = "line bigint, bucket bigint, content bigint, at int, windows int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the bytes `data` of each line, PIECE bytes at a time, long texts piece by piece."""

    def done(parts: list[tuple]) -> pa.RecordBatch:
        lines = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
        columns = [lines, *(np.concatenate([p[k] for p in parts]) for k in range(1, 5))]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["line", "bucket", "content", "at", "windows"]
        )

    for batch in slices(batches, "data", PIECE):
        parts, size = [], 0
        for line, data in zip(batch.column("line").to_pylist(), _views(batch.column("data"))):
            for start in range(0, max(len(data) - LENGTH + 1, 0), PIECE):
                piece = data[start : start + PIECE + LENGTH - 1]
                bucket, content, at, windows = runs_of(piece)
                parts.append((line, bucket, content, at + start, windows))
                size += len(piece)
                if size >= PIECE:
                    yield done(parts)
                    parts, size = [], 0
        if parts:
            yield done(parts)


def window_ranks(data: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Rank of each window in suffix order cut at `length` bytes, by prefix doubling; equal windows tie."""
    padded = np.zeros(len(data) + 8, np.uint64)
    padded[: len(data)] = data
    key = np.zeros(len(data), np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + len(data)]
    rank = np.unique(key, return_inverse=True)[1]
    known = 8
    while known < length:
        step = min(known, length - known)
        shifted = np.zeros_like(rank)
        shifted[:-step] = rank[step:]
        if known + step >= length:
            return np.unique(rank[windows] * (int(rank.max()) + 1) + shifted[windows], return_inverse=True)[1]
        rank = np.unique(rank * (int(rank.max()) + 1) + shifted, return_inverse=True)[1]
        known += step
    return rank[windows]


def repeated_windows(data: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows in text order: whether an earlier one is equal, and whether any other is.

    In suffix order with ties in text order, the previous smaller position of a
    window is its neighbour if that ties, so the longest previous factor reaches
    `length` exactly there; the next neighbour gives the same for later windows.
    """
    rank = window_ranks(data, windows, length)
    order = np.argsort(rank, kind="stable")
    tie = rank[order[1:]] == rank[order[:-1]]
    earlier, later = np.zeros(len(windows), bool), np.zeros(len(windows), bool)
    earlier[order[1:]] = tie
    later[order[:-1]] = tie
    return earlier, earlier | later


def _packed(flags: np.ndarray, owner: np.ndarray, offset: np.ndarray, count: int) -> list[list[int]]:
    """Flagged windows of each run as byte spans start << 31 | end."""
    out: list[list[int]] = [[] for _ in range(count)]
    hit = np.flatnonzero(flags)
    if not len(hit):
        return out
    joined = (owner[hit[1:]] == owner[hit[:-1]]) & (offset[hit[1:]] == offset[hit[:-1]] + 1)
    begin = hit[np.append(True, ~joined)]
    end = hit[np.append(~joined, True)]
    for a, b in zip(begin.tolist(), end.tolist()):
        out[owner[a]].append(int(offset[a]) << 31 | int(offset[b]) + LENGTH)
    return out


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows ordered by bucket as tables of near PIECE bytes; no bucket is in two tables."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        buckets = batch.column("bucket").to_numpy()
        starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
        sizes = np.add.reduceat(pa.compute.binary_length(batch.column("bytes")).to_numpy().astype(np.int64), starts)
        begin = 0
        for at, bucket, more in zip(starts.tolist(), buckets[starts].tolist(), sizes.tolist()):
            if size and bucket != last and size + more > PIECE:
                yield pa.Table.from_batches([*held, batch.slice(begin, at - begin)])
                held, size, begin = [], 0, at
            size, last = size + more, bucket
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each run with an equal window in another run of its bucket. Rows come ordered by bucket."""
    for table in _whole_buckets(batches):
        order = np.lexsort((table["at"].to_numpy(), table["line"].to_numpy()))
        table = table.take(order)
        texts = _views(table["bytes"].combine_chunks())
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = sizes - LENGTH + 1
        owner = np.repeat(np.arange(len(order)), counts)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        windows = (np.cumsum(sizes) - sizes)[owner] + offset
        earlier, other = repeated_windows(np.concatenate(texts), windows, LENGTH)
        spans = [_packed(flags, owner, offset, len(order)) for flags in (earlier, other)]
        yield pa.RecordBatch.from_arrays(
            [
                *[pa.array(table[c].to_numpy()) for c in ("bucket", "content")],
                *[pa.array(s, pa.list_(pa.int64())) for s in spans],
            ],
            names=["bucket", "content", "earlier", "other"],
        )


def _span(start: Column, end: Column) -> Column:
    return F.shiftleft(start.cast("long"), 31) + end


def _window_by_window(runs: DataFrame) -> DataFrame:
    """As `_compared` for buckets of any size: windows are counted by their hashes, combined before the shuffle."""
    each = runs.select(
        "bucket", "content", "line", "at", "bytes",
        F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - LENGTH)).alias("k"),
    )
    window = F.substring("bytes", F.col("k") + 1, F.lit(LENGTH))
    hashed = each.select(
        "bucket", "content", "k", F.struct("line", (F.col("at") + F.col("k")).alias("at")).alias("place"),
        F.xxhash64(window).alias("w1"), F.xxhash64(F.lit(1), window).alias("w2"),
    )
    key = ["bucket", "w1", "w2"]
    seen = hashed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).where("n > 1")
    span = _span(F.col("k"), F.col("k") + LENGTH)
    return (
        hashed.join(seen, key).groupBy("bucket", "content")
        .agg(
            F.collect_list(F.when(F.col("place") != F.col("first"), span)).alias("earlier"),
            F.collect_list(span).alias("other"),
        )
    )


def _cutter():
    @F.arrow_udf("struct<n_removed: bigint, n_spans: bigint, sha: string, rest: binary>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        removed, counts, shas, rests = [], [], [], []
        for data, packed in zip(_views(texts), spans):
            pairs = np.sort(np.array(packed.as_py() or [], np.int64))
            kept, at, gone, found = [], 0, 0, 0
            starts, ends = pairs >> 31, pairs & (2**31 - 1)
            if len(pairs):
                ends = np.maximum.accumulate(ends)
                fresh = np.append(True, starts[1:] > ends[:-1])
                stops = ends[np.append(fresh[1:], True)]
                for a, b in zip(starts[fresh].tolist(), stops.tolist()):
                    kept.append(data[at:a])
                    at, gone, found = b, gone + b - a, found + 1
            kept.append(data[at:])
            rest = b"".join(part.tobytes() for part in kept)
            removed.append(gone)
            counts.append(found)
            shas.append(hashlib.sha256(rest).hexdigest())
            rests.append(rest)
        return pa.StructArray.from_arrays(
            [pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas), pa.array(rests, pa.binary())],
            names=["n_removed", "n_spans", "sha", "rest"],
        )

    return cut


def repeated_spans(df: DataFrame, text: str = "text", keep: str = NONE) -> tuple[DataFrame, DataFrame]:
    """(rows as `line` and `row`, spans per line) of byte strings that occur more than once.

    A byte is in a span when a string of LENGTH bytes that covers it also starts
    elsewhere, in the same text or another; overlapping strings count, and all
    strings are judged on the input. With `keep` 'first', only strings that
    start earlier (in the order of rows, then of places) count, so the first
    copy stays; with 'none' every copy goes. Matches do not cross texts. Null
    and texts shorter than LENGTH have no span. A span is start << 31 | end.

    Windows are bucketed by the smallest hash inside them and travel as runs.
    A bucket met once is done; runs with equal bytes are counted before any
    shuffle, and only one of them joins the bucket's suffix order.
    """
    if keep not in (FIRST, NONE):
        raise ValueError("keep is 'first' or 'none'")
    base = df.select(
        F.monotonically_increasing_id().alias("line"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
    )
    table = written(base, "suffix-rows", compression="zstd")
    raw = table.select("line", F.col(f"row.`{text}`").cast("binary").alias("data"))
    every = written(raw.mapInArrow(_runs, RUNS), "suffix-every", compression="zstd")
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    runs = written(every.join(shared, "bucket"), "suffix-runs", compression="zstd")
    dropped(every)
    kinds = runs.groupBy("bucket", "content").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("line", "at", "windows")).alias("first")
    ).select("bucket", "content", "copies", "first.*")
    kinds = written(kinds, "suffix-kinds")
    sizes = kinds.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("kinds"), F.min("copies").alias("rarest")
    ).where("kinds > 1")
    if keep == NONE:
        sizes = sizes.where("rarest = 1")
    wanted = kinds.join(sizes.select("bucket", "kinds"), "bucket")
    cut = F.substring("data", F.col("at") + 1, F.col("windows") + (LENGTH - 1))
    pieces = written(
        wanted.join(raw, "line").select("bucket", "content", "line", "at", "kinds", cut.alias("bytes")), "suffix-pieces",
        compression="zstd",
    )
    schema = "bucket bigint, content bigint, earlier array<bigint>, other array<bigint>"
    small = pieces.where(F.col("kinds") <= BUCKET).drop("kinds").repartition("bucket").sortWithinPartitions("bucket")
    found = small.mapInArrow(_compared, schema).unionByName(
        _window_by_window(pieces.where(F.col("kinds") > BUCKET).drop("kinds"))
    )
    found = written(found, "suffix-found")
    dropped(pieces)
    judged = kinds.select("bucket", "content", "copies", F.col("line").alias("fl"), F.col("at").alias("fa")).join(
        found, ["bucket", "content"], "left"
    )
    if keep == NONE:
        judged = judged.where("copies > 1 OR size(other) > 0")
    else:
        judged = judged.where("copies > 1 OR size(earlier) > 0")
    whole = F.array(_span(F.lit(0), F.col("windows") + (LENGTH - 1)))
    copies = runs.join(judged, ["bucket", "content"])
    own = F.coalesce(F.col("other" if keep == NONE else "earlier"), F.array().cast("array<bigint>"))
    if keep == NONE:
        spans = F.when(F.col("copies") > 1, whole).otherwise(own)
    else:
        is_first = (F.col("line") == F.col("fl")) & (F.col("at") == F.col("fa"))
        spans = F.when(is_first, own).otherwise(whole)
    moved = F.transform(spans, lambda s: s + _span(F.col("at"), F.col("at")))
    per_line = copies.select("line", moved.alias("s")).groupBy("line").agg(
        F.flatten(F.collect_list("s")).alias("spans")
    )
    return table.select("line", "row"), per_line


def remove_repeats(df: DataFrame, text: str = "text", keep: str = FIRST) -> DataFrame:
    """(row, rest, n_removed, n_spans, sha): each row, the bytes of its text that stay, and their digest."""
    rows, spans = repeated_spans(df, text, keep)
    joined = rows.join(spans, "line", "left")
    done = joined.select("row", _cutter()(F.col(f"row.`{text}`").cast("binary"), F.col("spans")).alias("c"))
    return done.select("row", "c.rest", "c.n_removed", "c.n_spans", "c.sha")


def suffix_report(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, all copies removed."""
    done = remove_repeats(df.select("doc_id", "text"), keep=NONE)
    return done.select(
        "row.doc_id",
        F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_removed", "n_spans", F.col("sha").alias("kept_sha256"),
    )
