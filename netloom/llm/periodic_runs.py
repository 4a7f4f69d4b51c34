"""Periodic runs of words, found with string synchronising sets."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import free_name
from netloom.llm.exact_dedup import _views
from netloom.llm.sentencepiece_codec import mixed
from netloom.llm.suffix_dedup import _sliding_minimum

LEAST = 6  # words of a run
EXPONENT = 4  # periods of a run; the selection of positions relies on four
PLANTED = 10  # one in so many documents gets a repetition in the report
SLICE = 2_000_000  # bytes of text whose words are handled at once
_OUT = np.iinfo(np.uint64).max


def _extended(ids: np.ndarray, at: int, period: int, low: int, high: int) -> tuple[int, int]:
    """Widest stretch around `at` in [low, high) whose words equal those `period` later: its start and end."""
    right, step = at, 64
    while right + period < high:
        stop = min(right + step, high - period)
        differ = ids[right:stop] != ids[right + period : stop + period]
        if differ.any():
            right += int(differ.argmax())
            break
        right, step = stop, step * 2
    left, step = at, 64
    while left > low:
        stop = max(left - step, low)
        differ = ids[stop:left] != ids[stop + period : left + period]
        if differ.any():
            left -= int(differ[::-1].argmax())
            break
        left, step = stop, step * 2
    return left, right + period


def _periodic(runs: list[tuple[int, int, int]], scale: int, size: int) -> np.ndarray:
    """Places whose next `scale` words lie in a found run of at most a quarter of that as period."""
    edges = np.zeros(size + 1, np.int32)
    for start, end, period in runs:
        if period * EXPONENT <= scale <= end - start:
            edges[start] += 1
            edges[end - scale + 1] -= 1
    return np.cumsum(edges[:size]) > 0


def _selected(names: np.ndarray, omitted: np.ndarray, scale: int) -> np.ndarray:
    """Places chosen by hash: the smallest name among `scale` + 1 neighbours stands first or last of them.

    Whether a place is chosen depends on the 2 * `scale` words from it only.
    Within a stretch that is not highly periodic, every `scale` neighbours hold
    a chosen place. Omitted places have no name.
    """
    held = np.minimum(mixed(names ^ np.uint64(scale)), _OUT - np.uint64(1))
    held[omitted] = _OUT
    low = _sliding_minimum(held, scale + 1)
    return np.flatnonzero((low != _OUT) & ((low == held[: len(low)]) | (low == held[scale:])))


def word_runs(ids: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """All maximal runs (start, end, smallest period) of at least EXPONENT periods.

    `ids` numbers the words of several texts one after the other, `offsets` are
    the texts' starts, with the end as the last. Equal numbers are equal words.

    At scale t (1, 2, 4, ...) runs with periods from t to 2t - 1 are found. Names
    are hashes of the next t words, and a synchronising set of places is chosen
    from them. A run of four periods holds a chosen place among its first t, and
    the next place with the same 2t words is one period later, so equal contexts
    propose the period there. Each proposal is extended by comparing words. Places
    whose next t words have a period of at most t / 4 are omitted from the set;
    such stretches are runs of smaller scales, which supply these periods.
    """
    runs: list[tuple[int, int, int]] = []
    sizes = np.diff(offsets)
    place = np.arange(len(ids))  # where the words now looked at stand in `ids`
    text = np.repeat(np.arange(len(sizes)), sizes)
    names, scale = mixed(ids.astype(np.uint64)), 1
    while True:
        long = sizes[text] >= EXPONENT * scale
        if not long.all():
            place, text, names = place[long], text[long], names[long]
        if not len(place):
            return sorted(runs, key=lambda r: (r[0], r[2]))
        ends = offsets[text + 1]
        ahead = np.append(names[scale:], np.zeros(scale, np.uint64))
        contexts = mixed(names * np.uint64(3) + mixed(ahead))
        chosen = _selected(names, _periodic(runs, scale, len(ids))[place], scale)
        chosen = chosen[place[chosen] + 2 * scale <= ends[chosen]]
        order = chosen[np.argsort(contexts[chosen], kind="stable")]
        gap = order[1:] - order[:-1]
        close = (contexts[order[1:]] == contexts[order[:-1]]) & (gap >= scale) & (gap < 2 * scale)
        at, period = place[order[:-1][close]], gap[close]
        by_period = np.lexsort((at, period))
        seen, until = 0, -1
        for i, p in zip(at[by_period].tolist(), period[by_period].tolist()):
            if p == seen and i + p < until:
                continue
            k = int(np.searchsorted(offsets, i, "right")) - 1
            start, end = _extended(ids, i, p, int(offsets[k]), int(offsets[k + 1]))
            seen, until = p, end
            if end - start >= EXPONENT * p:
                runs.append((start, end, p))
        names, scale = contexts, 2 * scale


def _numbered(words: list[bytes]) -> np.ndarray:
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy() if words else np.zeros(0, np.int32)


def analysed(texts: list[list[bytes]], least: int = LEAST) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Per text, given as words: its runs (start, length, period), and the words that stay, joined by blanks."""
    offsets = np.cumsum([0, *map(len, texts)])
    ids = _numbered([w for words in texts for w in words])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs = [r for r in word_runs(ids, offsets) if r[1] - r[0] >= least]
    owner = np.searchsorted(offsets, [r[0] for r in runs], "right") - 1
    for (start, end, period), k in zip(runs, owner.tolist()):
        found[k].append((start - int(offsets[k]), end - start, period))
    out = []
    for words, own in zip(texts, found):
        if own:
            stays = np.ones(len(words), bool)
            for start, length, period in own:
                stays[start + period : start + length] = False
            words = [words[i] for i in np.flatnonzero(stays).tolist()]
        out.append((own, b" ".join(words)))
    return out


RUNS = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, n_words: bigint, rest: binary>"


def _finder(least: int, edit: Callable[[list[bytes], object], list[bytes]] | None):
    def results(texts: pa.Array, keys: list) -> pa.Array:
        done, counts = [], []
        held: list[list[bytes]] = []
        size = 0
        for view, key in zip(_views(texts), keys):
            words = view.tobytes().split()
            held.append(edit(words, key) if edit else words)
            size += len(view)
            if size >= SLICE:
                done += analysed(held, least)
                counts += map(len, held)
                held, size = [], 0
        done += analysed(held, least)
        counts += map(len, held)
        flat = np.array([r for runs, _ in done for r in runs], np.int64).reshape(-1, 3)
        rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(runs) for runs, _ in done]]), pa.int32()), rows)
        rest = pa.array([r for _, r in done], pa.binary())
        return pa.StructArray.from_arrays([lists, pa.array(counts, pa.int64()), rest], names=["runs", "n_words", "rest"])

    if edit is None:
        return F.arrow_udf(lambda texts: results(texts, [None] * len(texts)), RUNS)

    @F.arrow_udf(RUNS)
    def find(texts: pa.Array, keys: pa.Array) -> pa.Array:
        return results(texts, keys.to_pylist())

    return find


def find_runs(df: DataFrame, text: str = "text", into: str = "found", least: int = LEAST, edit=None, key: str | None = None) -> DataFrame:
    """Add the struct `into`: runs (start, length, period), n_words, and rest (binary) of every text.

    Words are what lies between blanks (space, tab to carriage return). A run is a
    stretch with a smallest period, at least EXPONENT periods and `least` words
    long, that no neighbouring word extends. Runs are ordered by start, then
    period. `rest` is what stays when each run keeps its first period only, joined
    by single blanks. Null, empty and blank texts have no words. `edit` changes
    the words of a row before, given the value of its column `key`.
    """
    raw = F.col(text).cast("binary")
    finder = _finder(least, edit)
    return df.withColumn(into, finder(raw) if edit is None else finder(raw, F.col(key).cast("string")))


def planted(words: list[bytes], key: str | None) -> list[bytes]:
    """The words with a repetition in one of PLANTED documents, placed by the checksum of the id; none for a null id."""
    if not words or key is None:
        return words
    h = zlib.crc32(key.encode())
    if h % PLANTED:
        return words
    g, n = h // PLANTED, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def _strongest(runs: Column) -> Column:
    """The run with the greatest length / period, of equal ones the first; null without runs."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    start = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, start, lambda best, r: F.when(better(best, r), r).otherwise(best))


def runs_report(df: DataFrame, least: int = LEAST) -> DataFrame:
    """Runs of every document, with a repetition planted in some by their id.

    doc_id, n_runs, start, length, period and exponent_milli of the strongest run
    (null without one), and the digests runs_sha256 and collapsed_sha256. Each row
    is judged by itself, so repeated rows and null ids (nothing is planted there)
    have their own results.
    """
    into = free_name(df, "found")
    found = find_runs(df.select("doc_id", "text"), into=into, least=least, edit=planted, key="doc_id")
    lines = F.transform(f"{into}.runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = found.select(
        "doc_id", F.size(f"{into}.runs").cast("long").alias("n_runs"), _strongest(F.col(f"{into}.runs")).alias("best"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(f"{into}.rest", 256).alias("collapsed_sha256"),
    )
    exact = F.expr("best.length * 1000 div best.period")
    return best.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", exact.alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )
