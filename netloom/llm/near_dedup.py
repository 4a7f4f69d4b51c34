"""Near duplicates by bottom-k sketches of one hash function."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import written
from netloom.llm.graph import components
from netloom.llm.sentencepiece_codec import mixed

KEPT = 64  # values of a first sketch
WIDE = 512  # values of the sketch of a text that passed the first
# Two texts of similarity 0.8 share about 51 of the 64 (410 of the 512) smallest
# values of their union. Fewer than these, five standard deviations below, happen
# to less than one pair in a million; sets that fit into a sketch are exact.
LEAST_SHARED = {KEPT: 32, WIDE: 362}
SLACK = 45  # values by which the overlap of two wide sketches can stay below its mean, likewise
PERCENT = 80
SLICE = 2_000_000  # bytes handled at once inside a task
BEFORE = 8  # values before a list's own that a member carries, see `_first_meeting`
FIRST_PIVOTS, MORE = 1, 4  # pivots of a list in the second round, and the factor of each further one

_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9D39247E33776D41)
_SIGN = np.uint64(1 << 63)
_PLACES = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every lower-cased word, and the number of words of each text.

    `starts` are the texts' offsets in `data`, with the end as the last.
    """
    inside = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    begins = np.flatnonzero(first)
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(starts) - 1, np.int64)
    place = np.flatnonzero(inside)
    word = np.cumsum(first)[place] - 1
    within = place - begins[word]
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(within.max()), _BASE, np.uint64))))
    values = _LOWER[data[place]] * powers[within]
    sizes = np.bincount(word)
    sums = np.add.reduceat(values, np.cumsum(sizes) - sizes)
    return mixed(sums + mixed(sizes.astype(np.uint64))), np.diff(np.searchsorted(begins, starts))


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the runs of `width` words, ascending; fewer words are one run."""
    if not len(words):
        return words
    run = min(width, len(words))
    total = np.zeros(len(words) - run + 1, np.uint64)
    for k in range(run):
        total += words[k : len(words) - run + 1 + k] * _PLACES[k]
    return np.unique(mixed(total + np.uint64(run)))


def shingle_sets(texts: pa.Array, width: int):
    """The set of every text of a binary column, one after the other; null and blank texts have none."""
    column = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        starts = offsets[row : stop + 1]
        words, counts = _word_hashes(flat[starts[0] : starts[-1]], starts - starts[0])
        ends = np.cumsum(counts)
        for a, b in zip(ends - counts, ends):
            yield _shingles(words[a:b], width)
        row = stop


def _signed(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as longs of the same order."""
    return (values ^ _SIGN).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _sketcher(width: int, kept: int):
    @F.arrow_udf("struct<n: bigint, f1: bigint, f2: bigint, sketch: array<bigint>>")
    def sketch(texts: pa.Array) -> pa.Array:
        size, one, two, low = [], [], [], []
        for found in shingle_sets(texts, width):
            size.append(len(found))
            one.append(mixed(found).sum(dtype=np.uint64).view(np.int64))
            two.append(mixed(found ^ _BASE).sum(dtype=np.uint64).view(np.int64))
            low.append(_signed(found[:kept]))
        longs = [pa.array(np.array(x, np.int64)) for x in (size, one, two)]
        return pa.StructArray.from_arrays([*longs, _lists(low)], names=["n", "f1", "f2", "sketch"])

    return sketch


def _set_maker(width: int):
    @F.arrow_udf("array<bigint>")
    def sets(texts: pa.Array) -> pa.Array:
        return _lists([_signed(found) for found in shingle_sets(texts, width)])

    return sets


def _needed(n: str, kept: int) -> Column:
    """Values that the sketches of two linked texts share at least, by the size of one set."""
    return F.least(F.ceil(F.col(n) * PERCENT / 100), F.lit(LEAST_SHARED[kept])).cast("int")


def _alike(x: str, y: str) -> Column:
    """The sizes of two sets allow the similarity."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * PERCENT


def _enough(meet: Column, x: Column, y: Column) -> Column:
    """Sets of sizes x and y with `meet` common values have the similarity."""
    return meet * 100 >= (x + y - meet) * PERCENT


def _overlap(x: Column, y: Column) -> Column:
    """Values that the wide sketches of two linked sets of sizes x and y share at least."""
    meet = F.ceil((x + y) * PERCENT / (100 + PERCENT))
    larger = F.greatest(x, y)
    return F.when(larger <= WIDE, meet).otherwise(meet * WIDE / larger - SLACK)


class _Candidates:
    """Distinct sets that can have a partner, their sketches, inverted lists and full sets."""

    def __init__(self, table: DataFrame, classes: DataFrame, text: str, width: int):
        reps = table.select("line", "s.n", "s.sketch").join(classes.select(F.col("rep").alias("line")), "line")
        narrow = reps.select("line", F.explode("sketch").alias("value"))
        common = narrow.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        passed = (
            narrow.join(common.select("value"), "value").groupBy("line").agg(F.count(F.lit(1)).alias("shared"))
            .join(reps.select("line", "n"), "line").where(F.col("shared") >= _needed("n", KEPT)).select("line", "n")
        )
        data = table.select("line", F.col(f"row.`{text}`").cast("binary").alias("data")).join(passed, "line")
        self.sets = written(data.select("line", "n", _set_maker(width)("data").alias("items")), "near-sets")
        self.live = written(self._prefixes(), "near-live")

    def _prefixes(self) -> DataFrame:
        """Per set: size, number of common values in its sketch, and the values of its inverted lists.

        Common values are ordered by frequency, rare ones first. Two linked sets
        share one of their first spare + 1 common values.
        """
        wide = self.sets.select("line", F.explode(F.slice("items", 1, WIDE)).alias("value"))
        common = wide.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        shared = (
            wide.join(common, "value").groupBy("line")
            .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"), F.sum("df").alias("weight"))
            .join(self.sets.select("line", "n"), "line")
            .withColumn("spare", F.size("shared") - _needed("n", WIDE))
            .where("spare >= 0")
        )
        prefix = F.transform(F.slice("shared", 1, F.col("spare") + 1), lambda x: x["value"])
        return shared.select("line", "n", F.size("shared").alias("common"), "weight", prefix.alias("prefix"))

    def lists(self) -> DataFrame:
        """(value, line, n, weight, room, before) of the inverted lists.

        room is how many common values stand at or after this one, before the few
        right ahead of it.
        """
        at = self.live.select("line", "n", "weight", "common", "prefix", F.posexplode("prefix").alias("at", "value"))
        length = F.least("at", F.lit(BEFORE))
        before = F.slice("prefix", F.col("at") - length + 1, length)
        return at.select("value", "line", "n", "weight", (F.col("common") - F.col("at")).alias("room"), before.alias("before"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (line, pivot) whose full sets have the similarity, as links (a, b)."""
        pairs = pairs.select(F.least("line", "pivot").alias("a"), F.greatest("line", "pivot").alias("b")).distinct()
        sketch = self.sets.select("line", F.slice("items", 1, KEPT).alias("sketch"))
        both = pairs.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b")
        union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, KEPT)
        hit = F.array_intersect("sa", "sb")
        near = both.withColumn("union", union)
        near = near.where(F.size(F.array_intersect("union", hit)) * KEPT >= F.size("union") * LEAST_SHARED[KEPT])
        near = written(near.select("a", "b"), "near-pairs")
        items = self.sets.select("line", "items")
        full = near.join(items.toDF("a", "xa"), "a").join(items.toDF("b", "xb"), "b")
        meet = F.size(F.array_intersect("xa", "xb"))
        return written(full.where(_enough(meet, F.size("xa"), F.size("xb"))).select("a", "b"), "near-links")


def _possible() -> Column:
    """A member and a pivot of a list can be linked and have no earlier value in common.

    Two sets with `_overlap` common values share one that has at least so many at
    or after it in both; only in the list of such a value must they meet.
    """
    x, y = F.col("n"), F.col("pn")
    return _alike("n", "pn") & (F.least("room", "pr") >= _overlap(x, y))


def _first_meeting() -> Column:
    """A member and a pivot of a list are not known to have met in an earlier list.

    Near copies share most of their values, so they stand together in many lists.
    They must be compared in that of their first common value only; one among the
    values right ahead of this one shows that this is not it.
    """
    return ~F.arrays_overlap("before", "pb")


def _feasible(lists: DataFrame) -> DataFrame:
    """Members that can be linked with some member of their list, by sizes and room."""
    ends = lists.groupBy("value").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("members")
    )
    n = F.col("n")
    low = F.greatest("low", F.ceil(n * PERCENT / 100))
    high = F.least("high", F.floor(n * 100 / PERCENT))
    can = F.col("room") >= F.least(_overlap(n, low), _overlap(n, high))
    return lists.join(ends.where("members > 1"), "value").where(can).drop("low", "high", "members")


def _links(found: _Candidates) -> DataFrame:
    """Links that leave the components of all linked pairs as they are.

    First each list compares its members with one pivot, the set with the most
    common values. A list whose members are then in one component is done. In
    any other, members outside its largest component are compared with all
    members of other components, more of them each round, until none is left:
    every pair is then compared in the list of its first common value or already
    in one component.
    """
    lists = _feasible(found.lists())
    top = lists.groupBy("value").agg(
        F.max(F.struct("weight", F.col("line").alias("pivot"), F.col("n").alias("pn"), F.col("room").alias("pr"))).alias("top"),
        F.count(F.lit(1)).alias("members"),
    )
    top = top.where("members > 1").select("value", "top.pivot", "top.pn", "top.pr")
    open_ = written(lists.join(top, "value").where("line <> pivot"), "near-lists")
    links = found.verified(open_.where(_possible()).select("line", "pivot"))
    open_ = open_.drop("pivot", "pn", "pr")
    pivots = FIRST_PIVOTS
    while True:
        label = components(links)
        named = _feasible(open_).join(label.withColumnRenamed("node", "line"), "line", "left")
        named = named.withColumn("label", F.coalesce("label", "line"))
        sizes = named.groupBy("value", "label").agg(F.count(F.lit(1)).alias("size"))
        main = (
            sizes.groupBy("value")
            .agg(F.max(F.struct("size", "label")).alias("main"), F.count(F.lit(1)).alias("parts"))
            .where("parts > 1")
            .select("value", F.col("main.label").alias("main"))
        )
        named = written(named.join(main, "value"), "near-lists")
        if named.isEmpty():
            return links
        order = Window.partitionBy("value").orderBy(F.desc("weight"), "line")
        chosen = (
            named.where("label <> main").withColumn("k", F.row_number().over(order)).where(F.col("k") <= pivots)
            .select(
                "value", F.col("line").alias("pivot"), F.col("n").alias("pn"), F.col("room").alias("pr"),
                F.col("label").alias("pl"), F.col("before").alias("pb"),
            )
        )
        chosen = written(chosen, "near-pivots")
        pairs = named.join(chosen, "value").where((F.col("label") != F.col("pl")) & _possible() & _first_meeting())
        links = links.unionByName(found.verified(pairs.select("line", "pivot")))
        used = chosen.select("value", F.col("pivot").alias("line"))
        open_ = named.select("value", "line", "n", "weight", "room", "before").join(used, ["value", "line"], "left_anti")
        pivots *= MORE


def group(
    df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5
) -> tuple[DataFrame, DataFrame]:
    """(rows as `line` and `row`, their groups: line, id, n, label) of near duplicates.

    Words are what lies between blanks (space, tab to carriage return), A-Z in
    lower case; a text's set is its distinct runs of `width` words, or all its
    words as one run if it has fewer. Two texts are linked when their sets have
    a Jaccard similarity of at least 0.8; equal sets are one node. A label is
    the same for all rows that links connect. Null, empty and blank texts have
    no set and are in no group. Every row is a node of its own, so repeated rows
    and null keys are allowed.

    Only sets that share half of their sketch with other sets go on, so no text
    is dropped by a cap; see LEAST_SHARED for what a sketch can miss. Shingles
    are compared by 64-bit hashes.
    """
    base = df.select(
        F.monotonically_increasing_id().alias("line"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        _sketcher(width, KEPT)(F.col(text).cast("binary")).alias("s"),
    )
    table = written(base, "near-rows", compression="zstd")
    prints = table.select("line", F.col(f"row.`{key}`").alias("id"), "s.n", "s.f1", "s.f2")
    same = ["n", "f1", "f2"]
    classes = written(
        prints.where("n > 0").groupBy(*same).agg(F.min("line").alias("rep"), F.count(F.lit(1)).alias("copies")),
        "near-classes",
    )
    links = _links(_Candidates(table, classes, text, width))
    labels = components(links).withColumnRenamed("node", "rep")
    rep = classes.join(labels, "rep", "left").select(*same, F.coalesce("label", "rep").alias("label"))
    grouped = prints.join(rep, same, "left").select("line", "id", "n", "label")
    return table.select("line", "row"), grouped


def near_report(df: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    _, groups = group(df.select("doc_id", "text"), width=width)
    smallest = groups.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("least"))
    joined = groups.join(smallest, "label", "left")
    component = F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("least"))
    return joined.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def drop_near_copies(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5) -> DataFrame:
    """One row of each group, that of the smallest key, and all rows in no group."""
    rows, groups = group(df, text, key, width)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "line")
    best = groups.where("label IS NOT NULL").groupBy("label").agg(F.min(order).alias("best"))
    gone = groups.join(best, "label").where(F.col("line") != F.col("best.line")).select("line")
    return rows.join(gone, "line", "left_anti").select("row.*")
