"""Language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import free_name, slices

UNDETERMINED = "und"
DIMENSIONS = 1024
GRAM = 3
PER_LABEL = 400  # texts of each label that a profile learns from
SURE = 0.1  # cosine from which a missing language is filled; unrelated vectors have a spread of 0.03
MAX_LABELS = 1000
SALTS = 64  # parts of a label whose first keys are chosen apart
SCALE = 1 << 20  # profile sums are integers of this resolution, so their order does not matter
SLICE = 1_000_000  # characters handled at once
GRAMS_KEPT = 40_000  # n-gram vectors a Python worker remembers before it starts anew
_DENSE = 128  # letters whose trigrams are found by direct addressing


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)


class Space:
    """Random letter vectors, and the n-gram vectors bound from them so far."""

    def __init__(self, dimensions: int, gram: int, seed: int):
        self.dimensions, self.gram, self.seed = dimensions, gram, seed
        self.letter_at = np.full(0x110000, -1, np.int32)
        self.letters: list[np.ndarray] = []
        self.forget()

    def forget(self) -> None:
        self.vectors = np.zeros((1024, self.dimensions), np.int8)
        self.known = 0
        self.dense = np.full(_DENSE**3, -1, np.int32) if self.gram == 3 else None
        self.sparse: dict[int, int] = {}

    def letter_numbers(self, points: np.ndarray) -> np.ndarray:
        numbers = self.letter_at[points]
        if (numbers < 0).any():
            for point in np.unique(points[numbers < 0]).tolist():
                self.letter_at[point] = len(self.letters)
                bits = np.random.default_rng([self.seed, point]).integers(0, 2, self.dimensions)
                self.letters.append((2 * bits - 1).astype(np.int8))
            numbers = self.letter_at[points]
        return numbers

    def _bind(self, numbers) -> int:
        """Vector of one n-gram: each letter vector rotated by its distance to the end, multiplied together."""
        vector = np.ones(self.dimensions, np.int8)
        for k, number in enumerate(numbers):
            vector = vector * np.roll(self.letters[number], self.gram - 1 - k)
        if self.known == len(self.vectors):
            self.vectors = np.concatenate((self.vectors, np.zeros_like(self.vectors)))
        self.vectors[self.known] = vector
        self.known += 1
        return self.known - 1

    def gram_numbers(self, columns: list[np.ndarray]) -> np.ndarray:
        """Row in `vectors` of each n-gram, given its letters as one array per place."""
        if self.dense is not None and max(c.max() for c in columns) < _DENSE:
            codes = (columns[0] * _DENSE + columns[1]) * _DENSE + columns[2]
            found = self.dense[codes]
            if (found < 0).any():
                for code in np.unique(codes[found < 0]).tolist():
                    rest, last = divmod(code, _DENSE)
                    self.dense[code] = self._bind([*divmod(rest, _DENSE), last])
                found = self.dense[codes]
            return found
        stacked, inverse = np.unique(np.stack(columns, 1), axis=0, return_inverse=True)
        rows = []
        for numbers in map(tuple, stacked.tolist()):
            if numbers not in self.sparse:
                self.sparse[numbers] = self._bind(numbers)
            rows.append(self.sparse[numbers])
        return np.array(rows, np.int64)[inverse.ravel()]

    def profile(self, texts: list[str]) -> np.ndarray:
        """Bundled vector of each text: the sum of the vectors of its n-grams, words parted by a blank letter."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        if self.known > GRAMS_KEPT:
            self.forget()
        group: list[tuple[int, str]] = []
        size = 0
        for row, text in enumerate(texts):
            for piece in _pieces(text):
                if size + len(piece) > SLICE and group:
                    self._add(out, group)
                    group, size = [], 0
                group.append((row, piece))
                size += len(piece)
        if group:
            self._add(out, group)
        return out

    def _add(self, out: np.ndarray, group: list[tuple[int, str]]) -> None:
        lowered = [f"\n{piece.lower()}\n" for _, piece in group]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        owner = np.repeat(np.arange(len(lowered), dtype=np.int32), sizes)
        letter = _is_letter()[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[np.cumsum(sizes) - sizes] = True
        points = np.where(letter, points, 0)[keep]
        owner = owner[keep]
        span = self.gram - 1
        whole = np.flatnonzero(owner[:-span] == owner[span:]) if len(owner) > span else np.zeros(0, np.int64)
        if not len(whole):
            return
        numbers = self.letter_numbers(points)
        grams = self.gram_numbers([numbers[whole + k] for k in range(self.gram)])
        used = np.flatnonzero(np.bincount(grams, minlength=self.known))
        column = np.zeros(self.known, np.int64)
        column[used] = np.arange(len(used))
        cells = owner[whole].astype(np.int64) * len(used) + column[grams]
        counts = np.bincount(cells, minlength=len(group) * len(used)).reshape(len(group), len(used))
        bundled = counts.astype(np.float32) @ self.vectors[used].astype(np.float32)
        np.add.at(out, [row for row, _ in group], bundled)


def _pieces(text: str, size: int = SLICE // 2) -> Iterator[str]:
    """Cut a long text behind a character that is no letter, if one is near the end of the piece."""
    start = 0
    while len(text) - start > size:
        cut = next((k for k in range(start + size, start + size - 200, -1) if not text[k - 1].isalpha()), start + size)
        yield text[start:cut]
        start = cut
    yield text[start:]


_spaces: dict[tuple, Space] = {}


def _space(*settings) -> Space:
    """The vector space of some settings, kept by the Python worker."""
    if settings not in _spaces:
        _spaces.clear()
        _spaces[settings] = Space(*settings)
    return _spaces[settings]


@dataclass(frozen=True)
class Profiles:
    """Unit prototype vectors, one row per label in sorted order."""

    labels: list[str]
    matrix: np.ndarray
    dimensions: int
    gram: int
    seed: int


def fit(
    df: DataFrame,
    text: str = "text",
    label: str = "lang",
    key: str = "doc_id",
    where: Column | None = None,
    per_label: int = PER_LABEL,
    dimensions: int = DIMENSIONS,
    gram: int = GRAM,
    seed: int = 11,
) -> Profiles:
    """Learn one prototype per label from a bounded sample of labelled texts.

    The sample is the `per_label` rows of each label with the smallest keyed hash
    of `key`, among rows with text, key and label for which `where` holds. The
    prototypes are the sums of the sampled texts' unit vectors; there is one per
    label, and over MAX_LABELS labels are an error. No labelled row gives no labels.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(label).isNotNull() & F.col(key).isNotNull())
    rows = rows.where(where) if where is not None else rows
    rows = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(text).alias("text"))
    # Salted parts of a label come first, so that no task sees more of a frequent label than its part.
    chosen = rows.drop("text").withColumn("part", F.spark_partition_id() % SALTS)
    for group in (("label", "part"), ("label",)):
        first = Window.partitionBy(*group).orderBy(F.xxhash64("key", F.lit(seed)), "key")
        chosen = chosen.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_label).drop("n")
    chosen = chosen.drop("part")
    if rows.select("label").distinct().limit(MAX_LABELS + 1).count() > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    # At most per_label * MAX_LABELS keys.
    sample = rows.join(F.broadcast(chosen.distinct()), ["key", "label"], "left_semi").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = _space(dimensions, gram, seed)
        for part in slices(batches, "text"):
            vectors = space.profile(part.column("text").to_pylist())
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            units = np.rint(vectors / np.where(norms, norms, 1) * SCALE).astype(np.int64)
            labels = np.array(part.column("label").to_pylist(), object)
            for name in sorted(set(labels.tolist())):
                total = units[labels == name].sum(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["label", "total"]
                )

    sums = sample.mapInArrow(run, "label string, total array<bigint>")
    sums = sums.select("label", F.posexplode("total").alias("k", "v")).groupBy("label", "k").agg(F.sum("v").alias("v"))
    rows = (
        sums.groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("total"))
        .orderBy("label")
        .collect()
    )
    matrix = np.array([r["total"] for r in rows], np.float64).reshape(len(rows), dimensions)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return Profiles([r["label"] for r in rows], matrix / np.where(norms, norms, 1), dimensions, gram, seed)


def identify(
    df: DataFrame, profiles: Profiles, text: str = "text", name: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """Add the label whose prototype has the largest cosine with the text's vector, and that cosine.

    The whole text counts. The score is the cosine, at least 0. Equal cosines go
    to the first label. A text that is null or has no letter, or any text if no
    label was learned, is `und` with score 0. Columns called `name` or `score`
    are replaced.
    """
    kept = df.drop(name, score)
    schema = T.StructType(
        [*kept.schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())]
    )
    settings = (profiles.dimensions, profiles.gram, profiles.seed)
    labels = [*profiles.labels, UNDETERMINED]
    matrix = profiles.matrix.T.copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = _space(*settings)
        for part in slices(batches, text, 2 * SLICE):
            vectors = space.profile([t or "" for t in part.column(text).to_pylist()]).astype(np.float64)
            norms = np.linalg.norm(vectors, axis=1)
            if len(labels) > 1:
                cosines = vectors @ matrix / np.where(norms, norms, 1)[:, None]
                best = np.where(norms > 0, cosines.argmax(1), len(labels) - 1)
                scores = np.where(norms > 0, cosines.max(1), 0.0).clip(0, 1)
            else:
                best, scores = np.zeros(len(norms), int), np.zeros(len(norms))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([labels[k] for k in best.tolist()], pa.string()), pa.array(scores)],
                names=[*part.schema.names, name, score],
            )

    return kept.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the key's text modulo 4 is 2. A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; profiles come from the rest."""
    docs = df.select("doc_id", "text", "lang")
    profiles = fit(docs, where=~held_out())
    found = identify(docs.drop("lang"), profiles)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, least: float = SURE) -> DataFrame:
    """Rows with a letter; those without a language get the predicted one.

    A row stays whatever its cosine, since that of a very short text is near the
    noise; a null language is filled only where the cosine is `least` or more, and
    given languages are not changed. Rows whose text is null, empty or has no
    letter go. Without a labelled row nothing is learned, and all rows with a
    letter stay as they are. Repeated rows and null keys are rows like any other.
    """
    profiles = fit(df, where=~held_out())
    if not profiles.labels:
        return df.where(F.col("text").rlike(r"\p{L}"))
    names = free_name(df, "lang_pred"), free_name(df, "lang_score")
    found = identify(df, profiles, name=names[0], score=names[1]).where(F.col(names[0]) != UNDETERMINED)
    filled = F.coalesce("lang", F.when(F.col(names[1]) >= least, F.col(names[0])))
    return found.withColumn("lang", filled).drop(*names)
