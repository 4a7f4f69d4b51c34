"""SentencePiece-style encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.bpe_arrays import SPACE, PairTable, PieceModel, blank_words, merge_all, piece_model, points_of, utf8_size
from netloom.llm.common import free_name, slices

MODEL = "piece_bpe_32k.model"
DROPOUT = 0.1
BITS = 40  # candidates up to which what an occurrence drops is a bit pattern; it stays below the words' numbers
REMEMBERED = 500_000  # pre-tokens a Python worker remembers before it starts anew
PART = 30_000  # occurrences whose drops are drawn at once
SEGMENTATIONS = 1_000_000  # segmentations it remembers before that

_MIX_A, _MIX_B, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = values.astype(np.uint64) + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def _spread(offsets: np.ndarray, merged: np.ndarray) -> np.ndarray:
    return mixed((offsets.astype(np.uint64) << np.uint64(32)) | merged.astype(np.uint64))


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all pre-tokens, the length of each, and the places of blank signs of the text itself.

    Those signs are kept apart from the blanks as U+10FFFF, which no piece holds: they become bytes.
    """
    points, sizes = points_of(words, " ")
    literal = points == ord(SPACE)
    return np.where(literal, 0x10FFFF, np.where(points == ord(" "), ord(SPACE), points)), sizes, literal


@lru_cache(maxsize=2)
def _prefix_tree(path: str) -> tuple[PairTable, np.ndarray]:
    """(node, character piece) -> node over the results of all merges, from node 0; and the piece that ends at a node, or -1."""
    model = piece_model(path)
    steps, ends = {}, {}
    for merged in set(model.joined.values()):
        node = 0
        for char in model.pieces[merged]:
            node = steps.setdefault((node, int(model.char_id[ord(char)])), len(steps) + 1)
        ends[node] = merged
    piece_of = np.full(len(steps) + 1, -1, np.int32)
    piece_of[list(ends)] = list(ends.values())
    return PairTable(steps), piece_of


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """`array` with room for `size` values, doubled as often as needed."""
    while size > len(array):
        array = np.concatenate((array, np.zeros_like(array)))
    return array


class Codec:
    """Encodes and decodes batches of texts.

    What is remembered never decides a result: a segmentation is kept under its
    pre-token and a set of dropped candidates, with the candidates that its run
    merged. An occurrence that drops all of that set and nothing that the run
    merged gives the same run: at every step the best candidate is one it keeps.
    """

    def __init__(self, path: str, seed: int, dropout: float):
        if not 0 <= dropout < 1:
            raise ValueError("dropout must be at least 0 and below 1")
        self.model: PieceModel = piece_model(path)
        self.seed = np.uint64(seed & (2**64 - 1))
        self.bound = np.uint64(int(dropout * 2**64))
        if self.bound:
            self.tree, self.piece_of = _prefix_tree(path)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        # Candidate merges of each pre-token: their number, where they start, and the place, size in characters and hash of all.
        self.many, self.start = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.place, self.wide, self.spread = (np.zeros(1 << 18, t) for t in (np.int32, np.int32, np.uint64))
        self.spreads = 0
        # The segmentation of each pre-token that drops nothing.
        self.base = np.zeros(1 << 16, np.int64)
        # Others: pre-token << BITS | dropped candidates, sorted, and the number of each.
        self.keys, self.numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Segmentations: where the ids start, how many, and the merged candidates as bits.
        self.at, self.size, self.merges = (np.zeros(1 << 16, np.int64) for _ in range(3))
        self.cuts = 0
        self.ids, self.used = np.zeros(1 << 18, np.int32), 0

    def _draw(self, keys, spread) -> np.ndarray:
        return mixed(keys ^ spread) < self.bound

    def _dropped(self, keys, offsets, merged) -> np.ndarray:
        return self._draw(keys, _spread(offsets, merged))

    def _meet(self, words: list[str]) -> None:
        """Number new pre-tokens, list their candidates and segment them without a drop."""
        first = len(self.number)
        self.number.update(zip(words, range(first, first + len(words))))
        self.names += words
        self.many, self.start, self.base = (_room(x, len(self.number)) for x in (self.many, self.start, self.base))
        if not words:
            return
        if self.bound:
            self._list(words, first)
        fresh = np.arange(first, len(self.number))
        self.base[fresh] = self._learn(fresh, np.zeros(len(words), np.int64))

    def _list(self, words: list[str], first: int) -> None:
        """List the candidates: every place where a piece of two or more characters stands."""
        points, sizes, _ = _symbols(words)
        chars = self.model.char_id[points]
        ends = np.repeat(np.cumsum(sizes), sizes)
        node = self.tree.find(np.zeros(len(chars), np.int64), chars)
        at, size = np.flatnonzero(node >= 0), 1
        node = node[at]
        places, pieces, wide = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        while len(at):
            whole = self.piece_of[node] >= 0
            places.append(at[whole])
            pieces.append(self.piece_of[node[whole]])
            wide.append(np.full(len(pieces[-1]), size, np.int32))
            on = at + size < ends[at]
            at = at[on]
            node = self.tree.find(node[on], chars[at + size])
            at, node, size = at[node >= 0], node[node >= 0], size + 1
        place, piece = np.concatenate(places), np.concatenate(pieces)
        order = np.argsort(place, kind="stable")
        place, piece, wide = place[order], piece[order], np.concatenate(wide)[order]
        owner = np.repeat(np.arange(len(words)), sizes)[place]
        many = np.bincount(owner, minlength=len(words))
        self.many[first : len(self.number)] = many
        self.start[first : len(self.number)] = self.spreads + np.cumsum(many) - many
        place -= (np.cumsum(sizes) - sizes)[owner]
        self.place, self.wide, self.spread = (_room(x, self.spreads + len(piece)) for x in (self.place, self.wide, self.spread))
        new = slice(self.spreads, self.spreads + len(piece))
        self.place[new], self.wide[new], self.spread[new] = place, wide, _spread(place, piece)
        self.spreads += len(piece)

    def _candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All candidates of some pre-tokens: whose each is, its place in the lists, and its number in the pre-token."""
        many = self.many[words]
        begins = np.cumsum(many) - many
        owner = np.repeat(np.arange(len(words)), many)
        nth = np.arange(len(owner)) - begins[owner]
        return owner, self.start[words][owner] + nth, nth

    def _patterns(self, words: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each occurrence drops, as bits (the last bit for pre-tokens with too many candidates), and which are such."""
        many = self.many[words]
        ends = np.cumsum(many)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), many)
        pick = np.arange(len(owner)) + (self.start[words] - (ends - many))[owner]
        hits = np.flatnonzero(self._draw(keys[owner], self.spread[pick]))
        owner = owner[hits]
        wide = many > BITS
        bit = np.where(wide[owner], 0, hits - (ends - many)[owner])
        # Sums of different powers below 2 ** BITS are exact.
        drops = np.bincount(owner, weights=np.ldexp(1.0, bit), minlength=len(words))
        return np.where(wide, 0, drops).astype(np.int64), wide & (drops > 0)

    def _learn(self, words: np.ndarray, drops: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
        """Segment pre-tokens: the agenda of each runs without the candidates of `drops`, or those its key drops.

        Returns the numbers of the segmentations.
        """
        points, sizes, literal = _symbols([self.names[k] for k in words.tolist()])
        begins = np.cumsum(sizes) - sizes
        many, done = self.many[words], []
        short = (many > 0) & (many <= BITS)
        if keys is not None:
            symbols, survivors = merge_all(self.model, points, sizes, keys, self._dropped)
        else:
            owner, pick, nth = self._candidates(np.where(short, words, words[0])[short])
            rows = np.flatnonzero(short)[owner]
            lost = (drops[rows] >> nth & 1).astype(bool)
            gone = np.sort((begins[rows] + self.place[pick])[lost] << 32 | self.wide[pick][lost])
            touched = np.zeros(len(points) + 1, bool)
            touched[gone >> 32] = True

            def left_out(starts, offsets, merged):
                at = starts.astype(np.int64) + offsets
                out = touched[at]
                near = np.flatnonzero(out)
                seek = at[near] << 32 | self.model.piece_chars[merged[near]]
                out[near] = gone[np.searchsorted(gone, seek).clip(max=len(gone) - 1)] == seek
                return out

            how = (begins.astype(np.uint64), left_out) if len(gone) else ()
            symbols, survivors = merge_all(self.model, points, sizes, *how, done=done if len(owner) else None)
        merges = np.zeros(len(words), np.int64)
        if done:
            # Candidates are sorted by place, then size, as their codes are.
            codes = (begins[rows] + self.place[pick]) << 32 | self.wide[pick]
            at, merged = (np.concatenate(x) for x in zip(*done))
            codes_done = at << 32 | self.model.piece_chars[merged]
            found = np.searchsorted(codes, codes_done).clip(max=len(codes) - 1)
            taken = np.zeros(len(codes), bool)
            taken[found[codes[found] == codes_done]] = True
            bits = np.bincount(rows[taken], weights=np.ldexp(1.0, nth[taken]), minlength=len(words))
            merges = bits.astype(np.int64)
        # U+10FFFF stands for the literal sign while merging; the order of characters is unchanged.
        points_left = -1 - symbols
        loose = symbols < 0
        if literal.any():
            places = np.flatnonzero(literal | (self.model.char_id[points] < 0))  # no pieces, so they never merge
            points_left[loose] = np.where(literal[places], ord(SPACE), points[places])
        widths = np.where(loose, utf8_size(points_left), 1)
        ends = np.cumsum(widths)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        begins = ends - widths
        out[begins[~loose]] = symbols[~loose]
        for point in np.unique(points_left[loose]).tolist():
            here = begins[loose & (points_left == point)]
            for k, byte in enumerate(chr(point).encode("utf-8", "surrogatepass")):
                out[here + k] = self.model.byte_id[byte]
        owner = np.repeat(np.arange(len(words)), survivors)
        sizes_out = np.bincount(owner, weights=widths, minlength=len(words)).astype(np.int64)
        self.ids = _room(self.ids, self.used + len(out))
        self.ids[self.used : self.used + len(out)] = out
        new = slice(self.cuts, self.cuts + len(words))
        self.at, self.size, self.merges = (_room(x, new.stop) for x in (self.at, self.size, self.merges))
        self.at[new], self.size[new], self.merges[new] = self.used + np.cumsum(sizes_out) - sizes_out, sizes_out, merges
        self.used += len(out)
        self.cuts = new.stop
        return np.arange(new.start, new.stop)

    def _segmented(self, words: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The number of each occurrence's segmentation."""
        out = self.base[words]
        if not self.bound:
            return out
        # A part at a time, so that its candidates stay in the cache.
        parts = [self._patterns(words[k : k + PART], keys[k : k + PART]) for k in range(0, len(words), PART)]
        drops, alone = (np.concatenate(x) for x in zip(*parts))
        if alone.any():
            out[alone] = self._learn(words[alone], drops[alone], keys[alone])
        # A run that merged what an occurrence drops is followed by the one that drops this, too.
        left = np.flatnonzero(drops & self.merges[out])
        lost = drops[left] & self.merges[out[left]]
        while len(left):
            kinds, kind = np.unique(words[left] << BITS | lost, return_inverse=True)
            at = np.searchsorted(self.keys, kinds)
            known = np.append(self.keys, -1)[at] == kinds
            found = np.empty(len(kinds), np.int64)
            found[known] = self.numbers[at[known]]
            fresh = kinds[~known]
            if len(fresh):
                found[~known] = self._learn(fresh >> BITS, fresh & ((1 << BITS) - 1))
                self.keys, self.numbers = np.insert(self.keys, at[~known], fresh), np.insert(self.numbers, at[~known], found[~known])
            out[left] = found[kind]
            more = drops[left] & self.merges[out[left]]
            left, lost = left[more > 0], (lost | more)[more > 0]
        return out

    def encode(self, texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        if len(self.number) > REMEMBERED or max(self.cuts, self.used // 4, self.spreads // 8) > SEGMENTATIONS:
            self._forget()
        split = [blank_words(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        if not counts.sum():
            return np.zeros(0, np.int32), counts
        listed = pa.array(list(chain.from_iterable(split)), pa.string()).dictionary_encode()
        different = listed.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._meet([w for w in different if w not in self.number])
        numbers = np.fromiter(map(self.number.__getitem__, different), np.int64, len(different))
        words = numbers[listed.indices.to_numpy(zero_copy_only=False)]
        place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
        drawn = mixed(np.repeat(mixed(keys.astype(np.uint64) ^ self.seed), counts) + place.astype(np.uint64))
        slots = self._segmented(words, drawn)
        sizes = self.size[slots]
        ends = np.cumsum(sizes)
        pick = np.arange(ends[-1]) + np.repeat(self.at[slots] - (ends - sizes), sizes)
        per_text = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return self.ids[pick], np.diff(per_text)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each text; the leading blank that encoding adds is taken off."""
        sizes = self.model.piece_size[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        pick = np.arange(total) + np.repeat(self.model.piece_at[ids] - (ends - sizes), sizes)
        data = self.model.piece_bytes[pick].tobytes()
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [data[a + 1 : b] if b > a else b"" for a, b in zip(cuts, cuts[1:])]


_codecs: dict[tuple, Codec] = {}


def codec(*settings) -> Codec:
    """The codec of some settings, kept by the Python worker."""
    if settings not in _codecs:
        _codecs.clear()
        _codecs[settings] = Codec(*settings)
    return _codecs[settings]


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))


def encode(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    seed: int = 7,
    dropout: float = DROPOUT,
    model_path: str | None = None,
    ids: str = "token_ids",
    lossless: str | None = None,
) -> DataFrame:
    """Add the token ids of each text under merge-dropout.

    Pre-tokens are segmented with an agenda ordered by rank, then from the left.
    A candidate merge is skipped when the keyed hash of (seed, `key`, place of the
    pre-token in the text, offset, merged piece) falls below `dropout`, so every
    occurrence of a word has draws of its own, and other seeds give others.
    The result depends on nothing else: a lost task gives the same ids again.
    With `dropout` 0 the ids are those of the library, but for texts that hold
    U+2581 itself, which becomes bytes here so that decoding gives it back.

    A null or empty text has an empty list, and a null key is a key like others.
    Columns called `ids` or `lossless` are replaced. `lossless` names a flag:
    the ids decode to exactly the text.
    """
    path = model_path or public_tokenizers.path(MODEL)
    drawn = free_name(df, "draw")
    kept = df.drop(ids, *([lossless] if lossless else [])).withColumn(drawn, F.xxhash64(key))
    fields = [f for f in kept.schema.fields if f.name != drawn]
    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if lossless:
        added.append(T.StructField(lossless, T.BooleanType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, seed, dropout)
        for part in slices(batches, text, 2_000_000):
            texts = part.column(text).to_pylist()
            keys = part.column(drawn).to_numpy(zero_copy_only=False).view(np.uint64)
            found, counts = tool.encode(texts, keys)
            columns = [part.column(f.name) for f in fields] + [_lists(found, counts)]
            if lossless:
                back = tool.decode(found, counts)
                columns.append(pa.array([(t or "").encode() == b for t, b in zip(texts, back)]))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields] + [f.name for f in added])

    return kept.mapInArrow(run, T.StructType(fields + added))


def decode(df: DataFrame, ids: str = "token_ids", name: str = "text", model_path: str | None = None) -> DataFrame:
    """Add the text of each list of ids; whatever the dropout was, it is the encoded text. Null stays null."""
    path = model_path or public_tokenizers.path(MODEL)
    kept = df.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, 0, 0.0)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column(ids)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                counts = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
                texts = [b.decode("utf-8", "replace") for b in tool.decode(flat, counts)]
                known = [t if valid else None for t, valid in zip(texts, lists.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(known, pa.string())], names=[*part.schema.names, name]
                )

    return kept.mapInArrow(run, schema)
