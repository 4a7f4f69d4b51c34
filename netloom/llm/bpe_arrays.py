"""BPE piece models as numpy tables, and merging of many short sequences at once.

A model file lists pieces with scores. Two neighbouring symbols may merge when
their joined string is a piece; the pair with the best score merges first, the
leftmost of equals. Sequences of symbols are ragged: one flat array and the
start of each sequence.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np

SPACE = "▁"  # how piece models write a blank
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # piece types of the model format (fixed values)
NEVER = np.int32(2**31 - 1)  # rank of a pair that does not merge
LONG = 256  # symbols from which a sequence uses its own agenda instead of the shared rounds
NONE = 2**62  # no pair
_HASH = np.uint64(0x9E3779B97F4A7C15)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(field number, value) of a protocol-buffer message; sub-messages stay bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PairTable:
    """Open-addressing table from (left, right) symbols to the merged symbol."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(8, int(len(pairs) * 8).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.merged = np.full(size, -1, np.int32)
        for (left, right), merged in pairs.items():
            key = left << 32 | right
            at = self._home(np.array([key], np.int64))[0]
            while self.keys[at] >= 0:
                at = (at + 1) & (size - 1)
            self.keys[at], self.merged[at] = key, merged

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged symbol of each pair, or -1."""
        keys = left.astype(np.int64) << 32 | right
        at = self._home(keys)
        there = self.keys[at]
        found = np.where(there == keys, self.merged[at], -1)
        # Few places hold another pair; an empty one ends the search.
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            there = self.keys[at[todo]]
            same = there == keys[todo]
            found[todo[same]] = self.merged[at[todo[same]]]
            todo = todo[~same & (there >= 0)]
        return np.where((left < 0) | (right < 0), -1, found)


class PieceModel:
    """Pieces, scores and pair table of a `.model` file of BPE type with byte fallback."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            fields = list(_fields(file.read()))
        self.pieces, scores, types = [], [], []
        for number, value in fields:
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
                types.append(piece.get(3, NORMAL))
        normal = dict(_fields(next(v for n, v in fields if n == 3)))
        if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only models without normalisation and with a leading blank are supported")
        if set(types) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with user-defined or unused pieces are not supported")
        mergeable = {p: i for i, p in enumerate(self.pieces) if types[i] == NORMAL}
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in mergeable.values()}, reverse=True))}
        self.rank = np.full(len(self.pieces), NEVER, np.int32)
        for i in mergeable.values():
            self.rank[i] = order[scores[i]]
        self.byte_id = np.zeros(256, np.int32)
        for i, kind in enumerate(types):
            if kind == BYTE:
                self.byte_id[int(self.pieces[i][1:-1], 16)] = i
        self.char_id = np.full(0x110000, -1, np.int32)
        joined, inside = {}, set()
        for piece, i in mergeable.items():
            if len(piece) == 1:
                self.char_id[ord(piece)] = i
            inside.update((ord(a) << 32) | ord(b) for a, b in zip(piece, piece[1:]))
            for cut in range(1, len(piece)):
                left, right = mergeable.get(piece[:cut]), mergeable.get(piece[cut:])
                if left is not None and right is not None:
                    joined[left, right] = i
                elif (cut == 1 and left is None) or (len(piece) - cut == 1 and right is None):
                    raise ValueError("a character of a piece is not a piece itself")
        self.joined = joined
        self.pairs = PairTable(joined)
        self.inside = np.array(sorted(inside), np.int64)
        blobs = []
        for i, kind in enumerate(types):
            text = self.pieces[i]
            blobs.append(bytes([int(text[1:-1], 16)]) if kind == BYTE else text.replace(SPACE, " ").encode())
        self.piece_bytes = np.frombuffer(b"".join(blobs), np.uint8)
        self.piece_size = np.array([len(b) for b in blobs], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.piece_chars = np.array([len(p) for p in self.pieces], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbol and its rank for each pair."""
        merged = self.pairs.find(left, right)
        return merged, np.where(merged >= 0, self.rank[merged], NEVER)


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    """The model of a path, once per process."""
    return PieceModel(path)


def points_of(words: list[str], lead: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in one array, each word behind `lead`, and their lengths with it."""
    joined = lead + lead.join(words) if words else ""
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    return points, np.fromiter(map(len, words), np.int64, len(words)) + len(lead)


def utf8_size(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)


def _never_dropped(keys, offsets, merged):
    return np.zeros(len(merged), bool)


def merge_all(model: PieceModel, points, sizes, keys=None, dropped=_never_dropped, plain=True, done=None):
    """Merge every sequence to the end.

    `points` and `sizes` are ragged code points. `dropped(keys, offsets, merged)`
    tells which candidate merges are skipped, from the key of the sequence, the
    offset of the pair's first character and the merged symbol. With `plain`,
    U+2581 in a word is the blank symbol. Returns the surviving symbols (a piece
    id, or -1 - code point where a character is no piece) and the count of each
    sequence. Long sequences are first cut where no piece has the two
    neighbouring characters. Pairs of arrays with the place in `points` and the
    merged symbol of all merges made are appended to the list `done`.
    """
    keys = np.zeros(len(sizes), np.uint64) if keys is None else keys
    symbols = model.char_id[points]
    symbols = np.where(symbols < 0, -1 - points, symbols)
    if not len(points):
        return symbols, sizes.copy()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.zeros(len(points), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    offset = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if sizes.max() > LONG:
        pair = points[:-1] << 32 | points[1:]
        near = np.searchsorted(model.inside, pair).clip(max=len(model.inside) - 1)
        apart = model.inside[near] != pair
        first[1:] |= apart & (sizes[owner[1:]] > LONG)
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(points)))
    out = symbols.copy()
    alive = np.ones(len(points), bool)
    for k in np.flatnonzero(lengths > LONG):
        a, b = starts[k], starts[k] + lengths[k]
        _agenda(model, out, alive, a, b, keys[owner[a]], offset, dropped, done)
    short = np.repeat(lengths <= LONG, lengths)
    places = np.flatnonzero(short)
    if len(places):
        _rounds(model, out, alive, places, first[places], keys[owner[places]], offset[places], dropped, done)
    return out[alive], np.bincount(owner[alive], minlength=len(sizes))


def _ranked(model, left, right, keys, offsets, dropped):
    merged, rank = model.ranks(left, right)
    live = np.flatnonzero(merged >= 0)
    rank[live[dropped(keys[live], offsets[live], merged[live])]] = NEVER
    return merged, rank


def _rounds(model, out, alive, places, first, keys, offset, dropped, done=None) -> None:
    """One merge per sequence and round, of its lowest rank, for all sequences together.

    Symbols stay in their places, linked to their neighbours. A pair is held as its
    rank and, below, its offset, so that the least one of a sequence is the pair to merge.
    """
    n = len(places)
    symbols = np.append(out[places], -1)  # the last stands behind and before every sequence
    begin = np.flatnonzero(first)
    sizes = np.diff(np.append(begin, n))
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[begin + sizes - 1] = before[begin] = n
    merged, rank = _ranked(model, symbols[:-1], symbols[after[:-1]], keys, offset, dropped)
    pairs = np.where(rank < NEVER, rank.astype(np.int64) * LONG + np.arange(n) - np.repeat(begin, sizes), NONE)
    head = begin  # where the sequences start in `pairs`, which loses those that are done
    while len(begin):
        best = np.minimum.reduceat(pairs, head)
        open_ = best < NONE
        if not open_.all():
            pairs = pairs[np.repeat(open_, sizes)]
            begin, sizes, best = begin[open_], sizes[open_], best[open_]
            head = np.cumsum(sizes) - sizes
            if not len(begin):
                break
        at = begin + best % LONG
        gone = after[at]
        symbols[at] = merged[at]
        out[places[at]] = merged[at]
        if done is not None:
            done.append((places[at], merged[at]))
        alive[places[gone]] = False
        far = after[gone]
        after[at] = far
        before[far] = at
        prior = before[at]
        back = np.flatnonzero(prior < n)
        left, right = np.concatenate((at, prior[back])), np.concatenate((far, at[back]))
        joined, rank = _ranked(model, symbols[left], symbols[right], keys[left], offset[left], dropped)
        merged[left] = joined
        shift = head - begin
        pairs[gone + shift] = NONE
        where = left - np.concatenate((begin, begin[back]))
        pairs[where + np.concatenate((head, head[back]))] = np.where(rank < NEVER, rank.astype(np.int64) * LONG + where, NONE)


def _agenda(model, out, alive, a, b, key, offset, dropped, done=None) -> None:
    """Merge one long sequence with a heap of candidates."""
    before = np.arange(a - 1, b - 1)
    after = np.arange(a + 1, b + 1)
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(at, nxt):
        left, right = int(out[at]), int(out[nxt])
        merged = model.joined.get((left, right))
        if merged is None:
            return
        if dropped is not _never_dropped and dropped(np.array([key], np.uint64), offset[[at]], np.array([merged]))[0]:
            return
        heapq.heappush(heap, (int(model.rank[merged]), at, nxt, left, right, merged))

    merged, rank = _ranked(
        model, out[a : b - 1], out[a + 1 : b], np.full(b - a - 1, key, np.uint64), offset[a : b - 1], dropped
    )
    for k in np.flatnonzero(rank < NEVER):
        at = int(a + k)
        heap.append((int(rank[k]), at, at + 1, int(out[at]), int(out[at + 1]), int(merged[k])))
    heapq.heapify(heap)
    while heap:
        _, at, nxt, left, right, merged = heapq.heappop(heap)
        if not (alive[at] and alive[nxt]) or after[at - a] != nxt or out[at] != left or out[nxt] != right:
            continue
        out[at] = merged
        if done is not None:
            done.append((np.array([at]), np.array([merged])))
        alive[nxt] = False
        far = int(after[nxt - a])
        after[at - a] = far
        if far < b:
            before[far - a] = at
            offer(at, far)
        prior = int(before[at - a])
        if prior >= a:
            offer(prior, at)


def blank_words(text: str) -> list[str]:
    """Pre-tokens of a text: a run of blanks (U+0020) and what follows it, without the first blank.

    The models add a blank before the text, so every pre-token has one, and it
    is left implicit. No piece continues from another character into a blank,
    so merges never cross pre-tokens.
    """
    if not text:
        return []
    parts = text.split(" ")
    if "" not in parts:
        return parts
    words, run = [], 0
    for part in parts[:-1]:
        if part:
            words.append(" " * run + part)
            run = 0
        else:
            run += 1
    words.append(" " * run + parts[-1])
    return words


def marked(word: str) -> str:
    """A pre-token of `blank_words` as the symbols of a piece model."""
    return SPACE + word.replace(" ", SPACE)
