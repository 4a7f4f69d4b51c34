"""Line dedup, periodic runs and whitening against brute force, and on hostile inputs."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import line_dedup, periodic_runs, whitening
from netloom.llm.line_dedup import Cuckoo, LineIndex

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
BLANKS = " \t\n\x0b\x0c\r"
LONG = "a line of some length"
ROWS = [
    (5, f"{LONG}\n\nshort\n  {LONG.upper()}\t\nonly here, a long line"),
    (2, f"{LONG}\nshort\n{LONG}"),
    (9, f"\t{LONG}\r\nelse"),
    (9, "twice the id, twice the line"),
    (9, "twice the id, twice the line"),
    (None, f"{LONG}\nline of the null id"),
    (None, "line of the null id\n"),
    (11, None),
    (12, ""),
    (13, "\n\n"),
    (14, "ééééééééé\nÄÄÄÄÄÄÄÄÄÄ\nääääääääää"),
    (15, "ééééééééé\nÄÄÄÄÄÄÄÄÄÄ"),
    (16, "z" * 300_000 + "\n" + LONG),
]
CLASHES = ("line", "row", "h1", "h2", "k", "doc", "first", "last", "refs", "gone", "keys", "found", "white", "x", "c")


def clashing(df):
    return df.withColumns({n: F.lit("x") for n in CLASHES})


# --- line dedup


def key(line):
    bare = line.strip(BLANKS)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare) if len(bare) >= 10 else None


def brute_lines(rows):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if key(line) is not None:
                holders[key(line)].add((doc is None, doc or 0))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [
            x for x in lines
            if key(x) is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == (doc is None, doc or 0)
        ]
        out.append((doc, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def reported(df, **how):
    return sorted((tuple(r) for r in line_dedup.line_report(df, **how).collect()), key=repr)


@pytest.mark.parametrize("increments", [1, 3])
def test_lines_equal_brute_force(spark, increments):
    assert reported(clashing(spark.createDataFrame(ROWS, DOCS)), increments=increments) == brute_lines(ROWS)


def test_lines_of_whole_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert reported(docs) == brute_lines(rows)


def test_lines_of_an_empty_table(spark):
    assert reported(spark.createDataFrame([], DOCS)) == []


def state(index):
    rows = index.counts().select("h1", "h2", "refs", "first.doc", "last.doc").collect()
    return sorted(tuple(r) for r in rows)


def filters_of(index):
    rows = index.filters().collect()
    return sum(r["items"] for r in rows), sum(int((np.frombuffer(r["slots"], np.uint16) > 0).sum()) for r in rows)


def test_deleting_documents_undoes_their_insertion(spark):
    rnd = random.Random(3)
    lines = [f"line number {k} of the pool" for k in range(400)]
    rows = [(d, "\n".join(rnd.choice(lines) for _ in range(12))) for d in range(120)]
    first, second = spark.createDataFrame(rows[:70], DOCS), spark.createDataFrame(rows[70:], DOCS)
    index = LineIndex.create(spark, shard_keys=50)
    index.insert(first)
    alone, in_filters = state(index), filters_of(index)
    index.insert(second)
    both = state(index)
    assert both != alone and index.keys == len(both)
    index.delete(second.select("doc_id"))
    assert state(index) == alone and filters_of(index)[0] == in_filters[0] == filters_of(index)[1]
    # The smallest holders go, and come back with a stored index.
    index.delete(first.where("doc_id < 20").select("doc_id"))
    left = LineIndex.create(spark)
    left.insert(first.where("doc_id >= 20"))
    assert state(index) == state(left)
    again = LineIndex.open(spark, index.folder)
    again.insert(first.where("doc_id < 20"))
    again.insert(second)
    assert state(again) == both
    got = line_dedup.deduplicated(spark.createDataFrame(rows, DOCS), again).select("row.doc_id", "n_lines", "n_dropped", "sha")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_lines(rows)


def test_a_hot_line_and_growing_filters(spark):
    rows = [(d, f"the line of every document\nits own line {d}") for d in range(3000)]
    index = LineIndex.create(spark, shard_keys=100)
    df = spark.createDataFrame(rows, DOCS)
    for k in range(3):
        index.insert(df.where(F.col("doc_id") % 3 == k))
    assert index.shards > 1 and index.keys == 3001 == filters_of(index)[0]
    assert [tuple(r) for r in index.shared().select("first.doc").collect()] == [(0,)]


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**62), 2**62, (50_000, 2))
    h1, h2 = keys[:, 0].copy(), keys[:, 1].copy()
    cuckoo = Cuckoo.sized(len(h1))
    assert cuckoo.add(h1, h2) and cuckoo.may_hold(h1, h2).all()
    other = rng.integers(-(2**62), 2**62, (50_000, 2))
    assert cuckoo.may_hold(other[:, 0].copy(), other[:, 1].copy()).mean() < 0.001
    cuckoo.remove(h1[:20_000], h2[:20_000])
    assert (cuckoo.table > 0).sum() == 30_000 and cuckoo.may_hold(h1[20_000:], h2[20_000:]).all()
    # Keys with the same place and fingerprint are stored and forgotten one by one.
    same = Cuckoo(4)
    one = np.zeros(6, np.int64)
    assert same.add(one, one) and (same.table > 0).sum() == 6
    same.remove(one[:5], one[:5])
    assert same.may_hold(one, one).all()
    assert not Cuckoo(2).add(*(rng.integers(0, 2**62, 40) for _ in range(2)))


# --- periodic runs


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= 4 * q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= 6)


def strings(rnd):
    """Random, periodic, nested periodic and Fibonacci word lists."""
    n, kind = rnd.randint(0, 80), rnd.randint(0, 4)
    if kind == 0:
        return rnd.choices("ab", k=n)
    if kind == 1:
        unit = rnd.choices("ab", k=rnd.randint(1, 12))
        return rnd.choices("abc", k=rnd.randint(0, 9)) + (unit * 20)[:n] + rnd.choices("abc", k=rnd.randint(0, 9))
    if kind == 2:
        return [c for c in rnd.choices("abc", k=n // 4) for _ in range(rnd.randint(1, 9))]
    if kind == 3:
        return ((["a"] * rnd.randint(4, 9) + ["b"] * rnd.randint(0, 5)) * 12)[:n]
    x, y = ["a"], ["b"]
    while len(y) < n:
        x, y = y, y + x
    return (y * 5)[: 3 * n]


def test_runs_equal_brute_force():
    rnd = random.Random(7)
    for _ in range(400):
        texts = [[c.encode() for c in strings(rnd)] for _ in range(rnd.randint(1, 4))]
        for words, (runs, rest) in zip(texts, periodic_runs.analysed(texts)):
            assert runs == brute_runs(words)
            gone = {i for s, length, q in runs for i in range(s + q, s + length)}
            assert rest == b" ".join(w for i, w in enumerate(words) if i not in gone)


def brute_report(rows):
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        n, h = len(words), 1 if doc is None else zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        out.append((
            doc, len(runs), *(top or (None,) * 3), top[1] * 1000 // top[2] if top else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
        ))
    return sorted(out, key=repr)


def test_runs_report_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 1500").select("doc_id", "text")
    odd = [
        (None, "x " * 50), (1, None), (2, ""), (3, " \n\t"), (4, "a b a b a b a b"), (4, "a b a b a b a b"), (5, "x\x1cy " * 9),
        (6, "y" * 200_000), (7, "  " * 6), (70, "one two three four five six seven"),
    ]
    docs = docs.unionByName(spark.createDataFrame(odd, DOCS))
    got = sorted((tuple(r) for r in periodic_runs.runs_report(clashing(docs)).collect()), key=repr)
    assert got == brute_report([tuple(r) for r in docs.collect()])
    assert sum(r[1] > 0 for r in got) > 10


def test_runs_of_one_very_long_text(spark):
    text = " ".join(f"w{k % 5000}" for k in range(250_000)) + " a" * 100_000
    row = periodic_runs.find_runs(spark.createDataFrame([(1, text)], DOCS)).select("found.runs", "found.rest").first()
    assert [tuple(r) for r in row["runs"]] == [(0, 250_000, 5000), (250_000, 100_000, 1)]
    assert len(row["rest"].split()) == 5001


def test_runs_of_an_empty_table(spark):
    assert periodic_runs.runs_report(spark.createDataFrame([], DOCS)).collect() == []


# --- whitening


@pytest.mark.parametrize("values", [
    np.linspace(1, 9, 40),
    np.r_[np.full(10, 5.0), np.full(10, 5.0 + 1e-9), np.linspace(1, 2, 20)],
    np.ones(30),
    np.r_[1.0, 1e-14, np.zeros(18)],
])
def test_eigenvectors_of_clustered_values(values):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.eigenvectors(a)
    assert np.abs(got - np.sort(values)[::-1]).max() < 1e-13 * values.max()
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-15 * len(a)
    assert np.abs(a @ x - x * got).max() < 1e-14 * values.max()


def brute_whitening(rows):
    """Per row: deviation and the whitened components up to sign, from exact sums and numpy's solver."""
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    xs = {i: [int(np.floor(256 * float(np.float32(c)))) for c in v] for i, v in good}
    fit = sorted(set(map(tuple, xs.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:4], v[:, ::-1][:, :4]
    return {
        i: (n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), np.array([c - s / n for c, s in zip(x, sums)]) @ v / np.sqrt(e), e / np.trace(y.T @ y / n))
        for i, x in xs.items()
    }


def test_whitening_equals_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    width = len(rows[0][1])
    odd = [(-1, None), (-2, [None] * width), (-3, [float("nan")] * width), (-4, [float("inf")] + [0.0] * (width - 1)), (-5, []), (-6, rows[0][1]), (-7, [0.5] * 3)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    want = brute_whitening(rows + [odd[5]])
    got = defaultdict(dict)
    for r in whitening.whitening_report(clashing(df)).collect():
        got[r["vec_id"]][r["component"]] = r
    assert set(got) == set(want) and all(set(v) == {1, 2, 3, 4} for v in got.values())
    signs = None
    for i, (n, apart, z, explained) in want.items():
        rows_ = [got[i][k] for k in (1, 2, 3, 4)]
        mine = np.array([r["whitened"] for r in rows_])
        signs = np.sign(mine * z) if signs is None else signs
        assert np.abs(mine - signs * z).max() < 1e-9
        assert all(r["n"] == n and r["deviation"] == apart and r["identity_error"] < 1e-9 for r in rows_)
        assert np.abs(np.array([r["explained"] for r in rows_]) - explained).max() < 1e-12


def test_whitening_of_repeats_and_nothing(spark):
    kind = "vec_id long, embedding array<double>"
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)
    assert whitening.whitening_report(one).collect() == []
    assert whitening.whitening_report(spark.createDataFrame([], kind)).collect() == []
    # Two points: one component; repeats do not weigh, null keys have rows too.
    rows = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0]), (None, [1.0, 1.0])]
    got = whitening.whitening_report(spark.createDataFrame(rows, kind)).collect()
    assert [r["component"] for r in got] == [1] * 4 and {round(abs(r["whitened"]), 9) for r in got} == {1.0}
    assert {r["n"] for r in got} == {2} and {r["deviation"] for r in got} == {2 * 256**2}


def test_deviations_past_the_longs():
    x = np.array([[2**40, 0], [0, 0]])
    assert whitening.deviations(x, 2, [2**40, 0]) == [None, None]
    assert whitening.deviations(x // 2**20, 2, [2**20, 0]) == [2**40, 2**40]
