"""Training-data operators against brute force, round trips, and hostile inputs."""

import hashlib
import os
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from netloom.llm import (
    exact_dedup,
    graph,
    language_id,
    mixing,
    near_dedup,
    quality_rules,
    sentencepiece_codec,
    suffix_dedup,
    token_counts,
    training_order,
    warc,
)

SMALL = "/root/testdata/sf0.001/documents.parquet"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Nulls, empties, ties, repeated rows, a long text and characters outside every vocabulary.
HOSTILE = [
    (1, "same words here again and again " * 12, "en", "a", 1),
    (1, "same words here again and again " * 12, "en", "a", 1),
    (2, "same words here again and again " * 12, None, None, None),
    (None, "same words here again and again " * 12, "en", "a", None),
    (None, None, None, None, None),
    (3, None, "en", "b", 0),
    (4, "", "fr", "b", 0),
    (5, " \n\t ", "fr", "b", 0),
    (6, "short", "de", "a", 5),
    (7, "▁ blank▁sign  two  blanks \U0010ffff 日本 é\r\n", "de", "a", 5),
    (8, "x" * 30_000, "en", "a", 30_000),
    (9, "eine lange zeile mit worten und zeichen\n" * 3000, "de", "c", 1),
]


@pytest.fixture(scope="module")
def hostile(spark):
    """Hostile rows, with extra columns whose names operators use inside."""
    docs = spark.createDataFrame(HOSTILE, DOCS)
    names = ("line", "row", "kept", "score", "label", "token_ids", "n", "draw", "tokens")
    return docs.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(SMALL)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- mixing


def test_raking_meets_all_margins(spark):
    cells = spark.createDataFrame(
        [("a", "en", "p", 900), ("a", "fr", "p", 50), ("b", "en", "p", 30), ("b", "fr", "q", 20), ("a", "en", "q", 40)],
        "source string, lang string, topic string, tokens long",
    )
    targets = {"source": {"a": 0.6, "b": 0.4}, "lang": {"en": 0.7, "fr": 0.3}}
    goals = {d: mixing.given(cells, d, t) for d, t in targets.items()}
    goals["topic"] = mixing.tempered(cells, "topic", 1.0)
    rated = mixing.rake(cells, goals).withColumn("mass", F.col("tokens") * F.col("rate"))
    for dimension, shares in targets.items():
        got = {r[0]: r[1] for r in rated.groupBy(dimension).agg(F.sum("mass")).collect()}
        assert got == pytest.approx(shares, abs=1e-6)


def test_calibration_keeps_the_share(spark):
    rated = spark.createDataFrame([(100, 9.0), (300, 1.0), (600, 0.1)], "tokens long, rate double")
    rows = mixing.calibrated(rated, 0.3).collect()
    assert sum(r["tokens"] * r["probability"] for r in rows) == pytest.approx(300)
    assert max(r["probability"] for r in rows) == 1.0


def test_sample_is_the_report(small):
    report = {r["doc_id"] for r in mixing.mixing_report(small).where("kept").collect()}
    kept = mixing.sample(small)
    assert kept.columns == small.columns
    assert {r["doc_id"] for r in kept.collect()} == report


def test_mixing_hostile(hostile):
    assert mixing.sample(hostile).columns == hostile.columns
    assert mixing.sample(hostile.limit(0)).count() == 0
    # Texts without a word weigh nothing and cells without tokens stay.
    assert mixing.mixing_report(hostile).where("tokens = 0 AND probability < 1").count() <= 4


# --- training order


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_permutation(size):
    out = training_order.permuted(np.arange(size), size, 9)
    assert sorted(out.tolist()) == list(range(size))
    if size > 100:
        assert (out != training_order.permuted(np.arange(size), size, 10)).any()


def test_shards_are_fixed_stride(spark, small, tmp_path):
    ordered = training_order.in_training_order(small, length=64, shard=500)
    rows = ordered.orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    training_order.write_shards(ordered, str(tmp_path / "shards"))
    back = training_order.read_shard(spark, str(tmp_path / "shards"), 1, 64).orderBy("place").collect()
    assert [bytes(r["tokens"]) for r in back] == [bytes(r["tokens"]) for r in rows if r["shard"] == 1]
    number, offset = training_order.position(777, 64, 500)
    file = next((tmp_path / "shards" / f"shard={number:08d}").glob("part-*"))
    data = file.read_bytes()[offset : offset + 128]
    assert data == bytes(rows[777]["tokens"])


def test_report_is_read_from_shard_files(spark, small, hostile, tmp_path):
    folder = tmp_path / "shards"
    report = training_order.order_report(small, length=64, shard=500, path=str(folder))
    want = training_order.in_training_order(small, length=64, shard=500).withColumnRenamed("key", "doc_id")
    assert report.columns == want.columns
    rows = report.collect()
    assert rows == want.orderBy("slot").collect()
    stride = 130
    for r in rows:
        assert (r["shard"], r["byte_offset"]) == training_order.position(r["slot"], 64, 500)
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) > 2 and len(list(folder.glob("shard=*"))) == len(sizes)
    for number, n in sizes.items():
        (file,) = (folder / f"shard={number:08d}").glob("part-*")
        assert file.stat().st_size == n * stride
    # What the report returns is what the file holds.
    (file,) = (folder / "shard=00000001").glob("part-*")
    data = bytearray(file.read_bytes())
    data[3 * stride : 3 * stride + 2] = b"\x07\x01"
    file.write_bytes(bytes(data))
    (folder / "shard=00000001" / f".{file.name}.crc").unlink(missing_ok=True)
    changed = report.where("slot = 503").collect()[0]
    assert bytes(changed["tokens"])[:2] == b"\x07\x01"
    assert training_order.order_report(hostile.limit(0)).count() == 0


def test_slots_do_not_depend_on_the_partitions(spark, small):
    again = small.limit(40)
    docs = small.unionByName(again)  # forty rows twice
    encoder = training_order._encoder(public_tokenizers.path(training_order.RANKS))
    # By hand: all sequences by key, text hash and part, then the permutation of their numbers.
    hashed = docs.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS print").collect()
    listed = []
    for row in sorted(hashed, key=lambda r: (r["doc_id"], r["print"])):
        ids = [*encoder.encode_ordinary(row["text"]), training_order.END]
        for part, start in enumerate(range(0, len(ids), 64)):
            cut = ids[start : start + 64]
            listed.append((row["doc_id"], part, len(cut), cut + [training_order.END] * (64 - len(cut))))
    slots = training_order.permuted(np.arange(len(listed)), len(listed), 5)
    want = {int(slot): sequence for slot, sequence in zip(slots, listed)}
    for partitions in (3, 5):
        rows = training_order.in_training_order(docs.repartition(partitions), length=64, shard=500).collect()
        assert len(rows) == len(want)
        for r in rows:
            assert (r["key"], r["part"], r["n_tokens"], np.frombuffer(r["tokens"], "<u2").tolist()) == want[r["slot"]]


def test_ids_come_as_arrays_and_slots_once(spark, small):
    encoder = training_order._encoder(public_tokenizers.path(training_order.RANKS))
    for text in ("", "a <|endoftext|> \u00e9<|endoftext|>\u00fc", " \0 \U0001f600  x\n\n"):
        assert training_order.encoded(encoder, text).tolist() == encoder.encode_ordinary(text)
    placed, total = training_order._placed(small, "text", "doc_id", 5, 64, 500)
    some = placed.where(F.col("slot").between(500, 999))
    assert some._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(r["slot"] for r in some.select("slot").collect()) == list(range(500, min(1000, total)))


def test_many_shards_are_read_in_order(spark, small, tmp_path):
    report = training_order.order_report(small, length=64, shard=20, path=str(tmp_path / "shards")).collect()
    want = training_order.in_training_order(small, length=64, shard=20).orderBy("slot").collect()
    assert len({r["shard"] for r in report}) > 100
    assert [(r["slot"], r["doc_id"], bytes(r["tokens"])) for r in report] == [(r["slot"], r["key"], bytes(r["tokens"])) for r in want]


@pytest.mark.parametrize("shard", [20, 400, 100_000])
def test_sequences_are_numbered_once_whatever_the_passes(small, tmp_path, monkeypatch, shard):
    passes, tables = [], []

    def files(table):
        return [f.removeprefix("file:").replace("//", "/") for f in table.inputFiles()]

    def write(ordered, path, mode):
        # What earlier passes have written is gone, the others' rows are there.
        left = {f.split("/pass=")[1].split("/")[0] for f in files(tables[1]) if os.path.exists(f)}
        assert len(left) == min(training_order.PASSES, shards) - len(passes)
        passes.append((ordered, ordered._jdf.queryExecution().executedPlan().toString(), [r["shard"] for r in ordered.select("shard").collect()]))
        training_order_write(ordered, path, mode)

    def keep(*args, **options):
        tables.append(common_written(*args, **options))
        return tables[-1]

    training_order_write, common_written = training_order.write_shards, training_order.written
    monkeypatch.setattr(training_order, "write_shards", write)
    monkeypatch.setattr(training_order, "written", keep)
    shards = -(-training_order.sequences(small, length=64).count() // shard)
    report = training_order.order_report(small, length=64, shard=shard, path=str(tmp_path / "shards")).collect()
    assert len(passes) == min(training_order.PASSES, shards)
    # A pass neither looks the numbers up nor computes slots, and reads the files of its shards alone.
    for ordered, plan, _ in passes:
        assert "Join" not in plan and "ArrowEvalPython" not in plan and "PartitionFilters: [isnotnull(pass" in plan
    assert [s for _, _, shards in passes for s in shards] == [r["shard"] for r in report]
    sequences, placed, places = map(files, tables)
    assert not any(map(os.path.exists, sequences + placed)) and all(map(os.path.exists, places)) and places


def test_sequences_give_the_texts_back(hostile):
    rows = training_order.in_training_order(hostile.where("doc_id > 1"), length=32).collect()
    encoder = training_order._encoder(public_tokenizers.path(training_order.RANKS))
    parts = defaultdict(list)
    for r in rows:
        parts[r["key"]].append((r["part"], np.frombuffer(r["tokens"], "<u2")[: r["n_tokens"]].tolist()))
    for key, text in texts_of(hostile.where("doc_id > 1")):
        ids = [i for _, part in sorted(parts[key]) for i in part]
        assert ids.pop() == training_order.END
        assert encoder.decode(ids) == (text or "")
    assert training_order.in_training_order(hostile.limit(0)).count() == 0


# --- WARC


def record(spark, rows):
    return spark.createDataFrame(rows, "record_id long, url string, at timestamp, kind string, headers string")


def test_canonical_url(spark):
    groups = [
        ["http://www.Ex.com:80/a/?b=2&a=1&utm_source=x#top", "https://ex.com/a?a=1&b=2", " http://ex.com/a/?a=1&b=2&ref=q "],
        ["http://ex.com/A"],
        ["ftp://x", " ftp://x"],
    ]
    flat = [(k, u) for k, g in enumerate(groups) for u in g]
    df = spark.createDataFrame(flat, "k long, u string")
    names = {(r[0], r[1]) for r in df.select("k", warc.canonical_url(F.col("u"))).collect()}
    assert len(names) == len(groups)


def test_revisits(spark):
    import datetime as dt

    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [
        (1, "http://a.com/", t(0), "response", 'ETag: "v1"\r\nContent-Type: text/html\r\nAge: 1'),
        (2, "http://a.com", t(500_000), "response", 'ETag: "v2"\r\nContent-Type: text/html\r\nAge: 1'),
        (3, "https://www.a.com", t(10), "revisit", 'ETag: W/"v1"\r\nContent-Type: no\r\nAge: 9'),
        (4, "http://a.com", t(900_000), "revisit", 'ETag: "v2"'),
        (5, "http://a.com", t(900_000), "revisit", 'ETag: "v1"'),
        (6, "http://a.com", t(0), "revisit", None),
        (7, "http://b.com", t(9), "revisit", "Last-Modified: x"),
        (8, None, t(9), "revisit", "x"),
        (9, "http://a.com", None, "revisit", "x"),
        (10, "http://a.com", t(5), "request", "x"),
    ]
    got = {r["record_id"]: r for r in warc.resolve_revisits(record(spark, rows)).collect()}
    status = {k: (r["status"], r["response_id"]) for k, r in got.items()}
    assert status == {
        3: ("resolved", 1), 4: ("resolved", 2), 5: ("validator_mismatch", None), 6: ("no_earlier_response", None),
        7: ("no_earlier_response", None), 8: ("no_earlier_response", None), 9: ("no_earlier_response", None),
    }
    assert got[3]["headers"] == {"etag": '"v1"', "content-type": "text/html", "age": "9"}
    assert warc.resolve_revisits(record(spark, [])).count() == 0


# --- language


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.where("lang = lang_pred").count() / found.count()
    assert right >= 0.97


def test_language_hostile(hostile):
    report = language_id.language_report(hostile)
    rows = {r["doc_id"]: r for r in report.collect()}
    assert report.count() == len(HOSTILE)
    assert rows[3]["lang_pred"] == rows[4]["lang_pred"] == rows[5]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert language_id.keep_identified(hostile).columns == hostile.columns
    assert language_id.language_report(hostile.limit(0)).count() == 0


def test_short_and_unlabelled_texts_stay(spark, small):
    short = spark.createDataFrame([(-k, t, "en", "a", 1) for k, t in enumerate(["Avec.", "A.", "日", "12"], 1)], small.schema)
    kept = {r["doc_id"] for r in language_id.keep_identified(small.unionByName(short)).where("doc_id < 0").collect()}
    assert kept == {-1, -2, -3}
    bare = short.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in language_id.keep_identified(bare).collect()} == kept


def test_missing_languages_are_filled(small):
    """Labels taken from some rows come back by the text; labels that are there stay."""
    known = small.where("lang IS NOT NULL AND length(text) > 200")
    hidden = F.col("doc_id") % 5 == 0
    df = known.withColumn("lang", F.when(~hidden, F.col("lang")))
    got = {r["doc_id"]: r["lang"] for r in language_id.keep_identified(df).collect()}
    want = {r["doc_id"]: (r["lang"], r["doc_id"] % 5 == 0) for r in known.collect()}
    assert set(got) == set(want) and all(got[k] == lang for k, (lang, gone) in want.items() if not gone)
    back = [got[k] == lang for k, (lang, gone) in want.items() if gone]
    assert len(back) > 20 and sum(back) >= 0.9 * len(back)


def test_profile_is_the_bundle_of_bound_vectors():
    space = language_id.Space(64, 3, 1)
    got = space.profile(["Ab, c"])[0]
    numbers = space.letter_numbers(np.array([ord("a"), ord("b"), ord("c"), 0], np.int32))
    letter = dict(zip("abc ", (space.letters[n].astype(int) for n in numbers)))
    want = sum(
        np.roll(letter[x], 2) * np.roll(letter[y], 1) * letter[z] for x, y, z in (" ab", "ab ", "b c", " c ")
    )
    assert got.tolist() == want.tolist()


# --- SentencePiece


def test_dropout_round_trip(spark, hostile):
    coded = sentencepiece_codec.encode(hostile, dropout=0.3, seed=1, lossless="lossless")
    assert coded.where("NOT lossless").count() == 0
    back = sentencepiece_codec.decode(coded.drop("text"))
    assert sorted(map(repr, (t or "" for _, t in texts_of(back)))) == sorted(repr(t or "") for _, t in texts_of(hostile))
    assert sentencepiece_codec.encode(hostile.limit(0)).count() == 0


def test_dropout_varies_by_seed_and_repeats(small):
    ids = lambda seed: {r["doc_id"]: r["token_ids"] for r in sentencepiece_codec.encode(small, seed=seed).collect()}
    one, again, other = ids(1), ids(1), ids(2)
    assert one == again
    assert sum(one[k] != other[k] for k in one) > len(one) * 0.9


def test_without_dropout_equals_the_library(small):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in sentencepiece_codec.encode(small, dropout=0.0).select("text", "token_ids").collect():
        assert r["token_ids"] == library.encode(r["text"] or "")


def cut_by_force(tool, word, key):
    """Pieces of one occurrence: the best undropped pair of neighbours merges until none is left."""
    model = tool.model
    chars = sentencepiece_codec.SPACE + word.replace(" ", sentencepiece_codec.SPACE)
    symbols = [(k, int(model.char_id[ord(c)]), c) for k, c in enumerate(chars)]
    while True:
        found = []
        for k, ((a, left, _), (_, right, _)) in enumerate(zip(symbols, symbols[1:])):
            merged = model.joined.get((left, right))
            if merged is not None and not tool._dropped(np.array([key]), np.array([a]), np.array([merged]))[0]:
                found.append((model.rank[merged], k, merged))
        if not found:
            return [i for _, p, c in symbols for i in ([p] if p >= 0 else [int(model.byte_id[b]) for b in c.encode()])]
        _, k, merged = min(found)
        symbols[k : k + 2] = [(symbols[k][0], merged, "")]


def test_every_occurrence_draws_for_itself():
    tool = sentencepiece_codec.Codec(MODEL, 7, 0.1)
    texts = ["and the " * 5000, "the", "internationalization-" * 12 + " xs" * 40 + " \U0001f600the  the"] * 2
    keys = np.array([3, 5, 8, 3, 9, 11], np.uint64)
    for first in (0, 3):  # the second time most segmentations are remembered
        ids, counts = tool.encode(texts[first : first + 3], keys[first : first + 3])
        ends = np.cumsum(counts)
        for k in (1, 2):
            base = sentencepiece_codec.mixed(keys[first + k : first + k + 1] ^ tool.seed)
            words = sentencepiece_codec.blank_words(texts[first + k])
            want = [i for n, w in enumerate(words) for i in cut_by_force(tool, w, sentencepiece_codec.mixed(base + np.uint64(n))[0])]
            assert ids[ends[k - 1] : ends[k]].tolist() == want


def test_runs_are_shared_where_what_is_dropped_never_merges():
    tool = sentencepiece_codec.Codec(MODEL, 7, 0.1)
    word = "stations"
    ids, counts = tool.encode([f"{word} " * 20_000 + word], np.array([4], np.uint64))
    # Few of the sets of candidates that occurrences drop lead to a run of their own.
    drops = tool._patterns(np.zeros(20_001, np.int64), sentencepiece_codec.mixed(sentencepiece_codec.mixed(np.array([4], np.uint64) ^ tool.seed) + np.arange(20_001).astype(np.uint64)))[0]
    assert 1 < tool.cuts < len(np.unique(drops)) / 2
    want = [
        i
        for n in range(300)
        for i in cut_by_force(tool, word, sentencepiece_codec.mixed(sentencepiece_codec.mixed(np.array([4], np.uint64) ^ tool.seed) + np.uint64(n))[0])
    ]
    assert ids[: len(want)].tolist() == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_drop_rate_of_a_repeated_word(spark, seed):
    model = sentencepiece_codec.piece_model(MODEL)
    blank = int(model.char_id[ord(sentencepiece_codec.SPACE)])
    pairs = [p for p in "abcdefghijklmnopqrstuvwxyz" if (blank, int(model.char_id[ord(p)])) in model.joined]
    df = spark.createDataFrame([(k, f"{p} " * 4000 + p) for k, p in enumerate(pairs[:4])], "doc_id long, text string")
    for r in sentencepiece_codec.encode(df, seed=seed).collect():
        # One merge in the word: two pieces where it is dropped.
        assert 0.08 < len(r["token_ids"]) / 4001 - 1 < 0.12


# --- token counts


def test_counts_equal_the_library(small, hostile):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for df in (small, hostile):
        for r in token_counts.count_tokens(df.select("doc_id", "text")).collect():
            assert r["n_tokens"] == len(library.encode(r["text"] or ""))
    assert token_counts.token_report(hostile.limit(0)).count() == 0


# --- near duplicates


def components_by_force(rows, width):
    sets = {}
    for key, text in rows:
        words = words_of(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        runs = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
        sets[key] = runs or ({tuple(words)} if words else set())
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = defaultdict(list)
    for key, items in sets.items():
        met = Counter(o for x in items for o in holders[x])
        for other, n in met.items():
            if 100 * n >= 80 * (len(items) + len(sets[other]) - n):
                a, b = sorted((root(key), root(other)))
                parent[b] = a
        for x in items:
            holders[x].append(key)
    return sorted((k, len(s), root(k), root(k) == k) for k, s in sets.items())


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(map(tuple, near_dedup.near_report(docs).collect()))
    assert got == components_by_force(texts_of(docs), 4)


def test_near_duplicates_in_a_cloud(spark):
    """One base with many copies changed by degrees, a chain, and a passage that all share."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 300):
        words = list(base)
        for at in rng.integers(0, 150, k % 9):
            words[at] = f"x{k}_{at}"
        rows.append((k, " ".join(words)))
    for k in range(60):
        rows.append((1000 + k, " ".join(f"c{j}" for j in range(k * 4, k * 4 + 100))))
        own = " ".join(f"o{k}_{j}" for j in range(60))
        rows.append((2000 + k, " ".join(base[:70]) + " " + own))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, near_dedup.near_report(df).collect()))
    assert got == components_by_force(rows, 4)


def test_near_hostile(hostile):
    report = near_dedup.near_report(hostile)
    assert report.count() == len(HOSTILE)
    rows = {(r["doc_id"], r["n_shingles"]): r for r in report.collect()}
    assert rows[2, 6]["component_id"] == 1 and not rows[2, 6]["kept"]
    assert rows[3, 0]["component_id"] == 3 and rows[3, 0]["kept"]
    kept = near_dedup.drop_near_copies(hostile)
    assert kept.columns == hostile.columns
    assert kept.where("text LIKE 'same words%'").count() == 1
    assert near_dedup.near_report(hostile.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 160)}}


# --- repeated strings


def repeats_by_force(rows, first):
    size = suffix_dedup.LENGTH
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(b[i : i + size] for _, b in data for i in range(len(b) - size + 1))
    met, out = set(), []
    for key, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if seen[w] > 1 and (not first or w in met):
                gone[i : i + size] = True
            met.add(w)
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((key, int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("keep, bucket", [("none", 2000), ("none", 2), ("first", 2000), ("first", 2)])
def test_repeats_against_brute_force(spark, small, monkeypatch, keep, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    extra = [(-1, "a" * 900), (-2, None), (-3, ""), (-4, "b" * 199), (-5, "xy" * 150 + "q" + "xy" * 150), (-6, "a" * 201)]
    docs = small.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")).coalesce(1)
    done = suffix_dedup.remove_repeats(docs, keep=keep)
    got = sorted(map(tuple, done.select("row.doc_id", "n_removed", "n_spans", "sha").collect()))
    assert got == repeats_by_force(texts_of(docs), keep == "first")


def test_repeats_hostile(hostile):
    rows = suffix_dedup.suffix_report(hostile).collect()
    assert len(rows) == len(HOSTILE)
    assert {r["doc_id"]: r["n_removed"] for r in rows}[8] == 30_000
    assert suffix_dedup.suffix_report(hostile.limit(0)).count() == 0


def peak_mb(step):
    """Most megabytes that numpy and Python hold at once while `step` runs."""
    tracemalloc.start()
    try:
        step()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_repeats_hold_a_piece_at_once():
    rng = np.random.default_rng(5)
    count = 20_000
    texts = [rng.bytes(250) for _ in range(count)]
    texts[1::100] = texts[::100]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(count) // 2), pa.array(np.arange(count)), pa.array(np.arange(count)), pa.array(np.zeros(count, np.int32)), pa.array(texts)],
        names=["bucket", "content", "line", "at", "bytes"],
    )
    got = []
    # One batch of 5 MB, then many batches that cut buckets.
    for batches in ([batch], [batch.slice(k, 333) for k in range(0, count, 333)]):
        rows = []
        held = peak_mb(lambda: rows.extend(r for b in suffix_dedup._compared(iter(batches)) for r in b.to_pylist()))
        assert held < 100
        got.append(sorted((r["content"], tuple(r["earlier"]), tuple(r["other"])) for r in rows))
    span = (250,)
    want = [(k, span if k % 100 == 1 else (), span if k % 100 < 2 else ()) for k in range(count)]
    assert got == [want, want]


def test_runs_of_a_long_text_hold_a_piece_at_once():
    suffix_dedup._powers.cache_clear()
    data = np.random.default_rng(6).bytes(3_000_000)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([None, data, data[:150]], pa.binary())], names=["line", "data"])
    seen = []
    assert peak_mb(lambda: seen.extend((b["line"].to_numpy(), b["at"].to_numpy(), b["windows"].to_numpy()) for b in suffix_dedup._runs(iter([batch])))) < 100
    lines, at, windows = (np.concatenate(c) for c in zip(*seen))
    assert set(lines.tolist()) == {2} and at[0] == 0 and (at[1:] == (at + windows)[:-1]).all()
    assert (at + windows)[-1] == len(data) - suffix_dedup.LENGTH + 1


# --- quality


def test_repeated_words_by_force(small, hostile):
    for df in (small, hostile):
        counted = quality_rules.metrics(df.select("text")).select("text", "m.*").collect()
        for r in counted:
            words = words_of(r["text"])
            runs = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
            twice = {x for x, n in Counter(runs).items() if n > 1}
            places = {k + j for k, x in enumerate(runs) if x in twice for j in range(3)}
            assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(places))


def test_order_does_not_change_the_verdict(hostile, small):
    rules = list(quality_rules.RULES)
    verdicts = []
    for order in (rules, rules[::-1]):
        df = quality_rules.metrics(small.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
        verdicts.append({r[0]: r[1] for r in df.select("doc_id", quality_rules.cascade(order).isNull()).collect()})
    assert verdicts[0] == verdicts[1]
    report = {r["doc_id"]: r for r in quality_rules.quality_report(hostile).collect()}
    assert report[3]["base_failed"] and not report[3]["kept"]
    assert quality_rules.keep_good(hostile).columns == hostile.columns
    assert quality_rules.quality_report(hostile.limit(0)).count() == 0


def test_rules_are_ordered_by_rejection_per_cost():
    rule = quality_rules.RULES[:3]
    estimates = [quality_rules.Estimate(rule[0], 1.0, 0.1), quality_rules.Estimate(rule[1], 0.1, 0.1), quality_rules.Estimate(rule[2], 9.0, 0.2)]
    assert quality_rules.ordered(estimates) == [rule[1], rule[0], rule[2]]


# --- exact copies


def test_fingerprints_compose():
    data = np.frombuffer(bytes(range(256)) * 40, np.uint8)
    base = exact_dedup.BASES[0]
    whole = exact_dedup.chunk_hash(data, base)
    for cut in (0, 1, 77, len(data)):
        left, right = exact_dedup.chunk_hash(data[:cut], base), exact_dedup.chunk_hash(data[cut:], base)
        assert exact_dedup.combined(left, right, len(data) - cut, base) == whole
    assert exact_dedup.text_hash(data, base, chunk=100) == whole


@pytest.mark.parametrize("settings", [{}, {"prime": 101}, {"huge": 300, "chunk": 100}, {"prime": 101, "huge": 300, "chunk": 100}])
def test_exact_copies(small, settings):
    rows = texts_of(small)
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    want = sorted((k, max(groups[t or ""]), len(groups[t or ""]), k == max(groups[t or ""])) for k, t in rows)
    _, decisions = exact_dedup.decide(small, **settings)
    assert sorted(map(tuple, decisions.select("id", "keep_id", "group_size", "kept").collect())) == want


def test_exact_hostile(hostile):
    rows = exact_dedup.exact_report(hostile).collect()
    assert len(rows) == len(HOSTILE)
    same = [r for r in rows if r["group_size"] == 4]
    assert len(same) == 4 and sum(r["kept"] for r in same) == 1 and {r["keep_id"] for r in same} == {2}
    kept = exact_dedup.drop_copies(hostile)
    assert kept.columns == hostile.columns and kept.count() == len({t or "" for _, t in texts_of(hostile)})
    assert exact_dedup.exact_report(hostile.limit(0)).count() == 0
