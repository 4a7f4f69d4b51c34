"""Reversible line dedup: sharded cuckoo filters in front of exact reference counts."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import written
from netloom.llm.exact_dedup import _views
from netloom.llm.sentencepiece_codec import mixed
from netloom.session import scratch_folder

LEAST = 10  # code points of a key that is compared
INCREMENTS = 2  # batches in which the report inserts a table
SHARD_KEYS = 1 << 20  # keys that one filter is meant for; the number of shards follows from the first batch
SLOTS = 4  # fingerprints of a bucket
LOAD = 0.85  # share of slots in use beyond which a filter doubles
KICKS = 500  # rounds of moving fingerprints before it doubles
BLANKS = b" \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# --- lines and keys


def key_of(line: bytes) -> bytes:
    """A line without blanks at its ends, A-Z in lower case."""
    return line.strip(BLANKS).translate(_LOWER)


def _long(key: bytes, least: int) -> bool:
    """The key has `least` code points; one takes four bytes at most."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _prints(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def line_keys(data: bytes, least: int = LEAST) -> list[bytes | None]:
    """128-bit print of each line's key, None for keys of less than `least` code points."""
    found = []
    for line in data.split(b"\n"):
        key = key_of(line)
        found.append(_prints(key) if _long(key, least) else None)
    return found


KEYS = "array<struct<h1: bigint, h2: bigint, k: int>>"


def _key_maker(least: int):
    @F.arrow_udf(KEYS)
    def keys(texts: pa.Array) -> pa.Array:
        """Distinct keys of a text; k counts them in the order of their first lines."""
        prints, places, counts = [], [], []
        for view in _views(texts):
            distinct = dict.fromkeys(p for p in line_keys(view.tobytes(), least) if p is not None)
            prints.extend(distinct)
            places.append(np.arange(len(distinct), dtype=np.int32))
            counts.append(len(distinct))
        halves = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
        k = np.concatenate(places) if places else np.zeros(0, np.int32)
        rows = pa.StructArray.from_arrays(
            [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(k)], names=["h1", "h2", "k"]
        )
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), rows)

    return keys


def _cutter(least: int):
    @F.arrow_udf("struct<n_lines: bigint, n_dropped: bigint, sha: string, rest: binary>")
    def cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
        lines, dropped, shas, rests = [], [], [], []
        for view, numbers in zip(_views(texts), gone):
            data = view.tobytes()
            rows = data.split(b"\n")
            wanted = set(numbers.as_py() or ())
            rest = data
            if wanted:
                place: dict[bytes, int] = {}
                kept = []
                for row, key in zip(rows, line_keys(data, least)):
                    if key is None or place.setdefault(key, len(place)) not in wanted:
                        kept.append(row)
                dropped.append(len(rows) - len(kept))
                rest = b"\n".join(kept)
            else:
                dropped.append(0)
            lines.append(len(rows))
            shas.append(hashlib.sha256(rest).hexdigest())
            rests.append(rest)
        return pa.StructArray.from_arrays(
            [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(shas), pa.array(rests, pa.binary())],
            names=["n_lines", "n_dropped", "sha", "rest"],
        )

    return cut


# --- cuckoo filters


class Cuckoo:
    """A set of 16-bit fingerprints that also forgets; equal fingerprints are stored once per key.

    A key's two buckets are an exclusive or of its fingerprint's hash apart, so a
    fingerprint can move without its key. Inserting works on all keys at once, in
    rounds: what finds a free slot stays, the rest swaps places with stored ones.
    """

    def __init__(self, bits: int, table: np.ndarray | None = None):
        self.bits = bits
        self.table = np.zeros((1 << bits, SLOTS), np.uint16) if table is None else table

    @staticmethod
    def sized(keys: int) -> Cuckoo:
        return Cuckoo(max(2, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * LOAD))))))

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(mark.astype(np.uint64)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (h2.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        bucket = (mixed(h1.view(np.uint64)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return mark, bucket

    def may_hold(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """False only for keys that were not inserted."""
        mark, one = self._places(h1, h2)
        two = self._other(one, mark)
        return (self.table[one] == mark[:, None]).any(axis=1) | (self.table[two] == mark[:, None]).any(axis=1)

    @staticmethod
    def _turns(bucket: np.ndarray) -> np.ndarray:
        """How many earlier rows name the same bucket."""
        order = np.argsort(bucket, kind="stable")
        ranked = bucket[order]
        fresh = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
        turn = np.empty(len(bucket), np.int64)
        turn[order] = np.arange(len(bucket)) - np.repeat(fresh, np.diff(np.append(fresh, len(ranked))))
        return turn

    def _settle(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their bucket; True for those that found one."""
        free = self.table[bucket] == 0
        turn = self._turns(bucket)
        fits = turn < free.sum(axis=1)
        slot = (np.cumsum(free, axis=1) <= turn[:, None]).sum(axis=1)
        self.table[bucket[fits], slot[fits]] = mark[fits]
        return fits

    def add(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """Insert distinct new keys; False, with the filter spoilt, if it is too full for them."""
        mark, bucket = self._places(h1, h2)
        for _ in range(2):
            left = ~self._settle(mark, bucket)
            mark, bucket = mark[left], self._other(bucket[left], mark[left])
        for k in range(KICKS):
            if not len(mark):
                return True
            # One waiting fingerprint per bucket takes a slot; what was there goes to its other bucket.
            first = self._turns(bucket) == 0
            at, slot = bucket[first], (mixed(mark[first].astype(np.uint64) + np.uint64(k)) % np.uint64(SLOTS)).astype(np.int64)
            evicted = self.table[at, slot].copy()
            self.table[at, slot] = mark[first]
            mark = np.concatenate((evicted, mark[~first]))
            bucket = np.concatenate((self._other(at, evicted), bucket[~first]))
            left = ~self._settle(mark, bucket)
            mark, bucket = mark[left], bucket[left]
        return False

    def remove(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Forget keys that were inserted, one fingerprint for each."""
        mark, bucket = self._places(h1, h2)
        for _ in range(2):
            same = self.table[bucket] == mark[:, None]
            turn = self._turns(bucket << 16 | mark)
            hit = turn < same.sum(axis=1)
            slot = (np.cumsum(same, axis=1) <= turn[:, None]).sum(axis=1)
            self.table[bucket[hit], slot[hit]] = 0
            mark, bucket = mark[~hit], self._other(bucket[~hit], mark[~hit])


FILTERS = "shard int, bits int, items bigint, full boolean, slots binary"


def _filter_row(shard: int, cuckoo: Cuckoo, items: int, full: bool) -> pa.Table:
    row = {"shard": [shard], "bits": [cuckoo.bits], "items": [items], "full": [full], "slots": [cuckoo.table.tobytes()]}
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.table({n: pa.array(v, k) for (n, v), k in zip(row.items(), kinds)})


def _stored_filter(rows: pa.Table) -> tuple[Cuckoo, int]:
    slots = np.frombuffer(rows["slots"][0].as_py(), np.uint16).reshape(-1, SLOTS).copy()
    return Cuckoo(rows["bits"][0].as_py(), slots), rows["items"][0].as_py()


def _halves(keys: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return keys["h1"].to_numpy(), keys["h2"].to_numpy()


def _built(keys: pa.Table) -> pa.Table:
    """The filter of all keys of a shard."""
    h1, h2 = _halves(keys)
    cuckoo = Cuckoo.sized(len(h1))
    while not cuckoo.add(h1, h2):
        cuckoo = Cuckoo(cuckoo.bits + 1)
    return _filter_row(keys["shard"][0].as_py(), cuckoo, len(h1), False)


def _probed(keys: pa.Table, rows: pa.Table) -> pa.Table:
    """Keys that the filter of their shard may hold."""
    names = ["h1", "h2"]
    if not keys.num_rows or not rows.num_rows:
        return keys.select(names).slice(0, 0)
    return keys.select(names).filter(pa.array(_stored_filter(rows)[0].may_hold(*_halves(keys))))


def _changed(keys: pa.Table, rows: pa.Table) -> pa.Table:
    """The filter of a shard after new keys came in or old ones went out (`live`); `full` if it is too small."""
    if not rows.num_rows:
        return _built(keys)
    cuckoo, items = _stored_filter(rows)
    shard = rows["shard"][0].as_py()
    if not keys.num_rows:
        return _filter_row(shard, cuckoo, items, False)
    live = keys["live"].to_numpy(zero_copy_only=False)
    h1, h2 = _halves(keys)
    cuckoo.remove(h1[~live], h2[~live])
    total = items + int(live.sum()) - int((~live).sum())
    fits = total <= LOAD * cuckoo.table.size and cuckoo.add(h1[live], h2[live])
    return _filter_row(shard, cuckoo, total, not fits)


# --- the index


def _first(doc: str) -> Column:
    """Order of documents: by id, the null id last."""
    return F.struct(F.col(doc).isNull().alias("none"), F.col(doc).alias("doc"))


def extracted(df: DataFrame, text: str, least: int, *keep: Column) -> DataFrame:
    """`keep`, h1, h2 and k of every distinct key of every row."""
    return df.select(*keep, _key_maker(least)(F.col(text).cast("binary")).alias("_keys")).select("*", F.inline("_keys")).drop("_keys")


@dataclass
class LineIndex:
    """Which document holds which line key: exact tables in a shared folder, and a filter per shard of keys.

    `holders` has one row per key and document row, `counts` one per change of a
    key: the references it has since that version, and the first and last
    document that holds it. The newest row of a key counts. Each insert or delete
    is a version, and its tables are complete before it is committed, so a job
    that died leaves the last version as it was.

    A batch of documents asks the filters first. Keys that no filter knows are new
    and need no look at `counts`; the others are looked up there exactly, so what a
    filter wrongly believes changes nothing. Filters forget keys whose last
    reference goes. Keys are compared by 128-bit prints.
    """

    spark: SparkSession
    folder: str
    least: int = LEAST
    shard_keys: int = SHARD_KEYS
    version: int = 0
    shards: int = 0
    keys: int = 0
    parts: list[tuple[str, int, str]] = field(default_factory=list)

    @staticmethod
    def create(spark: SparkSession, folder: str | None = None, least: int = LEAST, shard_keys: int = SHARD_KEYS) -> LineIndex:
        """An empty index in `folder` (by default a new one in the shared folder)."""
        return LineIndex(spark, folder or scratch_folder(spark, "line-index"), least, shard_keys)

    @staticmethod
    def open(spark: SparkSession, folder: str) -> LineIndex:
        """The last committed version of a stored index."""
        states = spark.read.parquet(f"{folder}/state")
        last = states.agg(F.max("version")).first()[0]
        rows = states.where(F.col("version") == last).collect()
        head = rows[0]
        parts = [(r["kind"], r["since"], r["path"]) for r in rows]
        return LineIndex(spark, folder, head["least"], head["shard_keys"], last, head["shards"], head["keys"], parts)

    def _commit(self, version: int, shards: int, keys: int, parts: list[tuple[str, int, str]]) -> None:
        rows = [(k, s, p, self.least, self.shard_keys, shards, keys) for k, s, p in parts]
        state = self.spark.createDataFrame(
            rows, "kind string, since int, path string, least int, shard_keys long, shards int, keys long"
        )
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state/version={version}")
        self.version, self.shards, self.keys, self.parts = version, shards, keys, parts

    def _write(self, df: DataFrame, kind: str, version: int) -> tuple[str, int, str]:
        """A table of a version that is not yet committed; one left over from a job that died is replaced."""
        path = f"{self.folder}/{kind}-{version}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return kind, version, path

    def _read(self, kind: str, parts: list[tuple[str, int, str]] | None = None) -> DataFrame | None:
        found = None
        for name, since, path in self.parts if parts is None else parts:
            if name == kind:
                rows = self.spark.read.parquet(path).withColumn("since", F.lit(since))
                found = rows if found is None else found.unionByName(rows)
        return found

    def _shard(self, shards: int) -> Column:
        return F.pmod(F.shiftrightunsigned("h1", 20), F.lit(shards)).cast("int")

    def holders(self) -> DataFrame | None:
        """Live (h1, h2, doc, since) rows."""
        held, gone = self._read("holders"), self._read("gone")
        if held is None or gone is None:
            return held
        gone = gone.select(F.col("doc").alias("_doc"), F.col("since").alias("_since"))
        return held.join(gone, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("since") < F.col("_since")), "left_anti")

    def counts(self, parts=None) -> DataFrame | None:
        """(h1, h2, refs, first, last) of every key with a reference."""
        rows = self._read("counts", parts)
        if rows is None:
            return None
        newest = F.max_by(F.struct("refs", "first", "last"), "since").alias("c")
        single = sum(kind == "counts" for kind, _, _ in (self.parts if parts is None else parts)) == 1
        latest = rows if single else rows.groupBy("h1", "h2").agg(newest).select("h1", "h2", "c.*")
        return latest.where("refs > 0").select("h1", "h2", "refs", "first", "last")

    def shared(self) -> DataFrame:
        """(h1, h2, first) of the keys that two documents or more hold."""
        found = self.counts()
        if found is None:
            return self.spark.createDataFrame([], "h1 long, h2 long, first struct<none: boolean, doc: long>")
        return found.where("NOT first <=> last").select("h1", "h2", "first")

    def filters(self) -> DataFrame | None:
        return self._read("filters")

    def _rebuilt(self, counts: DataFrame, shards: int) -> DataFrame:
        keyed = counts.select("h1", "h2", self._shard(shards).alias("shard"))
        return keyed.groupBy("shard").applyInArrow(_built, FILTERS)

    def _filtered(self, version: int, changes: DataFrame, keys: int, parts: list) -> tuple[int, list]:
        """Store the filters after `changes` (h1, h2, live): (number of shards, parts of the version)."""
        rest = [p for p in parts if p[0] != "filters"]
        if not self.shards or keys > 2 * self.shards * self.shard_keys:
            shards = max(1, -(-keys // self.shard_keys))
            return shards, [*rest, self._write(self._rebuilt(self.counts(parts), shards), "filters", version)]
        keyed = changes.withColumn("shard", self._shard(self.shards))
        updated = keyed.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(_changed, FILTERS)
        stored = self._write(updated, "filters", version)
        made = self.spark.read.parquet(stored[2])
        full = made.where("full").select("shard")
        if full.isEmpty():
            return self.shards, [*rest, stored]
        small = self.counts(parts).withColumn("shard", self._shard(self.shards)).join(full, "shard", "left_semi")
        whole = made.where("NOT full").unionByName(small.groupBy("shard").applyInArrow(_built, FILTERS))
        return self.shards, [*rest, ("filters", version, self._write(whole, "filters-grown", version)[2])]

    def insert(self, df: DataFrame, doc: str = "doc_id", text: str = "text") -> None:
        """Add the lines of documents; a document id that is there already holds the lines of both."""
        version = self.version + 1
        held = extracted(df, text, self.least, F.col(doc).alias("doc")).drop("k")
        parts = [*self.parts, self._write(held, "holders", version)]
        ends = F.min(_first("doc")).alias("first"), F.max(_first("doc")).alias("last")
        fresh = self.spark.read.parquet(parts[-1][2]).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("refs"), *ends)
        known = None
        if self.filters() is not None:
            batch = self.spark.read.parquet(self._write(fresh, "batch", version)[2])
            keyed = batch.select("h1", "h2", self._shard(self.shards).alias("shard"))
            suspects = keyed.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(_probed, "h1 bigint, h2 bigint")
            known = self.counts().join(suspects, ["h1", "h2"], "left_semi").toDF("h1", "h2", "_refs", "_first", "_last")
            fresh = batch.join(known, ["h1", "h2"], "left").select(
                "h1", "h2", (F.col("refs") + F.coalesce("_refs", F.lit(0))).alias("refs"),
                F.least("first", "_first").alias("first"), F.greatest("last", "_last").alias("last"),
                F.col("_refs").isNull().alias("live"),
            )
        else:
            fresh = fresh.withColumn("live", F.lit(True))
        parts.append(self._write(fresh, "counts", version))
        new = self.spark.read.parquet(parts[-1][2]).where("live").select("h1", "h2", "live")
        keys = self.keys + new.count()
        self._commit(version, *self._closed(version, new, keys, parts))

    def delete(self, ids: DataFrame, doc: str = "doc_id") -> None:
        """Take documents out again: the index is then as if they had never been inserted."""
        held = self.holders()
        if held is None:
            return
        version = self.version + 1
        out = self._write(ids.select(F.col(doc).alias("doc")).distinct(), "gone", version)
        gone = self.spark.read.parquet(out[2]).select(F.col("doc").alias("_doc"))
        same = F.col("doc").eqNullSafe(F.col("_doc"))
        touched = held.join(gone, same, "left_semi").select("h1", "h2").distinct()
        stay = held.join(touched, ["h1", "h2"], "left_semi").join(gone, same, "left_anti")
        ends = F.min(_first("doc")).alias("first"), F.max(_first("doc")).alias("last")
        left = stay.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("refs"), *ends)
        fresh = touched.join(left, ["h1", "h2"], "left").select(
            "h1", "h2", F.coalesce("refs", F.lit(0)).cast("long").alias("refs"), "first", "last", F.lit(False).alias("live")
        )
        parts = [*self.parts, out, self._write(fresh, "counts", version)]
        lost = self.spark.read.parquet(parts[-1][2]).where("refs = 0").select("h1", "h2", "live")
        keys = self.keys - lost.count()
        self._commit(version, *self._closed(version, lost, keys, parts))

    def _closed(self, version: int, changes: DataFrame, keys: int, parts: list) -> tuple[int, int, list]:
        shards, parts = self._filtered(version, changes, keys, parts)
        return shards, keys, parts


def deduplicated(df: DataFrame, index: LineIndex, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, n_lines, n_dropped, sha, rest) of every row: its text without lines that an earlier document holds.

    A line goes when its key is in two documents of the index at least, and this
    is not the first of them. `sha` is the SHA-256 of `rest`, the lines that stay.
    """
    base = df.select(
        F.monotonically_increasing_id().alias("line"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
    )
    table = written(base, "line-rows", compression="zstd")
    keys = extracted(table.select("line", F.col(f"row.`{doc}`").alias("doc"), F.col(f"row.`{text}`").alias("text")), "text", index.least, F.col("line"), F.col("doc"))
    later = keys.join(index.shared(), ["h1", "h2"]).where(~_first("doc").eqNullSafe(F.col("first")))
    gone = later.groupBy("line").agg(F.collect_list("k").alias("gone"))
    cut = _cutter(index.least)(F.col(f"row.`{text}`").cast("binary"), F.col("gone"))
    done = table.join(gone, "line", "left").select("row", cut.alias("c"))
    return done.select("row", "c.n_lines", "c.n_dropped", "c.sha", F.col("c.rest").cast("string").alias("rest"))


def line_report(df: DataFrame, increments: int = INCREMENTS, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document.

    The table goes into a new index in `increments` batches by a hash of its ids,
    so that all but the first ask the filters; their number does not change the
    result. A null or empty text is one empty line. Rows with the same id are one
    document: lines that only they hold stay in all of them. The null id is a
    document like any other, behind all others.
    """
    slim = df.select("doc_id", "text")
    index = LineIndex.create(df.sparkSession, least=least)
    for k in range(increments):
        index.insert(slim.where(F.pmod(F.xxhash64("doc_id"), F.lit(increments)) == k))
    return deduplicated(slim, index).select("row.doc_id", "n_lines", "n_dropped", F.col("sha").alias("kept_sha256"))


# The same rows by grouping: lines, the documents of each key, and the lines that stay.
REPORT_SQL = f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
  l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d),
  s AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
  k AS (SELECT doc_id, i, line, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key, length(bare) >= {LEAST} AS long FROM s),
  f AS (SELECT key, min(doc_id) AS first FROM k WHERE long GROUP BY key HAVING count(DISTINCT doc_id) > 1)
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first IS NOT NULL AND first <> doc_id) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (first IS NULL OR first = doc_id), '')) AS kept_sha256
  FROM k LEFT JOIN f ON long AND k.key = f.key GROUP BY doc_id"""
