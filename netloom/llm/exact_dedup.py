"""Exact duplicates by composable polynomial fingerprints."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import written

CHUNK = 1 << 20  # bytes hashed or compared at once
HUGE = 8 << 20  # texts from this many bytes are hashed chunk by chunk in parallel
PRIME = 2**31 - 1
BASES = (1_103_515_247, 69_069_001)


@lru_cache(maxsize=8)
def _powers(base: int, size: int, prime: int) -> np.ndarray:
    """base^(size-1), ..., base, 1 modulo the prime."""
    out = np.ones(1, np.int64)
    while len(out) < size:
        out = np.concatenate((out * pow(base, len(out), prime) % prime, out))
    return out[-size:]


def chunk_hash(data: np.ndarray, base: int, prime: int = PRIME) -> int:
    """Polynomial hash of at most CHUNK bytes; a byte b counts as b + 1."""
    powers = _powers(base, CHUNK, prime)
    return int((data.astype(np.int64) + 1) @ powers[len(powers) - len(data) :] % prime)


def combined(left: int, right: int, right_size: int, base: int, prime: int = PRIME) -> int:
    """Hash of two byte strings put together, from their hashes."""
    return (left * pow(base, right_size, prime) + right) % prime


def text_hash(data: np.ndarray, base: int, chunk: int = CHUNK, prime: int = PRIME) -> int:
    """Hash of a byte string of any length."""
    value = 0
    for start in range(0, len(data), chunk):
        part = data[start : start + chunk]
        value = combined(value, chunk_hash(part, base, prime), len(part), base, prime)
    return value


def _views(column: pa.Array):
    """The bytes of each value of a binary column without copies; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return [flat[a:b] for a, b in zip(offsets, offsets[1:])]


PAIR = "struct<f1: bigint, f2: bigint>"


def _pairs(rows: list[tuple[int, int]]) -> pa.Array:
    return pa.StructArray.from_arrays(
        [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["f1", "f2"]
    )


def _text_fingerprint(prime: int):
    @F.arrow_udf(PAIR)
    def fingerprint(texts: pa.Array) -> pa.Array:
        return _pairs([tuple(text_hash(v, b, prime=prime) for b in BASES) for v in _views(texts)])

    return fingerprint


def _chunk_fingerprint(prime: int):
    @F.arrow_udf(PAIR)
    def contribution(chunks: pa.Array, behind: pa.Array) -> pa.Array:
        sizes = behind.to_pylist()
        return _pairs(
            [
                tuple(combined(text_hash(v, b, prime=prime), 0, n, b, prime) for b in BASES)
                for v, n in zip(_views(chunks), sizes)
            ]
        )

    return contribution


def chunks_of(df: DataFrame, size: int, *keep: str) -> DataFrame:
    """One row per chunk of the binary column `data` (at least one): `keep`, chunk_no, chunk, behind.

    `behind` is the number of bytes after the chunk.
    """
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("data") / F.lit(size)).cast("int") - 1)
    numbered = df.select(*keep, "data", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    chunk = F.substring("data", F.col("chunk_no") * size + 1, F.lit(size))
    behind = F.greatest(F.lit(0), F.octet_length("data") - (F.col("chunk_no") + 1) * size).cast("long")
    return numbered.select(*keep, "chunk_no", chunk.alias("chunk"), behind.alias("behind"))


def fingerprint_chunks(chunks: DataFrame, key: str, prime: int = PRIME) -> DataFrame:
    """Fingerprints of texts given as chunk rows (key, chunk, behind), hashed in parallel.

    A chunk's hash is shifted by the length of what follows it, so the chunks of
    a text add up in any order; the sums combine before the shuffle.
    """
    each = chunks.select(key, _chunk_fingerprint(prime)("chunk", "behind").alias("f"))
    return each.groupBy(key).agg(
        (F.sum("f.f1") % prime).alias("f1"), (F.sum("f.f2") % prime).alias("f2")
    )


def _identified(df: DataFrame, text: str, prime: int, huge: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(all rows as `line`, `row`, `n_bytes`, `sha`), (line, n_bytes, sha, f1, f2)."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    base = df.select(
        F.monotonically_increasing_id().alias("line"),
        F.octet_length(raw).cast("long").alias("n_bytes"),
        F.sha2(raw, 256).alias("sha"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.when(F.octet_length(raw) < huge, raw).alias("data"),
    )
    table = written(
        base.select("line", "n_bytes", "sha", "row", _text_fingerprint(prime)("data").alias("f")),
        "exact-rows",
        compression="zstd",
    )
    slim = table.select("line", "n_bytes", "sha", "f.f1", "f.f2")
    large = table.where(F.col("n_bytes") >= huge).select("line", F.col(f"row.`{text}`").cast("binary").alias("data"))
    parts = chunks_of(large, chunk, "line").repartition("line", "chunk_no")
    hashed = slim.drop("f1", "f2").join(fingerprint_chunks(parts, "line", prime), "line")
    return table, slim.where(F.col("n_bytes") < huge).unionByName(hashed)


def _classes(table: DataFrame, slim: DataFrame, text: str, chunk: int) -> DataFrame:
    """(line, f1, f2, n_bytes, sha, part): rows are equal exactly when f1, f2, n_bytes and part are.

    Rows that share a fingerprint are compared chunk by chunk: equal chunks at a
    place fall into one group, on the map side already, so a large class costs
    one row per task. A place with two different chunks is a collision; the
    texts of such classes are told apart whole.
    """
    key = ["f1", "f2", "n_bytes"]
    slim = slim.transform(lambda df: written(df, "exact-prints"))
    shared = slim.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = slim.drop("sha").join(shared, key)
    data = table.select("line", F.coalesce(F.col(f"row.`{text}`").cast("binary"), F.lit(b"")).alias("data"))
    chunks = chunks_of(data.join(members, "line"), chunk, *key)
    distinct = chunks.groupBy(*key, "chunk_no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    collided = (
        distinct.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n"), F.max("chunk_no").alias("last"))
        .where("n > last + 1")
        .select(*key)
    )
    collided = written(collided, "exact-collisions")
    if collided.isEmpty():
        return slim.withColumn("part", F.lit(0).cast("long"))
    texts = data.join(slim.join(collided, key, "left_semi"), "line")
    first = texts.groupBy(*key, "data").agg(F.min("line").alias("part"))
    parts = texts.join(first, [*key, "data"]).select("line", "part")
    return slim.join(parts, "line", "left").withColumn("part", F.coalesce("part", F.lit(-1)))


def decide(
    df: DataFrame, text: str = "text", key: str = "doc_id", prime: int = PRIME, huge: int = HUGE, chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame]:
    """(rows as `line` and `row`, decisions per line) for rows with equal texts.

    Texts are equal when their bytes are, null counts as empty. Of equal rows the
    one with the largest `key` stays; a null key is the smallest, and among rows
    that repeat a key exactly one stays. Decisions: line, keep_id, group_size,
    kept, sha. An empty table gives empty tables. `prime` and `chunk` are for
    tests of collisions and of texts of many chunks.
    """
    table, slim = _identified(df, text, prime, huge, chunk)
    named = table.select("line", F.col(f"row.`{key}`").alias("id"))
    rows = _classes(table, slim, text, chunk).join(named, "line")
    same = ["f1", "f2", "n_bytes", "part"]
    groups = rows.groupBy(*same).agg(
        F.max(F.struct("id", "line")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    decisions = rows.join(groups, same).select(
        "line", "id", F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("line") == F.col("keep.line")).alias("kept"), "sha",
    )
    return table.select("line", "row"), decisions


def exact_report(df: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    _, decisions = decide(df)
    return decisions.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


def drop_copies(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns of `df`."""
    rows, decisions = decide(df, text, key)
    return rows.join(decisions.where(~F.col("kept")).select("line"), "line", "left_anti").select("row.*")
