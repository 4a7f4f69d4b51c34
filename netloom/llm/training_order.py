"""Token sequences in training order: a keyed permutation gives every sequence its slot."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import dropped, slices, written
from netloom.llm.sentencepiece_codec import mixed
from netloom.session import scratch_folder

RANKS = "byte_bpe_50k.tiktoken"
END = 50256  # id after each text and in the rest of its last sequence
NAME = "<|endoftext|>"  # what the library calls it
LENGTH = 1024  # tokens of a sequence
SHARD = 65_536  # sequences of a shard
ROUNDS = 6
PASSES = 6  # ranges of shards that are written one after the other, so that a shuffle holds a sixth of the records
# A record in a shard file is the sequence as little-endian uint16 and two zero bytes.
CLOSING = "\0\0"
DIGITS = 8  # of the shard number in a path


@lru_cache(maxsize=2)
def _encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    # Without any special token the library would try an empty pattern at every character.
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={NAME: END})


def encoded(encoder: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a text as an array; a special token's name inside it is plain text."""
    return encoder.encode_to_numpy(text, disallowed_special=())


def permuted(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A keyed permutation of 0 .. size - 1, applied to `index`.

    A balanced Feistel network permutes the smallest even number of bits that
    holds `size`; a value that leaves the range walks on along its cycle until
    it is back, which is four steps on average at most.
    """
    half = max(1, ((max(size - 1, 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mixed(np.arange(ROUNDS, dtype=np.uint64) + mixed(np.array([seed & (2**64 - 1)], np.uint64)))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for key in keys:
            left, right = right, left ^ (mixed(right ^ key) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def sequences(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, path: str | None = None) -> DataFrame:
    """(task, nth, key, part, n_tokens, tokens): the ids of every text and an end id, cut into sequences.

    `tokens` holds `length` little-endian uint16; the last sequence of a text is
    filled with end ids, which n_tokens does not count (the one end id is
    counted). A null or empty text is one sequence with the end id alone.
    `task` and `nth` number the sequences of each task in order. Texts are dealt
    by ranges of key and text, and equal rows over several tasks, so that going
    through the tasks in order passes all sequences by key, text and part.
    """
    ranks = path or public_tokenizers.path(RANKS)
    docs = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumns({"_print": F.xxhash64("text"), "_deal": F.rand(1)})
    docs = docs.repartitionByRange("key", "_print", "_deal").sortWithinPartitions("key", "_print").select("key", "text")
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, nth = _encoder(ranks), TaskContext.get().partitionId(), 0
        for part in slices(batches, "text", 2_000_000):
            ids = [encoded(encoder, one) for one in part.column("text").to_pylist()]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) + 1  # with the end id
            sizes = -(-lengths // length)
            begins = np.cumsum(sizes) - sizes
            flat = np.full(int(sizes.sum()) * length, END, "<u2")
            for begin, one in zip((begins * length).tolist(), ids):
                flat[begin : begin + len(one)] = one
            owner = np.repeat(np.arange(len(ids)), sizes)
            place = np.arange(len(owner)) - begins[owner]
            counts = np.minimum(length, lengths[owner] - place * length)
            cuts = pa.array(np.arange(len(owner) + 1) * 2 * length, pa.int64())
            records = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(owner), [None, cuts.buffers()[1], pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(owner), task), pa.int32()), pa.array(nth + np.arange(len(owner)), pa.int64()),
                    part.column("key").take(pa.array(owner)), pa.array(place, pa.int32()),
                    pa.array(counts, pa.int32()), records.cast(pa.binary()),
                ],
                names=["task", "nth", "key", "part", "n_tokens", "tokens"],
            )
            nth += len(owner)

    return docs.mapInArrow(run, f"task int, nth bigint, key {kind}, part int, n_tokens int, tokens binary")


def _placed(df: DataFrame, text: str, key: str, seed: int, length: int, shard: int) -> tuple[DataFrame, int]:
    """Every sequence with its place, in no order, and how many there are."""
    with _shuffles_deleted(df.sparkSession):
        table = written(sequences(df, text, key, length), "order-sequences", compression="zstd")
    tasks = table.groupBy("task").agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect()  # one row per task
    starts, total = [], 0
    for row in tasks:
        starts.append((row["task"], total))
        total += row["n"]
    offsets = df.sparkSession.createDataFrame(starts, "task int, start bigint")

    @F.arrow_udf("bigint")
    def slot(index: pa.Array) -> pa.Array:
        return pa.array(permuted(index.to_numpy(zero_copy_only=False), total, seed), pa.int64())

    # One row per task of the scan: bounded by the number of tasks. Called nondeterministic, the
    # function runs once a row; else the planner puts a second call into a filter on the slot.
    numbered = table.join(F.broadcast(offsets), "task").withColumn(
        "slot", slot.asNondeterministic()(F.col("start") + F.col("nth"))
    )
    return numbered.select(
        F.expr(f"slot div {shard}").cast("int").alias("shard"), "slot",
        (F.col("slot") % shard * _stride(length)).alias("byte_offset"), "key", "part", "n_tokens", "tokens",
    ), total


def _stride(length: int) -> int:
    return 2 * length + len(CLOSING)


def _by_slot(placed: DataFrame, first: int, end: int) -> DataFrame:
    """The records of shards `first` to `end` - 1: a partition per shard, in order."""
    return placed.repartitionById(max(1, end - first), F.col("shard") - first).sortWithinPartitions("shard", "slot")


def in_training_order(
    df: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 5, length: int = LENGTH, shard: int = SHARD
) -> DataFrame:
    """(shard, slot, byte_offset, key, part, n_tokens, tokens), a partition per shard, sorted by slot.

    Sequences are numbered densely by key, text (its hash) and part: those of earlier
    tasks, then those before in the task; the start of each task is a table of one row
    per task. The slot of a sequence is the keyed permutation of its number, so slots
    are 0 .. N - 1, each once, and depend on rows and seed alone, not on how the rows
    are dealt (equal rows may change places). Shard s holds the slots from s * `shard` on, and a record stands
    at `byte_offset` of its shard's file. An empty table has no sequences.
    """
    placed, total = _placed(df, text, key, seed, length, shard)
    return _by_slot(placed, 0, -(-total // shard))


def write_shards(ordered: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write fixed-stride shard files `shard=K/part-*`: records of a shard in slot order, no header.

    K has eight digits, so files sort by number. Spark's own writer commits whole
    tasks, so a lost executor leaves no half file. Every record ends with two zero bytes.
    """
    named = ordered.withColumn("_name", F.lpad(F.col("shard").cast("string"), DIGITS, "0")).sortWithinPartitions("_name", "slot")
    record = named.select(F.col("_name").alias("shard"), F.col("tokens").cast("string").alias("value"))
    record.write.mode(mode).partitionBy("shard").option("lineSep", CLOSING).text(path)


def position(slot: int, length: int = LENGTH, shard: int = SHARD) -> tuple[int, int]:
    """(shard, byte offset) of a slot: where reading goes on after a stop."""
    return slot // shard, slot % shard * _stride(length)


def read_shard(spark: SparkSession, path: str, number: int, length: int = LENGTH) -> DataFrame:
    """(place, tokens) of a shard: records of fixed length, read in splits."""
    stride = _stride(length)
    records = spark.sparkContext.binaryRecords(f"{path}/shard={number:0{DIGITS}d}/part-*", stride)
    rows = records.zipWithIndex().map(lambda x: (x[1], bytearray(x[0][: 2 * length])))
    return spark.createDataFrame(rows, "place bigint, tokens binary")


@contextmanager
def _shuffles_deleted(spark: SparkSession):
    """Shuffle files of a write in this block go when it has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _records(spark: SparkSession, path: str, length: int):
    """(place, record) of all shards, a partition each, in order; the places come from the files.

    One reader lists the files by name; splits are larger than any file.
    """
    kind = "org.apache.spark.input.FixedLengthBinaryInputFormat"
    settings = {f"{kind}.recordLength": str(_stride(length)), "mapreduce.input.fileinputformat.split.minsize": str(2**40)}
    io = "org.apache.hadoop.io"
    return spark.sparkContext.newAPIHadoopFile(
        f"{path}/shard=*/part-*", kind, f"{io}.LongWritable", f"{io}.BytesWritable", conf=settings
    )


def order_report(
    df: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 5, length: int = LENGTH, shard: int = SHARD,
    path: str | None = None,
) -> DataFrame:
    """Every sequence of the documents with its place, in training order; its tokens are read from the shard files.

    The shards are written to `path`, or to a new folder of the shared one. Sequences
    are numbered once: they are stored with their slots, apart by the pass that writes
    them; a pass reads its own alone, and they go when their shards are there. The list
    of places is dealt into the same partitions as the files; a file that has another
    number of records, or a record in another place, is an error.
    """
    spark = df.sparkSession
    placed, total = _placed(df, text, key, seed, length, shard)
    shards = -(-total // shard)
    schema = placed.withColumnRenamed("key", "doc_id").schema
    if not total:
        return spark.createDataFrame([], schema)
    path = path or scratch_folder(spark, "order-shards")
    # Pass k has the shards from `cuts[k]` on: the last k with shards * k < (shard + 1) * PASSES.
    cuts = [shards * k // PASSES for k in range(PASSES + 1)]
    number = F.expr(f"((shard + 1L) * {PASSES} - 1) div {shards}").cast("int")
    table = written(placed.withColumn("pass", number), "order-placed", "zstd", ("pass",))
    dropped(placed)
    places = written(table.drop("pass", "tokens").withColumnRenamed("key", "doc_id"), "order-places")
    with _shuffles_deleted(spark):
        for k, (first, end) in enumerate(zip(cuts, cuts[1:])):
            if first < end:
                write_shards(_by_slot(table.where(F.col("pass") == k).drop("pass"), first, end), path, "append")
                dropped(table, f"pass={k}")
    index = _by_slot(places, 0, shards)
    records = _records(spark, path, length)

    def joined(pair):
        row, (place, record) = pair
        if row["slot"] % shard != place:
            raise ValueError(f"slot {row['slot']} is record {place} of its shard")
        return (*row, record[: 2 * length])

    return spark.createDataFrame(index.rdd.zip(records).map(joined), schema, verifySchema=False)
