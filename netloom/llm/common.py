"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from netloom.session import discard, scratch_folder

SLICE_BYTES = 4_000_000  # text handled at once inside a task


_owners: list[str] = []
_tables: dict[str, list[str]] = {}


@contextmanager
def scratch_of(spark: SparkSession, owner: str):
    """Tables that `written` makes in this block are deleted when the owner's next block begins.

    For steps whose results are stored before the next one starts.
    """
    for path in _tables.pop(owner, []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _owners.append(owner)
    try:
        yield
    finally:
        _owners.pop()


def written(df: DataFrame, name: str, compression: str = "snappy", by: tuple[str, ...] = ()) -> DataFrame:
    """`df` as a table in the shared folder: later steps read it back, whatever executor made it.

    A filter on the columns `by` reads only the files of these values.
    """
    path = scratch_folder(df.sparkSession, name)
    if _owners:
        _tables.setdefault(_owners[-1], []).append(path)
    df.write.option("compression", compression).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame, value: str | None = None) -> None:
    """Delete the table that `written` made and nothing reads any more, or its rows of a `value`, as `column=1`."""
    paths = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for path in paths:
        if value is None or path.endswith(f"/{value}"):
            discard(df.sparkSession, path)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of a slice stays near `size`; one row at least."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for row, length in enumerate(lengths.tolist()):
            if total and total + length > size:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += length
        if batch.num_rows > start:
            yield batch.slice(start)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
