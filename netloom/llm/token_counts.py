"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.bpe_arrays import SPACE, blank_words, marked, merge_all, piece_model, points_of, utf8_size
from netloom.llm.common import slices

MODEL = "piece_bpe_32k.model"
REMEMBERED = 400_000  # pre-tokens whose count a Python worker remembers before it starts anew

_known: dict[str, dict[str, int]] = {}


def counts_of(words: list[str], path: str) -> np.ndarray:
    """Tokens of each pre-token: surviving symbols, and the UTF-8 bytes of characters that are no piece."""
    model = piece_model(path)
    points, sizes = points_of([marked(w) for w in words])
    symbols, survivors = merge_all(model, points, sizes)
    tokens = np.where(symbols >= 0, 1, utf8_size(-1 - symbols))
    owner = np.repeat(np.arange(len(words)), survivors)
    return np.bincount(owner, weights=tokens, minlength=len(words)).astype(np.int64)


def count_texts(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text. Pre-tokens not seen before are merged together in one ragged batch."""
    known = _known.setdefault(path, {})
    if len(known) > REMEMBERED:
        known.clear()
    split = [blank_words(t.replace(SPACE, " ")) if t else [] for t in texts]
    fresh = list(set().union(*split).difference(known))
    if fresh:
        known.update(zip(fresh, counts_of(fresh, path).tolist()))
    return [sum(map(known.__getitem__, words)) for words in split]


def count_tokens(
    df: DataFrame, text: str = "text", name: str = "n_tokens", model_path: str | None = None
) -> DataFrame:
    """Add the number of tokens that the piece model's library gives for each text.

    Begin, end and special tokens are not added, and their strings inside texts
    are ordinary text. A null or empty text has 0 tokens; a column called `name`
    is replaced. Pre-tokens of a slice of the batch are ragged arrays; each round
    applies the lowest-rank pair of every sequence (`bpe_arrays.merge_all`). What stays
    above `bpe_arrays.LONG` symbols after cutting uses a heap agenda of its own.
    """
    path = model_path or public_tokenizers.path(MODEL)
    kept = df.drop(name)
    schema = kept.select("*", F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            counts = count_texts(part.column(text).to_pylist(), path)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(counts, pa.int64())], names=[*part.schema.names, name]
            )

    return kept.mapInArrow(run, schema)


def token_report(df: DataFrame, limit: int = 4096, model_path: str | None = None) -> DataFrame:
    """doc_id, bytes and tokens of each text, and whether it has more than `limit` tokens."""
    counted = count_tokens(df.select("doc_id", "text"), model_path=model_path)
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
