"""User-supplied analysers and message handlers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]

_ANALYZERS: dict[str, Transform] = {}
_DECODERS: dict[str, Transform] = {}


def register_analyzer(name: str, fn: Transform) -> None:
    """Name a function from packets to results."""
    _ANALYZERS[name] = fn


def analyze(packets: DataFrame, name: str) -> DataFrame:
    """Run a registered analyser."""
    return packets.transform(_ANALYZERS[name])


def register_decoder(plugin: str, fn: Transform) -> None:
    """Name the function that decodes the messages of a plug-in."""
    _DECODERS[plugin] = fn


def route(messages: DataFrame, plugin: str) -> DataFrame:
    """Decoded messages of one plug-in.

    The plug-in column is dropped after the filter; stored as a partition
    column it prunes the scan to the plug-in's own files.
    """
    return _DECODERS[plugin](messages.where(F.col("plugin") == plugin).drop("plugin"))


def unknown_plugins(messages: DataFrame) -> DataFrame:
    """Messages per plug-in name that nothing decodes."""
    known = reduce(lambda a, b: a | b, [F.col("plugin") == p for p in _DECODERS], F.lit(False))
    return messages.where(~known).groupBy("plugin").agg(F.count(F.lit(1)).alias("messages"))
