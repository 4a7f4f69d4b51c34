"""Test inputs, registered queries and their reference SQL."""

from importlib import import_module

MODULES = (
    "score_queries", "group_queries", "client_queries", "probe_queries",
    "set_queries", "join_queries", "lan_queries", "packet_queries", "limit_queries",
    "codec_queries", "archive_queries", "source_queries", "frame_queries",
    "stream_queries", "selection_queries", "default_queries",
)


def load() -> None:
    """Import every module that registers queries."""
    for module in MODULES:
        import_module(f"netloom.plans.{module}")
