"""The registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; ``sql`` gives the same rows in DuckDB."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key!r} exists")
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All of them; importing the modules registers what they hold."""
    from quillmill.plans import evidence_queries, join_queries, merge_queries, record_queries, source_queries, stream_queries, trend_queries  # noqa: F401

    return dict(QUERIES), dict(ORACLES)
