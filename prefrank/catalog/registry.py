"""Named queries over the check tables, each with its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    from prefrank.catalog import (  # noqa: F401
        monitoring_queries, privacy_queries, quality_queries, metric_queries,
        reader_queries, routing_queries, scoring_queries, stream_queries, text_queries, training_queries,
    )

    return QUERIES, ORACLES
