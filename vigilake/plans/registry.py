"""Registered queries over the driver's tables, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigilake.session import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "d6_search_events"


def register(name: str, sql: str | None = None):
    """Register a query callable under `name`, with its SQL if SQL can express it."""

    def keep(function):
        QUERIES[name] = lambda spark, sf_dir: function(importable(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def load() -> None:
    """Import the modules that register queries."""
    from vigilake.plans import case_queries, ledger_queries, review_queries, stream_queries, tool_queries  # noqa: F401
