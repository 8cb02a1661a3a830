"""Named queries over the driver's tables, each with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its oracle."""

    def add(fn: Query) -> Query:
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return add


def queries() -> dict[str, Query]:
    load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    load()
    return _ORACLES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a search over all documents."""
    from lexmill.plans.search_queries import flagship

    return flagship(spark, sf_dir)


def load() -> None:
    """Import the modules that register queries."""
    from lexmill.plans import corpus_queries, display_queries, page_queries, search_queries, talk_queries, tool_queries  # noqa: F401
