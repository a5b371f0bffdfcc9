"""The register of named queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.plans.fixtures import Tables

Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is left out where SQL cannot express it on whole tables."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name](Tables(spark, folder))


def load() -> None:
    """Import the modules that register queries."""
    from paperloom.plans import (  # noqa: F401
        cache_queries,
        compliance_queries,
        enrich_queries,
        link_queries,
        metric_queries,
        record_queries,
        search_queries,
        source_queries,
        stream_queries,
    )
