"""The registry of queries over the driver's tables, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clickloom.plans import queries_graph, queries_model, queries_sources, queries_stream, queries_table, queries_text

Query = Callable[[SparkSession, str], DataFrame]


def _all() -> dict[str, tuple[Query, str | None]]:
    return {**queries_table.QUERIES, **queries_text.QUERIES, **queries_graph.QUERIES, **queries_model.QUERIES, **queries_stream.QUERIES, **queries_sources.QUERIES}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
