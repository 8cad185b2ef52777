"""Registered queries: name -> callable, and name -> DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registered() -> tuple[dict[str, Query], dict[str, str]]:
    from . import architecture, derived, links, patterns, sources, text

    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module in (patterns, architecture, derived, links, sources, text):
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
