"""All queries of the core with the SQL that gives the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyra.plans import core_problems, extraction_queries, layout_queries, passthrough_queries, sheet_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

for _part in (core_problems, text_queries, layout_queries, sheet_queries, passthrough_queries, extraction_queries):
    QUERIES.update(_part.QUERIES)
    SQL.update(_part.SQL)
