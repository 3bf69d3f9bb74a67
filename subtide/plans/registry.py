"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from subtide.plans import line_queries, word_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return line_queries.QUERIES | word_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return line_queries.SQL | word_queries.SQL
