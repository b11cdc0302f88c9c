"""All registered queries of the retrieval engine, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import more_queries, retrieval_queries, store_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return store_queries.QUERIES | retrieval_queries.QUERIES | more_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return store_queries.SQL | retrieval_queries.SQL | more_queries.SQL
