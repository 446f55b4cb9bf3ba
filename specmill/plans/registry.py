"""The registry of the core queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specmill.plans import audit_queries, audit_sql, quantities

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**audit_queries.QUERIES, **quantities.QUERIES}
SQL: dict[str, str] = {**audit_sql.SQL, **quantities.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that entry() runs: the report of every document."""
    return QUERIES["report"](spark, sf_dir)
