"""Queries of problem 1: measured values in common units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmill.operators.units import extract_measurements
from specmill.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every measured value of every section; a section delivered twice counts once."""
    found = extract_measurements(table(spark, sf_dir, "structure"), "content_text", ["doc_id", "section_ord"])
    return found.distinct()


def p1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per quantity: how many values there are, and their range in the base unit."""
    return p1_found(spark, sf_dir).groupBy("quantity").agg(
        F.count("*").alias("values"),
        F.countDistinct("doc_id").alias("docs"),
        F.min("base_value").alias("least"),
        F.max("base_value").alias("greatest"),
    )


QUERIES = {"p1_found": p1_found, "p1_summary": p1_summary}
SQL: dict[str, str] = {}
