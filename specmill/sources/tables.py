"""Parquet tables of a data directory, and removal of repeated deliveries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name in a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delivered_once(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key. Repeated deliveries have the same content, so any of them serves."""
    return df.dropDuplicates(list(keys))
