"""Parquet tables: one file or one folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Reads ``<folder>/<name>.parquet``; column pruning and filters are left to the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
