"""The parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; columns and filters are pruned by the scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
