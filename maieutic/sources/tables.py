"""Columnar table source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table root/name.parquet, a file or a folder of part files."""
    return spark.read.parquet(f"{root}/{name}.parquet")
