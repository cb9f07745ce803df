"""Parquet sources by table name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in ``folder``; a file or a directory of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
