"""Parquet tables of a data folder, as DataFrames or SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a folder (a file or a directory of part files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register_views(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Make tables of a folder known to SQL under their own names."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
