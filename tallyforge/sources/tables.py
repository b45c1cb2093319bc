"""Access to the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder: one parquet file, or a folder of them, named after the table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, *names: str) -> None:
    """Register tables as temporary views for SQL."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
