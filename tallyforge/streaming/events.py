"""Event metrics over a stream: counts by type and window, with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """A stream over the parquet files of a folder, its schema taken from the files there."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def windowed_counts(events: DataFrame, every: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """(window_start, event_type, n, total): works on streams and on tables alike.

    Events later than ``lateness`` behind the newest seen are dropped by the stream's watermark.
    """
    ts = events.withColumn("at", F.col("ts").cast("timestamp"))
    out = ts.withWatermark("at", lateness).groupBy(F.window("at", every), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", F.col("total").cast("double").alias("total"))
