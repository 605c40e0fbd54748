"""Bounded replay of a table as a stream. The engine's parity surface has no streaming operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, key: str = "event_type", ts: str = "ts", every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts with a watermark; the same plan serves a batch and a stream."""
    at = F.col(ts).cast("timestamp")
    return events.withColumn(ts, at).withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), key).agg(F.count("*").alias("n"))


def read_stream(spark: SparkSession, directory: str, like: DataFrame, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(like.schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(directory)
