"""Incremental ingest: the batch operators over a stream of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def counts_by_window(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts per key and tumbling window; rows later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).count()
