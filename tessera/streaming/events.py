"""Extension: windowed counts over an event stream, with a watermark for late rows. Not part of the batch surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_a_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def windowed(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, value): state is kept for open windows only."""
    w = F.window("ts", window)
    rows = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "value")
