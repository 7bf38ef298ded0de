"""An extension beyond the batch surface: event-time windows, the same for batches and streams.

State is bounded by the watermark: a window is dropped once its end is that far behind the latest event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if events.isStreaming else timed


def tumbling(events: DataFrame, length: str, late: str = "10 minutes") -> DataFrame:
    """begins, event_type, n, total for each window of `length` (or sliding ones: 'length, step')."""
    parts = [p.strip() for p in length.split(",")]
    found = _watermarked(events, late).groupBy(F.window("ts", *parts).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return found.select(F.col("w.start").alias("begins"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """user_id, begins, ends, n for each run of a user's events without a pause of `gap`."""
    found = _watermarked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")
