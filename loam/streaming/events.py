"""Event-time windows, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "30 minutes"


def counts(events: DataFrame, width: str) -> DataFrame:
    """window_start, event_type, n and total of events (ts, event_type, value); a stream drops windows LATE after their end."""
    if events.isStreaming:
        events = events.withWatermark("ts", LATE)
    sums = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
