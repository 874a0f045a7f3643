"""Burst alerts over an event stream (an extension; the batch form serves the query)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def burst_alerts(events: DataFrame, min_events: int = 5, size: str = "14 days", slide: str = "7 days", late: str = "1 day") -> DataFrame:
    """Count each user's events in sliding windows; windows with at least ``min_events`` alert.

    Works on a batch or a stream; on a stream the watermark bounds the state.
    """
    src = events.withWatermark("ts", late) if events.isStreaming else events
    out = src.groupBy(F.window("ts", size, slide), "user_id").agg(F.count("*").alias("events"))
    return out.where(F.col("events") >= min_events).select("user_id", F.col("window.start").alias("start"), "events")
