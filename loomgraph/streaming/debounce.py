"""Quiet-period debouncing of change events, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounce(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """events(event_id, user_id, ts) -> user_id, start, n, last_event: sessions closed by a quiet gap, per user."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = F.session_window("ts", gap)
    out = at.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "event_id")).alias("x"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.col("x.event_id").alias("last_event"))


def debounce_stream(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The same over a stream: sessions are emitted once the watermark has passed their end."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = at.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "event_id")).alias("x"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.col("x.event_id").alias("last_event"))
