"""Streaming twins: windowed counts and sliding co-occurrence of a user's events, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "30 minutes") -> DataFrame:
    """(window_start, event_type, n, value) per tumbling window; rows later than the watermark are dropped by a stream."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "value")


def cooccurrence(events: DataFrame, within: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, a_id, b_id): pairs of a user's events at most `within` apart, the earlier one first: an interval join of the stream with
    itself, whose state the watermark and the interval bound."""
    a = events.withWatermark("ts", late).select(F.col("user_id"), F.col("event_id").alias("a_id"), F.col("ts").alias("a_ts"))
    b = events.withWatermark("ts", late).select(F.col("user_id").alias("b_user"), F.col("event_id").alias("b_id"), F.col("ts").alias("b_ts"))
    near = (F.col("user_id") == F.col("b_user")) & (F.col("b_ts") > F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"interval {within}"))
    return a.join(b, near).select("user_id", "a_id", "b_id")
