"""Event-time windows over append-only logs, for batch tables and streams alike (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, time: str, every: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Rows by window and keys. On a stream, `late` is how long a window waits."""
    if events.isStreaming and late:
        events = events.withWatermark(time, late)
    out = events.groupBy(F.window(time, every).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    if events.isStreaming and late:
        events = events.withWatermark(time, late)
    out = events.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")
