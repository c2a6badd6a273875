"""Sessions and who waits for whom, over a table of sessions (sid, status, idle_s, blocked_by)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import reach


def by_urgency(sessions: DataFrame) -> DataFrame:
    """Blocked sessions first, then active ones, then the others; the longest idle first."""
    place = F.when(F.col("blocked_by").isNotNull(), 0).when(F.upper("status") == "ACTIVE", 1).otherwise(2)
    return sessions.orderBy(place, F.col("idle_s").desc(), "sid")


def blockers(sessions: DataFrame) -> DataFrame:
    """(sid, blocked, waiting): sessions that block others without waiting themselves, how many wait for them in all, directly or not, and the longest wait."""
    waits = sessions.filter("blocked_by IS NOT NULL").select(F.col("blocked_by").alias("src"), F.col("sid").alias("dst"))
    roots = sessions.filter("blocked_by IS NULL").select(F.col("sid").alias("node")).join(waits.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    found = reach(waits, roots).filter("depth > 0")
    held = found.join(sessions.select(F.col("sid").alias("node"), "idle_s"), "node")
    return held.groupBy(F.col("origin").alias("sid")).agg(F.count("*").alias("blocked"), F.max("idle_s").alias("waiting"))


def deadlocks(sessions: DataFrame) -> DataFrame:
    """(sid, ring): sessions that wait in a ring, and the least of it."""
    from .graph import strong_components

    waits = sessions.filter("blocked_by IS NOT NULL").select(F.col("sid").alias("src"), F.col("blocked_by").alias("dst"))
    return strong_components(waits).select(F.col("node").alias("sid"), F.col("component").alias("ring"))
