"""Logs as streams: histories that grow, counted once in event time, and analyses that follow what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.history import HISTORY


def history_stream(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Statements as they are appended; one that is appended twice within the lateness counts once."""
    rows = spark.readStream.schema(HISTORY + ", month string").json(path)
    return rows.withWatermark("t", late).dropDuplicatesWithinWatermark(["t", "profile", "user", "sql"])


def counts_by_window(stream: DataFrame, width: str = "1 hour", keys: tuple[str, ...] = ("kind",)) -> DataFrame:
    """(window_start, keys, n, failed) in event time; needs the stream's watermark."""
    out = stream.groupBy(F.window("t", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "failed")


def follow(stream: DataFrame, path: str, checkpoint: str, all_of_it: bool = True) -> StreamingQuery:
    """Appends a stream to a table; with `all_of_it` what is there now, then it ends."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if all_of_it else writer).start()


def reanalyse(units: DataFrame, checkpoint: str, known: Callable[[], DataFrame], analyse: Callable[[DataFrame], None]) -> StreamingQuery:
    """Runs `analyse` for each batch of units (unit, text, ..) whose content isn't among the hashes of `known` (hash): once for each content."""

    def each(batch: DataFrame, _: int) -> None:
        fresh = batch.withColumn("hash", F.sha2("text", 256)).dropDuplicates(["hash"]).join(known().select("hash"), "hash", "left_anti")
        if not fresh.isEmpty():
            analyse(fresh)

    return units.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
