"""Sharding by proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked; rank / rows of the source is a row's place on a line from 0 to 1.
Sorted by that place and cut in equal runs, every shard has each source in its share of the whole, to within a row or two.

Defined cases: a null source is a source of its own. Null ids sort first. Rows with equal ids are placed each by its text; rows that are equal in id and text stand
next to each other. An empty table gives an empty result. Extra columns are ignored; name those to carry in `carry`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._spread import running, seeded

#: Rows counted by one window group, on average.
GROUP_ROWS = 2048


def stratified_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 24, seed: int = 17) -> DataFrame:
    """One row for each of `df`'s: id, source, size, text_crc32, law ('rows': counts differ by one at most), shard, slot, grown_shard (null).

    Ranks come from running totals over parts of the hash range, so no task holds a source. A source's places are moved by a seeded
    fraction of a step, so that many one-row sources spread over the line.
    """
    spark = df.sparkSession
    tmp = Scratch(spark)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = tmp.put(
        df.select(
            F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        ).withColumn("_key", seeded(seed, "_id", "text_crc32", "size")),
        "rows",
    )
    total = rows.count()
    sources = rows.groupBy("_source").agg(F.count("*").alias("_rows")).withColumn("_shift", seeded(seed + 1, "_source")).withColumnRenamed("_source", "_s")
    placed = rows.join(sources, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    ties = ["_id", "text_crc32", "size"]
    ranked = running(placed, ["_source"], "_key", ties, F.lit(1), F.ceil(F.col("_rows") / GROUP_ROWS), "_rank")
    ranked = ranked.withColumn("_place", (F.col("_rank") + F.col("_shift")) / F.col("_rows"))
    line = running(ranked, [], "_place", ["_source", "_key", *ties], F.lit(1), F.lit(max(1, -(-total // GROUP_ROWS))), "_pos")
    shard = F.expr(f"(_pos * {shards}L) div {max(1, total)}L")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return line.withColumn("shard", shard.cast("int")).select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_pos") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
