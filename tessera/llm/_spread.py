"""Running totals over a whole table without one task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, group: list[str], key: str, order: list[str], amount: Column, buckets: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `amount` over the rows of the group that come before, in order of `key` and `order`.

    `key` is a number from 0 to 1. Its range is cut in `buckets` (a whole number, the same all over a group) equal parts. Sums by part
    are small, so their running total is one window over them; each part then counts its own rows.
    """
    df = df.withColumn("_part", F.least(F.floor(F.col(key) * buckets), buckets - 1).cast("long")).withColumn("_amount", amount.cast("long"))
    parts = df.groupBy(*group, "_part").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_g_part"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_g_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    own = Window.partitionBy(*group, "_part").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(parts, same).withColumn(out, F.col("_before") + F.coalesce(F.sum("_amount").over(own), F.lit(0))).drop("_part", "_amount", "_before", "_g_part", *[f"_g_{c}" for c in group])


def seeded(seed: int, *columns: str) -> Column:
    """A number from 0 to 1 out of the md5 of the seed and the columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
