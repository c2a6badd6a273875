"""Statement history and connection logs as JSON lines by month."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "t timestamp, profile string, user string, sql string, kind string, ms bigint, rows bigint, error string"
MOST_BYTES = 100_000


def cut_bytes(text, most: int = MOST_BYTES):
    """The longest beginning of whole characters in `most` bytes of UTF-8."""
    raw = text.cast("binary")
    cut = F.substring(raw, 1, most)
    # bytes 10xxxxxx go on a character: of the last three at least one begins one
    goes_on = lambda k: F.substring(raw, most + 2 - k, 1).between(F.unhex(F.lit("80")), F.unhex(F.lit("BF")))
    end = F.when(~goes_on(1), most).when(~goes_on(2), most - 1).when(~goes_on(3), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(cut, F.lit(1), end), "UTF-8"))


def append(df: DataFrame, path: str) -> None:
    """One folder for each month; a statement is kept to its first 100,000 bytes."""
    df.withColumn("sql", cut_bytes(F.col("sql"))).withColumn("month", F.date_format("t", "yyyy-MM")).write.partitionBy("month").mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY + ", month string").json(path)


def last_months(df: DataFrame, k: int) -> DataFrame:
    """What pruning to the last k months keeps."""
    newest = df.agg(F.max("t").alias("newest"))
    return df.join(F.broadcast(newest), F.col("t") >= F.add_months(F.date_trunc("month", "newest"), 1 - k)).drop("newest")


def search(df: DataFrame, words: str, column: str = "sql") -> DataFrame:
    """Rows that hold every word, whatever the case."""
    tests = [F.upper(F.col(column)).contains(w.upper()) for w in words.split()]
    return df.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def grouped(df: DataFrame, column: str = "sql", time: str = "t") -> DataFrame:
    """Each statement once, white space apart: how often, and when last."""
    norm = F.trim(F.regexp_replace(F.col(column), r"\s+", " "))
    return df.groupBy(norm.alias("statement")).agg(F.count("*").alias("n"), F.max(time).alias("last_at"))


CONNECTIONS = "t timestamp, profile string, kind string, code string, ms bigint, idle_ms bigint, message string"


def append_connections(df: DataFrame, path: str) -> None:
    """One folder for each day, so that old days can go."""
    df.withColumn("day", F.to_date("t")).write.partitionBy("day").mode("append").json(path)


def connections_since(spark: SparkSession, path: str, since) -> DataFrame:
    """Connection events from a time on, in order; only its days are read."""
    log = spark.read.schema(CONNECTIONS + ", day date").json(path)
    return log.filter((F.col("day") >= F.to_date(F.lit(since))) & (F.col("t") >= F.lit(since))).drop("day").orderBy("t")


def summary(log: DataFrame) -> DataFrame:
    """Connection log rows (kind, code, ms) by code: count, middle and longest time to connect."""
    return log.groupBy("code").agg(F.count("*").alias("n"), F.percentile("ms", 0.5).alias("median_ms"), F.max("ms").alias("max_ms"))


def by_size(log: DataFrame, size: Column, bounds: dict[str, int], last: str, value: Column) -> DataFrame:
    """(bucket, n, mean, p95) of a value by buckets of a size: up to each bound, the rest in `last`; p95 is the value of the nearest rank."""
    bucket = F.lit(last)
    for name, bound in sorted(bounds.items(), key=lambda b: -b[1]):
        bucket = F.when(size <= bound, name).otherwise(bucket)
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY _v)")
    return log.select(bucket.alias("bucket"), value.alias("_v")).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), p95.alias("p95"))


def too_large(buckets: DataFrame, order: Column, least: int = 5) -> DataFrame:
    """The first bucket (bucket, n, rate), after the base, of at least `least` rows whose rate is over twice the base's and a tenth more."""
    placed = buckets.withColumn("_at", order)
    base = placed.agg(F.min(F.struct("_at", "rate")).alias("b")).select(F.col("b._at").alias("_b"), F.col("b.rate").alias("_base"))
    worse = placed.join(F.broadcast(base)).filter((F.col("_at") > F.col("_b")) & (F.col("n") >= least) & (F.col("rate") > F.greatest(2 * F.col("_base"), F.col("_base") + 0.1)))
    return worse.orderBy("_at").limit(1).select("bucket", "n", "rate")
