"""A corpus from raw documents to shards: toxicity, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, minhash_dedup, mixing, sharding, toxicity
from tessera.llm._scratch import Scratch


def _without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier predicts toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the least id."""
    return minhash_dedup.drop_near_duplicates(docs)


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns by their places, so that no column of documents has the name of a result's; and the place of each."""
    places = {c: f"_d{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*places.values()), places


def _without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows, at = _renamed(docs)
    carry = tuple(p for c, p in at.items() if c != "doc_id")
    found = decontamination.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=at["doc_id"], text_col=at["text"], carry=carry)
    return found.filter("not contaminated").select(*[F.col(p).alias(c) for c, p in at.items()])


def _mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, 0 to 2 times; one that it takes in part, as often as comes nearest."""
    rows, at = _renamed(docs)
    carry = tuple(p for c, p in at.items() if c not in ("doc_id", "source"))
    mixed = mixing.mix_sources(rows, id_col=at["doc_id"], text_col=at["text"], source_col=at["source"], carry=carry)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    copies = mixed.withColumn("_times", times).filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return copies.select(*[F.col(p).alias(c) for c, p in at.items()])


def _sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and the place in it of each document of the mix."""
    return sharding.stratified_shards(docs)


STAGES = [("toxicity", _without_toxic), ("near_dedup", _without_near_duplicates), ("decontamination", _without_leaks), ("mixing", _mixed), ("sharding", _sharded)]

#: The toxicity classifier can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tmp.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
