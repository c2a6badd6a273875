"""Queries of the operators over the whole tables, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bloom_lm, decontamination, embedding_dedup, minhash_dedup, mixing, quality, sharding, substring_dedup, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_stratified_shards(spark, sf_dir):
    return sharding.stratified_shards(_table(spark, sf_dir, "documents"))


def op3_bloom_lm(spark, sf_dir):
    return bloom_lm.lm_scores(_table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.embedding_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_token_counts(spark, sf_dir, vocabulary: str | None = None):
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary)


def op8_source_mix(spark, sf_dir):
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")).drop("kept_text")


def op10_decontaminate(spark, sf_dir):
    return decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {}
