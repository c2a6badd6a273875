"""Connected components by alternating large and small stars, as joins on edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w")
    return both.filter("v > u").join(least, F.col("u") == F.col("w")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    near = e.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(e: DataFrame) -> bool:
    """Whether the edges (u, v) are those of every node to the least of its component already: no node has two, or is on both sides."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up > 0 AND down > 0")
    return odd.agg(F.count("*")).first()[0] == 0


def components(tmp: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of the edges (a, b): long numbers; the label is the least node that it reaches."""
    e = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, k = tmp.put(e, f"{name}_0"), 0
    while not _stars(e):
        k += 1
        e = tmp.put(_small(_large(e)), f"{name}_{k}")
        tmp.drop(f"{name}_{k - 1}")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def groups_of(linked: np.ndarray) -> np.ndarray:
    """The least member of each group of a symmetric relation, given as a matrix."""
    label = np.arange(len(linked))
    while len(label):
        least = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    return label
