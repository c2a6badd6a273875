"""Validation checks: a check returns the rows that break a rule, and passes with none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_reconcile(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with different numbers of rows on either side."""
    left, right = a.groupBy(*keys).agg(F.count("*").alias("n_a")), b.groupBy(*keys).agg(F.count("*").alias("n_b"))
    return left.join(right, keys, "full").select(*keys, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")).filter("n_a <> n_b")


def value_recompute(df: DataFrame, stored: Column, computed: Column, tolerance: float) -> DataFrame:
    return df.filter(F.abs(stored - computed) > tolerance)


def key_integrity(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Children without a parent; a null key refers to nothing and passes."""
    return child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias("_pk")).distinct(), F.col(fk) == F.col("_pk"), "left_anti")


def mandatory(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_missing) of columns with nulls; one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "n_missing").filter("n_missing > 0")


def transitions(df: DataFrame, entity: str, order: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Steps from one state to the next that aren't allowed."""
    from pyspark.sql import Window

    before = F.lag(state).over(Window.partitionBy(entity).orderBy(*order))
    steps = df.withColumn("from_state", before).filter("from_state IS NOT NULL")
    good = F.lit(False)
    for a, b in allowed:
        good = good | ((F.col("from_state") == a) & (F.col(state) == b))
    return steps.filter(~good)


def outcome(violations: DataFrame, name: str) -> DataFrame:
    """(check_name, passed, violations): passed with no rows."""
    return violations.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), (F.col("violations") == 0).alias("passed"), "violations")


def run_check(violations: DataFrame, name: str, most: int = 50) -> tuple[bool, str, list]:
    """(passed, how many rows break the rule, a sample): one row more than the sample (1 to 500 rows) is read, and a `+` says that there are more."""
    most = min(max(most, 1), 500)
    got = violations.limit(most + 1).collect()
    return not got, f"{min(len(got), most)}{'+' * (len(got) > most)}", got[:most]


def phrases(text: Column, must: list[str], must_not: list[str]) -> Column:
    """Whether a text has all of some phrases (`a|b`: one of them) and none of others, whatever the case."""
    low = F.lower(text)
    one_of = lambda m: reduce(lambda a, b: a | b, [low.contains(x.lower()) for x in m.split("|")])
    return reduce(lambda a, b: a & b, [one_of(m) for m in must] + [~low.contains(m.lower()) for m in must_not], F.lit(True))
