"""Row traces: whether keys stand in a table, and which statements could have put them there or taken them away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_trace(target: DataFrame, key: list[str], asked: DataFrame, uses: DataFrame, table: str) -> DataFrame:
    """Each distinct asked key with `stands`, `n_rows`, and the statements (`unit:line`, sorted) of `uses` that insert into `table` or delete from it.

    `uses` is the facts of code (unit, what, op, line, fact). Null parts of a key equal null parts. The statements are the same for all
    keys: they are gathered once, and broadcast as one row; their number follows the code, not the rows.
    """
    asked = asked.select(*[F.col(c).alias(f"_a_{c}") for c in key]).distinct()
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"_a_{c}").eqNullSafe(F.col(f"_t_{c}"))
    counted = target.groupBy(*[F.col(c).alias(f"_t_{c}") for c in key]).agg(F.count("*").alias("n_rows"))
    at = F.concat_ws(":", "unit", F.col("line").cast("string"))
    mine = uses.filter((F.col("fact") == "table") & (F.upper("what") == table.upper()))
    said = mine.agg(F.sort_array(F.collect_set(F.when(F.col("op") == "C", at))).alias("inserts"), F.sort_array(F.collect_set(F.when(F.col("op") == "D", at))).alias("deletes"))
    out = asked.join(counted, same, "left").select(*[F.col(f"_a_{c}").alias(c) for c in key], F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    return out.withColumn("stands", F.col("n_rows") > 0).join(F.broadcast(said))


def possible_writes(target: DataFrame, source: DataFrame, key: list[str], when=None) -> DataFrame:
    """Keys that an INSERT .. SELECT over `source` (with its condition `when`) would give, each marked `present` or `missing` in `target`."""
    source = source if when is None else source.filter(when)
    asked = source.select(*key).distinct()
    have = target.select(*[F.col(c).alias(f"_t_{c}") for c in key]).distinct()
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    state = F.when(F.col("_there"), "present").otherwise("missing")
    return asked.join(have.withColumn("_there", F.lit(True)), same, "left").select(*key, state.alias("state"))


def condition_flags(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """The rows with a column for each condition: O where it holds, X where it doesn't or isn't known."""
    return df.select("*", *[F.when(c, "O").otherwise("X").alias(name) for name, c in conditions.items()])


def join_survival(start: DataFrame, name: str, joins: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(step, joined, n): how many rows stand after each join, one more table at a time. One job counts all steps."""
    now = start
    out = now.agg(F.count("*").alias("n")).select(F.lit(1).alias("step"), F.lit(name).alias("joined"), "n")
    for step, (table, other, on) in enumerate(joins, 2):
        now = now.join(other, on)
        out = out.unionByName(now.agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), F.lit(table).alias("joined"), "n"))
    return out


def recomputed(df: DataFrame, keys: list[str], amount: Column, digits: int = 2) -> DataFrame:
    """The sum of an amount by key, exact if it is decimal."""
    return df.groupBy(*keys).agg(F.round(F.sum(amount), digits).cast("double").alias("recomputed"))


#: How a writer's value compares with the stored one, best first.
REPRODUCED = ("same", "differs", "no rows", "failed")


def by_outcome(writers: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Writers in order of how well they reproduce a value."""
    place = F.array_position(F.array(*[F.lit(x) for x in REPRODUCED]), F.col(outcome))
    return writers.orderBy(F.when(place > 0, place).otherwise(len(REPRODUCED) + 1), *[c for c in writers.columns if c != outcome])
