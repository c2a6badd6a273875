"""Comparison of two results: by key, with duplicates paired in order, or without a key as multisets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def common_columns(a: DataFrame, b: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """(in both, whatever the case; only in a; only in b)."""
    of_b = {c.lower(): c for c in reversed(b.columns)}
    both = [c for c in a.columns if c.lower() in of_b]
    return both, [c for c in a.columns if c.lower() not in of_b], [c for c in b.columns if c.lower() not in {x.lower() for x in a.columns}]


def diff_rows(a: DataFrame, b: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """status (same, chg, add, del), the keys, their ordinal, the values on either side as structs, and the names of changed columns.

    Null equals null. Without keys all common columns are the key, and rows are matched by how often they occur. Both sides meet in one aggregation by
    key; only the rows of keys that a side has several times are numbered, in `order` (all columns, if none is given), and joined.
    """
    both, _, _ = common_columns(a, b)
    keys = keys or both
    rest = [c for c in both if c not in keys]
    values = F.struct(*[F.col(c) for c in both])
    none = F.lit(None).cast(a.select(values.alias("v")).schema["v"].dataType)
    sides = a.select(*both).select(*keys, values.alias("a"), none.alias("b")).unionByName(b.select(*both).select(*keys, none.alias("a"), values.alias("b")))
    met = sides.groupBy(*keys).agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.any_value("a", True).alias("a"), F.any_value("b", True).alias("b"))
    if not rest:
        rows = met.withColumn("ordinal", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("n_a", "n_b"))))
        rows = rows.withColumn("a", F.when(F.col("ordinal") <= F.col("n_a"), F.col("a"))).withColumn("b", F.when(F.col("ordinal") <= F.col("n_b"), F.col("b")))
        return _told(rows, keys, rest)
    once = met.filter("n_a <= 1 AND n_b <= 1").withColumn("ordinal", F.lit(1).cast("long"))
    many = met.filter("n_a > 1 OR n_b > 1").select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    pair = Window.partitionBy(*keys).orderBy(*(order or both))

    def side(df, name):
        mine = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        df = df.select(*both).join(many, mine, "left_semi").withColumn("_n", F.row_number().over(pair).cast("long"))
        return df.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.col("_n").alias(f"{name}_n"), values.alias(name))

    on = reduce(lambda x, y: x & y, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys] + [F.col("a_n") == F.col("b_n")])
    several = side(a, "a").join(side(b, "b"), on, "full").select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys], F.coalesce("a_n", "b_n").alias("ordinal"), "a", "b")
    return _told(once.select(*keys, "ordinal", "a", "b").unionByName(several), keys, rest)


def _told(rows: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
    none = F.array().cast("array<string>")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in rest])) if rest else none
    status = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "del").when(F.size(changed) > 0, "chg").otherwise("same")
    return rows.select(status.alias("status"), *keys, F.col("ordinal").cast("int").alias("ordinal"), "a", "b", F.when(status == "chg", changed).otherwise(none).alias("changed"))


def worth_comparing(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results share at least half of the wider one's columns."""
    both, _, _ = common_columns(a, b)
    return bool(both) and 2 * len(both) >= max(len(a.columns), len(b.columns))


def diff_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("cnt"))


def key_uniqueness(df: DataFrame, candidates: list[list[str]]) -> DataFrame:
    """For each list of columns: rows, rows without null keys, distinct keys, and whether it is a key. One pass a candidate."""
    out = []
    for keys in candidates:
        some = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
        counts = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("n_full"), F.count("*").alias("n_keys"))
        out.append(counts.select(F.lit(",".join(keys)).alias("candidate"), "n_rows", "n_full", "n_keys", ((F.col("n_rows") == F.col("n_full")) & (F.col("n_rows") == F.col("n_keys"))).alias("is_key")))
    return reduce(DataFrame.unionByName, out)


def choose_key(a: DataFrame, b: DataFrame, primary: list[str] | None = None) -> list[str] | None:
    """The primary key if it is unique on both sides, else the first one to three common columns that are; else None."""
    both, _, _ = common_columns(a, b)
    tries = ([primary] if primary else []) + [both[:n] for n in (1, 2, 3) if len(both) >= n]
    for keys in tries:
        if all(key_uniqueness(df, [keys]).first().is_key for df in (a, b)):
            return keys
    return None
