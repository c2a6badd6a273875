"""Data movement: column plans, append, replace, merge, and the checks that come before."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.text_io import insert_script, literal


def family(kind: T.DataType) -> str:
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(kind, T.BinaryType):
        return "raw"
    if isinstance(kind, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "interval"
    return "unsupported"


def column_plan(source: T.StructType, target: T.StructType) -> list[tuple[str, str, str]]:
    """(column, status, note) in target order, then what only the source has."""
    have = {f.name.lower(): f for f in source}
    out = []
    for f in target:
        s = have.pop(f.name.lower(), None)
        if s is None:
            out.append((f.name, "dst_only", "" if f.nullable else "not null without a value"))
        elif "unsupported" in (family(s.dataType), family(f.dataType)):
            out.append((f.name, "unsupported", s.dataType.simpleString()))
        else:
            a, b = family(s.dataType), family(f.dataType)
            longer = a == "text" and s.dataType != f.dataType
            out.append((f.name, "copy", f"{a} to {b}" if a != b else f"length may differ: {s.dataType.simpleString()} to {f.dataType.simpleString()}" if longer else ""))
    return out + [(f.name, "src_only", "") for f in have.values()]


def replace_where(target: DataFrame, source: DataFrame, condition: Column) -> DataFrame:
    """The target with its rows of a condition replaced by the source's."""
    return target.filter(~F.coalesce(condition, F.lit(False))).unionByName(source.filter(condition))


def merge(target: DataFrame, source: DataFrame, keys: list[str], insert: bool = True) -> DataFrame:
    """Source values where keys match, target rows otherwise, and (with `insert`) source rows without a match. One full join."""
    columns = target.columns
    s = source.select(*[F.col(c).alias(f"_s_{c}") for c in columns if c in source.columns], F.lit(True).alias("_in_s"))
    t = target.withColumn("_in_t", F.lit(True))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_s_{k}") for k in keys])
    both = t.join(s, on, "full" if insert else "left")
    pick = [F.when(F.col("_in_s"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) if c in source.columns else F.col(c) for c in columns]
    return both.select(*pick)


def matched_twice(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target keys that several source rows would update."""
    many = source.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return many.join(target.select(*keys).distinct(), keys, "left_semi")


def inserted_twice(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Keys without a match that several source rows would insert."""
    many = source.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return many.join(target.select(*keys).distinct(), keys, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the target after the changes, changes that are refused with a `reason`). Changes have an `op` of insert, update or delete beside the target's columns.

    An update or delete must change one row: without a row of its key it is `missing`, with several it is `several`; more than one for a key is
    `twice`. An insert whose key stands and isn't deleted too is `exists`.
    """
    of_key = lambda df: [F.col(k).alias(f"_k_{k}") for k in keys]
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    rows = target.groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg(F.count("*").alias("_rows"))
    stand = reduce(lambda a, b: a & b, [F.col(f"_k_{k}").eqNullSafe(F.col(f"_t_{k}")) for k in keys])
    asked = changes.groupBy(*of_key(changes)).agg(F.count_if(F.col("op") != "insert").alias("_changes"), F.count_if(F.col("op") == "insert").alias("_inserts"), F.bool_or(F.col("op") == "delete").alias("_gone"))
    asked = asked.join(rows, stand, "left").drop(*[f"_t_{k}" for k in keys]).withColumn("_rows", F.coalesce("_rows", F.lit(0)))
    told = changes.join(asked, same).drop(*[f"_k_{k}" for k in keys])
    changing = F.when(F.col("_rows") == 0, "missing").when(F.col("_rows") > 1, "several").when(F.col("_changes") > 1, "twice")
    adding = F.when(F.col("_inserts") > 1, "twice").when((F.col("_rows") > 0) & ~((F.col("_rows") == 1) & (F.col("_changes") == 1) & F.col("_gone")), "exists")
    told = told.withColumn("reason", F.when(F.col("op") == "insert", adding).otherwise(changing)).drop("_rows", "_changes", "_inserts", "_gone")
    good = told.filter("reason IS NULL")
    changed = good.filter("op <> 'insert'").select(*of_key(good)).distinct()
    untouched = target.join(changed, same, "left_anti")
    return untouched.unionByName(good.filter("op <> 'delete'").select(*target.columns)), told.filter("reason IS NOT NULL")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def split_rejects(df: DataFrame, tests: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that fail with an `errors` array of the names of tests)."""
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items()]))
    marked = df.withColumn("errors", errors)
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


class Refused(ValueError):
    """A copy that can't be made as asked."""


class CopyPlan(NamedTuple):
    """What a copy will do; nothing has changed yet."""

    mode: str
    columns: list[tuple[str, str, str]]
    copied: list[str]
    keys: list[str]
    source_rows: int
    replaced_rows: int | None
    warnings: list[str]


def plan_copy(source: DataFrame, target: DataFrame, mode: str = "append", keys: list[str] | None = None, picked: list[str] | None = None, condition: str | None = None, target_is_table: bool = True, read_only: bool = False, same_table: bool = False) -> CopyPlan:
    """Columns by name, counts, and what would go wrong. Refused: a read-only target, one that isn't a table, the same table, no common columns, a merge
    without keys or with keys that aren't copied.
    """
    if mode not in ("append", "replace", "merge"):
        raise Refused(f"no such mode: {mode}")
    if read_only:
        raise Refused("the target is read-only")
    if not target_is_table:
        raise Refused("the target isn't a table")
    if same_table:
        raise Refused("source and target are the same table")
    plan = column_plan(source.schema, target.schema)
    wanted = {p.lower() for p in picked or []}
    copied = [c for c, status, _ in plan if status == "copy" and (not wanted or c.lower() in wanted)]
    if not copied:
        raise Refused("no column to copy: the tables need columns of the same name")
    by_lower = {c.lower(): c for c in target.columns}
    merged = [by_lower.get(k.lower(), k) for k in keys or []]
    if mode == "merge":
        if not merged:
            raise Refused("a merge without keys")
        for k in merged:
            if k not in copied:
                raise Refused(f"the key {k} isn't copied")
    warnings = [f"{c}: {note}" for c, status, note in plan if status == "dst_only" and note]
    if mode == "replace" and not (condition or "").strip():
        warnings.append("without a condition all rows of the target are replaced")
    some = F.expr(condition) if condition else F.lit(True)
    replaced = target.filter(some).count() if mode == "replace" else None
    return CopyPlan(mode, plan, copied, merged if mode == "merge" else [], source.filter(some).count(), replaced, warnings)


def copied_rows(source: DataFrame, target: T.StructType, copied: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of the target's columns and types, null where nothing is copied; rows whose values don't convert, or are null where that isn't allowed, with `errors`)."""
    have = {c.lower(): c for c in source.columns}
    made, tests = [], {}
    for f in target:
        if f.name not in copied:
            made.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        own = F.col(f"_s.{have[f.name.lower()]}")
        value = own if source.schema[have[f.name.lower()]].dataType == f.dataType else own.try_cast(f.dataType)
        made.append(value.alias(f.name))
        tests[f.name] = own.isNull() | value.isNotNull() if f.nullable else value.isNotNull()
    rows = source.select(F.struct(*source.columns).alias("_s"))
    good, bad = split_rejects(rows, tests)
    return good.select(*made), bad.select("_s.*", "errors")


def copy(source: DataFrame, target: DataFrame, plan: CopyPlan, condition: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the target after the copy, rejected source rows with `errors`); one job writes it."""
    some = F.expr(condition) if condition else F.lit(True)
    rows, bad = copied_rows(source.filter(some), target.schema, plan.copied)
    if plan.mode == "append":
        return target.unionByName(rows), bad
    if plan.mode == "replace":
        return target.filter(~F.coalesce(some, F.lit(False))).unionByName(rows), bad
    return merge(target, rows.select(*plan.copied), plan.keys).select(*target.columns), bad


def create_table_sql(table: str, schema: T.StructType, primary_key: list[str] | None = None, picked: list[str] | None = None) -> str:
    """CREATE TABLE of the (picked) columns; the key is kept in a table property if all its columns are, since nothing here enforces it."""
    wanted = {p.lower() for p in picked or []}
    fields = [f for f in schema if not wanted or f.name.lower() in wanted]
    lines = ",\n".join(f"  {f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in fields)
    names = {f.name.lower() for f in fields}
    whole = bool(primary_key) and all(k.lower() in names for k in primary_key)
    keys = f"\nTBLPROPERTIES ('primary_key' = '{','.join(primary_key)}')" if whole else ""
    return f"CREATE TABLE {table} (\n{lines}\n) USING parquet{keys}"


def insert_branches(source: DataFrame, branches: list[tuple[str, Column | None, dict[str, Column]]], first: bool = False) -> dict[str, DataFrame]:
    """Rows for each table of a multi-table insert: (table, condition or None for all or the rest, columns). With `first` a row goes to the first branch it fits."""
    out: dict[str, DataFrame] = {}
    before = F.lit(False)
    any_of = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for _, c, _ in branches if c is not None], F.lit(False))
    conditional = any(c is not None for _, c, _ in branches)
    for table, condition, columns in branches:
        mine = (~any_of if conditional else F.lit(True)) if condition is None else F.coalesce(condition, F.lit(False))
        rows = source.filter(mine & ~before if first else mine).select(*[c.alias(n) for n, c in columns.items()])
        out[table] = out[table].unionByName(rows) if table in out else rows
        if first:
            before = before | mine
    return out


def correlated_update(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the target with columns set from the source's row of the key, null where there is none; the changed rows as they were).

    A key with several source rows is an error in Oracle: check by `duplicate_keys` first; here the greatest row counts.
    """
    one = source.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max(F.struct(*columns)).alias("_new"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in keys])
    both = target.join(one, same, "left")
    changed = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_new.{c}")) for c in columns])
    return both.select(*[F.col(f"_new.{c}").alias(c) if c in columns else F.col(c) for c in target.columns]), both.filter(changed).select(*target.columns)


def merge_delete(target: DataFrame, source: DataFrame, keys: list[str], gone: Column) -> DataFrame:
    """MERGE whose matched rows are updated, then deleted where `gone` holds for the updated values; rows without a match in the source stay."""
    marked = merge(target.withColumn("_m", F.lit(False)), source.withColumn("_m", F.lit(True)).join(target.select(*keys).distinct(), keys, "left_semi"), keys, insert=False)
    fresh = source.join(target.select(*keys).distinct(), keys, "left_anti")
    return marked.filter(~(F.col("_m") & F.coalesce(gone, F.lit(False)))).drop("_m").unionByName(fresh.select(*target.columns))


def numbered(df: DataFrame, column: str, after: int = 0) -> DataFrame:
    """A sequence's next values as a column: each once, over `after`, not without gaps; no shuffle."""
    return df.withColumn(column, F.monotonically_increasing_id() + F.lit(after + 1))


def undo_script(before: DataFrame, table: str, keys: list[str], change: str, columns: list[str] | None = None) -> DataFrame:
    """Statements that bring the rows of a before-image back: INSERT after a delete, UPDATE of the columns after an update. Types without a literal are refused."""
    for f in before.schema:
        if isinstance(f.dataType, (T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            raise Refused(f"{f.name}: values of {f.dataType.simpleString()} can't be written as text")
    if change == "delete":
        return insert_script(before, table)
    pair = lambda c: F.concat(F.lit(f"{c} = "), literal(F.col(c), before.schema[c].dataType))
    at = lambda c: F.when(F.col(c).isNull(), F.lit(f"{c} IS NULL")).otherwise(pair(c))
    sets = F.concat_ws(", ", *[pair(c) for c in columns or [c for c in before.columns if c not in keys]])
    return before.select(F.concat(F.lit(f"UPDATE {table} SET "), sets, F.lit(" WHERE "), F.concat_ws(" AND ", *[at(k) for k in keys]), F.lit(";")).alias("line"))
