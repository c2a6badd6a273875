"""Operators over result rows: filter language, sort, pages, masks, value conditions, fill and tiling."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TERM = re.compile(r"(?is)^([A-Za-z_][\w$#]*)\s*(?:(is\s+not\s+null|is\s+null)|(!=|<>|>=|<=|=|~|>|<)\s*(.*))$")


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def _value(text: str) -> str:
    text = text.strip()
    return text[1:-1].replace("''", "'") if len(text) >= 2 and text[0] == text[-1] == "'" else text


def filter_condition(df: DataFrame, text: str) -> Column | None:
    """`name op value` terms joined by AND or &&; any other term is searched for in all columns, whatever its case.

    Null never equals, and is always unequal. Numbers compare as decimals.
    """
    names = {c.lower(): c for c in df.columns}
    out = []
    for term in re.split(r"(?i)\s+and\s+|&&", text.strip()):
        term = term.strip()
        if not term:
            continue
        m = _TERM.match(term)
        if not m or m[1].lower() not in names:
            out.append(reduce(lambda a, b: a | b, [F.coalesce(F.upper(F.col(c).cast("string")).contains(term.upper()), F.lit(False)) for c in df.columns]))
            continue
        name = names[m[1].lower()]
        col = F.col(name)
        if m[2]:
            out.append(col.isNotNull() if "not" in m[2].lower() else col.isNull())
            continue
        op, value = m[3], _value(m[4])
        if op == "~":
            out.append(F.coalesce(F.upper(col.cast("string")).contains(value.upper()), F.lit(False)))
            continue
        if _numeric(df, name):
            left, right = col, F.expr(f"try_cast({_quoted(value)} AS decimal(38,10))")
        else:
            left, right = col.cast("string"), F.lit(value)
        test = {"=": left == right, "!=": left != right, "<>": left != right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[op]
        out.append(col.isNull() | test if op in ("!=", "<>") else F.coalesce(test, F.lit(False)))
    return reduce(lambda a, b: a & b, out) if out else None


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def filter_rows(df: DataFrame, text: str) -> DataFrame:
    condition = filter_condition(df, text)
    return df if condition is None else df.filter(condition)


def sort_rows(df: DataFrame, column: str, descending: bool, position: list[str]) -> DataFrame:
    """Nulls last in either direction; ties by the original position."""
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(key, *position)


def page(df: DataFrame, keys: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """The rows after a key, in order of unique keys: the filter goes to the scan, the limit is a top-k."""
    if after is not None:
        test = F.lit(False)
        for i in reversed(range(len(keys))):
            test = (F.col(keys[i]) > after[i]) | ((F.col(keys[i]) == after[i]) & test)
        df = df.filter(test)
    return df.orderBy(*keys).limit(size)


def mask(df: DataFrame, selected: DataFrame, keys: list[str], keep: bool) -> DataFrame:
    return df.join(selected.select(*keys).distinct(), keys, "left_semi" if keep else "left_anti")


def in_list(col: Column, values: list) -> Column:
    """Null in the list takes null rows."""
    some = [v for v in values if v is not None]
    test = F.coalesce(col.isin(some), F.lit(False)) if some else F.lit(False)
    return test | col.isNull() if None in values else test


def not_in_list(col: Column, values: list) -> Column:
    """Null rows stay unless null is in the list."""
    some = [v for v in values if v is not None]
    test = ~F.coalesce(col.isin(some), F.lit(False)) if some else F.lit(True)
    return test & col.isNotNull() if None in values else test


def contains_literal(col: Column, text: str) -> Column:
    """LIKE '%text%' with % _ \\ taken as they are."""
    return col.contains(text)


def fill_down(df: DataFrame, column: str, order: list[str], group: list[str]) -> DataFrame:
    """Nulls take the last value above, within a group."""
    above = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(above))


def tile(target: DataFrame, row: str, values: list) -> DataFrame:
    """Pastes a column of values over rows numbered from 0, again and again."""
    return target.withColumn("pasted", F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(row) % len(values) + 1).cast("int")))


def distinct_values(df: DataFrame, column: str, position: str) -> DataFrame:
    """(value, first_seen) with null as a value of its own."""
    return df.groupBy(F.col(column).alias("value")).agg(F.min(position).alias("first_seen"))


def text_order(column: str, language: str = "UNICODE") -> Column:
    """Text in the order of a language instead of its bytes."""
    return F.collate(F.col(column), language)


#: What a click on a column's head does to its order, one after the other.
SORT_CYCLE = {None: "asc", "asc": "desc", "desc": None}


def sorted_by(df: DataFrame, orders: dict[str, str | None], position: list[str]) -> DataFrame:
    """The rows by the columns that have an order, nulls last, ties by the original position."""
    keys = [F.col(c).desc_nulls_last() if o == "desc" else F.col(c).asc_nulls_last() for c, o in orders.items() if o]
    return df.orderBy(*keys, *position)


def top_names(names: DataFrame, name: str, asked: str, most: int) -> DataFrame:
    """The names that answer best what was typed: a top-k by score and name."""
    from .catalog import name_score

    return names.withColumn("score", name_score(F.col(name), asked)).filter("score > 0").orderBy(F.col("score").desc(), name).limit(most)


def paste(cells: DataFrame, height: int, width: int, box: tuple[int, int, int, int], n_rows: int, n_cols: int) -> tuple[DataFrame, int, int]:
    """(cells (r, c, v) to put, rows cut off, columns cut off) for copied cells (r, c, v) of a range of `height` by `width`, pasted to a box (r0, r1, c0, c1).

    One cell fills the box; a box of a whole multiple of the range is tiled; else the range is put at the box's corner, cut at the end of the grid.
    """
    r0, r1 = sorted(box[:2])
    c0, c1 = sorted(box[2:])
    tall, broad = r1 - r0 + 1, c1 - c0 + 1
    single = height == width == 1
    if single or ((tall > height or broad > width) and tall % height == 0 and broad % width == 0):
        times = lambda n, size: F.explode(F.sequence(F.lit(0), F.lit(n // size - 1)))
        tiled = cells.withColumn("_a", times(tall, height)).withColumn("_b", times(broad, width))
        put = tiled.select((F.col("r") + r0 + F.col("_a") * height).alias("r"), (F.col("c") + c0 + F.col("_b") * width).alias("c"), "v")
        return put.filter((F.col("r") < n_rows) & (F.col("c") < n_cols)), 0, 0
    put = cells.select((F.col("r") + r0).alias("r"), (F.col("c") + c0).alias("c"), "v").filter((F.col("r") < n_rows) & (F.col("c") < n_cols))
    return put, max(0, r0 + height - n_rows), max(0, c0 + width - n_cols)


def fill_cells(cells: DataFrame) -> DataFrame:
    """Chosen cells (r, c, v): in each column the topmost one's value for all the others."""
    first = cells.groupBy("c").agg(F.min(F.struct("r", "v")).alias("top"))
    return cells.select("r", "c").join(first.select("c", "top"), "c").filter(F.col("r") > F.col("top.r")).select("r", "c", F.col("top.v").alias("v"))
