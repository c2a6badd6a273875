"""Conditions from values: one cell, a list of cells, as columns and as Oracle text; and the texts that lists are copied as."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import in_list, not_in_list

_NUMBER = re.compile(r"^-?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$")
_TIME = re.compile(r"^(\d{4}-\d{2}-\d{2})(?:[ T](\d{2}:\d{2}:\d{2})(\.\d+)?)?\s*([+-]\d{2}:\d{2})?$")


class NoCondition(ValueError):
    """A value that makes no condition."""


def _text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.CharType, T.VarcharType))


def _like_pattern(value: str) -> tuple[str, bool]:
    escaped = re.sub(r"([%_\\])", r"\\\1", value)
    return f"%{escaped}%", escaped != value


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def name_sql(name: str) -> str:
    """A name, in double quotes where Oracle needs them."""
    return name if re.fullmatch(r"[A-Z][A-Z0-9_$#]*", name) else '"' + name.replace('"', '""') + '"'


def literal_sql(value: str, kind: T.DataType) -> str:
    """An Oracle literal of a value shown as text."""
    if isinstance(kind, T.NumericType):
        return value.strip() if _NUMBER.match(value.strip()) else quoted(value)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        m = _TIME.match(value.strip())
        if not m:
            raise NoCondition(f"{value} is no date")
        day, clock, fraction, zone = m[1], m[2] or "00:00:00", m[3] or "", m[4]
        if zone:
            return f"TO_TIMESTAMP_TZ('{day} {clock}{fraction} {zone}', 'YYYY-MM-DD HH24:MI:SS{'.FF9' * bool(fraction)} TZH:TZM')"
        if fraction:
            return f"TO_TIMESTAMP('{day} {clock}{fraction}', 'YYYY-MM-DD HH24:MI:SS.FF9')"
        return f"TO_DATE('{day} {clock}', 'YYYY-MM-DD HH24:MI:SS')"
    return quoted(value)


def cell_condition(name: str, value, like: bool = False) -> Column:
    """The rows whose column has the value of a cell, null included; with `like` those whose text holds it, its wildcards taken as they are."""
    col = F.col(name)
    if like:
        if value is None:
            raise NoCondition("null is like nothing")
        return col.like(F.lit(_like_pattern(str(value))[0]), F.lit("\\")) if _accepts_escape() else col.contains(str(value))
    return col.isNull() if value is None else col == value


def _accepts_escape() -> bool:
    import inspect

    return len(inspect.signature(Column.like).parameters) > 2


def cell_text(name: str, value: str | None, kind: T.DataType, like: bool = False) -> str:
    """The same as Oracle text; `name` may be an expression."""
    if value is None:
        if like:
            raise NoCondition("null is like nothing")
        return f"{name} IS NULL"
    if not like:
        return f"{name} = {literal_sql(value, kind)}"
    if not _text(kind):
        raise NoCondition("only text is compared by LIKE")
    pattern, escaped = _like_pattern(value)
    return f"{name} LIKE {quoted(pattern)}" + (" ESCAPE '\\'" if escaped else "")


def _distinct(values: list) -> tuple[list, bool]:
    """The values once each in the order in which they are met, and whether null is among them."""
    return [v for v in dict.fromkeys(values) if v is not None], None in values


def list_condition(name: str, values: list, how: str = "in") -> Column:
    """in: the values, null where it is among them; notin: all others, null unless it is among them; like: texts that hold one of them."""
    some, null = _distinct(values)
    if not some and not null:
        raise NoCondition("no values")
    if how == "in":
        return in_list(F.col(name), values)
    if how == "notin":
        return not_in_list(F.col(name), values) if some else F.col(name).isNotNull()
    if not some:
        raise NoCondition("null is like nothing")
    out = reduce(lambda a, b: a | b, [F.coalesce(F.col(name).contains(str(v)), F.lit(False)) for v in some])
    return out | F.col(name).isNull() if null else out


def list_condition_text(name: str, values: list[str | None], kind: T.DataType, how: str = "in") -> str:
    some, null = _distinct(values)
    if not some and not null:
        raise NoCondition("no values")
    if how == "like":
        if not some or not _text(kind):
            raise NoCondition("only text is compared by LIKE")
        parts = [cell_text(name, v, kind, True) for v in some] + [f"{name} IS NULL"] * null
        return parts[0] if len(parts) == 1 else f"({' OR '.join(parts)})"
    made = [literal_sql(v, kind) for v in some]
    if how == "in":
        if not made:
            return f"{name} IS NULL"
        test = f"{name} = {made[0]}" if len(made) == 1 else f"{name} IN ({', '.join(made)})"
        return f"({test} OR {name} IS NULL)" if null else test
    if not made:
        return f"{name} IS NOT NULL"
    test = f"{name} <> {made[0]}" if len(made) == 1 else f"{name} NOT IN ({', '.join(made)})"
    return f"{name} IS NOT NULL AND {test}" if null else f"({test} OR {name} IS NULL)"


def list_text(name: str, values: list[str | None], kind: T.DataType, form: str) -> str:
    """A list as text to paste; forms: in, cond, comma, quoted, lines."""
    some, _ = _distinct(values)
    if not some:
        raise NoCondition("no values but null")
    if form == "comma":
        return ",".join(some)
    if form == "lines":
        return "\n".join(some)
    if form == "quoted":
        return ",".join(map(quoted, some))
    if form == "in":
        return f"({', '.join(literal_sql(v, kind) for v in some)})"
    return list_condition_text(name, values, kind)


def value_list(df: DataFrame, column: str, form: str = "quoted") -> DataFrame:
    """One row with the list of a column's distinct values in order, as the text of a form: comma, quoted, lines."""
    text = F.col("v") if form != "quoted" else F.concat(F.lit("'"), F.replace("v", F.lit("'"), F.lit("''")), F.lit("'"))
    some = df.select(F.col(column).cast("string").alias("v")).filter("v IS NOT NULL").distinct()
    return some.agg(F.array_join(F.sort_array(F.collect_list(text)), "\n" if form == "lines" else ",").alias("text"))


def name_like(column: str, pattern: str) -> Column:
    """Names that match a pattern of % and _, whatever their case; nothing escapes."""
    body = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern.upper())
    return F.upper(F.col(column)).rlike(f"(?s)^{body}$")
