"""Column functions with the meaning that they have in Oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any_null(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in cols])


def greatest(*cols: Column) -> Column:
    """Null if any is null."""
    return F.when(~_any_null(list(cols)), F.greatest(*cols))


def least(*cols: Column) -> Column:
    return F.when(~_any_null(list(cols)), F.least(*cols))


def concat(*cols: Column) -> Column:
    """Nulls count as empty text; empty text is null."""
    return F.nullif(F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), F.lit(""))


def decode(value: Column, *args) -> Column:
    """decode(value, search, result, ..., default); null equals null."""
    pairs, default = (args[:-1], args[-1]) if len(args) % 2 else (args, F.lit(None))
    out = None
    for search, result in zip(pairs[::2], pairs[1::2], strict=True):
        test = value.eqNullSafe(search)
        out = F.when(test, result) if out is None else out.when(test, result)
    return out.otherwise(default)


def add_months(date: Column, n) -> Column:
    """The last day of a month stays a last day."""
    moved = F.add_months(date, n)
    return F.when(F.to_date(date) == F.last_day(date), F.last_day(moved)).otherwise(moved)


def mod(a: Column, b: Column) -> Column:
    return F.when(b == 0, a).otherwise(F.try_mod(a, b))


def trunc(x: Column, digits: int = 0) -> Column:
    scale = F.lit(float(10**digits))
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def instr(text: Column, part: str, start: int = 1, nth: int = 1) -> Column:
    """The place of the nth occurrence from `start` on; 0 if there is none."""
    at = F.lit(start - 1)
    for _ in range(nth):
        at = F.when(at < 0, F.lit(-1)).otherwise(_after(text, part, at))
    return F.greatest(at, F.lit(0))


def _after(text: Column, part: str, at: Column) -> Column:
    found = F.call_function("locate", F.lit(part), text, at + 1)
    return F.when(found > 0, found).otherwise(F.lit(-1))


def regexp_substr(text: Column, pattern: str, nth: int = 1) -> Column:
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.size(every) >= nth, F.element_at(every, nth))


def stddev(x: Column) -> Column:
    """0 for one row."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def months_between(a: Column, b: Column) -> Column:
    return F.months_between(a, b, roundOff=False)


def days_between(a: Column, b: Column) -> Column:
    """Fractional days."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(a) - micros(b)) / F.lit(86_400_000_000.0)


#: Date elements and their patterns here.
DATE_ELEMENTS = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "MON": "MMM", "DDD": "DDD", "DD": "dd", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "FF": "SSSSSS", "FF1": "S", "FF2": "SS", "FF3": "SSS", "FF6": "SSSSSS", "FF9": "SSSSSSSSS", "RRRR": "yyyy", "RR": "yy", "MONTH": "MMMM", "A.M.": "a", "P.M.": "a", "AM": "a", "PM": "a", "DY": "E", "DAY": "EEEE", "Q": "q", "TZH:TZM": "xxx"}


def date_pattern(fmt: str) -> str:
    """A date format as a Spark pattern; text in double quotes is kept."""
    out, i = [], 0
    names = sorted(DATE_ELEMENTS, key=len, reverse=True)
    while i < len(fmt):
        if fmt[i] == '"':
            end = fmt.index('"', i + 1)
            out.append("'" + fmt[i + 1 : end] + "'")
            i = end + 1
            continue
        name = next((n for n in names if fmt[i : i + len(n)].upper() == n), None)
        out.append(DATE_ELEMENTS[name] if name else fmt[i])
        i += len(name) if name else 1
    return "".join(out)


def to_char(date: Column, fmt: str) -> Column:
    return F.date_format(date, date_pattern(fmt))
