"""Facts of procedural code: subprograms, table use, calls, marks; tokens in, rows out."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .lexer import Token, tokens

FACTS = "unit string, path string, fact string, what string, op string, line int"
#: Words that end a list of tables, and built-in functions that aren't calls.
_STOP = {"WHERE", "SET", "VALUES", "SELECT", "ON", "USING", "GROUP", "ORDER", "HAVING", "START", "CONNECT", "UNION", "MINUS", "INTERSECT", "WHEN", "LOOP", "INTO", "BULK", "FETCH", "RETURNING", "FOR", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL"}
_BUILT_IN = {"NVL", "NVL2", "DECODE", "COALESCE", "TO_CHAR", "TO_DATE", "TO_NUMBER", "SUM", "COUNT", "MIN", "MAX", "AVG", "ROUND", "TRUNC", "SUBSTR", "LENGTH", "UPPER", "LOWER", "TRIM", "INSTR", "REPLACE", "ABS", "MOD", "IF", "IN", "AND", "OR", "NOT", "VALUES", "RAISE_APPLICATION_ERROR", "EXISTS", "RETURN", "CURSOR", "TABLE", "INTO", "OVER", "ROW_NUMBER", "RANK", "VARCHAR2", "NUMBER", "CHAR", "ELSIF", "WHILE", "SELECT", "WHEN", "ON", "THEN", "BY", "FROM", "WHERE", "USING", "SET", "LIKE", "BETWEEN", "KEY"}
_BRANCH = {"IF", "ELSIF", "LOOP", "WHEN", "AND", "OR"}


def _name(ts: list[Token], i: int) -> tuple[str, int]:
    """A dotted name, and what comes after it; links (@x) belong to it."""
    if i >= len(ts) or ts[i].kind not in ("word", "quoted"):
        return "", i
    name = ts[i].up.strip('"')
    i += 1
    while i + 1 < len(ts) and ts[i].text in (".", "@") and ts[i + 1].kind in ("word", "quoted"):
        name += ts[i].text + ts[i + 1].up.strip('"')
        i += 2
    return name, i


def extract(unit: str, text: str) -> Iterator[tuple]:
    """(unit, path, fact, what, op, line); facts: subprogram, table (op C, R, U, D), call, sequence, handler, link, mark, complexity."""
    ts = tokens(text)
    ctes = {ts[i].up for i in range(len(ts) - 2) if ts[i + 1].up == "AS" and ts[i + 2].text == "(" and i and (ts[i - 1].up == "WITH" or ts[i - 1].text == ",")}
    names: list[tuple[str, int]] = []
    depth, complexity, opened = 0, {"": 1}, []
    i = 0

    def path():
        return ".".join(n for n, _ in names)

    def table(name, op, line):
        if name and name not in ctes and name != "DUAL" and not name.startswith("("):
            yield unit, path(), "table", name, op, line

    while i < len(ts):
        t, up = ts[i], ts[i].up
        after = ts[i + 1].up if i + 1 < len(ts) else ""
        before = ts[i - 1].up if i else ""
        if up in ("PROCEDURE", "FUNCTION") and before not in ("END", "DROP", "CREATE", "REPLACE") or up in ("PROCEDURE", "FUNCTION") and before in ("CREATE", "REPLACE"):
            name, j = _name(ts, i + 1)
            k, brackets = j, 0
            while k < len(ts) and not (brackets == 0 and (ts[k].up in ("IS", "AS") or ts[k].text == ";")):
                brackets += (ts[k].text == "(") - (ts[k].text == ")")
                k += 1
            if k < len(ts) and ts[k].text != ";":
                names.append((name, depth))
                complexity[path()] = 1
                yield unit, path(), "subprogram", name, up, t.line
            i = k + 1
            continue
        if up == "BEGIN" or (up in ("CASE", "IF", "LOOP") and before != "END"):
            depth += 1
            opened.append(up)
        elif up == "END":
            depth = max(0, depth - 1)
            kind = opened.pop() if opened else ""
            if names and kind == "BEGIN" and depth == names[-1][1]:
                yield unit, path(), "complexity", path(), "", complexity.get(path(), 1)
                names.pop()
            if after in ("IF", "LOOP", "CASE"):
                i += 1
        if up in _BRANCH and before != "END":
            complexity[path()] = complexity.get(path(), 1) + 1
        if up == "INSERT":
            j = i + 1 + (after in ("ALL", "FIRST"))
            while j < len(ts) and ts[j].up != "INTO":
                j += 1
            name, j = _name(ts, j + 1)
            yield from table(name, "C", t.line)
            i = j
            continue
        if up == "UPDATE" and before not in ("FOR", "DO") and after not in ("SET", "OF"):
            name, j = _name(ts, i + 1)
            yield from table(name, "U", t.line)
            i = j
            continue
        if up == "DELETE" and after not in (";", "WHERE"):
            name, j = _name(ts, i + 1 + (after == "FROM"))
            yield from table(name, "D", t.line)
            i = j
            continue
        if up == "TRUNCATE" and after == "TABLE":
            name, i = _name(ts, i + 2)
            yield from table(name, "D", t.line)
            continue
        if up == "MERGE" and after == "INTO":
            name, j = _name(ts, i + 2)
            yield from table(name, "C", t.line)
            yield from table(name, "U", t.line)
            i = j
            continue
        if up in ("FROM", "JOIN", "USING") and not (up == "FROM" and _in_call(ts, i)):
            j = i + 1
            while True:
                name, k = _name(ts, j)
                if name and name not in _STOP and not (k < len(ts) and ts[k].text == "("):
                    yield from table(name, "R", ts[j].line)
                if not name or up != "FROM":
                    break
                while k < len(ts) and ts[k].text not in (",", ";", ")", "(") and ts[k].up not in _STOP:
                    k += 1
                if k >= len(ts) or ts[k].text != ",":
                    break
                j = k + 1
            i += 1
            continue
        if up in ("NEXTVAL", "CURRVAL") and before == "." and i > 1:
            k = i - 2
            while k > 1 and ts[k - 1].text == ".":
                k -= 2
            yield unit, path(), "sequence", "".join(x.up.strip('"') for x in ts[k : i - 1]), up, t.line
        if up == "WHEN" and opened and opened[-1] == "BEGIN" and i + 2 < len(ts) and "THEN" in (ts[i + 2].up, *(x.up for x in ts[i + 3 : i + 12] if x.text != ";")):
            k = i + 1
            while k < len(ts) and ts[k].up != "THEN":
                name, after_name = _name(ts, k)
                if name and name != "OR":
                    yield unit, path(), "handler", name, "", t.line
                k = max(after_name, k + 1)
        if t.text == "@" and i and ts[i - 1].kind in ("word", "quoted") and i + 1 < len(ts) and ts[i + 1].kind in ("word", "quoted"):
            yield unit, path(), "link", _name(ts, i + 1)[0], "", t.line
        if up == "EXECUTE" and after == "IMMEDIATE":
            yield unit, path(), "mark", "dynamic", "", t.line
        elif up in ("COMMIT", "ROLLBACK"):
            yield unit, path(), "mark", "transaction", up, t.line
        elif up in ("RAISE", "RAISE_APPLICATION_ERROR"):
            yield unit, path(), "mark", "raise", "", t.line
        elif up == "OTHERS" and [x.up for x in ts[i + 1 : i + 4]] == ["THEN", "NULL", ";"]:
            yield unit, path(), "mark", "swallowed", "", t.line
        if t.kind == "word" and before != "." and up not in _BUILT_IN and up != "END":
            name, j = _name(ts, i)
            first = before in (";", "BEGIN", "THEN", "ELSE", "LOOP", "")
            if names and j < len(ts) and (ts[j].text == "(" and before not in ("INTO", "TYPE", "CURSOR", ",") and name not in ctes or ts[j].text == ";" and first and up not in ("NULL", "COMMIT", "ROLLBACK", "RAISE", "RETURN", "EXIT")):
                yield unit, path(), "call", name, "", t.line
        i += 1
    while names:
        yield unit, path(), "complexity", path(), "", complexity.get(path(), 1)
        names.pop()


class Subprogram(NamedTuple):
    """A subprogram of a unit; `overload` counts those of the same path, `public` says whether the package's head has its name (None: no head)."""

    path: str
    kind: str
    signature: str
    start_line: int
    end_line: int
    overload: int
    public: bool | None


def wrapped(text: str) -> bool:
    """Whether a unit's source is hidden: nothing of it can be read."""
    ts = tokens(text[:2000])
    return any(t.up == "WRAPPED" and t.kind == "word" for t in ts[:12])


def subprograms(text: str, head: str | None = None) -> list[Subprogram]:
    """The subprograms of a unit's text with the lines that they span, nested ones after their parent. Blocks without an end go to the last line."""
    if wrapped(text):
        return []
    known = {ts.up for ts in tokens(head) if ts.kind == "word"} if head is not None else None
    ts, out, stack, seen = tokens(text), [], [], {}
    depth, i = 0, 0
    last = ts[-1].line if ts else 1
    while i < len(ts):
        up, before = ts[i].up, ts[i - 1].up if i else ""
        if up in ("PROCEDURE", "FUNCTION", "TRIGGER") and before not in ("END", "DROP"):
            name, k = _name(ts, i + 1)
            stop, brackets = k, 0
            while stop < len(ts) and not (brackets == 0 and (ts[stop].up in ("IS", "AS", "BEGIN", "DECLARE") or ts[stop].text == ";")):
                brackets += (ts[stop].text == "(") - (ts[stop].text == ")")
                stop += 1
            if stop < len(ts) and ts[stop].text != ";" and name:
                path = ".".join([*(out[s].path for s, _ in stack[-1:]), name.split(".")[-1]])
                seen[path] = seen.get(path, 0) + 1
                signature = " ".join(text[ts[i].start : ts[stop].start].split())
                public = None if known is None or stack else path in known
                stack.append((len(out), depth))
                out.append(Subprogram(path, up, signature, ts[i].line, last, seen[path], public))
                if ts[stop].up in ("BEGIN", "DECLARE"):
                    stop -= 1
            i = stop + 1
            continue
        if up == "BEGIN" or up in ("CASE", "IF", "LOOP") and before != "END":
            depth += 1
        elif up == "END":
            depth = max(0, depth - 1)
            if stack and depth == stack[-1][1]:
                at, _ = stack.pop()
                end = i
                while end + 1 < len(ts) and ts[end].text != ";":
                    end += 1
                out[at] = out[at]._replace(end_line=ts[end].line)
        i += 1
    return out


def _in_call(ts: list[Token], i: int) -> bool:
    """FROM inside EXTRACT( ) or TRIM( )."""
    depth = 0
    for k in range(i - 1, max(-1, i - 12), -1):
        depth += (ts[k].text == ")") - (ts[k].text == "(")
        if depth < 0:
            return k > 0 and ts[k - 1].up in ("EXTRACT", "TRIM", "SUBSTRING")
    return False


def facts(units: DataFrame) -> DataFrame:
    """All facts of a table (unit, text)."""
    schema = pa.schema([("unit", pa.string()), ("path", pa.string()), ("fact", pa.string()), ("what", pa.string()), ("op", pa.string()), ("line", pa.int32())])

    def run(batches):
        for batch in batches:
            rows = [f for u, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in extract(u or "", t or "")]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return units.select("unit", "text").mapInArrow(run, FACTS)
