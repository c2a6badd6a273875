"""What single statements write and read, and how long code is cut: column writers, triggers, dynamic SQL, outlines, chunks."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .code_facts import _name, extract
from .lexer import Token, tokens

WRITERS = "unit string, table_name string, column_name string, via string, line int"
CHUNKS = "unit string, chunk int, first_line int, last_line int, hash string, text string"
#: Clauses of an outline; words that open and close a level of code.
_CLAUSES = ("WITH", "SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "UNION", "MINUS", "INTERSECT", "CONNECT", "START", "SET", "VALUES", "USING", "WHEN")
_OPENS, _EVENTS = ("BEGIN", "IF", "LOOP", "CASE", "("), ("INSERT", "UPDATE", "DELETE")


def _closing(ts: list[Token], i: int) -> int:
    """The place of the bracket that closes the one at i, or the end."""
    depth = 0
    for k in range(i, len(ts)):
        depth += (ts[k].text == "(") - (ts[k].text == ")")
        if depth == 0:
            return k
    return len(ts)


def _listed(ts: list[Token], i: int) -> tuple[list[Token], int]:
    """Names of the bracketed list at i, each without its alias, and what comes after the list."""
    end = _closing(ts, i)
    inner = ts[i + 1 : end]
    return [t for t, after in zip(inner, [*inner[1:], None], strict=True) if t.kind in ("word", "quoted") and (after is None or after.text != ".")], end + 1


def _assigned(ts: list[Token], i: int) -> tuple[list[Token], int]:
    """Columns set from i on, just after SET, up to the end of the clause."""
    out, k, at_target = [], i, True
    while k < len(ts):
        t = ts[k]
        if t.text in (";", ")") or t.up in ("WHERE", "WHEN", "RETURNING", "DELETE", "LOG"):
            break
        if at_target and t.text == "(":
            names, k = _listed(ts, k)
            out += names
            at_target = False
            continue
        if at_target and t.kind in ("word", "quoted") and k + 1 < len(ts) and ts[k + 1].text == "=":
            out.append(t)
            at_target = False
        elif t.text == ",":
            at_target = True
        elif t.text == "(":
            k = _closing(ts, k)
        elif t.up == "CASE":
            depth = 1
            while depth and k + 1 < len(ts):
                k += 1
                depth += (ts[k].up == "CASE") - (ts[k].up == "END")
        k += 1
    return out, k


def column_writers(unit: str, text: str) -> list[tuple]:
    """(unit, table, column, via, line); an INSERT without a list writes the column `*`."""
    ts, out, i, merged = tokens(text), [], 0, ""

    def put(table, names, via):
        out.extend((unit, table, t.up.strip('"'), via, t.line) for t in names)

    while i < len(ts):
        up, after = ts[i].up, ts[i + 1].up if i + 1 < len(ts) else ""
        before = ts[i - 1].up if i else ""
        if up == "MERGE" and after == "INTO":
            merged, i = _name(ts, i + 2)
        elif up == "UPDATE" and after == "SET" and merged:
            names, i = _assigned(ts, i + 2)
            put(merged, names, "merge_update")
        elif up == "INSERT" and merged and before == "THEN":
            names, k = _listed(ts, i + 1) if after == "(" else ([], i + 1)
            put(merged, names, "merge_insert") if names else out.append((unit, merged, "*", "merge_insert", ts[i].line))
            i = k
        elif up == "INTO" and (before in ("INSERT", "ALL", "FIRST") or before in (")", "THEN", "ELSE") and _many_inserts(ts, i)):
            table, k = _name(ts, i + 1)
            if k < len(ts) and ts[k].kind == "word" and ts[k].up not in ("VALUES", "SELECT", "WITH"):
                k += 1
            names, k2 = _listed(ts, k) if k < len(ts) and ts[k].text == "(" and ts[min(k + 1, len(ts) - 1)].up not in ("SELECT", "WITH") else ([], k)
            put(table, names, "insert") if names else out.append((unit, table, "*", "insert", ts[i].line))
            i = k2
        elif up == "UPDATE" and before not in ("FOR", "THEN", "OR", "BEFORE", "AFTER", "OF") and after not in ("SET", "OF") or up == "UPDATE" and before == "THEN" and after != "SET":
            table, k = _name(ts, i + 1)
            while k < len(ts) and ts[k].up != "SET" and ts[k].text != ";":
                k += 1
            names, i = _assigned(ts, k + 1)
            put(table, names, "update")
        else:
            if ts[i].text == ";":
                merged = ""
            i += 1
    return out


def _many_inserts(ts: list[Token], i: int) -> bool:
    """Whether the statement at i is an INSERT ALL or INSERT FIRST."""
    while i > 0 and ts[i - 1].text != ";":
        i -= 1
        if ts[i].up == "INSERT":
            return i + 1 < len(ts) and ts[i + 1].up in ("ALL", "FIRST")
    return False


def referenced_tables(text: str) -> list[str]:
    """Names after FROM, JOIN, INTO, UPDATE and TABLE, once each, in order."""
    ts, out = tokens(text), {}
    for i, t in enumerate(ts):
        if t.up in ("FROM", "JOIN", "INTO", "UPDATE", "TABLE"):
            out[_name(ts, i + 1)[0]] = None
    return [n for n in out if n and n not in ("SET", "OF", "SELECT")]


def trigger_target(text: str) -> tuple[str, list[str]]:
    """The table that a trigger watches, and its events; ('', []) for other code."""
    ts = tokens(text)
    at = next((i for i, t in enumerate(ts) if t.up == "TRIGGER"), None)
    on = next((i for i in range(at or 0, len(ts)) if ts[i].up == "ON"), None)
    if at is None or on is None:
        return "", []
    return _name(ts, on + 1)[0], [e for e in _EVENTS if any(t.up == e for t in ts[at:on])]


def dynamic_statements(text: str) -> list[tuple[str, int]]:
    """(SQL, line) of EXECUTE IMMEDIATE and OPEN .. FOR with literals: joined by ||, with `?` where a variable stands."""
    ts, out = tokens(text), []
    for i, t in enumerate(ts):
        run = t.up == "IMMEDIATE" and i and ts[i - 1].up == "EXECUTE"
        opened = t.up == "FOR" and i > 1 and ts[i - 2].up == "OPEN"
        if not (run or opened) or i + 1 >= len(ts) or not any(x.kind == "str" for x in ts[i + 1 : i + 4]):
            continue
        sql, k = "", i + 1
        while k < len(ts) and ts[k].text != ";" and ts[k].up not in ("INTO", "USING", "BULK", "RETURNING"):
            if ts[k].kind == "str":
                raw = ts[k].text.lstrip("nN")
                sql += raw[3:-2] if raw[:1] in "qQ" else raw[1:-1].replace("''", "'")
            elif ts[k].text == "(":
                sql, k = sql + "?", _closing(ts, k)
            elif ts[k].text != "||" and not sql.endswith("?"):
                sql += "?"
            k += 1
        out.append((sql, t.line))
    return out


def dynamic_tables(unit: str, text: str) -> list[tuple]:
    """(unit, table, op, line): tables used by dynamic SQL, as far as literals tell."""
    return [(unit, what, op, line) for sql, line in dynamic_statements(text) for _, _, fact, what, op, _ in extract(unit, sql) if fact == "table"]


def outline(text: str) -> list[tuple[str, int, int]]:
    """(clause, depth of brackets, line) of a statement."""
    out, depth = [], 0
    for t in tokens(text):
        depth += (t.text == "(") - (t.text == ")")
        if t.up in _CLAUSES:
            out.append((t.up, depth, t.line))
    return out


def chunks(text: str, most_lines: int = 120, most_chars: int = 6000) -> list[tuple[int, int]]:
    """(first line, last line) of pieces within both limits, cut where the code is least nested; a longer line stands alone.

    Cuts lie in the middle half of what is cut, at the least depth there, as near the middle as that allows. Neighbours that fit together again are joined; one of under a
    tenth of the limits is joined even if that exceeds them by a quarter.
    """
    lines = text.split("\n")
    depth, after, ts = 0, [0] * len(lines), tokens(text)
    for t, before in zip(ts, [None, *ts], strict=False):
        opens = t.up in _OPENS and (before is None or before.up != "END")
        depth = max(0, depth + opens - (t.up == "END" or t.text == ")"))
        after[t.line - 1] = depth
    said = {t.line - 1 for t in ts}
    for i in range(1, len(lines)):
        if i not in said:
            after[i] = after[i - 1]
    total = [0]
    for line in lines:
        total.append(total[-1] + len(line) + 1)

    def fits(a, b, slack=1.0):
        return b - a <= most_lines * slack and total[b] - total[a] <= most_chars * slack

    done, todo = [], [(0, len(lines))]
    while todo:
        a, b = todo.pop()
        if b - a == 1 or fits(a, b):
            done.append((a, b))
        else:
            edge = (b - a) // 4
            cut = min(range(a + max(1, edge), b - edge), key=lambda k: (after[k - 1], abs(2 * k - a - b)))
            todo += [(cut, b), (a, cut)]
    out: list[tuple[int, int]] = []
    for a, b in done:
        small = out and min(b - a, out[-1][1] - out[-1][0]) * 10 <= most_lines and min(total[b] - total[a], total[out[-1][1]] - total[out[-1][0]]) * 10 <= most_chars
        if out and (fits(out[-1][0], b) or small and fits(out[-1][0], b, 1.25)):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return [(a + 1, b) for a, b in out]


def _rows(units: DataFrame, ddl: str, schema: pa.Schema, of) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [r for u, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in of(u or "", t or "")]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return units.select(F.col("unit").cast("string"), "text").mapInArrow(run, ddl)


def writers_of(units: DataFrame) -> DataFrame:
    """Column writers of a table (unit, text)."""
    return _rows(units, WRITERS, pa.schema([("unit", pa.string()), ("table_name", pa.string()), ("column_name", pa.string()), ("via", pa.string()), ("line", pa.int32())]), column_writers)


def chunked(units: DataFrame, most_lines: int = 120, most_chars: int = 6000) -> DataFrame:
    """Chunks of a table (unit, text), with the hash of each; joined by line ends they give the text back."""

    def of(unit, text):
        lines = text.split("\n")
        for n, (a, b) in enumerate(chunks(text, most_lines, most_chars)):
            piece = "\n".join(lines[a - 1 : b])
            yield unit, n, a, b, hashlib.sha256(piece.encode()).hexdigest(), piece

    return _rows(units, CHUNKS, pa.schema([("unit", pa.string()), ("chunk", pa.int32()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("hash", pa.string()), ("text", pa.string())]), of)


def unfinished(pieces: DataFrame, finished: DataFrame, *versions: str) -> DataFrame:
    """Pieces whose key (hash and versions) isn't among the keys of `finished`."""
    key = F.sha2(F.concat_ws("|", "hash", *[F.lit(v) for v in versions]), 256)
    return pieces.withColumn("key", key).join(finished.select("key").distinct(), "key", "left_anti")


def same_value(a: Column, b: Column) -> Column:
    """Equal after trimming, or numbers within 1e-9, or one null and the other empty."""
    x, y = F.trim(F.coalesce(a.cast("string"), F.lit(""))), F.trim(F.coalesce(b.cast("string"), F.lit("")))
    return (x == y) | F.coalesce(F.abs(x.try_cast("double") - y.try_cast("double")) <= 1e-9, F.lit(False))
