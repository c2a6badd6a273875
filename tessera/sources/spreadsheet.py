"""Spreadsheets without other libraries: XLSX and ODS read as text, XLSX written.

A sheet is one file of bounded size (1,048,576 rows by its format), so one task reads it and the driver writes it.
"""

from __future__ import annotations

import datetime
import io
import os
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MOST_ROWS, MOST_COLUMNS, MOST_CHARS = 1_048_575, 16_384, 32_767
#: Number formats that are dates.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_EPOCH = datetime.datetime(1899, 12, 30)


class SheetError(ValueError):
    """A file that is no sheet, or a result that doesn't fit one."""


def _tag(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def number_text(value: float) -> str:
    """A number as text: whole ones without a point, none with an exponent."""
    if value == int(value) and abs(value) < 1e15:
        return str(int(value))
    said = repr(value)
    return f"{value:.10f}".rstrip("0").rstrip(".") if "e" in said or "E" in said else said


def _moment(days: float) -> str:
    return (_EPOCH + datetime.timedelta(seconds=round(days * 86400))).strftime("%Y-%m-%d %H:%M:%S")


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_xlsx(raw: bytes, sheet: str | None = None) -> tuple[list[str], str, list[list[str | None]]]:
    """(names of sheets, the one read, its rows as text)."""
    try:
        book = zipfile.ZipFile(io.BytesIO(raw))
        tree = ElementTree.fromstring(book.read("xl/workbook.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise SheetError(f"no workbook: {e}") from e
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = {}
    for node in tree.iter():
        if _tag(node) == "sheet":
            ident = next(v for k, v in node.attrib.items() if k.endswith("}id"))
            sheets[node.get("name")] = links[ident].lstrip("/").removeprefix("xl/")
    if not sheets:
        raise SheetError("a workbook without sheets")
    chosen = sheet if sheet in sheets else next(iter(sheets))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in item.iter() if _tag(t) == "t"))
    dates = _date_styles(book)
    rows: list[list[str | None]] = []
    for _, node in ElementTree.iterparse(io.BytesIO(book.read("xl/" + sheets[chosen]))):
        if _tag(node) != "row":
            continue
        number = int(node.get("r", len(rows) + 1))
        rows += [[] for _ in range(number - 1 - len(rows))]
        row: list[str | None] = []
        for cell in node:
            at = _column(cell.get("r")) if cell.get("r") else len(row)
            row += [None] * (at - len(row))
            row.append(_cell(cell, shared, dates))
        rows.append(row)
        node.clear()
    return list(sheets), chosen, rows


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Styles of cells that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    formats, out = set(_DATE_FORMATS), set()
    for node in ElementTree.fromstring(book.read("xl/styles.xml")):
        if _tag(node) == "numFmts":
            for f in node:
                code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", ""))
                if re.search(r"[ymdhs]", code, re.I):
                    formats.add(int(f.get("numFmtId")))
        elif _tag(node) == "cellXfs":
            out = {i for i, xf in enumerate(node) if int(xf.get("numFmtId", 0)) in formats}
    return out


def _cell(cell, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _tag(t) == "t")
    value = next((v.text for v in cell if _tag(v) == "v"), None)
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "d":
        return value.replace("T", " ")
    if kind in ("str", "e", "b"):
        return value
    number = float(value)
    return _moment(number) if int(cell.get("s", 0)) in dates else number_text(number)


def read_ods(raw: bytes, sheet: str | None = None) -> tuple[list[str], str, list[list[str | None]]]:
    try:
        tree = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("content.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise SheetError(f"no spreadsheet: {e}") from e
    attr = lambda node, name: next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == name), None)
    tables = {attr(n, "name"): n for n in tree.iter() if _tag(n) == "table"}
    if not tables:
        raise SheetError("a file without sheets")
    chosen = sheet if sheet in tables else next(iter(tables))
    rows: list[list[str | None]] = []
    for line in tables[chosen].iter():
        if _tag(line) != "table-row":
            continue
        row: list[str | None] = []
        for cell in line:
            if _tag(cell) not in ("table-cell", "covered-table-cell"):
                continue
            kind, value = attr(cell, "value-type"), attr(cell, "value")
            said = "\n".join("".join(p.itertext()) for p in cell if _tag(p) == "p") or None
            if kind in ("float", "percentage", "currency") and value is not None:
                said = number_text(float(value))
            elif kind == "boolean":
                said = "1" if attr(cell, "boolean-value") == "true" else "0"
            elif kind == "date":
                said = (attr(cell, "date-value") or "").replace("T", " ")
                said += " 00:00:00" if len(said) == 10 else ""
            times = int(attr(cell, "number-columns-repeated") or 1)
            row += [said] * (times if said is not None else min(times, MOST_COLUMNS - len(row)))
        while row and row[-1] is None:
            row.pop()
        times = int(attr(line, "number-rows-repeated") or 1)
        rows += [list(row) for _ in range(times)] if row else [[]] * min(times, 1)
    return list(tables), chosen, rows


def _bytes(spark: SparkSession, path: str) -> bytes:
    got = spark.read.format("binaryFile").load(path).select("content").head()
    if got is None:
        raise SheetError(f"no file: {path}")
    return bytes(got.content)


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, skip: int = 0, header: bool = True) -> DataFrame:
    """A sheet's columns as text: the first `skip` rows and empty rows go, the next names the columns, short rows are padded."""
    raw = _bytes(spark, path)
    _, _, rows = (read_ods if path.lower().endswith(".ods") else read_xlsx)(raw, sheet)
    rows = [r for r in rows[skip:] if any(c is not None and c.strip() for c in r)]
    width = max(map(len, rows), default=0)
    if not width:
        return spark.createDataFrame([], "value string")
    names = rows.pop(0) if header else []
    columns, seen = [], set()
    for k in range(width):
        name = (names[k] or "").strip() if k < len(names) else ""
        name = name or f"c{k + 1}"
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        columns.append(name)
    padded = [tuple(r) + (None,) * (width - len(r)) for r in rows]
    return spark.createDataFrame(padded, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def _number(value) -> str | None:
    """A number that a sheet holds exactly: of 15 digits at most."""
    said = str(value)
    digits = re.sub(r"[^0-9]", "", said).lstrip("0")
    if isinstance(value, float):
        return repr(value) if value == value and abs(value) != float("inf") else None
    return said if len(digits) <= 15 and "E" not in said.upper() else None


def _written(ref: str, value, kind: T.DataType) -> str:
    if value is None:
        return ""
    if isinstance(kind, T.NumericType) and (said := _number(value)) is not None:
        return f'<c r="{ref}"><v>{said}</v></c>'
    if isinstance(value, datetime.date) and value.year >= 1900:
        moment = value if isinstance(value, datetime.datetime) else datetime.datetime(value.year, value.month, value.day)
        return f'<c r="{ref}" s="1"><v>{(moment.replace(tzinfo=None) - _EPOCH) / datetime.timedelta(days=1)!r}</v></c>'
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value)[:MOST_CHARS])
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def write_xlsx(df: DataFrame, path: str, sql: str = "", sheet: str = "Result") -> int:
    """Writes a result to one sheet, and its SQL to a second; returns the number of rows. A result that doesn't fit a sheet is refused, not cut.

    Numbers of over 15 digits and dates before 1900 are text. The file appears whole or not at all.
    """
    if len(df.columns) > MOST_COLUMNS or not df.columns:
        raise SheetError(f"a sheet holds 1 to {MOST_COLUMNS} columns")
    if df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise SheetError(f"a sheet holds {MOST_ROWS} rows below its header")
    named = [sheet] + ["SQL"] * bool(sql.strip())
    temporary, n = f"{path}.{os.getpid()}.tmp", 0
    try:
        with zipfile.ZipFile(temporary, "w", zipfile.ZIP_DEFLATED) as book:
            book.writestr("[Content_Types].xml", f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(named))) + "</Types>")
            book.writestr("_rels/.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            book.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, s in enumerate(named)) + "</sheets></workbook>")
            book.writestr("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{_REL}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(named))) + f'<Relationship Id="rId{len(named) + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
            book.writestr("xl/styles.xml", f'{_XML}<styleSheet xmlns="{_MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm:ss"/></numFmts><fonts count="2"><font/><font><b/></font></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf numFmtId="164" applyNumberFormat="1"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
            with book.open("xl/worksheets/sheet1.xml", "w") as out:
                put = lambda s: out.write(s.encode())
                put(f'{_XML}<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData><row r="1">')
                put("".join(f'<c r="{_letters(k)}1" s="2" t="inlineStr"><is><t>{escape(c)}</t></is></c>' for k, c in enumerate(df.columns)) + "</row>")
                kinds = [f.dataType for f in df.schema]
                for row in df.toLocalIterator():
                    n += 1
                    put(f'<row r="{n + 1}">' + "".join(_written(f"{_letters(k)}{n + 1}", v, kinds[k]) for k, v in enumerate(row)) + "</row>")
                put(f'</sheetData><autoFilter ref="A1:{_letters(len(df.columns) - 1)}{n + 1}"/></worksheet>')
            if len(named) > 1:
                book.writestr("xl/worksheets/sheet2.xml", f'{_XML}<worksheet xmlns="{_MAIN}"><sheetData><row r="1">{_written("A1", sql, T.StringType())}</row></sheetData></worksheet>')
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.remove(temporary)
    return n
