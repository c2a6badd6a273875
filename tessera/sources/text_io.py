"""Delimited text in and out: sniffing, cleaning, date formats, rejects, and the texts of exports."""

from __future__ import annotations

import csv
import io
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import date_pattern
from ..operators.predicates import name_sql

#: Date formats that are tried, in this order, as (pattern of the values, format in Oracle's elements).
DATE_FORMATS = [
    (r"^\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}:\d{2}$", "YYYY-MM-DD HH24:MI:SS"), (r"^\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}:\d{2}\.\d+$", "YYYY-MM-DD HH24:MI:SS.FF"), (r"^\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}$", "YYYY-MM-DD HH24:MI"),
    (r"^\d{4}-\d{2}-\d{2}$", "YYYY-MM-DD"), (r"^\d{4}/\d{2}/\d{2} \d{1,2}:\d{2}:\d{2}$", "YYYY/MM/DD HH24:MI:SS"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "YYYY/MM/DD"), (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "YYYY.MM.DD"),
    (r"^\d{14}$", "YYYYMMDDHH24MISS"), (r"^\d{8}$", "YYYYMMDD"),
]
FALLBACK_FORMAT = "YYYY-MM-DD HH24:MI:SS"
_QUOTED = r'"[^"]*"'


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter that each of the first five lines has most often, outside quotes (of equals the last of `, tab ; |`); if none is in all, the one met most often."""
    bare = [re.sub(_QUOTED, "", line) for line in lines if line.strip()][:5]
    best = max("|;\t,", key=lambda d: (min((line.count(d) for line in bare), default=0), sum(line.count(d) for line in bare)))
    return best if any(best in line for line in bare) else ","


def _fields(lines: list[str], delimiter: str) -> list[list[str]]:
    return list(csv.reader(lines, delimiter=delimiter))


def read_delimited(spark: SparkSession, path: str, skip: int = 0, encoding: str | None = None, delimiter: str | None = None, header: bool = True) -> DataFrame:
    """All columns as text, named by the header (columns without a name by their place); `skip` records and blank rows go, short rows are padded with nulls.

    Without an encoding the file is UTF-8, or CP949 if any line isn't that. Cells in quotes may hold line ends; only then one task reads a whole
    file. Three passes: what the first lines are, how wide and how encoded the lines are, the rows.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    if encoding is None:
        encoding = "utf-8" if raw.filter(~F.is_valid_utf8("value")).isEmpty() else "cp949"
    unicode = encoding.lower().replace("-", "") == "utf8"
    if not unicode:  # Spark reads few encodings; lines are cut at the same byte in those that extend ASCII
        raw = raw.withColumn("value", F.col("value").cast("binary")).mapInArrow(_decoded(encoding), "value string, f string, b bigint, i bigint")
    raw = raw.withColumn("value", F.regexp_replace("value", "^\ufeff|\r$", ""))
    some = raw.filter(F.trim("value") != "")
    head = some.orderBy("f", "b", "i").limit(skip + 60).collect()
    if len(head) <= skip:
        return spark.createDataFrame([], "value string")
    delimiter = delimiter or sniff_delimiter([r.value for r in head[skip:]])
    bare = F.regexp_replace("value", _QUOTED, "")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd, wide = some.agg(F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False)), F.max(F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))))).first()
    first = next((k for k, row in enumerate(_fields([r.value for r in head], delimiter)[skip:]) if any(c.strip() for c in row)), 0) + skip
    names = _fields([r.value for r in head], delimiter)[first] if header else []
    width = max(len(names), wide + 1)
    columns, seen = [], set()
    for k in range(width):
        name = names[k].strip() if k < len(names) and names[k].strip() else f"c{k + 1}"
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        columns.append(name)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    options = {"sep": delimiter, "escape": '"', "mode": "PERMISSIVE", "multiLine": str(odd).lower()}
    if odd:  # a cell with a line end: records aren't lines
        if unicode:
            rows = spark.read.options(**options).schema(schema).csv(path).withColumn("_i", F.monotonically_increasing_id())
        else:
            rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_records(encoding, delimiter, columns), f"{_ddl(schema)}, _i bigint")
        rows = rows.filter(F.col("_i") >= first + header).drop("_i")
    else:
        last = head[first if header else skip - 1] if header or skip else None
        kept = some if last is None else some.filter(~((F.col("f") == last.f) & (F.col("b") == last.b) & (F.col("i") <= last.i)))
        rows = kept.select(F.from_csv("value", _ddl(schema), options).alias("r")).select("r.*")
    full = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(f"`{n}`")), F.lit("")) != "" for n in columns])
    return rows.filter(full)


def _decoded(encoding: str):
    def decoded(batches):
        for batch in batches:
            texts = [x.decode(encoding, "replace") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], names=["value", "f", "b", "i"])

    return decoded


def _records(encoding: str, delimiter: str, columns: list[str]):
    def records(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows = [r for r in csv.reader(io.StringIO(raw.decode(encoding, "replace"), newline=""), delimiter=delimiter) if r]
                cells = [pa.array([r[k] if k < len(r) and r[k] else None for r in rows], pa.string()) for k in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*cells, pa.array(range(len(rows)), pa.int64())], names=[*columns, "_i"])

    return records


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)


def preview(df: DataFrame, most: int = 100) -> tuple[list, int]:
    """(the first rows, how many there are)."""
    return df.limit(most).collect(), df.count()


def clean_text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def clean_number(c: Column) -> Column:
    """Numbers lose commas, spaces, hard spaces and currency signs."""
    return F.nullif(F.translate(F.trim(c), ", ₩$ ", ""), F.lit(""))


def date_format(df: DataFrame, column: str, fallback: str = FALLBACK_FORMAT) -> str:
    """The first format that all values have, in Oracle's elements; one pass."""
    return date_formats(df, [column], fallback)[column]


def date_formats(df: DataFrame, columns: list[str], fallback: str = FALLBACK_FORMAT) -> dict[str, str]:
    """The format of each column, all in one pass."""
    tests = [F.bool_and(clean_text(F.col(c)).rlike(p)).alias(f"f{k}_{i}") for k, c in enumerate(columns) for i, (p, _) in enumerate(DATE_FORMATS)]
    found = df.agg(*tests).first()
    n = len(DATE_FORMATS)
    return {c: next((fmt for hit, (_, fmt) in zip(found[k * n : (k + 1) * n], DATE_FORMATS, strict=True) if hit), fallback) for k, c in enumerate(columns)}


def reading_pattern(fmt: str) -> str:
    """A format as a Spark pattern that also reads numbers of one digit, where something parts them."""
    pattern = date_pattern(fmt)
    return pattern if re.fullmatch(r"[A-Za-z]+", pattern) else re.sub(r"\b(MM|dd|HH)\b", lambda m: m[0][0], pattern).replace(".SSSSSS", "[.SSSSSS][.SSS][.S]")


def match_columns(found: list[str], wanted: list[str]) -> dict[str, str]:
    """Names that agree but for case, spaces and marks."""
    plain = lambda x: re.sub(r"[\W_]", "", x).lower()
    of = {plain(w): w for w in reversed(wanted)}
    return {f: of[plain(f)] for f in found if plain(f) in of}


def typed(df: DataFrame, schema: T.StructType, formats: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the schema's types, rejected rows with the names of the columns that don't convert); formats of dates are Oracle's."""
    made = []
    for f in schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.NumericType):
            made.append(clean_number(c).try_cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            made.append(F.try_to_timestamp(clean_text(c), F.lit(reading_pattern((formats or {}).get(f.name, FALLBACK_FORMAT)))).cast(f.dataType).alias(f.name))
        else:
            made.append(clean_text(c).alias(f.name))
    good = F.struct(*made)
    bad = F.array_compact(F.array(*[F.when(clean_text(F.col(f.name)).isNotNull() & F.col(f"_t.{f.name}").isNull(), F.lit(f.name)) for f in schema]))
    rows = df.withColumn("_t", good).withColumn("_bad", bad)
    return rows.filter(F.size("_bad") == 0).select("_t.*"), rows.filter(F.size("_bad") > 0).drop("_t").withColumnRenamed("_bad", "errors")


class Stopped(ValueError):
    """Rows that don't convert, where none may be left out."""


def imported(df: DataFrame, schema: T.StructType, formats: dict[str, str] | None = None, skip_errors: bool = True, most_errors: int = 200) -> tuple[DataFrame, dict]:
    """(rows to append, summary): total, inserted, failed, and the first errors as (row, columns). Without `skip_errors` any error stops it all.

    Nothing is written here; the counts are of one pass.
    """
    good, bad = typed(df, schema, formats)
    failed = bad.count()
    errors = [(tuple(r[c] for c in df.columns), r.errors) for r in bad.limit(most_errors).collect()] if failed else []
    if failed and not skip_errors:
        raise Stopped(f"{failed} rows don't convert, the first in {', '.join(errors[0][1])}")
    inserted = good.count()
    return good, {"total": inserted + failed, "inserted": inserted, "failed": failed, "errors": errors}


def insert_statement(table: str, columns: dict[str, T.DataType], formats: dict[str, str] | None = None) -> str:
    """INSERT with numbered binds; dates by their format."""
    values = []
    for k, (name, kind) in enumerate(columns.items(), 1):
        fmt = (formats or {}).get(name, FALLBACK_FORMAT)
        date = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
        values.append(f"{'TO_TIMESTAMP' if 'FF' in fmt else 'TO_DATE'}(:{k}, '{fmt}')" if date else f":{k}")
    return f"INSERT INTO {table} ({', '.join(name_sql(c) for c in columns)}) VALUES ({', '.join(values)})"


def csv_field(c: Column, delimiter: str = ",") -> Column:
    """Quoted if it holds the delimiter, a quote, a line end, or a space at either edge; null is empty."""
    text = c.cast("string")
    odd = text.contains(delimiter) | text.contains('"') | text.rlike(r"[\r\n]|^\s|\s$")
    return F.coalesce(F.when(odd, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text), F.lit(""))


def csv_line(df: DataFrame, delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *[csv_field(F.col(c), delimiter) for c in df.columns])


def csv_lines(df: DataFrame, delimiter: str = ",", header: bool = True) -> DataFrame:
    """Lines of a CSV file, the names first."""
    lines = df.select(csv_line(df, delimiter).alias("line"))
    if not header:
        return lines
    names = df.sparkSession.createDataFrame([tuple(df.columns)], T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(df.columns))]))
    return names.select(csv_line(names, delimiter).alias("line")).union(lines)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True) -> None:
    """Lines with CR and LF; the header is the first part's first line."""
    csv_lines(df, delimiter, header).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def literal(c: Column, kind: T.DataType) -> Column:
    """The value as an Oracle literal."""
    text = c.cast("string")
    if isinstance(kind, T.NumericType):
        out = F.when(text.rlike(r"^-?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$"), text).otherwise(F.concat(F.lit("'"), text, F.lit("'")))
    elif isinstance(kind, T.DateType):
        out = F.concat(F.lit("TO_DATE('"), text, F.lit("', 'YYYY-MM-DD')"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        exact = c == F.date_trunc("second", c)
        out = F.when(exact, F.concat(F.lit("TO_DATE('"), whole, F.lit("', 'YYYY-MM-DD HH24:MI:SS')"))).otherwise(
            F.concat(F.lit("TO_TIMESTAMP('"), F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("', 'YYYY-MM-DD HH24:MI:SS.FF')"))
        )
    elif isinstance(kind, T.BinaryType):
        out = F.lit("NULL")
    else:
        quoted = lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / 1000).cast("int")), lambda i: F.concat(F.lit("TO_CLOB("), quoted(F.substring(text, i * 1000 + 1, F.lit(1000))), F.lit(")")))
        out = F.when(F.octet_length(text) > 4000, F.array_join(pieces, " || ")).otherwise(quoted(text))
    return F.coalesce(out, F.lit("NULL"))


def insert_script(df: DataFrame, table: str, one_line: bool = True) -> DataFrame:
    """One INSERT statement for each row; a column ROWID is left out."""
    fields = [f for f in df.schema if f.name.upper() != "ROWID"]
    names = ", ".join(f.name if re.fullmatch(r"\w+", f.name) else name_sql(f.name) for f in fields)
    values = F.concat_ws(", ", *[literal(F.col(f"`{f.name}`"), f.dataType) for f in fields])
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({names}){' ' if one_line else chr(10)}VALUES ("), values, F.lit(");")).alias("line"))


def tsv_line(df: DataFrame) -> Column:
    """Cells to paste into a sheet: quoted if they hold a tab, a quote or a line end."""

    def cell(c: str) -> Column:
        text = F.col(f"`{c}`").cast("string")
        return F.coalesce(F.when(text.rlike('[\t\n\r"]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text), F.lit(""))

    return F.concat_ws("\t", *[cell(c) for c in df.columns])


def html_row(df: DataFrame) -> Column:
    def cell(c: str) -> Column:
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
            text = F.replace(text, F.lit(mark), F.lit(name))
        return F.concat(F.lit("<td>"), text, F.lit("</td>"))

    return F.concat(F.lit("<tr>"), *[cell(c) for c in df.columns], F.lit("</tr>"))


def shown_text(c: Column, kind: T.DataType, most: int = 4000) -> Column:
    """A cell as text: cut with an ellipsis; what has no text is named by its type."""
    if isinstance(kind, (T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.when(c.isNotNull(), F.lit(f"({kind.typeName().upper()})"))
    text = c.cast("string")
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def shown(df: DataFrame, most: int = 4000) -> DataFrame:
    """All columns as text to show."""
    return df.select(*[shown_text(F.col(f"`{f.name}`"), f.dataType, most).alias(f.name) for f in df.schema])


def parse_tsv(text: str) -> list[list[str]]:
    """Cells of a copied range: quoted cells may hold tabs and line ends; a quote that isn't closed is text."""
    rows, row, i = [], [], 0
    text = text.replace("\r\n", "\n").removesuffix("\n")
    while True:
        end = None
        if text[i : i + 1] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"(?=[\t\n]|\Z)').match(text, i)
            if m:
                cell, end = m[1].replace('""', '"'), m.end()
        if end is None:
            end = min((k for k in (text.find("\t", i), text.find("\n", i)) if k >= 0), default=len(text))
            cell = text[i:end]
        row.append(cell)
        if end >= len(text):
            return [*rows, row]
        if text[end] == "\n":
            rows.append(row)
            row = []
        i = end + 1
