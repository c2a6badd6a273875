"""Files of code as units (owner, name, unit_type, text): SQL scripts, C with embedded SQL, XML files of queries.

The latter two become package bodies of one procedure for each function or query, line for line, so that lines of facts are lines of the file.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lexer import split_script, tokens

UNITS = "owner string, name string, unit_type string, text string, file string, place int"
#: Types of units that hold code, and suffixes of files by what they are.
BODIES = ("PROCEDURE", "FUNCTION", "PACKAGE BODY", "TYPE BODY", "TRIGGER")
SQL_FILES, C_FILES, XML_FILES = ("sql", "pkb", "pks", "pkg", "prc", "fnc", "trg", "tpb", "tps", "plsql"), ("pc",), ("xml",)
_SCHEMA = pa.schema([("owner", pa.string()), ("name", pa.string()), ("unit_type", pa.string()), ("text", pa.string()), ("file", pa.string()), ("place", pa.int32())])


def decode(raw: bytes) -> str:
    """UTF-8, with a mark or without, else CP949."""
    raw = raw.removeprefix(b"\xef\xbb\xbf")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("cp949", "replace")


def header(text: str) -> tuple[str, str, str, int]:
    """(owner, name, type, where the head begins) of a unit's text, CREATE and its words left out; empty if it is none."""
    ts, i = tokens(text), 0
    if ts and ts[0].up == "CREATE":
        i = 1
        while i < len(ts) and ts[i].up in ("OR", "REPLACE", "EDITIONABLE", "NONEDITIONABLE"):
            i += 1
    if i >= len(ts) or ts[i].up not in ("PROCEDURE", "FUNCTION", "PACKAGE", "TYPE", "TRIGGER"):
        return "", "", "", 0
    start, kind = ts[i].start, ts[i].up
    i += 1
    if i < len(ts) and ts[i].up == "BODY" and kind in ("PACKAGE", "TYPE"):
        kind, i = kind + " BODY", i + 1
    if i >= len(ts) or ts[i].kind not in ("word", "quoted"):
        return "", "", "", 0
    bare = lambda t: t.text[1:-1] if t.kind == "quoted" else t.up
    if i + 2 < len(ts) and ts[i + 1].text == "." and ts[i + 2].kind in ("word", "quoted"):
        return bare(ts[i]), bare(ts[i + 2]), kind, start
    return "", bare(ts[i]), kind, start


def units_of_script(text: str, owner: str) -> list[tuple[str, str, str, str]]:
    """(owner, name, type, text from its head on) of the units of a script; a file that begins with a unit's head is one unit."""
    out = []
    for statement, kind, _ in split_script(text):
        if kind == "unit":
            own, name, unit_type, start = header(statement)
            if name:
                out.append((own or owner.upper(), name, unit_type, statement[start:]))
    if not out:
        own, name, unit_type, start = header(text)
        if name and not text.lstrip().upper().startswith("CREATE"):
            out.append((own or owner.upper(), name, unit_type, re.sub(r"\s*/?\s*\Z", "", text[start:])))
    return out


def _binds(sql: str) -> str:
    """Host variables without indicators and members: `:a.b:c` is one bind."""
    return re.sub(r":(\w+)(?:(?:\.|->)\w+)*(?:\[[^\]]*\])?(?:\s*:\w+)?", r":\1", sql)


def _flat(sql: str) -> str:
    return " ".join(sql.split())


_C = re.compile(
    r"""(?P<comment>/\*.*?\*/|//[^\n]*)|(?P<exec>\bEXEC\s+SQL\b)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<word>[A-Za-z_]\w*)|(?P<line>\n)|(?P<hash>^\s*\#[^\n]*)|(?P<other>.)""",
    re.X | re.S | re.M | re.I,
)
_NOT_FUNCTIONS = {"if", "for", "while", "switch", "return", "sizeof", "else", "do"}


def _statement_end(text: str, at: int) -> int:
    """Where the embedded statement that begins at `at` ends, after its semicolon."""
    if re.match(r"\s*EXECUTE\s+(BEGIN|DECLARE)\b", text[at:], re.I):
        m = re.compile(r"END-EXEC\s*;?", re.I).search(text, at)
        return m.end() if m else len(text)
    quote = ""
    for k in range(at, len(text)):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == ";":
            return k + 1
    return len(text)


class _Embedded:
    """What embedded statements mean as procedural code; cursors and prepared statements are remembered until they are used."""

    def __init__(self):
        self.cursors: dict[str, str] = {}
        self.prepared: dict[str, str] = {}

    def code(self, sql: str) -> str | None:
        block = re.match(r"\s*EXECUTE\s+(?=BEGIN\b|DECLARE\b)", sql, re.I)
        if block:
            return _flat(_binds(re.sub(r"\s*END-EXEC\s*;?\s*\Z", "", sql[block.end() :], flags=re.I))).rstrip(";") + ";"
        sql = _flat(sql.rstrip().rstrip(";"))
        sql = re.sub(r"^AT\s+:?\w+\s+", "", sql, flags=re.I)
        sql = re.sub(r"^FOR\s+(:\w+|\d+)\s+(?=INSERT|UPDATE|DELETE|SELECT|MERGE)", "", sql, flags=re.I)
        words = sql.split()
        word, rest = (words[0].upper() if words else ""), sql[len(words[0]) :].strip() if words else ""
        if word in ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE"):
            return _binds(sql) + ";"
        if word == "DECLARE":
            m = re.match(r"(\w+)\s+CURSOR\s+FOR\s+(.*)", rest, re.I)
            if m:
                self.cursors[m[1].upper()] = m[2]
            return None
        if word == "OPEN":
            name = rest.split()[0].upper() if rest else ""
            query = self.cursors.get(name)
            if query is None:
                return None
            if query.split()[0].upper() in ("SELECT", "WITH") or query.startswith("("):
                return f"FOR r_{name} IN ({_binds(query)}) LOOP NULL; END LOOP;"
            return f"EXECUTE IMMEDIATE {self.prepared.get(query.upper(), ':stmt')};"
        if word in ("FETCH", "CLOSE", "SAVEPOINT"):
            return "NULL;"
        if word == "COMMIT":
            return "COMMIT;"
        if word == "ROLLBACK":
            return "NULL;" if "SAVEPOINT" in rest.upper() else "ROLLBACK;"
        if word == "PREPARE":
            m = re.match(r"(\w+)\s+FROM\s+(.*)", rest, re.I)
            if m:
                self.prepared[m[1].upper()] = self._text(m[2])
            return None
        if word == "EXECUTE":
            m = re.match(r"IMMEDIATE\s+(.*)", rest, re.I)
            return f"EXECUTE IMMEDIATE {self._text(m[1])};" if m else f"EXECUTE IMMEDIATE {self.prepared.get(rest.split()[0].upper() if rest else '', ':stmt')};"
        if word == "CALL":
            return _binds(rest) + ";"
        if word in ("TRUNCATE", "DROP", "ALTER", "CREATE", "LOCK"):
            return "EXECUTE IMMEDIATE '" + sql.replace("'", "''") + "';"
        return None

    @staticmethod
    def _text(said: str) -> str:
        said = said.strip()
        return "'" + said[1:-1].replace("'", "''") + "'" if said[:1] == '"' == said[-1:] else _binds(said)


def embedded_unit(text: str, name: str) -> str | None:
    """C with embedded SQL as a package body; None without any embedded statement."""
    pieces = list(_C.finditer(text))
    functions = {m["word"] for i, m in enumerate(pieces) if m["word"] and _defines(pieces, i)}
    out, depth, inside, count, at, known = [], 0, "", 0, 0, _Embedded()
    for i, m in enumerate(pieces):
        if m.start() < at:
            continue
        said = m[0]
        if m["exec"]:
            end = _statement_end(text, m.end())
            code = known.code(text[m.end() : end])
            count += 1
            if code and inside:
                out.append(f" {code} ")
            out.append("\n" * text.count("\n", m.start(), end))
            at = end
            continue
        if said == "{":
            depth += 1
        elif said == "}":
            depth = max(0, depth - 1)
            if depth == 0 and inside:
                out.append(f" NULL; END {inside};")
                inside = ""
        elif m["word"] and depth == 0 and m["word"] in functions and _defines(pieces, i):
            inside = m["word"].upper()
            out.append(f" PROCEDURE {inside} IS BEGIN ")
        elif m["word"] and inside and m["word"] in functions and _after(pieces, i) == "(":
            out.append(f" {m['word'].upper()};")
        out.append("\n" * said.count("\n"))
    if inside:
        out.append(f" NULL; END {inside};")
    if not count:
        return None
    return f"PACKAGE BODY {name} IS{''.join(out).rstrip(chr(10))} END {name};"


def _after(pieces: list, i: int) -> str:
    """The next sign after a word, blanks and comments apart."""
    for m in pieces[i + 1 : i + 60]:
        if not (m["comment"] or m["line"] or m[0].isspace()):
            return m[0]
    return ""


def _defines(pieces: list, i: int) -> bool:
    """Whether the word at i is the name of a function that is defined there: brackets, then a block."""
    if pieces[i]["word"].lower() in _NOT_FUNCTIONS or _after(pieces, i) != "(":
        return False
    depth, k = 0, i + 1
    while k < len(pieces):
        depth += (pieces[k][0] == "(") - (pieces[k][0] == ")")
        if depth == 0 and pieces[k][0] == ")":
            break
        if pieces[k][0] in ("{", ";") and depth == 0:
            return False
        k += 1
    return k < len(pieces) and _after(pieces, k) == "{"


_QUERY = re.compile(r"<query\b([^>]*?)(/?)>(.*?)</query\s*>", re.S | re.I)
_DIRECTIVE = re.compile(r"#(?:\{)?(?:if|elseif|else|end|foreach|set|macro|parse|include|stop|break|evaluate|define)(?:\})?\b\s*(?:\((?:[^()]|\([^()]*\))*\))?", re.I)
_VARIABLE = re.compile(r"\$!?\{?([A-Za-z_][\w.]*)\}?(?:\([^)]*\))?")


def _query_code(raw: str) -> str:
    """The procedural code of a query's text: all branches of templates stay, variables are binds; one in the place of a table makes it dynamic."""
    inner = re.search(r"<(statement|sql)\b[^>]*>(.*?)</\1\s*>", raw, re.S | re.I)
    raw = inner[2] if inner else raw
    raw = re.sub(r"<!\[CDATA\[(.*?)\]\]>", lambda m: html.escape(m[1], quote=False), raw, flags=re.S)
    sql = _DIRECTIVE.sub(" ", html.unescape(re.sub(r"</?[A-Za-z][^>]*>", " ", raw)))
    dynamic = re.search(r"\b(FROM|JOIN|INTO|UPDATE|TABLE)\s+\$", sql, re.I) is not None
    sql = _VARIABLE.sub(lambda m: ":" + m[1].replace(".", "_"), sql)
    sql = re.sub(r"(?<![\w:])\?", ":p", _flat(re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S))).rstrip("; ")
    call = re.match(r"\{\s*(?:\?\s*=\s*|:p\s*=\s*)?call\s+(.*?)\s*\}?$", sql, re.I)
    more = " EXECUTE IMMEDIATE :dynamic_sql;" if dynamic else ""
    word = sql.split("(")[0].split()[0].upper() if sql.split("(")[0].split() else ""
    if call:
        return _binds(call[1]) + ";" + more
    if word in ("SELECT", "WITH"):
        return f"FOR r_q IN ({_binds(sql)}) LOOP NULL; END LOOP;{more}"
    if word in ("INSERT", "UPDATE", "DELETE", "MERGE", "BEGIN", "DECLARE"):
        return f"{_binds(sql)};{more}"
    if word == "CALL":
        return f"{_binds(sql[4:].strip())};{more}"
    if word in ("TRUNCATE", "DROP", "ALTER", "CREATE", "LOCK"):
        return "EXECUTE IMMEDIATE '" + sql.replace("'", "''") + "';" + more
    return more.strip()


def queries_unit(text: str, name: str) -> str | None:
    """An XML file of queries as a package body of one procedure for each id; None without queries."""
    text = re.sub(r"<!--.*?-->", lambda m: "\n" * m[0].count("\n"), text, flags=re.S)
    out, at = [], 0
    for m in _QUERY.finditer(text):
        ident = re.search(r"""\bid\s*=\s*(?:"([^"]*)"|'([^']*)')""", m[1])
        code = _query_code(m[3]) if ident and not m[2] else ""
        if not code:
            continue
        proc = re.sub(r"\W", "_", (ident[1] or ident[2] or "")).upper()
        out.append("\n" * text.count("\n", at, m.start()) + f" PROCEDURE {proc} IS BEGIN {code} END {proc}; " + "\n" * m[0].count("\n"))
        at = m.end()
    if not out:
        return None
    return f"PACKAGE BODY {name} IS{''.join(out).rstrip(chr(10))} END {name};"


def units_of_file(path: str, raw: bytes, owner: str) -> list[tuple[str, str, str, str]]:
    name = path.rsplit("/", 1)[-1]
    stem, _, suffix = name.rpartition(".")
    suffix, text = suffix.lower(), decode(raw)
    unit = re.sub(r"\W", "_", stem).upper()
    if suffix in C_FILES or suffix in XML_FILES:
        body = (embedded_unit if suffix in C_FILES else queries_unit)(text, unit)
        return [(owner.upper(), unit, "PROC_BODY" if suffix in C_FILES else "XML_BODY", body)] if body else []
    return units_of_script(text, owner) if suffix in SQL_FILES else []


def read_units(spark: SparkSession, path: str, owner: str) -> DataFrame:
    """(owner, name, unit_type, text, file, spec) of all units below a folder: of a unit that occurs twice the last, in the order of files; `spec` is the text of
    the head of a package or type whose body this is.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kinds = "|".join((*SQL_FILES, *C_FILES, *XML_FILES))
    files = files.filter(F.lower("path").rlike(rf"\.({kinds})$")).select("path", "content")

    def run(batches):
        for batch in batches:
            rows = [(*u, p, k) for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, u in enumerate(units_of_file(p, raw, owner))]
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in rows], schema=_SCHEMA)

    found = files.mapInArrow(run, UNITS)
    last = found.groupBy("owner", "name", "unit_type").agg(F.max_by(F.struct("text", "file"), F.struct("file", "place")).alias("u")).select("owner", "name", "unit_type", "u.text", "u.file")
    specs = last.filter("unit_type IN ('PACKAGE', 'TYPE')").select("owner", "name", F.concat("unit_type", F.lit(" BODY")).alias("unit_type"), F.col("text").alias("spec"))
    bodies = last.filter(F.col("unit_type").isin(*BODIES, "PROC_BODY", "XML_BODY"))
    return bodies.join(specs, ["owner", "name", "unit_type"], "left")
