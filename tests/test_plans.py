"""Lexer, script splitting, facts, rewriting, and text formats."""

import pytest

from tessera.plans import code_facts, lexer, rewrite, statements
from tessera.sources import text_io


def test_strings_and_comments_hide_separators():
    text = "SELECT 'a;b' /* ; */ FROM t; -- ;\nSELECT q'[it's; fine]' FROM u;"
    assert [s for s, _, _ in lexer.split_script(text)] == ["SELECT 'a;b' /* ; */ FROM t", "SELECT q'[it's; fine]' FROM u"]


def test_blocks_end_at_a_lone_slash():
    text = "BEGIN\n a := 1; b := 4 / 2;\nEND;\n/\nDELETE FROM t;"
    found = lexer.split_script(text)
    assert [(k, line) for _, k, line in found] == [("block", 1), ("dml", 5)]


def test_tool_lines_stand_alone():
    assert lexer.split_script("set echo on\nSELECT 1 FROM dual;")[0] == ("set echo on", "tool", 1)


@pytest.mark.parametrize(("text", "kind"), [("with a as (select 1) select * from a", "query"), ("merge into t using s on (1=1)", "dml"), ("create table t (a int)", "ddl"), ("alter system kill session '1'", "admin"), ("", "empty"), ("commit", "transaction")])
def test_kinds(text, kind):
    assert lexer.classify(text) == kind


def test_guards():
    assert lexer.is_read_only("SELECT 1") and not lexer.is_read_only("SELECT * FROM t FOR UPDATE") and not lexer.is_read_only("DELETE FROM t")
    assert lexer.risks("DELETE FROM t") == ["delete_without_where"] and lexer.risks("UPDATE t SET a = 1 WHERE b = 2") == []
    assert lexer.binds("SELECT :a, ':b', :NEW.x, :a FROM t WHERE c = :c") == ["A", "C"]


def test_facts_of_a_unit():
    text = """CREATE OR REPLACE PACKAGE BODY p IS
  PROCEDURE run(x NUMBER) IS
  BEGIN
    WITH w AS (SELECT 1 FROM src) SELECT a INTO b FROM w, other o WHERE EXTRACT(YEAR FROM d) = 1;
    MERGE INTO target t USING feed f ON (t.id = f.id) WHEN MATCHED THEN UPDATE SET a = 1;
    helper(x);
    DELETE FROM old_rows;
  END;
END;"""
    facts = list(code_facts.extract("P", text))
    tables = {(w, op) for _, _, fact, w, op, _ in facts if fact == "table"}
    assert tables == {("SRC", "R"), ("OTHER", "R"), ("TARGET", "C"), ("TARGET", "U"), ("FEED", "R"), ("OLD_ROWS", "D")}
    assert ("HELPER", "RUN") in {(w, path) for _, path, fact, w, _, _ in facts if fact == "call"}


def test_rewrites():
    assert rewrite.to_spark("SELECT LNNVL(a = 1) FROM t") == "SELECT (coalesce(NOT (a = 1), true)) FROM t"
    assert rewrite.to_spark("SELECT * FROM (SELECT a FROM t) WHERE ROWNUM < 5") == "SELECT * FROM (SELECT a FROM t) LIMIT 4"
    assert "LEFT JOIN b ON a.id = b.id" in rewrite.to_spark("SELECT a.x FROM a, b WHERE a.id = b.id(+) AND a.x > 1")
    assert rewrite.to_spark("SELECT 'NVL2(a, b, c)' FROM t") == "SELECT 'NVL2(a, b, c)' FROM t"


def test_copied_ranges():
    assert text_io.parse_tsv('a\t"b\tc"\r\n"d ""e"""\tf\n') == [["a", "b\tc"], ['d "e"', "f"]]
    assert text_io.parse_tsv('"open\tx') == [['"open', "x"]]


def test_delimiter():
    assert text_io.sniff_delimiter(['a;b;"x,y,z,w,v"', "1;2;3"]) == ";"


def test_read_delimited(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id;name\n1;"a;b"\n\n;\n2\n')
    df = text_io.read_delimited(spark, str(tmp_path / "x.csv"))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "a;b"), ("2", None)]


def test_column_writers():
    text = """INSERT INTO a (x, y) VALUES (1, 2);
INSERT INTO b SELECT * FROM a;
UPDATE c t SET t.p = CASE WHEN 1 = 1 THEN 2 ELSE 3 END, (q, r) = (SELECT m, n FROM d WHERE m = 1) WHERE p = 3;
MERGE INTO e USING a ON (e.k = a.x) WHEN MATCHED THEN UPDATE SET v = f(a.x, 1), w = 2 WHEN NOT MATCHED THEN INSERT (k, v) VALUES (a.x, 1);
INSERT ALL WHEN x > 1 THEN INTO g (s) VALUES (x) ELSE INTO h (u) VALUES (y) SELECT x, y FROM a;
SELECT z INTO v_z FROM a FOR UPDATE OF z;"""
    found = [r[1:4] for r in statements.column_writers("P", text)]
    assert found == [
        ("A", "X", "insert"), ("A", "Y", "insert"), ("B", "*", "insert"), ("C", "P", "update"), ("C", "Q", "update"), ("C", "R", "update"),
        ("E", "V", "merge_update"), ("E", "W", "merge_update"), ("E", "K", "merge_insert"), ("E", "V", "merge_insert"), ("G", "S", "insert"), ("H", "U", "insert"),
    ]
    assert statements.column_writers("P", "") == []


def test_triggers_and_tables():
    assert statements.trigger_target("CREATE TRIGGER t BEFORE UPDATE OF a OR INSERT ON own.tab FOR EACH ROW BEGIN NULL; END;") == ("OWN.TAB", ["INSERT", "UPDATE"])
    assert statements.trigger_target("SELECT 1 FROM dual") == ("", [])
    assert statements.referenced_tables("SELECT * FROM a JOIN b.c ON 1 = 1 WHERE x IN (SELECT y FROM a)") == ["A", "B.C"]


def test_dynamic_sql():
    text = "BEGIN EXECUTE IMMEDIATE 'delete from logs where d < ' || v_day; EXECUTE IMMEDIATE v_any; OPEN c FOR q'[select 'x' from feed]'; END;"
    assert [s for s, _ in statements.dynamic_statements(text)] == ["delete from logs where d < ?", "select 'x' from feed"]
    assert [r[1:3] for r in statements.dynamic_tables("P", text)] == [("LOGS", "D"), ("FEED", "R")]


def test_outline():
    assert statements.outline("SELECT a\nFROM (SELECT b FROM t)\nWHERE a = 1") == [("SELECT", 0, 1), ("FROM", 0, 2), ("SELECT", 1, 2), ("FROM", 1, 2), ("WHERE", 0, 3)]


@pytest.mark.parametrize("text", ["", "x", "BEGIN\n" + "IF a THEN\n b;\nEND IF;\n" * 150 + "END;", "y" * 9000 + "\nz", "if\n" * 3000])
def test_chunks_cover_the_text(text):
    found, lines = statements.chunks(text), text.split("\n")
    assert [a for a, _ in found] == [1, *[b + 1 for _, b in found[:-1]]] and found[-1][1] == len(lines)
    for a, b in found:
        assert a == b or b - a + 1 <= 150 and sum(map(len, lines[a - 1 : b])) + b - a <= 7500


def test_chunks_are_cut_between_statements():
    text = "BEGIN\n" + "IF a THEN\n b;\nEND IF;\n" * 150 + "END;"
    assert all(text.split("\n")[b - 1].startswith("END") for _, b in statements.chunks(text))


def test_finished_pieces_are_left_out(spark):
    pieces = statements.chunked(spark.createDataFrame([("a", "x\ny"), ("b", None)], "unit string, text string"))
    assert [tuple(r)[:4] for r in pieces.orderBy("unit").collect()] == [("a", 0, 1, 2), ("b", 0, 1, 1)]
    none = spark.createDataFrame([], "key string")
    first = statements.unfinished(pieces, none, "m1")
    assert first.count() == 2 and statements.unfinished(pieces, first, "m1").count() == 0 and statements.unfinished(pieces, first, "m2").count() == 2


def test_same_value(spark):
    rows = [("a ", "a", True), ("1.0", "1", True), (None, "", True), ("a", "b", False), ("1", None, False), ("1", "1.1", False)]
    df = spark.createDataFrame(rows, "a string, b string, same boolean")
    from pyspark.sql import functions as F

    assert df.filter(statements.same_value(F.col("a"), F.col("b")) != F.col("same")).count() == 0
