"""Statements at a place, subprograms, registered functions, sessions, streams, and the rest of the workbench."""

import datetime

from pyspark.sql import functions as F

from tessera.functions import registered
from tessera.operators import catalog, sessions
from tessera.plans import code_facts, lexer
from tessera.sources import history
from tessera.streaming import logs, windows
from tessera.workbench import Workbench

UNIT = """PACKAGE BODY p IS
  FUNCTION f(a NUMBER) RETURN NUMBER IS
    PROCEDURE inner IS BEGIN NULL; END;
  BEGIN
    IF a = 1 THEN inner; END IF;
    RETURN seq.NEXTVAL;
  EXCEPTION
    WHEN NO_DATA_FOUND OR pkg.e_bad THEN NULL;
    WHEN OTHERS THEN RAISE;
  END f;
  FUNCTION f RETURN NUMBER IS
  BEGIN
    INSERT INTO t@far VALUES (1);
    RETURN 2;
  END;
END;"""


def test_statements_at_a_place():
    text = "SELECT 1 FROM a;\nSELECT 2\nFROM b\n\nSELECT 3 FROM c;\nBEGIN\n x;\n\n y;\nEND;\n/\n"
    at = lambda s: lexer.statement_at(text, text.index(s))
    assert [at("1"), at("b"), at("3")] == ["SELECT 1 FROM a", "SELECT 2\nFROM b", "SELECT 3 FROM c"] and at("y;").startswith("BEGIN") and lexer.statement_at("", 0) == ""
    assert lexer.production_risks("DELETE FROM t") == ["changes rows", "delete_without_where"] and lexer.production_risks("SELECT 1 FROM t FOR UPDATE") == ["locks rows"] and lexer.production_risks("SELECT 1") == []


def test_subprograms_and_their_facts():
    got = code_facts.subprograms(UNIT, "PACKAGE p IS FUNCTION f RETURN NUMBER; END;")
    assert [(s.path, s.start_line, s.end_line, s.overload, s.public) for s in got] == [("F", 2, 10, 1, True), ("F.INNER", 3, 3, 1, None), ("F", 11, 15, 2, True)]
    assert got[0].signature == "FUNCTION f(a NUMBER) RETURN NUMBER" and code_facts.subprograms("PROCEDURE x IS BEGIN y;")[0].end_line == 1
    assert code_facts.wrapped("PACKAGE BODY p wrapped\na000000\n") and code_facts.subprograms("PACKAGE BODY p wrapped\nPROCEDURE x IS BEGIN NULL; END;") == []
    facts = {(f, w) for _, _, f, w, _, _ in code_facts.extract("P", UNIT)}
    assert {("sequence", "SEQ"), ("handler", "NO_DATA_FOUND"), ("handler", "PKG.E_BAD"), ("handler", "OTHERS"), ("table", "T@FAR")} <= facts


def test_functions_of_sql(spark):
    registered.register(spark)
    spark.createDataFrame([("u", "SELECT 1 FROM a; DELETE FROM b;"), ("v", None)], "unit string, text string").createOrReplaceTempView("code_units")
    assert [tuple(r) for r in spark.sql("SELECT sql_kind('DELETE FROM t'), sql_read_only('SELECT 1'), sql_risks('DROP TABLE t'), sql_binds('SELECT :a')").collect()] == [("dml", True, ["drop"], ["A"])]
    got = spark.sql("SELECT u.unit, s.statement, s.kind FROM code_units u, LATERAL split_script(u.text) s ORDER BY s.line, s.kind").collect()
    assert [(r.unit, r.kind) for r in got] == [("u", "dml"), ("u", "query")]
    assert {(r.what, r.op) for r in spark.sql("SELECT f.what, f.op FROM code_units u, LATERAL code_facts(u.unit, u.text) f WHERE f.fact = 'table'").collect()} == {("A", "R"), ("B", "D")}


def test_sessions(spark):
    s = spark.createDataFrame([(1, "ACTIVE", 5, None), (2, "INACTIVE", 90, None), (3, "ACTIVE", 7, 1), (4, "ACTIVE", 8, 3), (5, "ACTIVE", 1, 6), (6, "ACTIVE", 2, 5)], "sid int, status string, idle_s int, blocked_by int")
    assert [r.sid for r in sessions.by_urgency(s).collect()] == [4, 3, 6, 5, 1, 2]
    assert [tuple(r) for r in sessions.blockers(s).collect()] == [(1, 2, 8)] and sorted(tuple(r) for r in sessions.deadlocks(s).collect()) == [(5, 5), (6, 5)]


def test_streams(spark, tmp_path):
    t = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    rows = [(t(1), "p", "u", "a", "query", 1, 1, None), (t(1, 5), "p", "u", "b", "dml", 1, 1, "x"), (t(9), "p", "u", "c", "query", 1, 1, None)]
    kind = "t timestamp, profile string, user string, sql string, kind string, ms bigint, rows bigint, error string"
    history.append(spark.createDataFrame(rows, kind), str(tmp_path / "h"))
    history.append(spark.createDataFrame(rows[:1], kind), str(tmp_path / "h"))
    counts = logs.counts_by_window(logs.history_stream(spark, str(tmp_path / "h")), keys=())
    logs.follow(counts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = [(r.window_start.hour, r.n, r.failed) for r in spark.read.schema("window_start timestamp, n bigint, failed bigint").parquet(str(tmp_path / "out")).collect()]
    assert got == [(1, 2, 1)]  # the last window is still open
    done = []
    (tmp_path / "units").mkdir()
    spark.createDataFrame([("u", "x"), ("v", "x"), ("w", "y")], "unit string, text string").write.mode("append").json(str(tmp_path / "units"))
    units = spark.readStream.schema("unit string, text string").json(str(tmp_path / "units"))
    known = lambda: spark.createDataFrame([(h,) for h in done], "hash string") if done else spark.createDataFrame([], "hash string")
    for _ in range(2):
        logs.reanalyse(units, str(tmp_path / "cp2"), known, lambda df: done.extend(r.hash for r in df.collect())).awaitTermination(120)
        spark.createDataFrame([("z", "x")], "unit string, text string").write.mode("append").json(str(tmp_path / "units"))
    assert len(done) == 2
    events = spark.createDataFrame([("a", t(1)), ("a", t(1, 20)), ("a", t(3)), ("b", t(1))], "k string, ts timestamp")
    assert sorted((r.k, r.n) for r in windows.sessions(events, "ts", "30 minutes", ["k"]).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_the_rest_of_the_workbench(spark, tmp_path):
    spark.range(20).selectExpr("cast(id AS int) AS r_regionkey", "'x' AS r_name").write.parquet(str(tmp_path / "region.parquet"))
    w = Workbench(spark, str(tmp_path))
    assert w.count("SELECT * FROM {region} WHERE r_regionkey > 4") == 15 and w.load("SELECT * FROM {region}", 5)[1] and len(list(w.stream("SELECT * FROM {region}"))) == 20
    w.attach("far_away", spark.range(3))
    assert w.beside(str(tmp_path)).sql("SELECT count(*) AS n FROM far_away").first().n == 3
    w.cancel()
    tagged = catalog.tagged({"a": spark.range(1), "b": spark.createDataFrame([("x",)], "n string")})
    assert sorted(map(tuple, tagged.collect()), key=str) == [("a", 0, None), ("b", None, "x")]
    usage = catalog.folder_usage(spark, str(tmp_path))
    assert usage.agg(F.round(F.sum("share"), 6)).first()[0] == 1.0
    cols = catalog.columns_of(spark, {"region": w.table("region")})
    assert [tuple(r) for r in catalog.unknown_columns("SELECT r.r_name, r.bad, region.r_name AS made, x.made FROM region r", cols).collect()] == [("R", "BAD")]


def test_answers(spark):
    from tessera.operators import answers

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(answers.share_of(F.lit("한글 abc"), r"\p{IsHangul}")) == 0.4 and one(answers.share_of(F.lit("12"), r"\p{L}")) is None
    assert one(answers.names_in(F.lit("uses ORD_ITEMS and P.RUN_IT, not Plain, ORD_ITEMS"))) == ["ORD_ITEMS", "P.RUN_IT"]
    said = spark.createDataFrame([("u", "reads ORD_ITEMS via PKG.RUN"), ("v", "PKG.RUN")], "unit string, text string")
    known = spark.createDataFrame([("u", "pkg"), ("u", "run"), ("v", "pkg")], "unit string, word string")
    found = answers.ungrounded(said, known)
    assert sorted(map(tuple, found.collect())) == [("u", "ORD_ITEMS"), ("v", "PKG.RUN")] and answers.most_ungrounded(found, 1).first().name == "ORD_ITEMS"
    code = spark.createDataFrame([("u", "select a, b from t\n  where a = 1 and b = 2\nupdate t set x = 1\n;")], "unit string, text string")
    copy = spark.createDataFrame([("u", "It does: select  a, b from t\nselect a, b from t\nwhere a = 1 and b = 2\nupdate t set x = 1")], "unit string, text string")
    assert [tuple(r) for r in answers.copies_code(copy, code).collect()] == [("u", 3)]
    assert answers.worst(spark.createDataFrame([("a", 1), ("b", 3)], "unit string, weight int"), 1).first().unit == "b"


def test_snapshots_of_all_kinds(spark):
    a = catalog.columns_of(spark, {"t": spark.createDataFrame([], "k int, v string")})
    keys = spark.createDataFrame([("t", "k", 1)], "table_name string, column_name string, position int")
    mine = catalog.constraints(a.withColumn("nullable", F.col("column_name") == "k"), keys, spark.createDataFrame([("t", "v", 1), ("t", "k", 2)], keys.schema))
    assert sorted(r.definition for r in mine.collect()) == ["PRIMARY KEY (K)", "UNIQUE (V, K)", "V IS NOT NULL"]
    got = catalog.compare_all({"column": a, "constraint": mine.withColumn("enabled", F.lit(True))}, {"column": a.filter("column_name = 'k'")}, {"column": ["table_name", "column_name"], "constraint": ["definition"]})
    assert sorted((r.kind, r.object, r.status) for r in got.collect()) == [("column", "t.k", "same"), ("column", "t.v", "a_only"), ("constraint", "PRIMARY KEY (K)", "a_only"), ("constraint", "UNIQUE (V, K)", "a_only"), ("constraint", "V IS NOT NULL", "a_only")]


def test_more_of_the_dialect(spark):
    from tessera.plans.rewrite import to_spark

    one = lambda q: tuple(spark.sql(to_spark(q)).first())
    assert one("""SELECT XMLELEMENT("a", 1, XMLELEMENT(b, '<x>')) AS x, CONVERT('é', 'UTF8') AS c, JSON_EXISTS('{"k": 1}', '$.k') AS j FROM dual""") == ("<a>1<B>&lt;x&gt;</B></a>", "é", True)
    assert one("SELECT XMLAGG(n ORDER BY n DESC) AS x FROM (SELECT 'a' AS n FROM dual UNION ALL SELECT 'b' FROM dual)") == ("ba",)
    assert str(one("SELECT TIMESTAMP '2024-01-01 00:00:00' AT TIME ZONE 'Asia/Seoul' AS t FROM dual")[0]) == "2024-01-01 09:00:00"


def test_commands(spark, tmp_path, capsys):
    import json

    from tessera.__main__ import main

    spark.range(3).selectExpr("cast(id AS int) AS r_regionkey").write.parquet(str(tmp_path / "t" / "region.parquet"))
    folder = str(tmp_path / "t")
    assert main(["sql", folder, "SELECT r_regionkey FROM {region} ORDER BY 1", "--most", "2"], spark) == 0
    said = capsys.readouterr()
    assert [json.loads(x) for x in said.out.splitlines()] == [{"r_regionkey": 0}, {"r_regionkey": 1}] and "more than 2" in said.err
    assert main(["count", folder, "SELECT * FROM {region}"], spark) == 0 and capsys.readouterr().out == "3\n"
    assert main(["check", folder, "SELECT nothing FROM {region}"], spark) == 1 and main(["explain", folder, "SELECT * FROM {region}"], spark) == 0
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "a.sql").write_text("CREATE PROCEDURE p IS BEGIN INSERT INTO t SELECT * FROM s; q; END;\n/\nDELETE FROM t;\n")
    capsys.readouterr()
    assert main(["split", str(tmp_path / "code" / "a.sql")]) == 0
    assert [json.loads(x)["kind"] for x in capsys.readouterr().out.splitlines()] == ["unit", "dml"]
    assert main(["run", str(tmp_path / "code"), str(tmp_path / "b"), "--owner", "me"], spark) == 0
    assert json.loads(capsys.readouterr().out)["units"] == 1
    assert main(["show", str(tmp_path / "b"), "steps"], spark) == 0 and json.loads(capsys.readouterr().out) == {"src": "S", "dst": "T"}
    assert main(["show", str(tmp_path / "b"), "calls"], spark) == 0 and json.loads(capsys.readouterr().out)["dst"] == "Q"
    assert main(["show", str(tmp_path / "b"), "none"], spark) == 2


def test_progress(spark):
    from tessera.streaming import progress

    spark.sparkContext.setJobGroup("counted", "x")
    spark.range(10).repartition(3).count()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    p = progress.of_group(spark, "counted")
    assert 0 < p.done <= p.total and p.failed == 0  # stages whose shuffle was there already do nothing
