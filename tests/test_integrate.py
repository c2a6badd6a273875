"""The graph of many units, on a small code base with known answers."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, integrate

BODY = "PACKAGE BODY"
KEY = "owner string, unit string, unit_type string, path string"


@pytest.fixture(scope="module")
def code(spark):
    subs = spark.createDataFrame(
        [
            ("A", "P", BODY, "RUN", "PROCEDURE", "run", 1, 10, True, 3, False, False), ("A", "P", BODY, "RUN", "PROCEDURE", "run(x)", 11, 12, None, 5, True, False),
            ("A", "P", BODY, "STEP", "PROCEDURE", "step", 20, 29, False, 1, False, False), ("A", "P", BODY, "DEAD", "PROCEDURE", "dead", 30, 31, False, 1, False, False),
            ("A", "LOAD", "PROCEDURE", "LOAD", "PROCEDURE", "load", 1, 5, None, 2, True, False), ("A", "T1", "TRIGGER", "T1", "TRIGGER", "t1", 1, 3, None, 1, False, False),
        ],
        KEY + ", kind string, signature string, start_line int, end_line int, public boolean, complexity int, commits boolean, autonomous boolean",
    )
    calls = spark.createDataFrame([("A", "P", BODY, "RUN", "STEP", 5), ("A", "P", BODY, "RUN", "STEP", 3), ("A", "P", BODY, "RUN", "STEP", 5), ("A", "P", BODY, "STEP", "LOAD", 21), ("A", "LOAD", "PROCEDURE", "LOAD", "UTL_FILE.PUT", 2), ("A", "P", BODY, "STEP", "STEP", 25)], KEY + ", callee string, line int")
    use = spark.createDataFrame([("A", "P", BODY, "RUN", "SRC", "R", 2), ("A", "P", BODY, "STEP", "DST", "U", 22), ("A", "P", BODY, "STEP", "DST", "C", 23), ("A", "LOAD", "PROCEDURE", "LOAD", "B.LOG", "C", 3), ("A", "LOAD", "PROCEDURE", "LOAD", "SYN", "R", 3), ("A", "LOAD", "PROCEDURE", "LOAD", "X@FAR", "R", 3)], KEY + ", table_name string, op string, line int")
    return subs, calls, use


def got(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_nodes_edges_entries(spark, code):
    subs, calls, _ = code
    of = integrate.nodes(subs)
    assert got(of.filter("node = 'A.P.RUN'"), "overloads", "complexity", "lines", "commits", "public", "signature") == [(2, 5, 12, True, True, "run")]
    edges = integrate.call_edges(calls, subs)
    assert got(edges) == sorted([("A.P.RUN", "A.P.STEP", True, None, [3, 5]), ("A.P.STEP", "A.LOAD", True, None, [21]), ("A.P.STEP", "A.P.STEP", True, None, [25]), ("A.LOAD", "UTL_FILE.PUT", False, "system", [2])], key=str)
    alone = integrate.entries_and_unused(of, edges)
    assert got(alone) == sorted([("A.P.RUN", True, False), ("A.P.DEAD", False, True), ("A.T1", True, False)], key=str)
    entries = alone.filter("entry")
    assert got(integrate.commit_reach(of, edges, entries)) == [("A.P.RUN", ["A.LOAD", "A.P.RUN"])]
    parts = spark.createDataFrame([("u", 1, [3, 1], 4, ["b"]), ("u", 0, [1, 2], 2, ["a"])], "unit string, part int, lines array<int>, complexity int, statements array<string>")
    assert got(integrate.merged_facts(parts, ["unit"])) == [("u", [1, 2, 3], 5, ["a", "b"])]


def test_tables_and_dictionary(spark, code):
    subs, calls, use = code
    deps = spark.createDataFrame([("A", "LOAD", "PROCEDURE", "B.REAL", "TABLE", "PUBLIC.SYN", None), ("A", "LOAD", "PROCEDURE", "B.LOG", "TABLE", None, None), ("A", "LOAD", "PROCEDURE", "B.MORE", "VIEW", None, None), ("A", "LOAD", "PROCEDURE", "B.PKG", "PACKAGE", None, None)], "owner string, unit string, unit_type string, name string, kind string, via string, link string")
    uses = integrate.table_uses(use, deps)
    assert got(uses) == sorted([("A.SRC", "A.P.RUN", "R"), ("A.DST", "A.P.STEP", "CU"), ("B.LOG", "A.LOAD", "C"), ("B.REAL", "A.LOAD", "R"), ("A.X@FAR", "A.LOAD", "R")], key=str)
    real = use.withColumn("table_name", F.when(F.col("table_name") == "SYN", "B.REAL").otherwise(F.col("table_name")))
    found = integrate.reconciled(real, deps)
    assert got(found, "table_name", "found") == sorted([("B.LOG", "both"), ("B.REAL", "both"), ("B.MORE", "dict_only")], key=str)
    assert got(integrate.dictionary_stats(found)) == [(2, 1, 0)] and got(integrate.unusable(use, deps), "unit") == [("P",)]
    assert got(found.select(integrate.confidence(F.col("found")).alias("c")).distinct()) == [("dict",), ("ok",)]
    edges = integrate.call_edges(calls, subs)
    pairs = graph.impacted(integrate.steps(edges), integrate.nodes(subs).select("node"), uses.select("table_name", "node", F.substring("ops", 1, 1).alias("op")))
    screen = {r.table_name: (r.entries, r.total) for r in integrate.for_screen(pairs, 2).collect()}
    assert screen == {"A.DST": (["A.P.RUN", "A.P.STEP"], 2), "B.LOG": (["A.LOAD", "A.P.RUN"], 3)}
    flows = spark.createDataFrame([("A.P.RUN", "A", "c", ["SRC", "DST"], "DST", "C", 3, "record r"), ("A.P.RUN", "A", "c", ["B.Z"], "DST", "C", 3, "x")], "node string, owner string, cursor string, src_tables array<string>, dst_table string, ops string, line int, via string")
    feeds = integrate.lineage_edges(flows)
    assert got(feeds) == [("A.SRC", "A.DST"), ("B.Z", "A.DST")]
    fed = integrate.fed_tables(feeds)
    assert got(fed.filter("table_name = 'A.DST'")) == [("A.DST", ["A.SRC", "B.Z"], [])]
    (row,) = integrate.table_report("dst", uses, fed, pairs).collect()
    assert (row.table_name, [tuple(u) for u in row.used_by], row.fed_from, row.total) == ("A.DST", [("A.P.STEP", "CU")], ["A.SRC", "B.Z"], 2)
    (row,) = integrate.relations("p.step", integrate.nodes(subs), edges, uses, integrate.entries_and_unused(integrate.nodes(subs), edges)).collect()
    assert ([r.src for r in row.called_by], [r.dst for r in row.calls], row.tables, row.is_entry) == (["A.P.RUN", "A.P.STEP"], ["A.LOAD", "A.P.STEP"], ["A.DST(CU)"], False)


def test_findings_statements_writers(spark, code):
    subs, calls, _ = code
    edges = integrate.call_edges(calls, subs)
    marks = spark.createDataFrame([("A.P.RUN", 4, "swallowed"), ("A.P.RUN", 6, "dynamic"), ("A.P.RUN", 7, "raise")], "node string, line int, kind string")
    found = integrate.findings(marks, spark.createDataFrame([("A.P", "no end")], "node string, message string"), edges)
    assert got(found, "node", "line", "kind") == sorted([("A.P.RUN", 4, "swallowed"), ("A.P.RUN", 6, "dynamic"), ("A.P", None, "structure"), ("A.P.STEP", None, "cycle")], key=str)
    assert got(integrate.counts_by_kind(found)) == [("cycle", 1), ("dynamic", 1), ("structure", 1), ("swallowed", 1)]
    said = spark.createDataFrame([("A.P.RUN", 9, "x"), ("A.P.RUN", 2, "y"), ("A.P.STEP", 1, "z")], "node string, line int, text string")
    assert [r.text for r in integrate.statements_of(said, "p.run").collect()] == ["y", "x"] and integrate.statements_of(said, "P").count() == 3
    writers = spark.createDataFrame([("U", "A.DST", "X", "insert", 3), ("U", "DST", "*", "insert", 5), ("U", "B.DST", "X", "update", 7)], "unit string, table_name string, column_name string, via string, line int")
    flows = spark.createDataFrame([("U", "c", "A.DST", 3, "record r")], "unit string, cursor string, dst_table string, line int, via string")
    cursors = spark.createDataFrame([("U", "c", "SELECT 1 FROM s")], "unit string, cursor string, query string")
    assert got(integrate.writers_and_cursors(writers, flows, cursors, "a.dst", "x")) == sorted([("U", 3, "insert", "set", "c", "record r", "SELECT 1 FROM s"), ("U", 5, "insert", "all", None, None, None)], key=str)
    text = integrate.report(integrate.nodes(subs), edges, integrate.table_uses(code[2]), found, most=1)
    assert "- cycle: 1" in text and text.count("-->") == 1 and "Only the first 1 calls" in text


def test_diagrams(spark, code):
    subs, calls, use = code
    of, edges = integrate.nodes(subs), integrate.call_edges(calls, subs)
    uses = integrate.table_uses(use).withColumn("conf", F.when(F.col("table_name") == "A.DST", "dict"))
    feeds = spark.createDataFrame([("A.SRC", "A.DST")], "src string, dst string")
    triggers = spark.createDataFrame([("A.T1", "A.DST", "INSERT,UPDATE")], "node string, trigger_on string, events string")
    boxes, lines = integrate.diagram(of, uses, edges, feeds, triggers)
    flat = got(lines, "s", "t", "kind", "label", "guess")
    assert ("A.P.STEP", "A.DST", "write", "C,U", True) in flat and ("A.SRC", "A.P.RUN", "read", "R", False) in flat and ("A.DST", "A.T1", "trig", "INSERT,UPDATE", False) in flat and ("A.SRC", "A.DST", "flow", "", False) in flat
    assert {r.id: r.type for r in boxes.collect()}["A.T1"] == "trig" and ("A.P.RUN", "A.P.STEP", "call", "", False) in flat and len(flat) == 9
    packed, merged = integrate.diagram(of, uses, edges, feeds, triggers, by_package=True)
    assert ("A.P", "A.LOAD", "call") in got(merged, "s", "t", "kind") and {"A.P", "A.LOAD", "A.T1"} == {r.id for r in packed.filter("type <> 'table'").collect()}
    near, between = integrate.view(boxes, lines, "A.DST", 1)
    assert {r.id for r in near.filter("NOT copy").collect()} == {"A.DST", "A.P.STEP", "A.T1", "A.SRC"}
    assert {(r.id, r.lane, r.copy) for r in near.filter("type = 'table'").collect()} == {("A.DST", 2, False), ("A.DST@in", 0, True), ("A.SRC", 0, False)}
    assert {r.id for r in near.filter("more").collect()} == {"A.P.STEP", "A.SRC"} and ("A.DST@in", "A.T1", "trig") in got(between, "s", "t", "kind")
    up, _ = integrate.view(boxes, lines, "A.DST", 1, direction="up", calls=False, flows=False)
    assert {r.id for r in up.collect()} == {"A.DST", "A.P.STEP"}
    everything, _ = integrate.view(boxes, lines, hidden=("A.DST",))
    assert "A.DST" not in {r.id for r in everything.collect()}


def test_names(spark):
    df = spark.createDataFrame([("A.T",), ("T",), ("B.T",), ("A.T@L",), ("A.XT",)], "n string")
    assert got(df.filter(integrate.is_table(F.col("n"), "a.t"))) == [("A.T",), ("A.T@L",), ("T",)]
    assert got(df.filter(integrate.ends_with(F.col("n"), "t"))) == [("A.T",), ("B.T",), ("T",)]
    assert got(df.select(integrate.qualified(F.lit("O"), F.col("n")).alias("x"))) == [("A.T",), ("A.T@L",), ("A.XT",), ("B.T",), ("O.T",)]
