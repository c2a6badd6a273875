"""Copies, changes, conditions from values, pasted ranges, catalogs: small cases with defined results."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import catalog, checks, diff, move, predicates, rows, trace
from tessera.plans import edit_sql


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_changes_must_hit_one_row(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "d"), (None, "n")], "k int, v string")
    c = spark.createDataFrame([(1, "x", "update"), (9, "x", "update"), (3, "x", "delete"), (2, "y", "delete"), (2, "z", "insert"), (5, "e", "insert"), (5, "f", "insert"), (None, "m", "update"), (1, "q", "insert")], "k int, v string, op string")
    done, refused = move.apply_changes(t, c, ["k"])
    assert rows_of(done) == rows_of(spark.createDataFrame([(1, "x"), (2, "z"), (3, "c"), (3, "d"), (None, "m")], t.schema))
    assert rows_of(refused.select("k", "op", "reason")) == sorted([(9, "update", "missing"), (3, "delete", "several"), (5, "insert", "twice"), (5, "insert", "twice"), (1, "insert", "exists")], key=str)


def test_copies_are_refused(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "x")], "K int, w string")
    for bad in ({"read_only": True}, {"target_is_table": False}, {"same_table": True}, {"mode": "merge"}, {"mode": "merge", "keys": ["w"]}, {"mode": "other"}, {"picked": ["v"]}):
        with pytest.raises(move.Refused):
            move.plan_copy(a, b, **bad)
    plan = move.plan_copy(a, b, "replace")
    assert plan.copied == ["K"] and plan.replaced_rows == 1 and plan.warnings == ["without a condition all rows of the target are replaced"]
    strict = spark.createDataFrame([], T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("z", T.IntegerType(), False)]))
    assert move.plan_copy(a, strict).warnings == ["z: not null without a value"]
    good, bad = move.copied_rows(spark.createDataFrame([("1",), ("x",), (None,)], "k string"), T.StructType([T.StructField("k", T.IntegerType(), False)]), ["k"])
    assert rows_of(good) == [(1,)] and bad.count() == 2


def test_created_tables_and_sequences(spark):
    kind = T.StructType([T.StructField("k", T.LongType(), False), T.StructField("v", T.StringType())])
    assert move.create_table_sql("t", kind, ["k"]) == "CREATE TABLE t (\n  k bigint NOT NULL,\n  v string\n) USING parquet\nTBLPROPERTIES ('primary_key' = 'k')"
    assert move.create_table_sql("t", kind, ["k"], ["v"]) == "CREATE TABLE t (\n  v string\n) USING parquet"
    n = [r.id for r in move.numbered(spark.range(100).repartition(3).toDF("x"), "id", 7).collect()]
    assert len(set(n)) == 100 and min(n) == 8
    with pytest.raises(move.Refused):
        move.undo_script(spark.createDataFrame([(1, b"x")], "k int, v binary"), "t", ["k"], "update")
    assert move.undo_script(spark.createDataFrame([(1, None), (None, "it's")], "k int, v string"), "t", ["k"], "update").collect()[1].line == "UPDATE t SET v = 'it''s' WHERE k IS NULL;"


def test_multi_table_insert(spark):
    s = spark.range(10)
    every = move.insert_branches(s, [("a", F.col("id") > 3, {"k": F.col("id")}), ("b", F.col("id") > 6, {"k": F.col("id")}), ("a", None, {"k": -F.col("id")})])
    assert every["a"].count() == 6 + 4 and every["b"].count() == 3


def test_conditions_from_values(spark):
    df = spark.createDataFrame([("a%", 1), ("ab", 2), (None, 3), ("x_y", 4)], "t string, n int")
    keep = lambda c: [r.n for r in df.filter(c).orderBy("n").collect()]
    assert keep(predicates.cell_condition("t", None)) == [3] and keep(predicates.cell_condition("t", "%", like=True)) == [1]
    assert keep(predicates.list_condition("t", ["ab", None])) == [2, 3] and keep(predicates.list_condition("t", ["ab"], "notin")) == [1, 3, 4]
    assert keep(predicates.list_condition("t", ["ab", None], "notin")) == [1, 4] and keep(predicates.list_condition("t", [None], "notin")) == [1, 2, 4]
    assert keep(predicates.list_condition("t", ["_", "b", None], "like")) == [2, 3, 4] and keep(predicates.name_like("t", "A_")) == [1, 2]
    text, number, day = T.StringType(), T.DecimalType(), T.TimestampType()
    assert predicates.cell_text("T", "50%", text, like=True) == "T LIKE '%50\\%%' ESCAPE '\\'" and predicates.cell_text("T", None, text) == "T IS NULL"
    assert predicates.list_condition_text("N", ["1", "1", "2", None], number) == "(N IN (1, 2) OR N IS NULL)" and predicates.list_condition_text("N", ["1"], number, "notin") == "(N <> 1 OR N IS NULL)"
    assert predicates.list_condition_text("N", ["1", None], number, "notin") == "N IS NOT NULL AND N <> 1"
    assert predicates.literal_sql("2024-01-02 03:04:05.6 +09:00", day) == "TO_TIMESTAMP_TZ('2024-01-02 03:04:05.6 +09:00', 'YYYY-MM-DD HH24:MI:SS.FF9 TZH:TZM')"
    forms = {f: predicates.list_text("T", ["a", "it's", "a", None], text, f) for f in ("in", "cond", "comma", "quoted", "lines")}
    assert forms == {"in": "('a', 'it''s')", "cond": "(T IN ('a', 'it''s') OR T IS NULL)", "comma": "a,it's", "quoted": "'a','it''s'", "lines": "a\nit's"}
    assert predicates.value_list(df, "t").first().text == "'a%','ab','x_y'"
    for bad in (lambda: predicates.list_text("T", [None], text, "in"), lambda: predicates.cell_text("N", "1", number, like=True), lambda: predicates.literal_sql("soon", day), lambda: predicates.list_condition("t", [])):
        with pytest.raises(predicates.NoCondition):
            bad()


def test_pasted_ranges(spark):
    cells = spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "r int, c int, v string")
    put, cut_rows, cut_cols = rows.paste(cells, 1, 2, (2, 3, 0, 3), 10, 10)
    assert (cut_rows, cut_cols) == (0, 0) and rows_of(put) == sorted([(r, c, "ab"[c % 2]) for r in (2, 3) for c in range(4)], key=str)
    put, cut_rows, cut_cols = rows.paste(cells, 1, 2, (9, 9, 9, 9), 10, 10)
    assert (cut_rows, cut_cols) == (0, 1) and rows_of(put) == [(9, 9, "a")]
    one = rows.paste(cells.filter("c = 0"), 1, 1, (0, 1, 0, 2), 10, 10)[0]
    assert one.count() == 6
    fill = rows.fill_cells(spark.createDataFrame([(1, 0, "x"), (2, 0, "y"), (4, 0, None), (3, 1, "z")], "r int, c int, v string"))
    assert rows_of(fill) == [(2, 0, "x"), (4, 0, "x")]


def test_sorts_and_names(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "A"), (4, "é")], "p int, t string")
    assert [r.p for r in rows.sorted_by(df, {"t": "desc"}, ["p"]).collect()] == [4, 1, 3, 2] and rows.SORT_CYCLE["desc"] is None
    assert [r.p for r in df.orderBy(rows.text_order("t").asc_nulls_last()).collect()] == [3, 1, 4, 2]
    names = spark.createDataFrame([("ORDERS",), ("ORDER_ITEMS",), ("MY_ORDERS",), ("REORDER",), ("X",)], "n string")
    assert [(r.n, r.score) for r in rows.top_names(names, "n", "orders", 9).collect()] == [("ORDERS", 1100), ("MY_ORDERS", 600)]


def test_differences(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n"), (4, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "a"), (2, "d"), (None, "n"), (5, "e")], "k int, v string")
    got = rows_of(diff.diff_rows(a, b, ["k"]).select("status", "k", "ordinal", "changed"))
    assert got == sorted([("same", 1, 1, []), ("del", 1, 2, []), ("chg", 2, 1, ["v"]), ("same", None, 1, []), ("del", 4, 1, []), ("add", 5, 1, [])], key=str)
    assert rows_of(diff.diff_counts(diff.diff_rows(a, b))) == sorted([("same", 2), ("del", 3), ("add", 2)], key=str)
    assert diff.choose_key(a, b) is None or diff.choose_key(a, b) == ["k", "v"]
    assert diff.choose_key(b, b, ["v"]) == ["v"] and diff.worth_comparing(a, b) and not diff.worth_comparing(a, spark.range(1))
    assert diff.common_columns(a, b.toDF("K", "w")) == (["k"], ["v"], ["w"])


def test_catalogs(spark):
    lines = spark.createDataFrame([("U1", 1, "select cust_id from t"), ("U2", 3, "x.CUST_ID := 1;"), ("U3", 1, "cust_id_2")], "unit string, line int, text string")
    uses = spark.createDataFrame([("U1", "T"), ("U2", "S"), ("U3", "t"), ("U4", "OTHER"), ("T", "SEQ")], "unit string, name string")
    synonyms = spark.createDataFrame([("S", "T"), ("S2", "S"), ("L1", "L2"), ("L2", "L1")], "synonym string, table_name string")
    usage = rows_of(catalog.column_usage("cust_id", lines, uses, synonyms, "t").select("unit", "how", "line"))
    assert usage == sorted([("U1", "direct", 1), ("U2", "synonym", 3), ("U3", "direct", None)], key=str)
    fks = spark.createDataFrame([("T", "P"), ("C", "T"), ("U1", "T")], "child string, parent string")
    assert rows_of(catalog.dependencies("t", uses, synonyms, fks)) == sorted([("used_by", "U1", "direct,foreign key"), ("used_by", "U2", "synonym"), ("used_by", "U3", "direct"), ("used_by", "C", "foreign key"), ("uses", "SEQ", "direct"), ("uses", "P", "foreign key")], key=str)
    found = {r.name: r.target for r in catalog.resolve_synonyms(spark.createDataFrame([("S2",), ("T",), ("L1",)], "name string"), synonyms).collect()}
    assert found == {"S2": "T", "T": "T", "L1": None}
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(catalog.rewrite_owner(F.lit('app.t, "app".u, my_app.v, x.app, APP . w'), "app", "new")) == "new.t, new.u, my_app.v, x.app, new . w"
    assert one(catalog.normal_default(F.lit(" sysdate || 'aB' "))) == "SYSDATE || 'aB'" and one(catalog.normal_view(F.lit("select a  \nfrom t "))) == "SELECT A\nFROM T"
    assert [one(catalog.script_order(F.lit(k))) for k in ("table", "foreign key", "odd")] == [2, 10, 11]
    a = catalog.columns_of(spark, {"t": spark.createDataFrame([], "x int, y string")})
    b = catalog.columns_of(spark, {"t": spark.createDataFrame([], "x bigint, z string")})
    script = sorted(r.line for r in catalog.sync_script(catalog.compare(a, b, ["table_name", "column_name"]), a).collect())
    assert script == ["-- ALTER TABLE t DROP COLUMN z;", "ALTER TABLE t ADD COLUMN y string;", "ALTER TABLE t ALTER COLUMN x TYPE int;"]


def test_checks_and_traces(spark):
    bad = spark.range(7)
    assert checks.run_check(bad, "c", 5)[:2] == (False, "5+") and checks.run_check(bad, "c", 9)[:2] == (False, "7") and checks.run_check(bad.limit(0), "c")[:2] == (True, "0")
    w = spark.createDataFrame([("a", "failed"), ("b", "same"), ("c", "differs"), ("d", "?")], "writer string, outcome string")
    assert [r.writer for r in trace.by_outcome(w).collect()] == ["b", "c", "a", "d"]


def test_merges_are_read():
    m = edit_sql.parse_merge("MERGE INTO own.t a USING (SELECT k, v FROM s) b ON (a.k = b.k AND a.z = b.v) WHEN MATCHED THEN UPDATE SET a.v = b.v, a.k = 1 WHEN NOT MATCHED THEN INSERT (k, v) VALUES (b.k, b.v)")
    assert (m.table, m.alias, m.source_alias, m.on, m.inserts) == ("own.t", "a", "b", "a.k = b.k AND a.z = b.v", True)
    assert edit_sql.merge_keys(m) == ([("K", "K"), ("Z", "V")], True) and edit_sql.updated_keys(m) == ["K"]
    assert edit_sql.merge_keys(edit_sql.parse_merge("MERGE INTO t USING s ON (t.k = s.k OR t.a > s.b) WHEN MATCHED THEN UPDATE SET v = 1")) == ([], False)
    assert edit_sql.newer_than("SELECT 'FETCH FIRST' FROM t FETCH FIRST 3 ROWS ONLY -- LATERAL", 11) == ["FETCH FIRST"] and edit_sql.newer_than("SELECT a FROM t FETCH FIRST 3 ROWS ONLY", 19) == []
    assert edit_sql.judged("SELECT a FROM t", ["group by|from t", "where"], ["select a"], 11) == ["missing: where", "not wanted: select a"]
