from tessera.operators import trace
from tessera.plans import code_facts


def test_row_trace(spark):
    code = spark.createDataFrame([("P", "BEGIN\nINSERT INTO t (a) VALUES (1);\nDELETE FROM t WHERE a = 2;\nUPDATE t SET a = 3;\nEND;"), ("Q", "INSERT INTO other VALUES (1)")], "unit string, text string")
    target = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "a int, b string")
    asked = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (2, "x")], "a int, b string")
    got = trace.row_trace(target, ["a", "b"], asked, code_facts.facts(code), "T").collect()
    assert sorted(((r.a or 0, r.b, r.n_rows, r.stands) for r in got)) == [(0, "y", 1, True), (1, "x", 2, True), (2, "x", 0, False)]
    assert all((r.inserts, r.deletes) == (["P:2"], ["P:3"]) for r in got)
    none = trace.row_trace(target.limit(0), ["a"], asked, code_facts.facts(code.limit(0)), "T").collect()
    assert [(r.stands, r.inserts, r.deletes) for r in none] == [(False, [], [])] * 3


def test_possible_writes(spark):
    source = spark.createDataFrame([(1, 5), (2, 5), (3, 0), (None, 7)], "a int, n int")
    target = spark.createDataFrame([(1,), (None,)], "a int")
    got = trace.possible_writes(target, source, ["a"], source.n > 0).collect()
    assert sorted((r.a or 0, r.state) for r in got) == [(0, "present"), (1, "present"), (2, "missing")]
