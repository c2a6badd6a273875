"""Values traced back to the queries that compute them."""

from tessera.plans import value_trace as v


def one(sql, column="TOTAL", keys=("ID",), **more):
    (path,) = v.paths(sql, "own.bill", column, list(keys), **more)
    return path


def test_insert_select():
    p = one("INSERT INTO bill (id, total) SELECT o.k, SUM(l.price * 2) s FROM orders o, lines l WHERE l.k = o.k AND o.state = 'F' AND (l.a = 1 OR l.b = 2) GROUP BY o.k")
    assert (p.expression, p.keys, p.source.tables, p.source.conditions) == ("SUM(l.price * 2)", {"ID": "o.k"}, {"O": "ORDERS", "L": "LINES"}, ("l.k = o.k", "o.state = 'F'", "(l.a = 1 OR l.b = 2)"))
    assert v.value_query(p, {"id": "7"}) == "SELECT o.k AS ID, SUM(l.price * 2) AS value FROM orders o, lines l WHERE l.k = o.k AND o.state = 'F' AND ((l.a = 1 OR l.b = 2)) AND o.k = 7 GROUP BY o.k"
    assert v.rows_query(p).startswith("SELECT * FROM orders o, lines l WHERE") and v.joins(p)[0] == ["l.k = o.k"]
    sql, conditions = v.flags_query(p)
    assert conditions == ["o.state = 'F'", "(l.a = 1 OR l.b = 2)"] and "CASE WHEN o.state = 'F' THEN 'O' ELSE 'X' END AS c1" in sql and sql.endswith("WHERE l.k = o.k")
    assert [t for t, _ in v.survival_queries(p)] == ["O", "L"] and v.survival_queries(p)[0][1] == "SELECT count(*) AS n FROM ORDERS O WHERE o.state = 'F'"
    assert one("INSERT INTO bill SELECT a, b FROM t", columns=["ID", "TOTAL"]).expression == "b"
    for sql, said in (("INSERT INTO bill SELECT a, b FROM t", "order isn't known"), ("INSERT INTO bill (id, total) SELECT 1, 2 FROM t UNION SELECT 3, 4 FROM u", "set operation"), ("INSERT ALL INTO bill (id) VALUES (1) SELECT 1 FROM t", "several tables"), ("INSERT INTO bill (id, total) VALUES (1)", "values than columns")):
        assert said in one(sql).notes[0]
    assert v.paths("INSERT INTO other (total) SELECT 1 FROM t", "bill", "total", []) == [] and v.paths("DELETE FROM bill", "bill", "total", []) == []


def test_values_of_cursors_and_variables():
    feeds = [v.Feed("cursor", "r", "SELECT o.k id, o.a + o.b amt FROM orders o WHERE o.x = 1", 3), v.Feed("into", "", "SELECT max(z) INTO v_z FROM zs WHERE k = v_k", 5)]
    p = one("INSERT INTO bill (id, total) VALUES (r.id, r.amt * 2)", feeds=feeds)
    assert (p.expression, p.keys, p.source.conditions, p.via[0][:2]) == ("(o.a + o.b) * 2", {"ID": "o.k"}, ("o.x = 1",), ("cursor", "r"))
    p = one("INSERT INTO bill (id, total) VALUES (v_k, v_z)", feeds=feeds)
    assert (p.expression, p.source.conditions) == ("max(z)", ("k = v_k",))
    assert one("INSERT INTO bill (id, total) VALUES (1, f(2))").source is None


def test_updates_and_merges():
    p = one("UPDATE bill b SET b.x = 1, (total, tax) = (SELECT sum(l.p), 2 FROM lines l WHERE l.k = b.id AND l.q > 0) WHERE b.id < 9")
    assert (p.expression, p.keys, p.source.conditions, p.notes) == ("sum(l.p)", {"ID": "l.k"}, ("l.q > 0",), ())
    p = one("UPDATE bill SET total = total * 2 WHERE id = 3")
    assert (p.expression, p.keys, p.source.source, p.source.conditions) == ("total * 2", {"ID": "BILL.ID"}, "BILL BILL", ("id = 3",))
    merge = "MERGE INTO own.bill b USING (SELECT k, sum(p) s FROM lines GROUP BY k) x ON (b.id = x.k) WHEN MATCHED THEN UPDATE SET total = x.s WHERE x.s > 0 WHEN NOT MATCHED THEN INSERT (id, total) VALUES (x.k, x.s + 1)"
    a, b = v.paths(merge, "bill", "total", ["id"])
    assert (a.label, a.expression, a.keys) == ("MERGE UPDATE", "x.s", {"ID": "x.k"}) and (b.label, b.expression) == ("MERGE INSERT", "x.s + 1")
    below = v.unwrapped(a)
    assert (below.expression, below.keys, below.source.group) == ("sum(p)", {"ID": "k"}, "GROUP BY k") and v.unwrapped(below) is None
    assert [p.label for p in v.unwrapped_all(b)] == ["MERGE INSERT", "view X"]


def test_runs_on_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.plans.statements import same_value
    from tessera.workbench import Workbench

    spark.createDataFrame([(1, "a", 10), (1, "b", 5), (2, "a", 7)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    w = Workbench(spark, str(tmp_path))
    p = one("INSERT INTO bill (id, total) SELECT n.n_nationkey, sum(n.n_regionkey) FROM {nation} n WHERE n.n_name <> 'b' AND n.n_regionkey > v_limit GROUP BY n.n_nationkey".replace("{nation}", "NATION_"))
    p = p._replace(source=p.source._replace(source="{nation} n"))
    p = v.runnable(p, w.problem)
    assert p.notes == ("left out: n.n_regionkey > v_limit",)
    stored = spark.createDataFrame([(1, "10.0"), (2, "8")], "id int, total string")
    both = stored.join(w.sql(v.value_query(p)).toDF("k", "value"), F.col("id") == F.col("k"), "left")
    assert {r.id: r.same for r in both.select("id", same_value(F.col("total"), F.col("value")).alias("same")).collect()} == {1: True, 2: False}
