"""Rewriting block by block: every part of a query is kept, stands for something in the result, or is refused."""

import pytest

from tessera.plans import edit_sql
from tessera.plans.rewrite import NotUnderstood, to_spark


@pytest.mark.parametrize(
    ("asked", "kept"),
    [
        ("SELECT b FROM u UNION ALL SELECT a FROM t WHERE ROWNUM <= 5", ["SELECT b FROM u UNION ALL", "SELECT a FROM t LIMIT 5"]),
        ("SELECT a.x FROM a, b WHERE a.id = b.id(+) UNION ALL SELECT c.y FROM c", ["LEFT JOIN b ON a.id = b.id", "UNION ALL SELECT c.y FROM c"]),
        ("SELECT a FROM t WHERE ROWNUM <= 5 ORDER BY a", ["(SELECT * FROM t LIMIT 5) t", "ORDER BY a"]),
        ("SELECT a, count(*) FROM t WHERE x > 1 AND ROWNUM <= 5 GROUP BY a HAVING count(*) > 1", ["WHERE x > 1 LIMIT 5", "GROUP BY a", "HAVING count(*) > 1"]),
        ("WITH q AS (SELECT a FROM t) SELECT a FROM q WHERE x > 1 AND ROWNUM <= 5", ["WITH q AS (SELECT a FROM t)", "WHERE x > 1 LIMIT 5"]),
        ("WITH q(k, n) AS (SELECT 1, 2 FROM dual), r AS (SELECT k FROM q) SELECT * FROM r MINUS SELECT 1", ["q(k, n) AS (", "r AS (SELECT k FROM q)", "MINUS SELECT 1"]),
        ("SELECT a FROM t WHERE a IN (SELECT b FROM u WHERE ROWNUM < 3) OR b = 1", ["IN (SELECT b FROM u LIMIT 2)", "OR b = 1"]),
        ("SELECT DISTINCT a FROM t WHERE a IS DISTINCT FROM b", ["DISTINCT a", "IS DISTINCT FROM b"]),
        ("SELECT a FROM t WHERE d BETWEEN 1 AND 3 AND ROWNUM <= 2", ["d BETWEEN 1 AND 3 LIMIT 2"]),
        ("SELECT /*+ BROADCAST(t) */ a -- why\nFROM t", ["/*+ BROADCAST(t) */", "FROM t"]),
    ],
)
def test_nothing_is_left_out(asked, kept):
    made = to_spark(asked)
    for part in kept:
        assert part in made, made


@pytest.mark.parametrize(
    "asked",
    [
        "SELECT a FROM t, u WHERE ROWNUM <= 5 ORDER BY a",
        "SELECT a FROM t WHERE ROWNUM > 5",
        "SELECT a FROM t WHERE ROWNUM <= 5 OR b = 1",
        "SELECT a.x FROM a, b WHERE a.id = b.id(+) OR a.id = 1",
        "SELECT a.x FROM a JOIN c ON 1 = 1, b WHERE a.id = b.id(+)",
        "SELECT a.x FROM a, b WHERE a.id(+) = b.id AND b.k(+) = a.k",
        "SELECT s.nextval FROM dual",
        "SELECT ROWID FROM t",
        "SELECT a FROM t FETCH FIRST 3 ROWS WITH TIES",
        "SELECT a FROM t ORDER BY 1 FETCH FIRST 3 ROWS WITH TIES",
        "SELECT TO_CHAR(d, f) FROM t",
        "SELECT TRUNC(d, 'CC') FROM t",
        "SELECT * FROM t START WITH a = 1 CONNECT BY PRIOR a = b",
        "SELECT a FROM t FROM u",
        "SELECT f((a) FROM t",
        "UPDATE t SET a = 1",
    ],
)
def test_what_is_not_understood_is_refused(asked):
    with pytest.raises(NotUnderstood):
        to_spark(asked, dates=["d"])


def test_templates_keep_what_follows():
    assert to_spark("SELECT STDDEV(x) OVER (PARTITION BY g) FROM t") == "SELECT (CASE WHEN count(x) OVER (PARTITION BY g) = 1 THEN 0D ELSE stddev_samp(x) OVER (PARTITION BY g) END) FROM t"
    assert "ORDER BY a DESC NULLS FIRST ROWS UNBOUNDED PRECEDING" in to_spark("SELECT sum(x) OVER (ORDER BY a DESC ROWS UNBOUNDED PRECEDING) FROM t")
    assert to_spark("SELECT 'a\\b' || q'[it's]' FROM t") == "SELECT nullif(concat('a\\\\b', 'it\\'s'), '') FROM t"
    assert to_spark("SELECT a - b, c * 2 - 1 FROM t") == "SELECT a - b, c * 2 - 1 FROM t"


def test_casts_to_whole_numbers_round(spark, tmp_path):
    import duckdb

    from tessera.plans import lineage
    from tessera.queries import ORACLE, QUERIES
    from tessera.workbench import Workbench

    halves = [None, 0.5, 1.5, 2.5, -0.5, -1.5, -2.5, 2.4999, 2.51, -2.51, 9999.5, 10000.5, 10001.5, 20000.6, 2147483647.4 - 10001]
    # 10000.6 and 0.2 are within 10000 of each other only when cut, 1.5 and 10002.4 only when rounded
    orders = [(k, 1, v) for k, v in enumerate(halves)] + [(100, 2, 10000.4), (101, 2, 0.5), (102, 3, 10000.6), (103, 3, 0.2), (104, None, 1.5), (105, None, 10002.4)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["win_range_frame"](spark, str(tmp_path)).collect())) == sorted(con.execute(ORACLE["win_range_frame"]).fetchall())

    w = Workbench(spark, str(tmp_path))
    text = "SELECT o_orderkey, cast(o_totalprice AS int) AS a, cast(cast(o_totalprice AS decimal(18, 4)) AS bigint) AS b, cast(cast(o_totalprice AS float) AS integer) AS c, 1 - cast(cast(o_totalprice AS smallint) AS int) AS d FROM {orders} WHERE o_totalprice < 30000"
    assert sorted(map(tuple, w.sql(text).collect())) == sorted(con.execute(text.replace("{orders}", "orders")).fetchall())
    grouped = "SELECT cast(o_totalprice AS int) AS a, cast(sum(o_totalprice) AS bigint) AS n FROM {orders} WHERE o_totalprice > -9 GROUP BY cast(o_totalprice AS int)"
    assert sorted(map(tuple, w.sql(grouped).collect())) == sorted(con.execute(grouped.replace("{orders}", "orders")).fetchall())
    words = "SELECT cast('2.5' AS int) AS a, cast('-7' AS int) AS b, cast(NULL AS int) AS c, cast('9007199254740993' AS bigint) AS d, cast(9007199254740993 AS bigint) AS e, cast(3.5 AS int) AS f"
    assert tuple(w.sql(words + " FROM dual").first()) == con.execute(words).fetchone() == (3, -7, None, 9007199254740993, 9007199254740993, 4)
    # whole columns stay as they are, and so do the columns' origins
    assert "CASE" not in w.sql("SELECT cast(o_orderkey AS int) AS k FROM {orders}")._jdf.queryExecution().optimizedPlan().toString()
    kinds = {r.result_column: (r.kind, r.column_name) for r in lineage.column_lineage(w.sql("SELECT cast(o_totalprice AS int) AS a, cast(o_orderkey + 1 AS int) AS b FROM {orders}")).collect()}
    assert kinds == {"a": ("column", "o_totalprice"), "b": ("computed", "o_orderkey")}


def test_conditions_in_and_round_a_query():
    assert edit_sql.add_condition("SELECT a FROM t WHERE x = 1 OR y = 2 ORDER BY a;", "z = 3") == "SELECT a FROM t WHERE (x = 1 OR y = 2)\n  AND z = 3\nORDER BY a;"
    assert edit_sql.add_condition("SELECT a FROM t GROUP BY a", "z = 3") == "SELECT a FROM t\nWHERE z = 3\nGROUP BY a"
    assert edit_sql.wrap_condition("SELECT count(*) n, o.k FROM o GROUP BY o.k ORDER BY n DESC, o.k", "n = 1") == "SELECT *\nFROM (\nSELECT count(*) n, o.k FROM o GROUP BY o.k\n)\nWHERE n = 1\nORDER BY n DESC, K"
    make = lambda e: f"{e} = 1"
    assert edit_sql.place_condition("SELECT o.a, b x FROM o", "A", make) == ("SELECT o.a, b x FROM o\nWHERE o.a = 1", False)
    assert edit_sql.place_condition("SELECT o.a, b + 1 x FROM o", "X", make)[1]
    assert edit_sql.place_condition("SELECT a, row_number() OVER (ORDER BY a) r FROM o", "A", make)[1]
    assert edit_sql.place_condition("SELECT * FROM o", "Q", make) == ("SELECT * FROM o\nWHERE Q = 1", False)
    for bad in ("DELETE FROM t", "SELECT a FROM t UNION SELECT b FROM u"):
        with pytest.raises(edit_sql.NotPossible):
            edit_sql.add_condition(bad, "x = 1")
    with pytest.raises(edit_sql.NotPossible):
        edit_sql.wrap_condition("SELECT a FROM t FOR UPDATE", "x = 1")


def test_columns_are_inserted():
    assert edit_sql.insert_columns("SELECT * FROM t", "select", ["a", "b"]) == "SELECT a, b FROM t"
    assert edit_sql.insert_columns("SELECT x FROM t", "select", ["a"]) == "SELECT x, a FROM t"
    assert edit_sql.insert_columns("SELECT x FROM t ORDER BY x FETCH FIRST 1 ROWS ONLY", "order", ["a"]) == "SELECT x FROM t ORDER BY x, a\nFETCH FIRST 1 ROWS ONLY"
    assert edit_sql.insert_columns("SELECT x FROM t HAVING 1 = 1", "group", ["a"]) == "SELECT x FROM t\nGROUP BY a\nHAVING 1 = 1"
    assert edit_sql.insert_columns("SELECT x FROM t WHERE", "where", ["a"]) == "SELECT x FROM t WHERE a = "


def test_editable_queries_and_changes():
    assert edit_sql.editable_table("SELECT a, b FROM own.t x WHERE a = 1 ORDER BY b") == ("own.t", "x")
    for bad in ("SELECT a FROM t, u", "SELECT a FROM t JOIN u ON 1 = 1", "SELECT DISTINCT a FROM t", "SELECT a FROM (SELECT 1 FROM t)", "SELECT a FROM dual", "SELECT (SELECT 1 FROM u) FROM t", "WITH q AS (SELECT 1 FROM t) SELECT * FROM q"):
        with pytest.raises(edit_sql.NotPossible):
            edit_sql.editable_table(bad)
    change = edit_sql.parse_change("UPDATE own.t x SET x.a = (SELECT max(b) FROM u WHERE c = 1), (d, e) = (SELECT 1, 2 FROM dual) WHERE x.k IN (1, 2) RETURNING a INTO :v")
    assert change == ("update", "own.t", "x", ("A", "D", "E"), "x.k IN (1, 2)")
    assert edit_sql.affected_sql(change) == "SELECT COUNT(*) AS n FROM own.t x WHERE (x.k IN (1, 2))"
    assert edit_sql.affected_sql(edit_sql.parse_change("DELETE t"), 5) == "SELECT * FROM t WHERE 1 = 1 AND ROWNUM <= 5"
    for bad in ("SELECT 1", "UPDATE (SELECT 1 FROM t) SET a = 1", "DELETE FROM t@far"):
        with pytest.raises(edit_sql.NotPossible):
            edit_sql.parse_change(bad)


def test_workbench(spark, tmp_path):
    from tessera.workbench import Workbench

    spark.createDataFrame([(i, f"n{i}") for i in range(12)], "r_regionkey int, r_name string").write.parquet(str(tmp_path / "region.parquet"))
    w = Workbench(spark, str(tmp_path))
    got, more = w.first_rows("SELECT r_regionkey FROM {region} ORDER BY 1", 10)
    assert [r[0] for r in got] == list(range(10)) and more
    assert w.first_rows("SELECT r_regionkey FROM {region}", 12)[1] is False
    assert w.sql("SELECT r_name FROM {region} WHERE r_regionkey = :k", k=3).first()[0] == "n3"
    assert "Physical Plan" in w.explain("SELECT * FROM {region} WHERE r_regionkey > 3")
    assert w.problem("SELECT r_name FROM {region}") is None
    for bad in ("SELECT nothing FROM {region}", "SELECT FROM WHERE", "DELETE FROM {region}", "SELECT ROWID FROM {region}"):
        assert w.problem(bad)
