"""Named queries over the tables of a folder, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import dialect as D
from .operators import catalog, checks, diff, graph, integrate, move, predicates, rows, sessions, trace
from .plans import code_facts, edit_sql, flows, lexer, lineage, rewrite, statements, value_trace
from .sources import code_files, history, text_io
from .streaming import windows
from .workbench import TABLES, Workbench

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Workbench(spark, sf_dir))
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query in the dialect of the workbench; {t} is a table. Without an oracle the same text runs in both."""
    QUERIES[name] = lambda spark, sf_dir: Workbench(spark, sf_dir).sql(text)
    plain = oracle or text
    for t in TABLES:
        plain = plain.replace(f"{{{t}}}", t)
    ORACLE[name] = plain


# --- comparison of results ---

_SNAPSHOTS = """a AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderkey % 11 <> 0)"""
_STATUS = "CASE WHEN a.o_orderkey IS NULL THEN 'add' WHEN b.o_orderkey IS NULL THEN 'del' WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'chg' ELSE 'same' END"


def _snapshots(w: Workbench) -> tuple[DataFrame, DataFrame]:
    orders = w.table("orders")
    raised = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return orders.filter("o_orderkey % 7 <> 0"), orders.filter("o_orderkey % 11 <> 0").withColumn("o_totalprice", raised)


@query(f"WITH {_SNAPSHOTS} SELECT {_STATUS} AS status, count(*) AS cnt FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey GROUP BY 1")
def diff_counts_keyed(w):
    return diff.diff_counts(diff.diff_rows(*_snapshots(w), ["o_orderkey"]))


@query(f"WITH {_SNAPSHOTS} SELECT {_STATUS} AS status, coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, round(a.o_totalprice, 2) AS price_a, round(b.o_totalprice, 2) AS price_b FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey")
def diff_rows_keyed(w):
    return diff.diff_rows(*_snapshots(w), ["o_orderkey"]).select("status", "o_orderkey", F.round("a.o_totalprice", 2).alias("price_a"), F.round("b.o_totalprice", 2).alias("price_b"))


@query(f"WITH {_SNAPSHOTS} SELECT 'o_totalprice' AS column_name, count(*) AS n FROM a JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_totalprice <> b.o_totalprice")
def diff_changed_columns(w):
    return diff.diff_rows(*_snapshots(w), ["o_orderkey"]).select(F.explode("changed").alias("column_name")).groupBy("column_name").agg(F.count("*").alias("n"))


_LINES = "l_orderkey, l_linenumber, l_quantity, l_returnflag"


@query(f"""WITH a AS (SELECT {_LINES}, count(*) n FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY ALL), b AS (SELECT {_LINES}, count(*) n FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY ALL),
 j AS (SELECT coalesce(a.n, 0) x, coalesce(b.n, 0) y FROM a FULL JOIN b USING ({_LINES}))
 SELECT status, cnt FROM (SELECT 'same' status, sum(least(x, y))::BIGINT cnt FROM j UNION ALL SELECT 'del', sum(greatest(x - y, 0))::BIGINT FROM j UNION ALL SELECT 'add', sum(greatest(y - x, 0))::BIGINT FROM j) WHERE cnt > 0""")
def diff_multiset_counts(w):
    lines = w.table("lineitem")
    pick = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
    return diff.diff_counts(diff.diff_rows(lines.filter("l_partkey % 3 <> 0").select(*pick), lines.filter("l_partkey % 4 <> 0").select(*pick)))


_PAIRED = "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_orderkey, l_linenumber, l_quantity, l_returnflag) AS n"


@query(f"""WITH a AS (SELECT {_LINES}, {_PAIRED} FROM lineitem WHERE l_partkey % 3 <> 0), b AS (SELECT {_LINES}, {_PAIRED} FROM lineitem WHERE l_partkey % 4 <> 0)
 SELECT CASE WHEN a.n IS NULL THEN 'add' WHEN b.n IS NULL THEN 'del' WHEN a.l_quantity <> b.l_quantity OR a.l_returnflag <> b.l_returnflag THEN 'chg' ELSE 'same' END AS status, count(*) AS cnt
 FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.n = b.n GROUP BY 1""")
def diff_duplicate_keys_paired(w):
    lines = w.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_partkey")
    return diff.diff_counts(diff.diff_rows(lines.filter("l_partkey % 3 <> 0").drop("l_partkey"), lines.filter("l_partkey % 4 <> 0").drop("l_partkey"), ["l_orderkey", "l_linenumber"]))


@query("""SELECT 'o_orderkey' AS candidate, count(*) AS n_rows, count(o_orderkey) AS n_full, count(DISTINCT o_orderkey) AS n_keys, count(*) = count(DISTINCT o_orderkey) AS is_key FROM orders
 UNION ALL SELECT 'o_custkey', count(*), count(o_custkey), count(DISTINCT o_custkey), count(*) = count(DISTINCT o_custkey) FROM orders
 UNION ALL SELECT 'o_custkey,o_orderdate', count(*), count(*), count(DISTINCT (o_custkey, o_orderdate)), count(*) = count(DISTINCT (o_custkey, o_orderdate)) FROM orders""")
def key_uniqueness_report(w):
    return diff.key_uniqueness(w.table("orders"), [["o_orderkey"], ["o_custkey"], ["o_custkey", "o_orderdate"]])


# --- rows: filters, sorts, pages, masks ---

_CUSTOMERS = "SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS segment, c_nationkey FROM customer"


def _customers(w):
    return w.table("customer").select("c_custkey", "c_name", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"), "c_nationkey")


def _grid(name: str, text: str, where: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rows.filter_rows(_customers(Workbench(spark, sf_dir)), text)
    ORACLE[name] = f"SELECT * FROM ({_CUSTOMERS}) WHERE {where}"


_grid("grid_filter_contains_any", "auto", "c_custkey::VARCHAR ILIKE '%auto%' OR c_name ILIKE '%auto%' OR segment ILIKE '%auto%' OR c_nationkey::VARCHAR ILIKE '%auto%'")
_grid("grid_filter_eq", "segment = MACHINERY", "segment = 'MACHINERY'")
_grid("grid_filter_ne_keeps_null", "segment != MACHINERY", "segment IS NULL OR segment <> 'MACHINERY'")
_grid("grid_filter_range", "c_custkey >= 10 AND c_custkey < 500", "c_custkey >= 10 AND c_custkey < 500")
_grid("grid_filter_is_null", "segment is null", "segment IS NULL")
_grid("grid_filter_and", "segment is not null && c_nationkey = 7 AND c_name ~ customer", "segment IS NOT NULL AND c_nationkey = 7 AND c_name ILIKE '%customer%'")


@query("SELECT c_custkey, segment, row_number() OVER (ORDER BY segment ASC NULLS LAST, c_custkey) AS place FROM (" + _CUSTOMERS + ") QUALIFY place <= 200")
def grid_sort_nulls_last_asc(w):
    top = rows.sort_rows(_customers(w), "segment", False, ["c_custkey"]).limit(200)
    return _placed(top, F.col("segment").asc_nulls_last())


@query("SELECT c_custkey, segment, row_number() OVER (ORDER BY segment DESC NULLS LAST, c_custkey) AS place FROM (" + _CUSTOMERS + ") QUALIFY place <= 200")
def grid_sort_nulls_last_desc_topk(w):
    top = rows.sort_rows(_customers(w), "segment", True, ["c_custkey"]).limit(200)
    return _placed(top, F.col("segment").desc_nulls_last())


def _placed(top, order):
    from pyspark.sql import Window

    return top.select("c_custkey", "segment", F.row_number().over(Window.orderBy(order, "c_custkey")).cast("long").alias("place"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderkey) > (100, 500) ORDER BY o_custkey, o_orderkey LIMIT 50")
def keyset_page(w):
    return rows.page(w.table("orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], 50, (100, 500))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def offset_page(w):
    return w.table("orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").offset(100).limit(50)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def row_mask_keep(w):
    chosen = w.table("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return rows.mask(w.table("customer").select("c_custkey", "c_name"), chosen, ["c_custkey"], True)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def row_mask_exclude(w):
    chosen = w.table("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return rows.mask(w.table("customer").select("c_custkey", "c_name"), chosen, ["c_custkey"], False)


@query(f"SELECT * FROM ({_CUSTOMERS}) WHERE segment IN ('MACHINERY') OR segment IS NULL")
def in_list_with_null(w):
    return _customers(w).filter(rows.in_list(F.col("segment"), ["MACHINERY", None]))


@query(f"SELECT 'kept' AS list, count(*) AS n FROM ({_CUSTOMERS}) WHERE segment NOT IN ('MACHINERY') OR segment IS NULL UNION ALL SELECT 'dropped', count(*) FROM ({_CUSTOMERS}) WHERE segment NOT IN ('MACHINERY') AND segment IS NOT NULL")
def not_in_list_null_semantics(w):
    c = _customers(w)
    part = lambda name, values: c.filter(rows.not_in_list(F.col("segment"), values)).agg(F.count("*").alias("n")).select(F.lit(name).alias("list"), "n")
    return part("kept", ["MACHINERY"]).union(part("dropped", ["MACHINERY", None]))


_LABELS = "SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN '_%' WHEN 1 THEN 'x%' ELSE '_y' END AS label FROM part"


@query(f"SELECT * FROM ({_LABELS}) WHERE label LIKE '%t!_!%%' ESCAPE '!'")
def like_escape(w):
    tail = F.when(F.col("p_partkey") % 3 == 0, "_%").when(F.col("p_partkey") % 3 == 1, "x%").otherwise("_y")
    return w.table("part").select("p_partkey", F.concat("p_name", tail).alias("label")).filter(predicates.cell_condition("label", "t_%", like=True))


@query("SELECT segment AS value, min(c_custkey) AS first_seen FROM (" + _CUSTOMERS + ") GROUP BY 1")
def distinct_selected_values(w):
    return rows.distinct_values(_customers(w), "segment", "c_custkey")


@query("SELECT event_id, last_value(kind IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS kind FROM (SELECT event_id, user_id, nullif(event_type, 'view') AS kind FROM events)")
def fill_down(w):
    e = w.table("events").select("event_id", "user_id", F.nullif(F.col("event_type"), F.lit("view")).alias("kind"))
    return rows.fill_down(e, "kind", ["event_id"], ["user_id"]).select("event_id", "kind")


@query("SELECT event_id, ['x', 'y', 'z'][event_id % 3 + 1] AS pasted FROM events")
def paste_tile(w):
    return rows.tile(w.table("events").select("event_id"), "event_id", ["x", "y", "z"])


# --- joins ---

sql("join_inner", "SELECT n.n_name, count(*) AS n FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
sql("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
sql("join_full", "SELECT coalesce(s.s_nationkey, c.c_nationkey) AS k, s.n AS n_s, c.n AS n_c FROM (SELECT s_nationkey, count(*) AS n FROM {supplier} GROUP BY s_nationkey) s FULL JOIN (SELECT c_nationkey, count(*) AS n FROM {customer} WHERE c_custkey % 3 = 0 GROUP BY c_nationkey) c ON s.s_nationkey = c.c_nationkey")
sql("join_semi", "SELECT c.c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
sql("join_anti", "SELECT c.c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
sql("join_null_aware_anti", "SELECT count(*) AS n FROM {customer} c WHERE c.c_custkey NOT IN (SELECT nullif(o.o_custkey, 1) FROM {orders} o)")
sql("join_theta_range", "SELECT r.lo, count(*) AS n FROM {orders} o JOIN (SELECT 0 AS lo, 100000 AS hi UNION ALL SELECT 100000, 200000 UNION ALL SELECT 200000, 400000) r ON o.o_totalprice >= r.lo AND o.o_totalprice < r.hi GROUP BY r.lo")
sql("join_cross_small", "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n WHERE n.n_regionkey <> r.r_regionkey")
sql("join_natural", "SELECT count(*) AS n FROM (SELECT n_nationkey AS k, n_name FROM {nation}) a NATURAL JOIN (SELECT c_nationkey AS k, c_custkey FROM {customer}) b")
sql("join_lateral_topn", "SELECT n.n_name, t.c_custkey FROM {nation} n, LATERAL (SELECT c.c_custkey FROM {customer} c WHERE c.c_nationkey = n.n_nationkey ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 3) t")
sql("join_outer_mark", "SELECT c.c_custkey, o.o_orderkey FROM {customer} c, {orders} o WHERE c.c_custkey = o.o_custkey(+)", "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey")


@query("SELECT * FROM (VALUES ('customer', 'nation', 'c_nationkey = n_nationkey'), ('lineitem', 'orders', 'l_orderkey = o_orderkey'), ('lineitem', 'part', 'l_partkey = p_partkey'), ('lineitem', 'supplier', 'l_suppkey = s_suppkey'), ('nation', 'region', 'n_regionkey = r_regionkey'), ('orders', 'customer', 'o_custkey = c_custkey'), ('supplier', 'nation', 's_nationkey = n_nationkey')) t(child, parent, condition)")
def fk_join_inference(w):
    tables = "region nation customer supplier part orders lineitem".split()
    cols = catalog.columns_of(w.spark, {t: w.table(t) for t in tables})
    return catalog.join_conditions(cols, cols.filter("position = 1 AND table_name <> 'lineitem'"))


# --- aggregates ---

sql("agg_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS avg_price, min(l_shipdate) AS first_ship, max(l_discount) AS top_discount FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
sql("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM {orders} GROUP BY o_orderstatus")
sql("agg_conditional", "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_f, count(*) FILTER (WHERE o_totalprice > 100000) AS n_high FROM {orders} GROUP BY o_orderpriority", "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n_f, count(*) FILTER (WHERE o_totalprice > 100000) AS n_high FROM {orders} GROUP BY o_orderpriority")
sql("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
sql("agg_rollup", "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS g1, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
sql("agg_listagg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey")
sql("agg_median", "SELECT c_mktsegment, round(median(c_acctbal), 3) AS m FROM {customer} GROUP BY c_mktsegment")
sql("agg_percentile_disc", "SELECT c_mktsegment, percentile_disc(0.9) WITHIN GROUP (ORDER BY c_acctbal) AS p90, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY c_acctbal), 3) AS p25 FROM {customer} GROUP BY c_mktsegment")
sql("agg_stddev_single_row_zero", "SELECT c_custkey % 700 AS k, round(STDDEV(c_acctbal), 4) AS sd FROM {customer} GROUP BY c_custkey % 700", "SELECT c_custkey % 700 AS k, round(CASE WHEN count(c_acctbal) = 1 THEN 0 ELSE stddev_samp(c_acctbal) END, 4) AS sd FROM {customer} GROUP BY 1")
sql("agg_regression", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM {lineitem} GROUP BY l_returnflag")
sql("agg_keep_first", "SELECT o_custkey, count(*) AS n, min(o_orderkey) KEEP (DENSE_RANK FIRST ORDER BY o_orderpriority, o_orderstatus DESC) AS k FROM {orders} WHERE o_orderkey > 9 GROUP BY o_custkey", "SELECT o_custkey, count(*) AS n, min(o_orderkey) FILTER (WHERE r = 1) AS k FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus DESC) AS r FROM orders WHERE o_orderkey > 9) GROUP BY 1")
sql("agg_keep_dense_rank_last", "SELECT o_custkey, sum(cast(round(o_totalprice * 100) AS bigint)) KEEP (DENSE_RANK LAST ORDER BY o_orderdate) AS cents FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, sum(cents)::BIGINT AS cents FROM (SELECT o_custkey, cast(round(o_totalprice * 100) AS bigint) AS cents, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM {orders}) t WHERE r = 1 GROUP BY o_custkey")
sql("agg_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot_status(w):
    out = w.table("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return out.na.fill(0)


@query("SELECT l_orderkey, measure, round(sum(v), 2) AS v FROM (SELECT l_orderkey, 'l_quantity' AS measure, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, 'l_tax', nullif(l_tax, 0) FROM lineitem) WHERE v IS NOT NULL GROUP BY ALL")
def unpivot_measures(w):
    out = w.table("lineitem").select("l_orderkey", "l_quantity", F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax")).unpivot(["l_orderkey"], ["l_quantity", "l_tax"], "measure", "v")
    return out.filter("v IS NOT NULL").groupBy("l_orderkey", "measure").agg(F.round(F.sum("v"), 2).alias("v"))


# --- windows ---

_O = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
sql("win_row_number_topn", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) t WHERE rn <= 3")
sql("win_rank_dense", "SELECT s_suppkey, cast(rank() OVER (ORDER BY s_nationkey) AS bigint) AS r, cast(dense_rank() OVER (ORDER BY s_nationkey) AS bigint) AS d FROM {supplier}")
sql("win_ntile", "SELECT s_suppkey, cast(ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS bigint) AS q FROM {supplier}")
sql("win_lag_lead", f"SELECT o_orderkey, lag(o_orderkey, 1, -1) {_O} AS before, lead(o_orderkey, 2) {_O} AS after FROM {{orders}}", f"SELECT o_orderkey, lag(o_orderkey, 1, -1) {_O} AS before, lead(o_orderkey, 2) {_O} AS after FROM {{orders}}")
sql("win_first_last_ignore_nulls", f"SELECT o_orderkey, first_value(nullif(o_orderstatus, 'O')) IGNORE NULLS {_O} AS f, last_value(nullif(o_orderstatus, 'O')) IGNORE NULLS {_O} AS l FROM {{orders}}", f"SELECT o_orderkey, first_value(nullif(o_orderstatus, 'O') IGNORE NULLS) {_O} AS f, last_value(nullif(o_orderstatus, 'O') IGNORE NULLS) {_O} AS l FROM {{orders}}")
sql("win_nth_value", f"SELECT o_orderkey, nth_value(o_orderkey, 2) {_O} AS second FROM {{orders}}")
sql("win_cume_percent", "SELECT s_suppkey, round(cume_dist() OVER (ORDER BY s_nationkey), 6) AS c, round(percent_rank() OVER (ORDER BY s_nationkey), 6) AS p FROM {supplier}")
sql("win_ratio_to_report", "SELECT s_suppkey, round(RATIO_TO_REPORT(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS r FROM {supplier}", "SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS r FROM {supplier}")
sql("win_running_total", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 2) AS total FROM {events}")
sql("win_moving_avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS m FROM {events}")
sql("win_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY cast(o_totalprice AS int) RANGE BETWEEN 10000 PRECEDING AND 10000 FOLLOWING) AS near FROM {orders}")
sql("win_duplicates", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM {lineitem}) t WHERE n > 1")

# --- set operations, limits, hierarchies, generators ---

sql("set_union", "SELECT s_nationkey AS k FROM {supplier} UNION SELECT c_nationkey FROM {customer}")
sql("set_union_all", "SELECT k, count(*) AS n FROM (SELECT s_nationkey AS k FROM {supplier} UNION ALL SELECT c_nationkey FROM {customer}) t GROUP BY k")
sql("set_intersect", "SELECT o_custkey AS k FROM {orders} INTERSECT SELECT c_custkey FROM {customer} WHERE c_custkey % 2 = 0")
sql("set_minus", "SELECT c_custkey AS k FROM {customer} MINUS SELECT o_custkey FROM {orders} WHERE o_orderkey % 3 = 0", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderkey % 3 = 0")
sql("limit_rownum", "SELECT * FROM (SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey) WHERE ROWNUM <= 25", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql("limit_with_ties", "SELECT p_partkey, p_size FROM {part} ORDER BY p_size DESC FETCH FIRST 10 ROWS WITH TIES", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 10")
sql("limit_percent", "SELECT p_partkey, p_size FROM {part} ORDER BY p_size DESC, p_partkey FETCH FIRST 5 PERCENT ROWS ONLY", "SELECT p_partkey, p_size FROM part QUALIFY row_number() OVER (ORDER BY p_size DESC, p_partkey) <= ceil(count(*) OVER () * 5 / 100)")
sql("limit_offset_fetch", "SELECT o_orderkey FROM {orders} ORDER BY o_totalprice DESC, o_orderkey OFFSET 20 ROWS FETCH NEXT 30 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 20")
sql("limit_rownum_paging", "SELECT * FROM (SELECT x.o_orderkey, ROWNUM AS rn FROM (SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey) x WHERE ROWNUM <= 40) WHERE rn > 20", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders QUALIFY rn BETWEEN 21 AND 40")
sql("limit_rownum_in_union", "SELECT o_orderkey AS k, 'o' AS t FROM {orders} WHERE o_orderkey < 20 UNION ALL SELECT c_custkey, 'c' FROM (SELECT c_custkey FROM {customer} ORDER BY c_custkey DESC) WHERE ROWNUM <= 5 ORDER BY k", "SELECT o_orderkey AS k, 'o' AS t FROM orders WHERE o_orderkey < 20 UNION ALL (SELECT c_custkey, 'c' FROM customer ORDER BY c_custkey DESC LIMIT 5)")
sql("limit_rownum_grouped", "SELECT s_nationkey, count(*) AS n FROM (SELECT s_nationkey FROM {supplier} ORDER BY s_suppkey) WHERE s_nationkey >= 0 AND ROWNUM < 9 GROUP BY s_nationkey", "SELECT s_nationkey, count(*) AS n FROM (SELECT s_nationkey FROM supplier ORDER BY s_suppkey LIMIT 8) GROUP BY s_nationkey")
sql("order_nulls_default", "SELECT c_custkey, segment FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM {customer}) ORDER BY segment DESC, c_custkey FETCH FIRST 30 ROWS ONLY", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer ORDER BY segment DESC NULLS FIRST, c_custkey LIMIT 30")
sql("order_nulls_in_windows", "SELECT c_custkey, cast(row_number() OVER (PARTITION BY c_nationkey ORDER BY nullif(c_mktsegment, 'BUILDING'), c_custkey) AS bigint) AS up, cast(row_number() OVER (PARTITION BY c_nationkey ORDER BY nullif(c_mktsegment, 'BUILDING') DESC, c_custkey) AS bigint) AS down FROM {customer}", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY nullif(c_mktsegment, 'BUILDING') NULLS LAST, c_custkey) AS up, row_number() OVER (PARTITION BY c_nationkey ORDER BY nullif(c_mktsegment, 'BUILDING') DESC NULLS FIRST, c_custkey) AS down FROM customer")
sql("dual_row", "SELECT 1 + 1 AS two, d.dummy AS x FROM dual d UNION ALL SELECT 3, dummy FROM DUAL WHERE 1 = 1", "SELECT 2 AS two, 'X' AS x UNION ALL SELECT 3, 'X'")
sql("row_generator_connect_by", "SELECT LEVEL AS n, LEVEL * 2 AS twice FROM dual CONNECT BY LEVEL <= 50", "SELECT range AS n, range * 2 AS twice FROM range(1, 51)")
sql("hier_path", "SELECT k, LEVEL AS lvl, SYS_CONNECT_BY_PATH(name, '/') AS path FROM (SELECT concat('r', r_regionkey) AS k, '' AS parent, r_name AS name FROM {region} UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name FROM {nation}) START WITH parent = '' CONNECT BY PRIOR k = parent", "SELECT 'r' || r_regionkey AS k, 1 AS lvl, '/' || r_name AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 2, '/' || r_name || '/' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey")
sql("hier_level_leaf", "SELECT lvl, count(*) AS n FROM (WITH RECURSIVE h AS (SELECT r_regionkey AS k, 1 AS lvl FROM {region} UNION ALL SELECT n.n_nationkey, h.lvl + 1 FROM {nation} n JOIN h ON n.n_regionkey = h.k AND h.lvl = 1) SELECT k, lvl FROM h) t GROUP BY lvl", "SELECT 1 AS lvl, count(*) AS n FROM region UNION ALL SELECT 2, count(*) FROM nation")


@query("WITH d AS (SELECT min(ts)::DATE a, max(ts)::DATE b FROM events) SELECT g.day::DATE AS day, count(e.event_id) AS n FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS day FROM d) g LEFT JOIN events e ON e.ts::DATE = g.day::DATE GROUP BY 1")
def row_generator_calendar_fill(w):
    e = w.table("events").select(F.to_date("ts").alias("day"))
    days = e.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(e.groupBy("day").agg(F.count("*").alias("n")), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT k, CASE WHEN a AND b THEN 'both' WHEN a THEN 'a_only' ELSE 'b_only' END AS side FROM (SELECT k, bool_or(t = 'a') a, bool_or(t = 'b') b FROM (SELECT o_custkey k, 'a' t FROM orders UNION ALL SELECT c_custkey, 'b' FROM customer) GROUP BY k)")
def set_three_way_partition(w):
    return graph.three_way(w.table("orders").select(F.col("o_custkey").alias("k")), w.table("customer").select(F.col("c_custkey").alias("k")), "k")


# --- functions of the dialect ---

sql("concat_null_sql", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') || nullif(c_nationkey, 3) || '-' AS a, nullif(c_mktsegment, 'BUILDING') || nullif(c_mktsegment, 'BUILDING') AS b FROM {customer}", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), '') || coalesce(nullif(c_nationkey, 3)::VARCHAR, '') || '-' AS a, nullif(c_mktsegment, 'BUILDING') || nullif(c_mktsegment, 'BUILDING') AS b FROM customer")
sql("to_char_date_sql", "SELECT o_orderkey, TO_CHAR(o_orderdate, 'YYYY-MM-DD HH24:MI:SS') AS a, TO_CHAR(o_orderdate, 'DD/MM/YY') AS b, TO_CHAR(o_orderdate + 1.5, 'YYYYMMDD\"T\"HH24MI') AS c, TO_CHAR(o_orderdate, 'Q') AS q FROM {orders}", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS a, strftime(o_orderdate, '%d/%m/%y') AS b, strftime(o_orderdate + INTERVAL 36 HOUR, '%Y%m%dT%H%M') AS c, quarter(o_orderdate)::VARCHAR AS q FROM orders")
sql("to_char_number_sql", "SELECT p_partkey, TO_CHAR(p_retailprice, 'FM99990.00') AS a, TO_CHAR(p_size, '000') AS b, TO_CHAR(p_partkey) AS c, TO_CHAR(p_retailprice * 1000, 'FM9,999,999,990') AS d FROM {part}", "SELECT p_partkey, format('{:.2f}', p_retailprice) AS a, ' ' || lpad(p_size::VARCHAR, 3, '0') AS b, p_partkey::VARCHAR AS c, format('{:,}', round(p_retailprice * 1000)::BIGINT) AS d FROM part")
sql("to_date_sql", "SELECT o_orderkey, TO_DATE(TO_CHAR(o_orderdate, 'DD.MM.YYYY'), 'DD.MM.YYYY') - TO_DATE('1995-01-01', 'YYYY-MM-DD') AS days, TO_NUMBER('1,234.5', '9,999.9') AS n FROM {orders}", "SELECT o_orderkey, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS days, 1234.5::DECIMAL(5, 1) AS n FROM orders")
sql("date_trunc_round_sql", "SELECT event_id, TRUNC(ts) AS d, TRUNC(ts, 'MM') AS m, TRUNC(ts, 'Q') AS q, TRUNC(ts, 'IW') AS w, TRUNC(ts, 'HH24') AS h, ROUND(ts) AS rd, ROUND(ts, 'MM') AS rm, ROUND(ts, 'YYYY') AS ry FROM {events}", "SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS d, date_trunc('month', ts)::TIMESTAMP AS m, date_trunc('quarter', ts)::TIMESTAMP AS q, date_trunc('week', ts)::TIMESTAMP AS w, date_trunc('hour', ts) AS h, date_trunc('day', ts + INTERVAL 12 HOUR)::TIMESTAMP AS rd, (date_trunc('month', ts) + CASE WHEN day(ts) >= 16 THEN INTERVAL 1 MONTH ELSE INTERVAL 0 MONTH END)::TIMESTAMP AS rm, (date_trunc('year', ts) + CASE WHEN month(ts) >= 7 THEN INTERVAL 1 YEAR ELSE INTERVAL 0 YEAR END)::TIMESTAMP AS ry FROM events")
sql("date_arithmetic_sql", "SELECT event_id, round(ts - TRUNC(ts), 6) AS part_of_day, ts - 7 AS week_before, ts + 1 / 24 AS hour_later, ts + NUMTODSINTERVAL(30, 'MINUTE') AS half, (ts + INTERVAL '2' DAY) - ts AS two FROM {events}", "SELECT event_id, round(epoch_us(ts - date_trunc('day', ts)::TIMESTAMP) / 86400000000, 6) AS part_of_day, ts - INTERVAL 7 DAY AS week_before, ts + INTERVAL 1 HOUR AS hour_later, ts + INTERVAL 30 MINUTE AS half, 2.0::DOUBLE AS two FROM events")
sql("instr_sql", "SELECT c_custkey, INSTR(c_name, '0', 1, 3) AS third, INSTR(c_name, '0', 12) AS late, INSTR(c_name, '0', -1) AS last, INSTR(c_name, 'zz', 1, 2) AS none FROM {customer}", "SELECT c_custkey, coalesce(list_filter(range(1, len(c_name) + 1), lambda i: c_name[i] = '0')[3], 0)::INT AS third, coalesce(list_filter(range(12, len(c_name) + 1), lambda i: c_name[i] = '0')[1], 0)::INT AS late, coalesce(list_filter(range(1, len(c_name) + 1), lambda i: c_name[i] = '0')[-1], 0)::INT AS last, 0 AS none FROM customer")
sql("regexp_substr_sql", "SELECT c_custkey, REGEXP_SUBSTR(c_name, '[[:digit:]]') AS first, REGEXP_SUBSTR(c_name, '[1-9]', 1, 2) AS second, REGEXP_SUBSTR(c_name, 'CUSTOMER#(\\d+)', 1, 1, 'i', 1) AS grp, REGEXP_REPLACE(c_name, '(\\w+)#0*', '\\1:') AS re, REGEXP_INSTR(c_name, '[1-9]') AS at, REGEXP_COUNT(c_name, '0', 12) AS late FROM {customer}", "SELECT c_custkey, regexp_extract_all(c_name, '[0-9]')[1] AS first, regexp_extract_all(c_name, '[1-9]')[2] AS second, regexp_extract(c_name, '#([0-9]+)', 1) AS grp, regexp_replace(c_name, '(\\w+)#0*', '\\1:') AS re, coalesce(list_filter(range(1, len(c_name) + 1), lambda i: c_name[i] >= '1' AND c_name[i] <= '9')[1], 0)::INT AS at, len(regexp_extract_all(substr(c_name, 12), '0'))::INT AS late FROM customer")
sql("win_stddev_over", "SELECT s_suppkey, round(STDDEV(s_acctbal) OVER (PARTITION BY s_nationkey), 4) AS sd, round(VARIANCE(s_acctbal) OVER (PARTITION BY s_nationkey), 2) AS v FROM {supplier}", "SELECT s_suppkey, round(CASE WHEN n = 1 THEN 0 ELSE sd END, 4) AS sd, round(CASE WHEN n = 1 THEN 0 ELSE v END, 2) AS v FROM (SELECT s_suppkey, count(*) OVER p AS n, stddev_samp(s_acctbal) OVER p AS sd, var_samp(s_acctbal) OVER p AS v FROM supplier WINDOW p AS (PARTITION BY s_nationkey))")
sql("null_functions_sql", "SELECT c_custkey, LNNVL(nullif(c_nationkey, 3) > 10) AS l, NANVL(c_acctbal, 0) AS nan, REMAINDER(c_custkey, 7) AS r, NULLIF(c_nationkey, 3) AS n FROM {customer}", "SELECT c_custkey, NOT coalesce(nullif(c_nationkey, 3) > 10, false) AS l, c_acctbal AS nan, (c_custkey - 7 * round_even(c_custkey / 7.0, 0))::DOUBLE AS r, nullif(c_nationkey, 3) AS n FROM customer")
sql("bytes_and_hex_sql", "SELECT c_custkey, LENGTHB(c_name || 'é') AS n, RAWTOHEX('AZ') AS h, SUBSTRB(c_name, 1, 4) AS s, ASCIISTR('é' || c_nationkey) AS a, UNISTR('\\00e9') AS u, ORA_HASH(c_custkey, 0) AS z FROM {customer}", "SELECT c_custkey, (strlen(c_name) + 2)::INT AS n, '415A' AS h, substr(c_name, 1, 4) AS s, '\\00E9' || c_nationkey AS a, 'é' AS u, 0::BIGINT AS z FROM customer")
sql("json_suite_sql", "SELECT event_id, JSON_VALUE(props, '$.k' RETURNING NUMBER) AS k, JSON_OBJECT('id' VALUE event_id, 'kind' VALUE event_type) AS o FROM {events}", "SELECT event_id, json_extract_string(props, '$.k')::DECIMAL(38, 10) AS k, json_object('id', event_id, 'kind', event_type)::VARCHAR AS o FROM events")
sql("xml_extract_sql", "SELECT n_nationkey, EXTRACTVALUE('<n><name>' || n_name || '</name></n>', '/n/name') AS x FROM {nation}", "SELECT n_nationkey, n_name AS x FROM nation")
sql("cast_types_sql", "SELECT c_custkey, CAST(c_acctbal AS NUMBER(12, 1)) AS a, CAST(c_custkey AS VARCHAR2(10)) AS b, TO_NUMBER('7') AS c FROM {customer}", "SELECT c_custkey, c_acctbal::DECIMAL(12, 1) AS a, c_custkey::VARCHAR AS b, 7::DECIMAL(38, 10) AS c FROM customer")
sql("join_outer_chain", "SELECT c.c_custkey, o.o_orderkey, l.l_linenumber FROM {customer} c, {orders} o, {lineitem} l WHERE l.l_orderkey(+) = o.o_orderkey AND l.l_quantity(+) > 45 AND o.o_custkey(+) = c.c_custkey AND o.o_orderstatus(+) = 'F' AND c.c_custkey BETWEEN 10 AND 200 ORDER BY c.c_custkey", "SELECT c.c_custkey, o.o_orderkey, l.l_linenumber FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_quantity > 45 WHERE c.c_custkey BETWEEN 10 AND 200")
sql("join_outer_in_union", "SELECT c.c_custkey AS k, count(o.o_orderkey) AS n FROM {customer} c, {orders} o WHERE c.c_custkey = o.o_custkey(+) AND o.o_orderstatus(+) = 'P' GROUP BY c.c_custkey UNION ALL SELECT -n_nationkey, 0 FROM {nation}", "SELECT c.c_custkey AS k, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P' GROUP BY c.c_custkey UNION ALL SELECT -n_nationkey, 0 FROM nation")
sql("join_apply", "SELECT n.n_name, t.c_custkey FROM {nation} n OUTER APPLY (SELECT c.c_custkey FROM {customer} c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000 ORDER BY c.c_acctbal DESC, c.c_custkey FETCH FIRST 1 ROWS ONLY) t", "SELECT n.n_name, t.c_custkey FROM nation n LEFT JOIN LATERAL (SELECT c.c_custkey FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000 ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 1) t ON true")
sql("pivot_sql", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus FROM {orders}) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
sql("unpivot_sql", "SELECT l_orderkey, l_linenumber, measure, v FROM (SELECT l_orderkey, l_linenumber, l_quantity, nullif(l_tax, 0) AS l_tax FROM {lineitem}) UNPIVOT (v FOR measure IN (l_quantity AS 'q', l_tax AS 't'))", "SELECT l_orderkey, l_linenumber, 'q' AS measure, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 't', l_tax FROM lineitem WHERE l_tax <> 0")
sql("hier_siblings", "SELECT k, LEVEL AS lvl, CONNECT_BY_ROOT name AS top, CONNECT_BY_ISLEAF AS leaf, SYS_CONNECT_BY_PATH(name, '/') AS path FROM (SELECT concat('r', r_regionkey) AS k, cast(NULL AS string) AS parent, r_name AS name FROM {region} UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name FROM {nation}) t WHERE LEVEL < 3 START WITH parent IS NULL CONNECT BY NOCYCLE PRIOR t.k = t.parent ORDER SIBLINGS BY name", "SELECT 'r' || r_regionkey AS k, 1 AS lvl, r_name AS top, CASE WHEN r_regionkey IN (SELECT n_regionkey FROM nation) THEN 0 ELSE 1 END AS leaf, '/' || r_name AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 2, r_name, 1, '/' || r_name || '/' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey")
sql("hier_deep_chain", "SELECT o_orderkey AS k, LEVEL AS lvl FROM (SELECT o_orderkey FROM {orders} WHERE o_orderkey <= 130) t START WITH o_orderkey = 0 CONNECT BY o_orderkey = PRIOR o_orderkey + 1", "SELECT o_orderkey AS k, (o_orderkey + 1)::INT AS lvl FROM orders WHERE o_orderkey <= 130")


@query("SELECT c_custkey, segment IS NULL AS none, coalesce(segment, 'x') AS filled FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS segment FROM customer)")
def empty_string_is_null(w):
    return w.sql("SELECT c_custkey, segment IS NULL AS none, NVL(segment, 'x') AS filled FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS segment FROM {customer})", empty_is_null=True)


sql("decode_null", "SELECT c_custkey, DECODE(nullif(c_mktsegment, 'BUILDING'), 'MACHINERY', 'm', NULL, 'none', 'other') AS d, NVL(nullif(c_mktsegment, 'BUILDING'), '-') AS n, NVL2(nullif(c_mktsegment, 'BUILDING'), 1, 0) AS n2 FROM {customer}", "SELECT c_custkey, CASE WHEN s = 'MACHINERY' THEN 'm' WHEN s IS NULL THEN 'none' ELSE 'other' END AS d, coalesce(s, '-') AS n, CASE WHEN s IS NULL THEN 0 ELSE 1 END AS n2 FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') s FROM {customer})")
sql("greatest_null", "SELECT c_custkey, GREATEST(c_nationkey, nullif(c_custkey % 3, 0)) AS g, LEAST(c_nationkey, nullif(c_custkey % 3, 0)) AS l FROM {customer}", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN greatest(c_nationkey, c_custkey % 3) END AS g, CASE WHEN c_custkey % 3 <> 0 THEN least(c_nationkey, c_custkey % 3) END AS l FROM {customer}")
sql("number_suite", "SELECT p_partkey, round(p_retailprice, 1) AS r, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, TRUNC(p_retailprice, 1) AS t, MOD(p_partkey, p_size % 3) AS m, BITAND(p_size, 6) AS b, sign(p_size - 25) AS s, round(power(p_size, 2), 0) AS p, round(sqrt(p_size), 6) AS q, round(ln(p_size + 1), 6) AS ln FROM {part}", "SELECT p_partkey, round(p_retailprice, 1) AS r, ceil(p_retailprice)::BIGINT AS c, floor(p_retailprice)::BIGINT AS f, floor(p_retailprice * 10.0::DOUBLE) / 10.0::DOUBLE AS t, CASE WHEN p_size % 3 = 0 THEN p_partkey ELSE p_partkey % (p_size % 3) END AS m, p_size & 6 AS b, sign(p_size - 25)::DOUBLE AS s, round(power(p_size, 2), 0) AS p, round(sqrt(p_size), 6) AS q, round(ln(p_size + 1), 6) AS ln FROM {part}")
sql("str_suite", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS lo, initcap(lower(c_mktsegment)) AS ic, substr(c_name, 2, 4) AS s, length(c_name) AS n, lpad(cast(c_custkey AS string), 8, '0') AS lp, rpad(c_mktsegment, 4, '*') AS rp, replace(c_name, '0', 'o') AS re, translate(c_name, '01', 'xy') AS tr, instr(c_name, '#') AS i, reverse(c_mktsegment) AS rv, ascii(c_mktsegment) AS a, ltrim(rtrim(concat(' ', c_name, ' '))) AS t FROM {customer}", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS lo, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS ic, substr(c_name, 2, 4) AS s, length(c_name)::INT AS n, lpad(c_custkey::VARCHAR, 8, '0') AS lp, rpad(c_mktsegment, 4, '*') AS rp, replace(c_name, '0', 'o') AS re, translate(c_name, '01', 'xy') AS tr, instr(c_name, '#')::INT AS i, reverse(c_mktsegment) AS rv, ascii(c_mktsegment) AS a, c_name AS t FROM {customer}")
sql("regexp_suite", "SELECT c_custkey, REGEXP_LIKE(c_name, '[0-9]*7$') AS l, regexp_replace(c_name, '[0-9]+', '<n>') AS r, regexp_count(c_name, '0') AS n FROM {customer}", "SELECT c_custkey, regexp_matches(c_name, '[0-9]*7$') AS l, regexp_replace(c_name, '[0-9]+', '<n>', 'g') AS r, len(regexp_extract_all(c_name, '0'))::INT AS n FROM {customer}")
sql("date_suite", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, last_day(o_orderdate) AS ld, extract(year FROM o_orderdate) AS y, cast(quarter(o_orderdate) AS int) AS q, datediff(o_orderdate, DATE '1995-01-01') AS days FROM {orders}", "SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS m, last_day(o_orderdate) AS ld, extract(year FROM o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS days FROM {orders}")


@query("SELECT o_orderkey, CASE WHEN o_orderdate::DATE = last_day(o_orderdate) THEN last_day(o_orderdate::DATE + INTERVAL 1 MONTH) ELSE (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE END AS next_month FROM orders")
def add_months_eom(w):
    return w.table("orders").select("o_orderkey", D.add_months(F.to_date("o_orderdate"), 1).alias("next_month"))


@query("SELECT o_orderkey, CASE WHEN last_day(d) = d AND last_day(r) = r OR day(d) = day(r) THEN (year(d) - year(r)) * 12 + month(d) - month(r) ELSE round((year(d) - year(r)) * 12 + month(d) - month(r) + (day(d) - day(r)) / 31.0, 6) END::DOUBLE AS months FROM (SELECT o_orderkey, o_orderdate::DATE d, DATE '1994-03-31' r FROM orders)")
def months_between_suite(w):
    return w.table("orders").select("o_orderkey", F.round(D.months_between(F.to_date("o_orderdate"), F.lit("1994-03-31").cast("date")), 6).alias("months"))


@query("SELECT c_custkey, nullif(coalesce(nullif(c_mktsegment, 'BUILDING'), '') || coalesce(nullif(c_nationkey, 3)::VARCHAR, ''), '') AS joined FROM customer")
def concat_null(w):
    return w.table("customer").select("c_custkey", D.concat(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.nullif(F.col("c_nationkey"), F.lit(3))).alias("joined"))


@query("SELECT c_custkey, strftime(TIMESTAMP '2020-01-01' + to_days(c_custkey::INT), '%Y/%m/%d') AS shown, regexp_extract_all(c_name, '[0-9]')[2] AS second FROM customer")
def to_char_and_nth_match(w):
    day = F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(cast(c_custkey AS int))")
    return w.table("customer").select("c_custkey", D.to_char(day, "YYYY/MM/DD").alias("shown"), D.regexp_substr(F.col("c_name"), "[0-9]", 2).alias("second"))


sql("json_extract_props", "SELECT event_id, cast(JSON_VALUE(props, '$.k') AS int) AS k FROM {events}", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM {events}")

# --- movement ---


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F') AND o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def copy_replace_where(w):
    o = w.table("orders").select("o_orderkey", "o_orderstatus")
    return move.replace_where(o.filter("o_orderkey % 2 = 0"), o, F.col("o_orderstatus") == "F")


_MERGE = "t AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), s AS (SELECT c_custkey, c_name, c_acctbal + 100 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)"


@query(f"WITH {_MERGE} SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey, coalesce(s.c_name, t.c_name) AS c_name, round(CASE WHEN s.c_custkey IS NOT NULL THEN s.c_acctbal ELSE t.c_acctbal END, 2) AS c_acctbal FROM t FULL JOIN s ON t.c_custkey = s.c_custkey")
def copy_merge_upsert(w):
    c = w.table("customer").select("c_custkey", "c_name", "c_acctbal")
    out = move.merge(c.filter("c_custkey % 3 <> 0"), c.filter("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 100), ["c_custkey"])
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT * FROM (VALUES ('c_custkey', 'copy', ''), ('c_name', 'copy', ''), ('c_since', 'dst_only', 'not null without a value'), ('c_acctbal', 'copy', 'number to text'), ('c_nationkey', 'src_only', ''), ('c_mktsegment', 'src_only', '')) t(column_name, status, note)")
def copy_plan_columns(w):
    target = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("C_NAME", T.StringType()), T.StructField("c_since", T.TimestampNTZType(), False), T.StructField("c_acctbal", T.StringType())])
    plan = [(c.lower(), s, n) for c, s, n in move.column_plan(w.table("customer").schema, target)]
    return w.spark.createDataFrame(plan, "column_name string, status string, note string")


@query("SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1 HAVING count(*) > 1")
def merge_check_dup_match(w):
    return move.matched_twice(w.table("customer").filter("c_custkey % 2 = 0"), w.table("orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1 HAVING count(*) > 1")
def merge_check_dup_insert_key(w):
    return move.inserted_twice(w.table("customer").filter("c_custkey % 2 = 0"), w.table("orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


sql("dml_affected_count", "SELECT count(*) AS n FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice < 50000")


def _changes(w):
    """Updates, deletes, inserts, and some of each that must be refused."""
    o = w.table("orders").select("o_orderkey", "o_orderstatus")
    changes = o.filter("o_orderkey % 6 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit("update").alias("op"))
    changes = changes.union(o.filter("o_orderkey % 10 = 0 AND o_orderkey % 6 <> 0").withColumn("op", F.lit("delete")))
    changes = changes.union(o.filter("o_orderkey % 1000 = 1").select(-F.col("o_orderkey"), F.lit("N"), F.lit("insert")))
    changes = changes.union(o.filter("o_orderkey % 100 = 7").select(F.col("o_orderkey") + 10**9, F.lit("Y"), F.lit("update")))
    return o, changes.union(o.filter("o_orderkey % 100 = 9").withColumn("op", F.lit("insert")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0 OR o_orderkey % 6 = 0 UNION ALL SELECT -o_orderkey, 'N' FROM orders WHERE o_orderkey % 1000 = 1")
def grid_apply_changes(w):
    return move.apply_changes(*_changes(w), ["o_orderkey"])[0]


@query("SELECT o_orderkey + 1000000000 AS o_orderkey, 'update' AS op, 'missing' AS reason FROM orders WHERE o_orderkey % 100 = 7 UNION ALL SELECT o_orderkey, 'insert', 'exists' FROM orders WHERE o_orderkey % 100 = 9")
def grid_change_rejects(w):
    return move.apply_changes(*_changes(w), ["o_orderkey"])[1].select("o_orderkey", "op", "reason")


_COPY = "t AS (SELECT c_custkey, c_name, c_nationkey, NULL::VARCHAR AS note FROM customer WHERE c_custkey % 3 = 0), s AS (SELECT c_custkey, c_name || '!' AS c_name, CASE WHEN c_custkey % 50 = 1 THEN 'n/a' ELSE c_nationkey::VARCHAR END AS c_nationkey FROM customer WHERE c_custkey % 2 = 1)"


def _copy(w):
    c = w.table("customer").select("c_custkey", "c_name", "c_nationkey")
    source = c.filter("c_custkey % 2 = 1").select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), F.when(F.col("c_custkey") % 50 == 1, "n/a").otherwise(F.col("c_nationkey").cast("string")).alias("c_nationkey"))
    return source, c.filter("c_custkey % 3 = 0").withColumn("note", F.lit(None).cast("string"))


@query(f"WITH {_COPY} SELECT * FROM t UNION ALL SELECT c_custkey, c_name, c_nationkey::INT, NULL FROM s WHERE c_nationkey <> 'n/a' AND c_custkey > 5")
def copy_append(w):
    source, target = _copy(w)
    return move.copy(source, target, move.plan_copy(source, target, condition="c_custkey > 5"), "c_custkey > 5")[0]


@query(f"WITH {_COPY} SELECT c_custkey, 'c_nationkey' AS errors FROM s WHERE c_nationkey = 'n/a'")
def copy_rejects(w):
    source, target = _copy(w)
    return move.copy(source, target, move.plan_copy(source, target))[1].select("c_custkey", F.array_join("errors", ",").alias("errors"))


@query(f"WITH {_COPY} SELECT * FROM t WHERE NOT c_custkey > 50 UNION ALL SELECT c_custkey, c_name, c_nationkey::INT, NULL FROM s WHERE c_nationkey <> 'n/a' AND c_custkey > 50")
def copy_replace(w):
    source, target = _copy(w)
    return move.copy(source, target, move.plan_copy(source, target, "replace", condition="c_custkey > 50"), "c_custkey > 50")[0]


@query(f"WITH {_COPY}, g AS (SELECT * FROM s WHERE c_nationkey <> 'n/a') SELECT coalesce(g.c_custkey, t.c_custkey) AS c_custkey, coalesce(g.c_name, t.c_name) AS c_name, coalesce(g.c_nationkey::INT, t.c_nationkey) AS c_nationkey, t.note FROM t FULL JOIN g ON g.c_custkey = t.c_custkey")
def copy_merge_typed(w):
    source, target = _copy(w)
    return move.copy(source, target, move.plan_copy(source, target, "merge", ["C_CUSTKEY"]))[0]


@query("SELECT 'big' AS target, o_orderkey AS k FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT 'open', o_orderkey FROM orders WHERE o_totalprice <= 300000 AND o_orderstatus = 'O' UNION ALL SELECT 'rest', o_orderkey FROM orders WHERE o_totalprice <= 300000 AND o_orderstatus <> 'O'")
def insert_first(w):
    made = move.insert_branches(w.table("orders"), [("big", F.col("o_totalprice") > 300000, {"k": F.col("o_orderkey")}), ("open", F.col("o_orderstatus") == "O", {"k": F.col("o_orderkey")}), ("rest", None, {"k": F.col("o_orderkey")})], first=True)
    out = [df.select(F.lit(t).alias("target"), "k") for t, df in made.items()]
    return out[0].union(out[1]).union(out[2])


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN n ELSE NULL END AS c_name FROM (SELECT c_custkey, n_name || '/' || c_custkey AS n FROM customer JOIN nation ON n_nationkey = c_nationkey)")
def update_from_query(w):
    c = w.table("customer").select("c_custkey", "c_name")
    source = w.table("customer").filter("c_custkey % 2 = 0").join(w.table("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.concat_ws("/", "n_name", F.col("c_custkey").cast("string")).alias("c_name"))
    return move.correlated_update(c, source, ["c_custkey"], ["c_name"])[0]


@query("WITH t AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), s AS (SELECT c_custkey, c_acctbal - 5000 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0) SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM (SELECT t.* FROM t ANTI JOIN s USING (c_custkey) UNION ALL SELECT s.* FROM s ANTI JOIN t USING (c_custkey) UNION ALL SELECT s.* FROM s SEMI JOIN t USING (c_custkey) WHERE NOT s.c_acctbal < 0)")
def merge_with_delete(w):
    c = w.table("customer").select("c_custkey", "c_acctbal")
    out = move.merge_delete(c.filter("c_custkey % 3 <> 0"), c.filter("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") - 5000), ["c_custkey"], F.col("c_acctbal") < 0)
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT 'UPDATE nation SET n_name = ''' || n_name || ''', n_regionkey = ' || n_regionkey || ' WHERE n_nationkey = ' || n_nationkey || ';' AS line FROM nation WHERE n_regionkey = 1")
def undo_update_script(w):
    return move.undo_script(w.table("nation").filter("n_regionkey = 1"), "nation", ["n_nationkey"], "update")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_wins(w):
    return move.latest(w.table("events"), ["user_id"], [F.col("event_id").desc()]).select("user_id", "event_id")


# --- text in and out ---

_PRICES = "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'n/a' WHEN p_partkey % 9 = 1 THEN '' ELSE '$ ' || (p_size * 1234)::VARCHAR || ',5' END AS price FROM part"


def _prices(w):
    price = F.when(F.col("p_partkey") % 9 == 0, "n/a").when(F.col("p_partkey") % 9 == 1, "").otherwise(F.concat(F.lit("$ "), (F.col("p_size") * 1234).cast("string"), F.lit(",5")))
    return w.table("part").select("p_partkey", price.alias("price"))


@query(f"SELECT p_partkey, nullif(replace(replace(replace(price, ',', ''), '$', ''), ' ', ''), '') AS cleaned FROM ({_PRICES})")
def import_clean_numbers(w):
    return _prices(w).select("p_partkey", text_io.clean_number(F.col("price")).alias("cleaned"))


@query(f"SELECT count(*) FILTER (WHERE price <> 'n/a') AS good, count(*) FILTER (WHERE price = 'n/a') AS rejected FROM ({_PRICES})")
def import_reject_split(w):
    text = _prices(w).select(F.col("p_partkey").cast("string").alias("p_partkey"), "price")
    good, bad = text_io.typed(text, T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("price", T.DecimalType(18, 2))]))
    return good.agg(F.count("*").alias("good")).join(bad.agg(F.count("*").alias("rejected")))


_FORMATTED = "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%Y%m%d') AS b, strftime(ts, '%Y/%-m/%-d') AS c, strftime(ts, '%Y-%m-%d %-H:%M') AS d, strftime(ts, '%Y.%m.%d') AS e, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS f FROM events"
_GUESS = "SELECT '{0}' AS name, CASE WHEN bool_and(regexp_matches({0}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}$')) THEN 'YYYY-MM-DD HH24:MI:SS' WHEN bool_and(regexp_matches({0}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}[.][0-9]+$')) THEN 'YYYY-MM-DD HH24:MI:SS.FF' WHEN bool_and(regexp_matches({0}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{1,2}}:[0-9]{{2}}$')) THEN 'YYYY-MM-DD HH24:MI' WHEN bool_and(regexp_matches({0}, '^[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}$')) THEN 'YYYY/MM/DD' WHEN bool_and(regexp_matches({0}, '^[0-9]{{4}}[.][0-9]{{1,2}}[.][0-9]{{1,2}}$')) THEN 'YYYY.MM.DD' WHEN bool_and(regexp_matches({0}, '^[0-9]{{8}}$')) THEN 'YYYYMMDD' END AS format FROM x"


@query(f"WITH x AS ({_FORMATTED}) " + " UNION ALL ".join(_GUESS.format(c) for c in "abcdef"))
def date_format_inference(w):
    shown = {"a": "yyyy-MM-dd HH:mm:ss", "b": "yyyyMMdd", "c": "yyyy/M/d", "d": "yyyy-MM-dd H:mm", "e": "yyyy.MM.dd", "f": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    e = w.table("events").select(*[F.date_format("ts", p).alias(c) for c, p in shown.items()])
    return w.spark.createDataFrame(list(text_io.date_formats(e, list(shown)).items()), "name string, format string")


@query("SELECT event_id, date_trunc('minute', ts) AS read FROM events")
def import_dates_of_one_digit(w):
    text = w.table("events").select(F.col("event_id").cast("string").alias("event_id"), F.date_format("ts", "yyyy-MM-dd H:mm").alias("read"))
    kinds = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("read", T.TimestampNTZType())])
    return text_io.typed(text, kinds, {"read": text_io.date_format(text, "read")})[0]


@query("SELECT c_custkey, c_custkey || ',' || chr(34) || c_name || ', ' || repeat(chr(34), 2) || 'x' || repeat(chr(34), 3) || ',' || c_mktsegment AS line FROM customer")
def export_csv_lines(w):
    c = w.table("customer").select("c_custkey", F.concat("c_name", F.lit(', "x"')).alias("c_name"), "c_mktsegment")
    return c.select("c_custkey", text_io.csv_line(c).alias("line"))


@query("""SELECT 'INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''', ' || n_regionkey || ');' AS line FROM nation""")
def export_insert_script(w):
    return text_io.insert_script(w.table("nation"), "nation")


# --- catalog, checks ---


@query("SELECT * FROM (VALUES ('orders', 'o_comment', 'b_only', ''), ('orders', 'o_custkey', 'changed', 'data_type'), ('orders', 'o_orderkey', 'same', ''), ('orders', 'o_orderpriority', 'a_only', ''), ('orders', 'o_orderstatus', 'same', ''), ('orders', 'o_totalprice', 'same', ''), ('orders', 'o_orderdate', 'same', '')) t(table_name, column_name, status, differs)")
def schema_compare_columns(w):
    a = w.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    b = a.drop("o_orderpriority").withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumn("o_comment", F.lit(""))
    return catalog.compare(catalog.columns_of(w.spark, {"orders": a}).drop("nullable"), catalog.columns_of(w.spark, {"orders": b}).drop("nullable").withColumn("position", F.when(F.col("column_name") == "o_comment", 6).otherwise(F.col("position"))), ["table_name", "column_name"])


@query("SELECT * FROM (VALUES ('CHECK (A > 0)', 'same', ''), ('UNIQUE (B)', 'a_only', ''), ('UNIQUE (C)', 'b_only', '')) t(definition, status, differs)")
def schema_compare_constraints(w):
    make = lambda rows: w.spark.createDataFrame(rows, "raw string, enabled boolean").select(catalog.definition_key("raw").alias("definition"), "enabled")
    return catalog.compare(make([("check  (a > 0)", True), ("unique (b)", True)]), make([("CHECK (a >  0)", True), ("unique (c)", True)]), ["definition"])


_HASHES = "SELECT doc_id, count(*) AS n_lines, sum(('0x' || substr(md5((n - 1) || ':' || rtrim(line)), 1, 15))::BIGINT)::VARCHAR AS h FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM ({0})) GROUP BY doc_id"


@query(f"""WITH a AS ({_HASHES.format("SELECT doc_id, text AS t FROM documents WHERE doc_id % 9 <> 0")}), b AS ({_HASHES.format("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'x' WHEN doc_id % 3 = 0 THEN text || '  ' ELSE text END AS t FROM documents WHERE doc_id % 8 <> 0")})
 SELECT CASE WHEN b.doc_id IS NULL THEN 'a_only' WHEN a.doc_id IS NULL THEN 'b_only' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS status, count(*) AS units, min(a.h) AS least_hash FROM a FULL JOIN b USING (doc_id) GROUP BY 1""")
def source_hash_compare(w):
    """Units of two sides by their hashes: lines added count, blanks at the end of a line don't."""
    d = w.table("documents")
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\nx"))).when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("  "))).otherwise(F.col("text"))
    hashes = lambda df: catalog.source_hash(df.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")), "doc_id", "line", "text")
    a, b = hashes(d.filter("doc_id % 9 <> 0")), hashes(d.filter("doc_id % 8 <> 0").withColumn("text", changed))
    both = catalog.compare(a, b, ["doc_id"]).join(a.select("doc_id", "source_hash"), "doc_id", "left")
    return both.groupBy("status").agg(F.count("*").alias("units"), F.min("source_hash").alias("least_hash"))


@query("SELECT l_orderkey AS k, n_a, n_b FROM (SELECT l_orderkey, count(*) n_a FROM lineitem GROUP BY 1) JOIN (SELECT l_orderkey k2, count(*) n_b FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1) ON l_orderkey = k2 WHERE n_a <> n_b UNION ALL SELECT l_orderkey, count(*), 0 FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_partkey % 5 <> 0) = 0")
def check_count_reconcile(w):
    lines = w.table("lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey")
    return checks.count_reconcile(lines, lines.filter("l_partkey % 5 <> 0"), ["k"])


@query("SELECT o_orderkey, round(o_totalprice, 2) AS stored, round(total, 2) AS computed FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS total FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE abs(o_totalprice - total) > 1000")
def check_value_recompute(w):
    total = w.table("lineitem").groupBy("l_orderkey").agg(F.sum(F.expr("l_extendedprice * (1 - l_discount) * (1 + l_tax)")).alias("total"))
    both = w.table("orders").join(total, F.col("o_orderkey") == F.col("l_orderkey"))
    return checks.value_recompute(both, F.col("o_totalprice"), F.col("total"), 1000.0).select("o_orderkey", F.round("o_totalprice", 2).alias("stored"), F.round("total", 2).alias("computed"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)")
def check_key_integrity(w):
    return checks.key_integrity(w.table("orders"), w.table("customer").filter("c_custkey % 50 <> 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query(f"SELECT 'segment' AS column_name, count(*) AS n_missing FROM ({_CUSTOMERS}) WHERE segment IS NULL HAVING count(*) > 0")
def check_mandatory(w):
    return checks.mandatory(_customers(w), ["c_custkey", "c_name", "segment"])


@query("SELECT event_id, f AS from_state, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) f FROM events) WHERE f IS NOT NULL AND NOT ((f = 'view' AND event_type = 'click') OR (f = 'click' AND event_type = 'purchase') OR (f = 'signup' AND event_type = 'view'))")
def check_state_transition(w):
    bad = checks.transitions(w.table("events"), "user_id", ["ts", "event_id"], "event_type", [("view", "click"), ("click", "purchase"), ("signup", "view")])
    return bad.select("event_id", "from_state", "event_type")


@query("SELECT 'orders_have_customers' AS check_name, count(*) = 0 AS passed, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def check_outcome(w):
    return checks.outcome(checks.key_integrity(w.table("orders"), w.table("customer"), "o_custkey", "c_custkey"), "orders_have_customers")


# --- graphs and facts ---

_EDGES = "e AS (SELECT DISTINCT a AS src, b AS dst FROM (SELECT event_type || user_id % 7 AS a, lead(event_type || user_id % 7) OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS b FROM events) WHERE b IS NOT NULL)"


def _edges(w):
    from pyspark.sql import Window

    node = F.concat("event_type", (F.col("user_id") % 7).cast("string"))
    e = w.table("events").select(node.alias("src"), F.lead(node).over(Window.partitionBy(F.col("user_id") % 50).orderBy("event_id")).alias("dst"))
    return e.filter("dst IS NOT NULL").distinct()


_PARTS = "e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def _parts(w):
    pair = lambda df, p, a, q, b: df.select(F.concat(F.lit(p), F.col(a).cast("string")).alias("src"), F.concat(F.lit(q), F.col(b).cast("string")).alias("dst"))
    return pair(w.table("lineitem"), "p", "l_partkey", "s", "l_suppkey").union(pair(w.table("supplier"), "s", "s_suppkey", "n", "s_nationkey")).union(pair(w.table("nation"), "n", "n_nationkey", "r", "n_regionkey")).distinct()


@query(f"WITH {_EDGES} SELECT node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT src AS node, 0 i, 1 o FROM e WHERE src <> dst UNION ALL SELECT dst, 1, 0 FROM e WHERE src <> dst) GROUP BY 1")
def graph_degree(w):
    return graph.degrees(_edges(w))


@query(f"WITH RECURSIVE {_PARTS}, r AS (SELECT src AS origin, src AS node FROM e WHERE src LIKE 'p%' UNION SELECT r.origin, e.dst FROM r JOIN e ON e.src = r.node) SELECT DISTINCT origin, node FROM r")
def graph_reachability(w):
    e = _parts(w)
    return graph.reach(e, e.filter("src LIKE 'p%'").select(F.col("src").alias("node"))).select("origin", "node")


@query(f"WITH {_PARTS} SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e)")
def graph_entries_unused(w):
    e = _parts(w)
    return graph.entries(e.select(F.col("src").alias("node")).distinct(), e)


_RING = "e AS (SELECT n_nationkey AS src, CASE WHEN n_nationkey % 5 = 4 THEN n_nationkey - 4 ELSE n_nationkey + 1 END AS dst FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey, n_nationkey + 1 FROM nation WHERE n_nationkey BETWEEN 19 AND 23)"


@query(f"WITH RECURSIVE {_RING}, r AS (SELECT src AS o, dst AS n FROM e UNION SELECT r.o, e.dst FROM r JOIN e ON e.src = r.n) SELECT a.o AS node, min(a.n) AS component FROM r a JOIN r b ON a.o = b.n AND a.n = b.o GROUP BY 1")
def graph_scc(w):
    n = w.table("nation").select(F.col("n_nationkey").alias("k"))
    ring = n.filter("k < 20").select(F.col("k").alias("src"), F.when(F.col("k") % 5 == 4, F.col("k") - 4).otherwise(F.col("k") + 1).alias("dst"))
    return graph.strong_components(ring.union(n.filter("k BETWEEN 19 AND 23").select("k", F.col("k") + 1)))


_USE = "u AS (SELECT 's' || l_suppkey AS node, 't' || l_partkey % 30 AS table_name, CASE l_linenumber % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'R' WHEN 2 THEN 'U' ELSE 'D' END AS op FROM lineitem)"


def _use(w):
    op = F.element_at(F.array(*[F.lit(x) for x in "CRUD"]), F.col("l_linenumber") % 4 + 1)
    return w.table("lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("node"), F.concat(F.lit("t"), (F.col("l_partkey") % 30).cast("string")).alias("table_name"), op.alias("op"))


@query(f"WITH RECURSIVE {_PARTS}, {_USE}, r AS (SELECT src AS origin, src AS node FROM e WHERE src LIKE 'p%' UNION SELECT r.origin, e.dst FROM r JOIN e ON e.src = r.node) SELECT table_name, count(DISTINCT origin) AS n_origins FROM r JOIN u USING (node) WHERE op <> 'R' GROUP BY 1")
def graph_impact(w):
    e = _parts(w)
    return graph.impact(e, e.filter("src LIKE 'p%'").select(F.col("src").alias("node")), _use(w))


@query(f"WITH {_USE} SELECT table_name, node, CASE WHEN bool_or(op = 'C') THEN 'C' ELSE '' END || CASE WHEN bool_or(op = 'R') THEN 'R' ELSE '' END || CASE WHEN bool_or(op = 'U') THEN 'U' ELSE '' END || CASE WHEN bool_or(op = 'D') THEN 'D' ELSE '' END AS ops FROM u GROUP BY 1, 2")
def crud_matrix(w):
    return graph.crud_matrix(_use(w))


@query(f"WITH {_USE} SELECT DISTINCT r.table_name AS src, x.table_name AS dst FROM u r JOIN u x USING (node) WHERE r.op = 'R' AND x.op <> 'R' AND r.table_name <> x.table_name")
def lineage_levels(w):
    return graph.lineage_steps(_use(w).distinct())


@query(f"WITH {_PARTS} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1 ORDER BY degree DESC, node LIMIT 1")
def busiest_node(w):
    return graph.busiest(_parts(w))


@query(f"WITH RECURSIVE {_PARTS}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT 'n3' AS node, 0 AS depth UNION SELECT b.dst, r.depth + 1 FROM r JOIN b ON b.src = r.node WHERE r.depth < 2) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def k_hop_view(w):
    e = _parts(w)
    return graph.reach(e, w.spark.createDataFrame([("n3",)], "node string"), 2, both_ways=True).select("node", "depth")


_MEMBERS = """members AS (SELECT DISTINCT owner, unit, unit_type, path, CASE WHEN unit_type = 'PROCEDURE' THEN owner || '.' || path ELSE owner || '.' || unit || '.' || path END AS node FROM (
 SELECT 'O' || p_partkey % 4 AS owner, CASE WHEN p_partkey % 5 = 0 THEN 'S' ELSE 'P' END || p_size % 9 AS unit, CASE WHEN p_partkey % 5 = 0 THEN 'PROCEDURE' ELSE 'PACKAGE BODY' END AS unit_type,
 CASE WHEN p_partkey % 5 = 0 THEN 'S' || p_size % 9 WHEN p_partkey % 3 = 0 THEN 'M' || p_size % 4 || '.M' || p_partkey % 7 ELSE 'M' || p_partkey % 7 END AS path FROM part WHERE (p_partkey % 4) * 9 + p_size % 9 <> 13 AND p_partkey % 11 <> 1))"""
_CALLS = """calls AS (SELECT DISTINCT owner, unit, unit_type, path, CASE l_linenumber % 7 WHEN 0 THEN 'M' || l_suppkey % 8 WHEN 1 THEN 'S' || l_suppkey % 9 WHEN 2 THEN 'P' || l_suppkey % 10 || '.M' || l_orderkey % 7 WHEN 3 THEN 'O' || l_suppkey % 5 || '.S' || l_orderkey % 9
 WHEN 4 THEN 'O' || l_suppkey % 4 || '.P' || l_orderkey % 9 || '.M' || l_partkey % 7 WHEN 5 THEN 'DBMS_OUTPUT.PUT_LINE' ELSE 'M' || l_suppkey % 4 END AS callee
 FROM (SELECT DISTINCT l_linenumber, l_suppkey, l_orderkey % 63 AS l_orderkey, l_partkey, l_partkey % (SELECT count(*) FROM members) + 1 AS pick FROM lineitem) l JOIN (SELECT owner, unit, unit_type, path, row_number() OVER (ORDER BY owner, unit, unit_type, path) AS k FROM members) m ON k = pick)"""
_RESOLVED = """ SELECT owner, unit, unit_type, path, callee, target, CASE WHEN target IS NOT NULL THEN 'resolved' WHEN callee LIKE 'DBMS%' THEN 'system' ELSE 'unknown' END AS status FROM (
 SELECT c.*, CASE len(string_split(callee, '.'))
  WHEN 1 THEN coalesce(
   (SELECT min(node) FROM members m WHERE m.owner = c.owner AND m.unit = c.unit AND m.unit_type = c.unit_type AND m.path = c.path || '.' || callee),
   (SELECT min(node) FROM members m WHERE m.owner = c.owner AND m.unit = c.unit AND m.unit_type = c.unit_type AND contains(c.path, '.') AND m.path = string_split(c.path, '.')[1] || '.' || callee),
   (SELECT min(node) FROM members m WHERE m.owner = c.owner AND m.unit = c.unit AND m.unit_type = c.unit_type AND m.path = callee),
   (SELECT min(node) FROM members m WHERE m.owner = c.owner AND m.unit_type = 'PROCEDURE' AND m.path = callee))
  WHEN 2 THEN coalesce(
   (SELECT min(node) FROM members m WHERE m.owner = c.owner AND m.unit = c.unit AND m.unit_type = c.unit_type AND m.unit = string_split(callee, '.')[1] AND m.path = string_split(callee, '.')[2]),
   CASE WHEN EXISTS (SELECT 1 FROM members m WHERE m.unit_type = 'PACKAGE BODY' AND m.owner = c.owner AND m.unit = string_split(callee, '.')[1])
    THEN (SELECT min(node) FROM members m WHERE m.unit_type = 'PACKAGE BODY' AND m.owner = c.owner AND m.unit = string_split(callee, '.')[1] AND m.path = string_split(callee, '.')[2])
    ELSE coalesce((SELECT min(node) FROM members m WHERE m.unit_type = 'PROCEDURE' AND m.owner = string_split(callee, '.')[1] AND m.path = string_split(callee, '.')[2]),
     (SELECT CASE WHEN count(DISTINCT m.owner) = 1 THEN min(node) FILTER (WHERE m.path = string_split(callee, '.')[2]) END FROM members m WHERE m.unit_type = 'PACKAGE BODY' AND m.unit = string_split(callee, '.')[1])) END)
  ELSE (SELECT min(node) FROM members m WHERE m.unit_type = 'PACKAGE BODY' AND m.owner = string_split(callee, '.')[1] AND m.unit = string_split(callee, '.')[2] AND m.path = string_split(callee, '.')[3]) END AS target FROM calls c)"""


def _members(w):
    return w.sql("WITH " + _MEMBERS.replace("FROM part", "FROM {part}") + " SELECT owner, unit, unit_type, path FROM members")


@query(f"WITH {_MEMBERS}, {_CALLS}" + _RESOLVED)
def call_resolution_precedence(w):
    asked = "WITH " + _MEMBERS.replace("FROM part", "FROM {part}") + ", " + _CALLS.replace("FROM lineitem", "FROM {lineitem}") + " SELECT * FROM calls"
    return graph.resolve_calls(w.sql(asked), _members(w))


@query("SELECT side, count(*) AS n FROM (SELECT k, CASE WHEN count(DISTINCT t) = 2 THEN 'both' WHEN min(t) = 'd' THEN 'a_only' ELSE 'b_only' END side FROM (SELECT DISTINCT l_suppkey k, 'd' t FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT DISTINCT s_suppkey, 's' FROM supplier WHERE s_acctbal > 0) GROUP BY k) GROUP BY 1")
def gap_partition(w):
    a = w.table("lineitem").filter("l_quantity > 45").select(F.col("l_suppkey").alias("k"))
    b = w.table("supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("k"))
    return graph.three_way(a, b, "k").groupBy("side").agg(F.count("*").alias("n"))


# --- the graph of many units ---

_SUBS = "SELECT 'O' || l_suppkey % 3 AS owner, 'P' || l_suppkey % 20 AS unit, CASE WHEN l_partkey % 3 = 0 THEN 'FUNCTION' ELSE 'PACKAGE BODY' END AS unit_type, 'M' || l_partkey % 30 AS path, 'K' || l_orderkey % 2 AS kind, 'S' || l_linenumber AS signature, cast(l_orderkey AS int) AS start_line, cast(l_orderkey + l_linenumber AS int) AS end_line, l_linestatus = 'O' AS public, cast(l_quantity AS int) AS complexity, l_returnflag = 'R' AND l_quantity > 49 AS commits, false AS autonomous FROM lineitem"


@query(f"SELECT owner || '.' || CASE WHEN unit_type = 'FUNCTION' THEN path ELSE unit || '.' || path END AS node, count(*) AS overloads, max(complexity) AS complexity, sum(end_line - start_line + 1)::BIGINT AS lines, bool_or(commits) AS commits, bool_or(public) AS public FROM ({_SUBS}) GROUP BY 1")
def node_rollup(w):
    return integrate.nodes(w.sql(_SUBS.replace("FROM lineitem", "FROM {lineitem}"))).select("node", "overloads", "complexity", "lines", "commits", "public")


@query(f"WITH RECURSIVE {_PARTS}, r AS (SELECT src AS origin, src AS node FROM e WHERE src LIKE 'p%' UNION SELECT r.origin, e.dst FROM r JOIN e ON e.src = r.node) SELECT origin AS node, string_agg(DISTINCT node, ',' ORDER BY node) AS commits FROM r WHERE node LIKE 's%' AND substr(node, 2)::INT % 7 = 0 OR node = 'r2' GROUP BY 1")
def commit_reachability(w):
    e = _parts(w)
    of = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    commits = (F.col("node").startswith("s") & (F.substring("node", 2, 9).try_cast("int") % 7 == 0)) | (F.col("node") == "r2")
    found = integrate.commit_reach(of.withColumn("commits", F.coalesce(commits, F.lit(False))), e.withColumn("resolved", F.lit(True)), of.filter("node LIKE 'p%'"))
    return found.withColumn("commits", F.array_join("commits", ","))


_UNIT_USE = "SELECT DISTINCT 'O' || l_suppkey % 3 AS owner, 'U' || l_suppkey % 20 AS unit, 'PACKAGE BODY' AS unit_type, 'M' || l_linenumber AS path, CASE WHEN l_partkey % 10 = 0 THEN 'DUAL' WHEN l_partkey % 10 = 1 THEN 'T' || l_partkey % 40 || '@FAR' WHEN l_partkey % 10 < 5 THEN 'O2.T' || l_partkey % 40 ELSE 'T' || l_partkey % 40 END AS table_name, CASE l_linenumber % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'R' WHEN 2 THEN 'U' ELSE 'D' END AS op, 1 AS line FROM lineitem"
_UNIT_DEPS = "SELECT DISTINCT 'O' || l_suppkey % 3 AS owner, 'U' || l_suppkey % 20 AS unit, 'PACKAGE BODY' AS unit_type, 'O' || l_orderkey % 3 || '.T' || l_partkey % 40 AS name, CASE WHEN l_orderkey % 5 = 0 THEN 'PACKAGE' ELSE 'TABLE' END AS kind, CASE WHEN l_orderkey % 4 = 0 THEN 'PUBLIC.T' || l_orderkey % 40 END AS via, cast(NULL AS VARCHAR) AS link FROM lineitem WHERE l_suppkey % 20 <> 3 AND l_orderkey % 3 = 0"


def _unit_facts(w):
    return w.sql(_UNIT_USE.replace("FROM lineitem", "FROM {lineitem}")), w.sql(_UNIT_DEPS.replace("FROM lineitem", "FROM {lineitem}").replace("VARCHAR", "string"))


@query(f"""WITH u AS ({_UNIT_USE}), d AS ({_UNIT_DEPS}), s AS (SELECT DISTINCT owner, unit, CASE WHEN contains(table_name, '.') THEN table_name ELSE owner || '.' || table_name END AS table_name FROM u WHERE table_name <> 'DUAL' AND NOT contains(table_name, '@')),
 k AS (SELECT owner, unit, table_name, bool_or(data) AS data FROM (SELECT owner, unit, name AS table_name, kind = 'TABLE' AS data FROM d UNION ALL SELECT owner, unit, via, false FROM d WHERE via IS NOT NULL) GROUP BY ALL)
 SELECT owner, unit, table_name, found FROM (SELECT owner, unit, table_name, CASE WHEN s.table_name IS NULL THEN CASE WHEN data THEN 'dict_only' END WHEN data IS NULL THEN 'source_only' ELSE 'both' END AS found FROM (SELECT *, 1 AS one FROM s) s FULL JOIN k USING (owner, unit, table_name)) WHERE found IS NOT NULL AND (owner, unit) IN (SELECT owner, unit FROM d)""")
def dictionary_reconcile(w):
    return integrate.reconciled(*_unit_facts(w)).drop("unit_type")


@query(f"""WITH u AS ({_UNIT_USE}), d AS ({_UNIT_DEPS}), n AS (SELECT owner, unit, a, min(struct_pack(r := r, name := name)).name AS name FROM (SELECT owner, unit, via AS a, name, 0 AS r FROM d WHERE via IS NOT NULL UNION ALL SELECT owner, unit, owner || '.' || string_split(via, '.')[-1], name, 1 FROM d WHERE via IS NOT NULL) GROUP BY ALL HAVING a IS NOT NULL),
 q AS (SELECT u.owner, u.unit, u.path, op, CASE WHEN contains(string_split(table_name, '@')[1], '.') THEN table_name ELSE owner || '.' || table_name END AS t FROM u)
 SELECT coalesce(n.name, t) AS table_name, q.owner || '.' || q.unit || '.' || path AS node, CASE WHEN bool_or(op = 'C') THEN 'C' ELSE '' END || CASE WHEN bool_or(op = 'R') THEN 'R' ELSE '' END || CASE WHEN bool_or(op = 'U') THEN 'U' ELSE '' END || CASE WHEN bool_or(op = 'D') THEN 'D' ELSE '' END AS ops FROM q LEFT JOIN n ON n.owner = q.owner AND n.unit = q.unit AND n.a = q.t GROUP BY 1, 2""".replace(" GROUP BY ALL HAVING a IS NOT NULL", " WHERE a IS NOT NULL GROUP BY owner, unit, a"))
def crud_with_synonyms(w):
    return integrate.table_uses(*_unit_facts(w))


@query("SELECT DISTINCT src, dst FROM (SELECT unnest(['O0.T' || l_partkey % 9, 'T' || l_suppkey % 9]) AS s, 'O' || l_orderkey % 2 AS owner, 'T' || l_linenumber AS d FROM lineitem), LATERAL (SELECT CASE WHEN contains(s, '.') THEN s ELSE owner || '.' || s END AS src, owner || '.' || d AS dst) WHERE src <> dst")
def lineage_flow_edges(w):
    t = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    flows = w.table("lineitem").select(F.array(t("O0.T", "l_partkey", 9), t("T", "l_suppkey", 9)).alias("src_tables"), t("O", "l_orderkey", 2).alias("owner"), F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("dst_table"))
    return integrate.lineage_edges(flows)


@query(f"""WITH {_USE}, x AS (SELECT DISTINCT * FROM u), b AS (SELECT table_name, node, string_agg(DISTINCT op, '') AS ops FROM x GROUP BY ALL)
 SELECT s, t, kind, label FROM (SELECT table_name AS s, node AS t, 'read' AS kind, 'R' AS label FROM b WHERE contains(ops, 'R') UNION ALL
 SELECT node, table_name, 'write', concat_ws(',', CASE WHEN contains(ops, 'C') THEN 'C' END, CASE WHEN contains(ops, 'U') THEN 'U' END, CASE WHEN contains(ops, 'D') THEN 'D' END) FROM b WHERE regexp_matches(ops, '[CUD]'))""")
def diagram_edges(w):
    uses = graph.crud_matrix(_use(w)).withColumn("conf", F.lit(None).cast("string"))
    none = w.spark.createDataFrame([], "src string, dst string, resolved boolean, lines array<int>")
    triggers = w.spark.createDataFrame([], "node string, trigger_on string, events string")
    return integrate.diagram(uses.select("node").distinct(), uses, none, none.select("src", "dst"), triggers)[1].select("s", "t", "kind", "label")


@query(f"WITH RECURSIVE {_USE}, x AS (SELECT DISTINCT * FROM u), s AS (SELECT DISTINCT r.table_name AS src, y.table_name AS dst FROM x r JOIN x y USING (node) WHERE r.op = 'R' AND y.op IN ('C', 'U') AND r.table_name <> y.table_name), l AS (SELECT 't1' AS t, 1 AS level UNION SELECT dst, level + 1 FROM l JOIN s ON src = t WHERE level < 3), m AS (SELECT t, min(level) AS level FROM l GROUP BY 1) SELECT m.level::INT AS level, t AS table_name, x.node, 'R' AS ops, (SELECT count(DISTINCT table_name) FROM x o WHERE o.node = x.node AND o.op IN ('C', 'U') AND o.table_name <> t)::INT AS n_others FROM m JOIN x ON x.table_name = t AND x.op = 'R'")
def lineage_by_levels(w):
    return graph.lineage(_use(w), "t1", up=False, depth=3).withColumn("n_others", F.size("others")).drop("others")


# --- history, metrics, search ---


@query("SELECT event_type || ' ' || user_id % 20 AS statement, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1")
def history_dedupe_counts(w):
    e = w.table("events").select(F.concat("event_type", F.lit("   "), (F.col("user_id") % 20).cast("string")).alias("sql"), "ts")
    return history.grouped(e, "sql", "ts")


@query("SELECT conv_id, turn FROM conversations WHERE upper(text) LIKE '%THE%' AND upper(text) LIKE '%AN%' ORDER BY conv_id DESC, turn DESC LIMIT 200")
def history_search_topk(w):
    return history.search(w.table("conversations"), "the an", "text").select("conv_id", "turn").orderBy(F.col("conv_id").desc(), F.col("turn").desc()).limit(200)


@query("SELECT event_type AS code, count(*) AS n, round(median(value), 4) AS median_ms, max(value) AS max_ms FROM events GROUP BY 1")
def connection_summary(w):
    return history.summary(w.table("events").select(F.col("event_type").alias("code"), F.col("value").alias("ms"))).withColumn("median_ms", F.round("median_ms", 4))


@query("SELECT CASE WHEN n_chars < 500 THEN 'small' WHEN n_chars < 3000 THEN 'middle' ELSE 'large' END AS bucket, count(*) AS n, round(avg(n_chars), 3) AS mean, quantile_disc(n_chars, 0.95) AS p95 FROM documents GROUP BY 1")
def metrics_p95_buckets(w):
    return history.by_size(w.table("documents"), F.col("n_chars"), {"small": 499, "middle": 2999}, "large", F.col("n_chars")).withColumn("mean", F.round("mean", 3))


@query("SELECT c_name AS name, CASE WHEN upper(c_name) LIKE '%1%' THEN 3 ELSE 0 END + 1 AS score FROM customer")
def table_search_score(w):
    c = w.table("customer").select(F.col("c_name").alias("name"), F.array(F.lit("KEY_1"), F.lit("OTHER")).alias("columns"))
    return catalog.search(c, ["1"], "name", "columns").select("name", F.col("score").cast("int").alias("score"))


@query("SELECT doc_id, contains(lower(text), ' the ') AND NOT contains(lower(text), 'licensed') AS passed FROM documents")
def phrase_judge(w):
    return w.table("documents").select("doc_id", checks.phrases(F.col("text"), [" the "], ["licensed"]).alias("passed"))


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '(?i)(^|[^\\w$#])the([^\\w$#]|$)') GROUP BY 1")
def word_in_line(w):
    lines = w.table("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return catalog.used_in_lines(lines, "the").groupBy("doc_id").agg(F.count("*").alias("n"))


# --- value traces ---


@query("SELECT l_orderkey, round(sum(l_extendedprice::DECIMAL(15, 2) * (1 - l_discount::DECIMAL(5, 2))), 2)::DOUBLE AS recomputed FROM lineitem GROUP BY 1")
def value_recompute(w):
    # Decimals: in doubles, amounts that end at half a cent round either way, by the order of the sum.
    return trace.recomputed(w.table("lineitem"), ["l_orderkey"], F.expr("cast(l_extendedprice AS decimal(15, 2)) * (1 - cast(l_discount AS decimal(5, 2)))"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'O' ELSE 'X' END AS c1, CASE WHEN o_totalprice > 100000 THEN 'O' ELSE 'X' END AS c2 FROM orders")
def condition_flags(w):
    flagged = trace.condition_flags(w.table("orders"), {"c1": F.col("o_orderstatus") == "F", "c2": F.col("o_totalprice") > 100000})
    return flagged.select("o_orderkey", "c1", "c2")


@query("SELECT 1 AS step, 'orders' AS joined, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, 'lineitem', count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' UNION ALL SELECT 3, 'part', count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey AND p_size > 25 WHERE o_orderstatus = 'F'")
def join_survival_counts(w):
    joins = [("lineitem", w.table("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")), ("part", w.table("part").filter("p_size > 25"), F.col("p_partkey") == F.col("l_partkey"))]
    return trace.join_survival(w.table("orders").filter("o_orderstatus = 'F'"), "orders", joins)


# --- streams (an extension) ---


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_counts(w):
    return windows.tumbling_counts(w.table("events"), "ts", "1 hour", ["event_type"])


# --- code: text to facts (no SQL) ---

_SCRIPT = """set echo on
SELECT 1 FROM dual;
CREATE OR REPLACE PROCEDURE ship_orders IS
  n NUMBER;
BEGIN
  FOR r IN (SELECT order_id, total FROM open_orders o JOIN accounts a ON a.id = o.account_id) LOOP
    INSERT INTO shipped_orders (id, total) VALUES (r.order_id, r.total);
    UPDATE stock SET on_hand = on_hand - 1 WHERE item = 'a;b';
    log_pkg.note('done');
  END LOOP;
  EXECUTE IMMEDIATE 'truncate table stage';
  COMMIT;
EXCEPTION WHEN OTHERS THEN NULL;
END;
/
DELETE FROM stage;
"""


@query()
def split_script(w):
    return w.spark.createDataFrame(lexer.split_script(_SCRIPT), "statement string, kind string, line int")


@query()
def classify(w):
    return w.spark.createDataFrame([(s, k, lexer.is_read_only(s), lexer.risks(s)) for s, k, _ in lexer.split_script(_SCRIPT)], "statement string, kind string, read_only boolean, risks array<string>")


@query()
def extract_facts(w):
    return code_facts.facts(w.spark.createDataFrame([("SHIP_ORDERS", _SCRIPT)], "unit string, text string"))


@query()
def dialect_rewrite(w):
    asked = ["SELECT NVL(a, 0), GREATEST(b, c) FROM t", "SELECT * FROM (SELECT a FROM t) WHERE ROWNUM <= 5", "SELECT a.x, b.y FROM a, b WHERE a.id = b.id(+)"]
    return w.spark.createDataFrame([(a, rewrite.to_spark(a)) for a in asked], "asked string, spark string")


@query()
def column_writers(w):
    return statements.writers_of(w.spark.createDataFrame([("SHIP_ORDERS", _SCRIPT)], "unit string, text string"))


@query()
def dynamic_tables(w):
    return w.spark.createDataFrame(statements.dynamic_tables("SHIP_ORDERS", _SCRIPT), "unit string, table_name string, op string, line int")


@query()
def clause_outline(w):
    return w.spark.createDataFrame(statements.outline("SELECT a FROM (SELECT b FROM t) WHERE a = 1 ORDER BY a"), "clause string, depth int, line int")


@query()
def chunk_units(w):
    """Chunks of every whole text."""
    return statements.chunked(w.table("documents").select(F.col("doc_id").cast("string").alias("unit"), "text"))


@query("""SELECT o_orderkey, x IS NOT DISTINCT FROM y OR abs(coalesce(x, 0) - coalesce(y, 0)) <= 1e-9 AND x IS NOT NULL AND y IS NOT NULL AS same FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS x, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey + o_orderkey % 2 END AS y FROM orders)""")
def same_value_flags(w):
    o = w.table("orders")
    stored = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(".0")))
    shown = F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_custkey") + F.col("o_orderkey") % 2).cast("string")).otherwise("")
    return o.select("o_orderkey", statements.same_value(stored, shown).alias("same"))


# --- lineage, data flow, row traces ---

_LINEAGE = """WITH spent AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey)
SELECT c_name, total, total / 2 AS half, rank() OVER (ORDER BY total) AS place, 'x' AS mark, n_name FROM {customer} JOIN spent ON c_custkey = k JOIN {nation} ON n_nationkey = c_nationkey"""


@query("""SELECT * FROM (VALUES (1, 'c_name', 'column', 'customer', 'c_name'), (2, 'total', 'aggregate', 'orders', 'o_totalprice'), (3, 'half', 'computed', 'orders', 'o_totalprice'), (4, 'place', 'analytic', 'orders', 'o_totalprice'), (5, 'mark', 'constant', NULL, NULL), (6, 'n_name', 'column', 'nation', 'n_name')) AS t(position, result_column, kind, table_name, column_name)""")
def result_column_lineage(w):
    """Sources of the columns of a query, by the analysed plan."""
    return lineage.column_lineage(w.sql(_LINEAGE)).withColumn("table_name", F.regexp_extract("table_name", "^wb_(.*)_[0-9a-f]{8}$", 1))


@query()
def data_flows(w):
    return flows.flows_of(w.spark.createDataFrame([("SHIP_ORDERS", _SCRIPT)], "unit string, text string"))


@query()
def local_names(w):
    return w.spark.createDataFrame(flows.local_names(_SCRIPT), "name string, kind string, line int")


@query("""SELECT l_orderkey AS o_orderkey, coalesce(n, 0) AS n_rows, coalesce(n, 0) > 0 AS stands, 'SHIP_ORDERS:7' AS inserts, '' AS deletes FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN (SELECT o_orderkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_orderkey) ON l_orderkey = o_orderkey""")
def row_trace(w):
    """Which orders of the lines stand among those that aren't open, and which statements could have put them there."""
    uses = code_facts.facts(w.spark.createDataFrame([("SHIP_ORDERS", _SCRIPT)], "unit string, text string"))
    asked = w.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    found = trace.row_trace(w.table("orders").filter("o_orderstatus <> 'O'"), ["o_orderkey"], asked, uses, "SHIPPED_ORDERS")
    return found.withColumn("inserts", F.array_join("inserts", ",")).withColumn("deletes", F.array_join("deletes", ","))


@query("""SELECT s.o_custkey, CASE WHEN t.o_custkey IS NULL THEN 'missing' ELSE 'present' END AS state FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 1000) s LEFT JOIN (SELECT DISTINCT c_custkey AS o_custkey FROM customer WHERE c_acctbal > 0) t ON s.o_custkey = t.o_custkey""")
def possible_writes(w):
    orders = w.table("orders")
    target = w.table("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return trace.possible_writes(target, orders, ["o_custkey"], F.col("o_totalprice") > 1000)


# --- conditions, names, changes as texts that run ---


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'cold') OR contains(p_name, 'dg')")
def multi_like(w):
    return w.table("part").select("p_partkey", "p_name").filter(predicates.list_condition("p_name", ["cold", "dg", "cold"], "like"))


@query("SELECT string_agg('''' || v || '''', ',' ORDER BY v) AS text FROM (SELECT DISTINCT p_type AS v FROM part)")
def value_list_text(w):
    return predicates.value_list(w.table("part"), "p_type")


@query("SELECT p_partkey FROM part WHERE upper(p_name) LIKE '_O%WIDGET'")
def name_like_pattern(w):
    return w.table("part").filter(predicates.name_like("p_name", "_o%widget")).select("p_partkey")


_STATUS_TOTALS = "SELECT o.o_orderstatus AS st, count(*) AS n FROM {orders} o WHERE o.o_orderkey < 500 OR o.o_orderkey > 1000 GROUP BY o.o_orderstatus ORDER BY n DESC"


@query("SELECT o_orderstatus AS st, count(*) AS n FROM orders WHERE (o_orderkey < 500 OR o_orderkey > 1000) AND o_totalprice > 100000 GROUP BY 1")
def condition_added(w):
    return w.sql(edit_sql.add_condition(_STATUS_TOTALS.replace("{orders}", "ORDERS_"), "o.o_totalprice > 100000").replace("ORDERS_", "{orders}"))


@query("SELECT o_orderstatus AS st, count(*) AS n FROM orders WHERE o_orderkey < 500 OR o_orderkey > 1000 GROUP BY 1 HAVING count(*) > 100")
def condition_wrapped(w):
    text, wrapped = edit_sql.place_condition(_STATUS_TOTALS.replace("{orders}", "ORDERS_"), "N", lambda e: f"{e} > 100")
    return w.sql(text.replace("ORDERS_", "{orders}")) if wrapped else None


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice < 50000 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))")
def change_affects(w):
    change = edit_sql.parse_change("DELETE FROM ORDERS_ o WHERE o.o_orderstatus = 'F' AND (o.o_totalprice < 50000 OR o.o_custkey IN (SELECT c_custkey FROM CUSTOMER_ WHERE c_acctbal < 0))")
    return w.sql(edit_sql.affected_sql(change).replace("ORDERS_", "{orders}").replace("CUSTOMER_", "{customer}"))


@query("SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1 HAVING count(*) > 1")
def merge_statement_check(w):
    """The keys of a MERGE are read from its text."""
    merge = edit_sql.parse_merge("MERGE INTO customer c USING (SELECT o_custkey, o_totalprice FROM orders WHERE MOD(o_orderkey, 4) = 0) s ON (c.c_custkey = s.o_custkey) WHEN MATCHED THEN UPDATE SET c.c_acctbal = s.o_totalprice")
    (pair,), _ = edit_sql.merge_keys(merge)
    source = w.table("orders").filter("o_orderkey % 4 = 0").select(F.col(pair[1].lower()).alias(pair[0].lower()))
    return move.matched_twice(w.table("customer"), source, [pair[0].lower()])


_TRACED = "INSERT INTO order_totals (order_id, total) SELECT o.o_orderkey, SUM(l.l_quantity) FROM traced_orders o, traced_lines l WHERE l.l_orderkey = o.o_orderkey AND o.o_orderstatus = 'F' AND l.l_tax > v_least GROUP BY o.o_orderkey"


def _traced(w):
    w.attach("traced_orders", w.table("orders"))
    w.attach("traced_lines", w.table("lineitem"))
    (path,) = value_trace.paths(_TRACED, "order_totals", "total", ["order_id"])
    return value_trace.runnable(path, w.problem)


@query("SELECT l_orderkey AS order_id, sum(l_quantity) AS value, sum(l_quantity) = sum(l_quantity) + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS reproduced FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY l_orderkey")
def value_trace_reproduced(w):
    """Stored values against those that the statement's own query gives; the condition on a variable is left out."""
    found = w.sql(value_trace.value_query(_traced(w)))
    stored = w.table("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.sum("l_quantity") + F.when(F.col("l_orderkey") % 7 == 0, 1).otherwise(0)).alias("stored"))
    both = found.join(stored, F.col("ORDER_ID") == F.col("k"))
    return both.select(F.col("ORDER_ID").alias("order_id"), "value", statements.same_value(F.col("stored"), F.col("value")).alias("reproduced"))


@query("SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'F' THEN 'O' ELSE 'X' END AS c1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def value_trace_flags(w):
    out = w.sql(value_trace.flags_query(_traced(w))[0])
    return out.toDF(*[c.lower() for c in out.columns])


@query("SELECT 1 AS step, 'O' AS joined, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, 'L', count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def value_trace_survival(w):
    parts = [w.sql(q).select(F.lit(i).alias("step"), F.lit(a).alias("joined"), "n") for i, (a, q) in enumerate(value_trace.survival_queries(_traced(w)), 1)]
    return parts[0].unionByName(parts[1])


@query("WITH RECURSIVE s AS (SELECT c_custkey AS name, c_custkey + 1 AS t FROM customer WHERE c_custkey % 12 <> 0), r AS (SELECT c_custkey AS name, c_custkey AS target, 0 AS hops FROM customer UNION ALL SELECT r.name, s.t, hops + 1 FROM r JOIN s ON s.name = r.target WHERE hops < 8) SELECT 'C' || name AS name, CASE WHEN max_by(target, hops) IN (SELECT name FROM s) THEN NULL ELSE 'C' || max_by(target, hops) END AS target FROM r GROUP BY r.name")
def synonym_chains(w):
    c = w.table("customer").select("c_custkey")
    called = lambda n: F.concat(F.lit("C"), n.cast("string"))
    links = c.filter("c_custkey % 12 <> 0").select(called(F.col("c_custkey")).alias("synonym"), called(F.col("c_custkey") + 1).alias("table_name"))
    return catalog.resolve_synonyms(c.select(called(F.col("c_custkey")).alias("name")), links)


_SESSIONS = "SELECT c_custkey AS sid, CASE WHEN c_nationkey % 2 = 0 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status, c_nationkey AS idle_s, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey - 1 END AS blocked_by FROM customer"


@query(f"SELECT sid - sid % 6 AS sid, count(*) AS blocked, max(idle_s) AS waiting FROM ({_SESSIONS}) WHERE blocked_by IS NOT NULL GROUP BY 1")
def lock_waits(w):
    return sessions.blockers(w.sql(_SESSIONS.replace("FROM customer", "FROM {customer}")))


@query("SELECT name, CASE WHEN n = 'WIDGET' THEN 1100 WHEN n LIKE 'WIDGET%' THEN 1000 - least(length(n) - 6, 200) WHEN contains('_' || n, '_WIDGET') THEN 600 WHEN contains(n, 'WIDGET') THEN 400 END::INT AS score FROM (SELECT DISTINCT replace(p_name, ' ', '_') AS name, upper(replace(p_name, ' ', '_')) AS n FROM part) WHERE contains(n, 'WIDGET') ORDER BY score DESC, name LIMIT 10")
def name_completion_topk(w):
    names = w.table("part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("name")).distinct()
    return rows.top_names(names, "name", "widget", 10).select("name", "score")


@query("SELECT 'b' AS bucket, count(*) AS n, avg((o_orderstatus = 'F')::INT) AS rate FROM orders WHERE o_orderkey % 3 = 1")
def bucket_threshold(w):
    b = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    failed = F.when(b == "a", F.lit(0)).otherwise((F.col("o_orderstatus") == "F").cast("int"))
    return history.too_large(w.table("orders").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg(failed).alias("rate")), F.col("bucket"))


@query("SELECT 'c' AS tag, c_custkey AS k, c_name AS name, NULL AS price FROM customer UNION ALL SELECT 'o', o_orderkey, NULL, o_totalprice FROM orders")
def tagged_union(w):
    return catalog.tagged({"c": w.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), "o": w.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))})


@query("SELECT (n_nationkey + 25 * a.x)::INT AS r, b.y::INT AS c, n_name AS v FROM nation, range(2) a(x), range(3) b(y)")
def paste_tiled(w):
    cells = w.table("nation").select(F.col("n_nationkey").alias("r"), F.lit(0).alias("c"), F.col("n_name").alias("v"))
    return rows.paste(cells, 25, 1, (0, 49, 0, 2), 100, 100)[0]


@query()
def subprogram_spans(w):
    return w.spark.createDataFrame([tuple(s) for s in code_facts.subprograms(_SCRIPT)], "path string, kind string, signature string, start_line int, end_line int, overload int, public boolean")


@query()
def embedded_queries(w):
    """Facts of queries kept in XML."""
    text = "<queries><query id='open'>SELECT a FROM open_orders #if($x) WHERE k = $x #end</query></queries>"
    return code_facts.facts(w.spark.createDataFrame([("Q", code_files.queries_unit(text, "Q"))], "unit string, text string"))
