"""The facts of many code units as one graph: nodes, calls, tables, lineage, confidence, findings, and the reports drawn from them.

Inputs are tables of facts. `subs` is (owner, unit, unit_type, path, kind, signature, start_line, end_line, public, complexity, commits, autonomous), one row for each
subprogram (overloads several); `use` is (owner, unit, unit_type, path, table_name, op, line); `calls` (owner, unit, unit_type, path, callee, line); `flows`
(node, owner, cursor, src_tables, dst_table, ops, line, via); `deps` (owner, unit, unit_type, name, kind, via, link), the dictionary's dependencies of a unit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import impacted, node_id, reach, resolve_calls, strong_components

#: Fixed value: the path of code that runs when a unit is loaded.
INIT = "(init)"
#: Kinds of dictionary objects that hold data.
DATA = ("TABLE", "VIEW", "MATERIALIZED VIEW")


def qualified(owner: Column, name: Column) -> Column:
    """A table's name with its owner; the unit's owner if none is written. A link stays at the end."""
    return F.when(F.element_at(F.split(name, "@"), 1).contains("."), name).otherwise(F.concat_ws(".", owner, name))


def without_link(name: Column) -> Column:
    return F.element_at(F.split(name, "@"), 1)


def is_table(name: Column, table: str) -> Column:
    """Whether a name stands for a table: equal, or one without an owner to the other's last part."""
    want = table.upper().split("@")[0]
    own = F.upper(without_link(name))
    short = want.split(".")[-1]
    return own == want if "." not in want else (own == want) | (own == short)


def ends_with(name: Column, asked: str) -> Column:
    """A full name that is what was asked, or ends with it after a dot."""
    q = asked.strip().upper()
    return (F.upper(name) == q) | F.upper(name).endswith("." + q)


def letters(ops: Column) -> Column:
    """Letters of an array of operations, once each, in the order C, R, U, D."""
    all_of = F.array_join(ops, "")
    return F.concat(*[F.when(all_of.contains(op), F.lit(op)).otherwise(F.lit("")) for op in "CRUD"])


def nodes(subs: DataFrame) -> DataFrame:
    """One row for each node: overloads are counted, their lines summed, the highest complexity and any commit kept; public if any is."""
    s = subs.filter(F.col("path") != INIT).withColumn("node", node_id())
    return s.groupBy("node").agg(
        F.min("owner").alias("owner"), F.min("unit").alias("unit"), F.min("unit_type").alias("unit_type"), F.min("path").alias("path"), F.min_by("kind", "start_line").alias("kind"), F.min_by("signature", "start_line").alias("signature"),
        F.count("*").alias("overloads"), F.max("complexity").alias("complexity"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"),
        F.bool_or("commits").alias("commits"), F.bool_or("autonomous").alias("autonomous"), F.bool_or("public").alias("public"),
    )


def merged_facts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of code that was read in parts: lines once each, complexities as one (each but the first gives what it has over 1), statements in order."""
    return parts.groupBy(*keys).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"), (F.sum(F.col("complexity") - 1) + 1).alias("complexity"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "statements"))), lambda p: p["statements"])).alias("statements"))


def call_edges(calls: DataFrame, subs: DataFrame) -> DataFrame:
    """(src, dst, resolved, external, lines): distinct sorted lines of each call; what isn't resolved keeps its name."""
    told = resolve_calls(calls, subs.filter(F.col("path") != INIT))
    key = ["owner", "unit", "unit_type", "path", "callee"]
    rows = calls.join(told, key)
    out = rows.groupBy(node_id().alias("src"), F.coalesce("target", "callee").alias("dst"), F.col("target").isNotNull().alias("resolved"), F.when(F.col("status") != "resolved", F.col("status")).alias("external"))
    return out.agg(F.sort_array(F.collect_set("line")).alias("lines"))


def entries_and_unused(of: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, entry, unused): nodes that no other calls; entries are on the top level and not private, unused ones private."""
    called = edges.filter("resolved AND src <> dst").select(F.col("dst").alias("_called")).distinct()
    alone = of.join(called, F.col("node") == F.col("_called"), "left_anti")
    return alone.select("node", (~F.col("path").contains(".") & ~F.coalesce(~F.col("public"), F.lit(False))).alias("entry"), F.coalesce(~F.col("public"), F.lit(False)).alias("unused")).filter("entry OR unused")


def steps(edges: DataFrame) -> DataFrame:
    return edges.filter("resolved").select("src", "dst")


def commit_reach(of: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(node, commits): the nodes that commit or roll back below each entry; found backwards from those."""
    ends = of.filter("commits").select("node", F.col("node").alias("table_name"), F.lit("C").alias("op"))
    found = impacted(steps(edges), entries.select("node"), ends)
    return found.groupBy(F.col("origin").alias("node")).agg(F.sort_array(F.collect_set("table_name")).alias("commits"))


def table_uses(use: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(table_name, node, ops): qualified names, synonyms (owner, unit, unit_type, via, name) replaced by what they stand for."""
    rows = use.withColumn("node", node_id()).withColumn("table_name", qualified(F.col("owner"), F.col("table_name")))
    if synonyms is not None:
        key = ["owner", "unit", "unit_type"]
        short = F.concat_ws(".", F.col("owner"), F.element_at(F.split("via", "\\."), -1))
        known = synonyms.filter("via IS NOT NULL")
        names = known.select(*key, F.col("via").alias("_as"), "name", F.lit(0).alias("_rank")).unionByName(known.select(*key, short.alias("_as"), "name", F.lit(1).alias("_rank")))
        names = names.groupBy(*key, "_as").agg(F.min(F.struct("_rank", "name")).alias("_to"))
        same = reduce(lambda a, b: a & b, [F.col(f"r.{k}") == F.col(f"n.{k}") for k in key])
        rows = rows.alias("r").join(names.alias("n"), same & (F.col("r.table_name") == F.col("n._as")), "left").select("r.*", F.coalesce("n._to.name", "r.table_name").alias("_real"))
        rows = rows.drop("table_name").withColumnRenamed("_real", "table_name")
    return rows.groupBy("table_name", "node").agg(letters(F.collect_set("op")).alias("ops"))


def reconciled(use: DataFrame, deps: DataFrame) -> DataFrame:
    """(owner, unit, unit_type, table_name, found): tables of each unit as the source and the dictionary know them: both, source_only, dict_only.

    DUAL and tables behind a link aren't compared. What the dictionary knows but not as a table or view confirms a name of the source, and is none alone.
    Units of which the dictionary has nothing though their source names tables are left out: see `unusable`.
    """
    key = ["owner", "unit", "unit_type"]
    plain = lambda c: ~F.col(c).contains("@") & (F.col(c) != "DUAL") & ~F.col(c).endswith(".DUAL")
    source = use.select(*key, qualified(F.col("owner"), F.col("table_name")).alias("table_name")).distinct().filter(plain("table_name"))
    known = deps.filter("link IS NULL").select(*key, F.col("name").alias("table_name"), F.col("kind").isin(*DATA).alias("data"))
    known = known.unionByName(deps.filter("via IS NOT NULL").select(*key, F.col("via").alias("table_name"), F.lit(False).alias("data")))
    known = known.filter(plain("table_name")).groupBy(*key, "table_name").agg(F.bool_or("data").alias("data"))
    both = source.withColumn("_s", F.lit(True)).join(known, [*key, "table_name"], "full")
    usable = deps.select(*key).distinct()
    found = F.when(F.col("_s").isNull(), F.when(F.col("data"), "dict_only")).when(F.col("data").isNull(), "source_only").otherwise("both")
    return both.join(usable, key, "left_semi").withColumn("found", found).filter("found IS NOT NULL").select(*key, "table_name", "found")


def unusable(use: DataFrame, deps: DataFrame) -> DataFrame:
    """Units whose source names tables while the dictionary has no dependencies of them."""
    key = ["owner", "unit", "unit_type"]
    return use.filter(~F.col("table_name").contains("@") & (F.col("table_name") != "DUAL")).select(*key).distinct().join(deps.select(*key).distinct(), key, "left_anti")


def confidence(found: Column) -> Column:
    """ok: source and dictionary agree; src: the source alone; dict: the dictionary alone, with an unknown operation."""
    return F.when(found == "both", "ok").when(found == "source_only", "src").when(found == "dict_only", "dict")


def dictionary_stats(found: DataFrame) -> DataFrame:
    """One row: tables of units that both know, that only the dictionary or only the source knows."""
    return found.agg(*[F.count_if(F.col("found") == f).alias(f) for f in ("both", "dict_only", "source_only")])


def lineage_edges(flows: DataFrame) -> DataFrame:
    """(src, dst): tables whose rows reach another through a cursor, once each."""
    pairs = flows.select(F.explode("src_tables").alias("src"), "owner", "dst_table")
    return pairs.select(qualified(F.col("owner"), F.col("src")).alias("src"), qualified(F.col("owner"), F.col("dst_table")).alias("dst")).filter("src <> dst").distinct()


def fed_tables(edges: DataFrame) -> DataFrame:
    """(table_name, fed_from, feeds_into), each a sorted array."""
    back = edges.groupBy(F.col("dst").alias("table_name")).agg(F.sort_array(F.collect_set("src")).alias("fed_from"))
    out = edges.groupBy(F.col("src").alias("table_name")).agg(F.sort_array(F.collect_set("dst")).alias("feeds_into"))
    none = F.array().cast("array<string>")
    return back.join(out, "table_name", "full").select("table_name", F.coalesce("fed_from", none).alias("fed_from"), F.coalesce("feeds_into", none).alias("feeds_into"))


def findings(marks: DataFrame, warnings: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, line, kind, message): swallowed errors and dynamic SQL of marks (node, line, kind), warnings (node, message) of units, and cycles of calls."""
    said = {"swallowed": "errors are caught and nothing is done", "dynamic": "tables and calls of dynamic SQL may be missing"}
    out = [marks.filter(F.col("kind") == k).select("node", "line", F.lit(k).alias("kind"), F.lit(text).alias("message")) for k, text in said.items()]
    none = F.lit(None).cast("int")
    out.append(warnings.select("node", none.alias("line"), F.lit("structure").alias("kind"), "message"))
    rings = strong_components(steps(edges)).groupBy("component").agg(F.array_join(F.sort_array(F.collect_list("node")), " -> ").alias("message"))
    out.append(rings.select(F.col("component").alias("node"), none.alias("line"), F.lit("cycle").alias("kind"), "message"))
    return reduce(DataFrame.unionByName, out)


def counts_by_kind(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count("*").alias("n"))


def for_screen(pairs: DataFrame, most: int = 50) -> DataFrame:
    """(table_name, entries, total): the first entries (table_name, origin) that each table's writers are reached from, and how many there are."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("table_name").orderBy("origin"))
    totals = pairs.groupBy("table_name").agg(F.count("*").alias("total"))
    first = pairs.withColumn("_n", place).filter(F.col("_n") <= most).groupBy("table_name").agg(F.sort_array(F.collect_list("origin")).alias("entries"))
    return first.join(totals, "table_name").select("table_name", "entries", "total")


def table_report(asked: str, uses: DataFrame, feeds: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each table that an asked name stands for: who uses it, where its data comes from and goes to, entries that reach its writers."""
    mine = uses.filter(ends_with(F.col("table_name"), asked)).groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct("node", "ops"))).alias("used_by"))
    none = F.array().cast("array<string>")
    out = mine.join(feeds, "table_name", "left").join(for_screen(pairs), "table_name", "left")
    return out.select("table_name", "used_by", F.coalesce("fed_from", none).alias("fed_from"), F.coalesce("feeds_into", none).alias("feeds_into"), F.coalesce("entries", none).alias("entries"), F.coalesce("total", F.lit(0)).alias("total"))


def relations(asked: str, of: DataFrame, edges: DataFrame, uses: DataFrame, entries: DataFrame) -> DataFrame:
    """One row for each node that an asked name stands for: callers, callees, tables with operations, whether it is an entry."""
    mine = of.filter(ends_with(F.col("node"), asked)).select("node", "kind", "signature", "complexity")
    gather = lambda df, key, value, name: df.groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_list(value)).alias(name))
    own = mine.select(F.col("node").alias("_m"))
    callers = gather(edges.join(own, F.col("dst") == F.col("_m"), "left_semi"), "dst", F.struct("src", "lines"), "called_by")
    callees = gather(edges.join(own, F.col("src") == F.col("_m"), "left_semi"), "src", F.struct("dst", "resolved", "lines"), "calls")
    tables = gather(uses.withColumnRenamed("node", "_n").join(own, F.col("_n") == F.col("_m"), "left_semi"), "_n", F.concat("table_name", F.lit("("), "ops", F.lit(")")), "tables")
    out = mine
    for part in (callers, callees, tables):
        out = out.join(part, F.col("node") == F.col("_k"), "left").drop("_k")
    return out.join(entries.filter("entry").select(F.col("node").alias("_e")), F.col("node") == F.col("_e"), "left").withColumn("is_entry", F.col("_e").isNotNull()).drop("_e")


def statements_of(statements: DataFrame, asked: str, most: int = 200) -> DataFrame:
    """Statements (node, line, ..) of a subprogram, or of all of a package if no subprogram has the name, in the order of the source."""
    exact = statements.filter(ends_with(F.col("node"), asked))
    q = asked.strip().upper()
    if exact.isEmpty():
        exact = statements.filter(F.upper("node").startswith(q + ".") | F.upper("node").contains(f".{q}."))
    return exact.orderBy("node", "line").limit(most)


def writers_and_cursors(writers: DataFrame, flows: DataFrame, cursors: DataFrame, table: str, column: str) -> DataFrame:
    """Statements (unit, table_name, column_name, via, line) that write a column, `*` included, each with the cursors that feed its table and their queries.

    flows: (unit, cursor, dst_table, line, via); cursors: (unit, cursor, query).
    """
    mine = writers.filter(is_table(F.col("table_name"), table) & F.upper("column_name").isin(column.upper(), "*")).withColumn("how", F.when(F.col("column_name") == "*", "all").otherwise("set"))
    fed = flows.select(F.col("unit").alias("_u"), F.col("dst_table").alias("_t"), F.col("line").alias("_l"), "cursor", F.col("via").alias("evidence"))
    out = mine.join(fed, (F.col("unit") == F.col("_u")) & (F.col("line") == F.col("_l")) & (F.col("table_name") == F.col("_t")), "left").drop("_u", "_t", "_l")
    named = cursors.select(F.col("unit").alias("_u"), F.col("cursor").alias("_c"), "query")
    return out.join(named, (F.col("unit") == F.col("_u")) & (F.col("cursor") == F.col("_c")), "left").select("unit", "line", "via", "how", "cursor", "evidence", "query")


# --- diagrams ---


def package_of(node: Column) -> Column:
    """OWNER.PACKAGE of a node within a package; a standalone unit itself."""
    parts = F.split(node, "\\.")
    return F.when(F.size(parts) >= 3, F.concat_ws(".", F.slice(parts, 1, 2))).otherwise(node)


def diagram(of: DataFrame, uses: DataFrame, edges: DataFrame, feeds: DataFrame, triggers: DataFrame, by_package: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, type), edges (s, t, kind, label, guess, lines)) of a data flow diagram.

    uses: (table_name, node, ops, conf); triggers: (node, trigger_on, events). Kinds: read, write, use (an unknown operation), call, trig, flow. With `by_package`
    the nodes of a package, but its triggers, are one; edges that come together so are merged, and guessed only if all of them are.
    """
    trigger = triggers.select(F.col("node").alias("_tr")).distinct()
    every = of.select("node").unionByName(uses.select("node")).distinct().join(trigger, F.col("node") == F.col("_tr"), "left")
    keyed = every.select("node", (F.when(F.col("_tr").isNull(), package_of(F.col("node"))).otherwise(F.col("node")) if by_package else F.col("node")).alias("id"), F.when(F.col("_tr").isNotNull(), "trig").otherwise("proc").alias("type"))
    keys = keyed.select(F.col("node").alias("_n"), F.col("id").alias("_id"))
    none = F.array().cast("array<int>")
    used = uses.join(keys, F.col("node") == F.col("_n")).withColumn("guess", F.coalesce(F.col("conf").isin("llm", "dict"), F.lit(False)))
    row = lambda df, s, t, kind, label, guess, lines=none: df.select(s.alias("s"), t.alias("t"), F.lit(kind).alias("kind"), label.alias("label"), guess.alias("guess"), lines.alias("lines"))
    table, own, no = F.col("table_name"), F.col("_id"), F.lit(False)
    writes = F.array_join(F.array_compact(F.array(*[F.when(F.col("ops").contains(op), F.lit(op)) for op in "CUD"])), ",")
    parts = [
        row(used.filter("contains(ops, 'R')"), table, own, "read", F.lit("R"), F.col("guess")),
        row(used.filter(writes != ""), own, table, "write", writes, F.col("guess")),
        row(used.filter(~F.col("ops").rlike("[CRUD]")), table, own, "use", F.lit("?"), F.lit(True)),
    ]
    called = edges.filter("resolved").join(keys.toDF("_sn", "_s"), F.col("src") == F.col("_sn")).join(keys.toDF("_dn", "_d"), F.col("dst") == F.col("_dn")).filter("_s <> _d")
    parts.append(row(called, F.col("_s"), F.col("_d"), "call", F.lit(""), no, F.col("lines").cast("array<int>")))
    parts.append(row(triggers, F.col("trigger_on"), F.col("node"), "trig", F.col("events"), no))
    parts.append(row(feeds.filter("src <> dst"), F.col("src"), F.col("dst"), "flow", F.lit(""), no))
    lines = reduce(DataFrame.unionByName, parts)
    marks = F.array_distinct(F.flatten(F.collect_list(F.split("label", ","))))
    ordered = F.concat(F.array_compact(F.array(*[F.when(F.array_contains("_marks", op), F.lit(op)) for op in "CRUD"])), F.filter(F.sort_array("_marks"), lambda m: ~m.isin("C", "R", "U", "D", "")))
    merged = lines.groupBy("s", "t", "kind").agg(marks.alias("_marks"), F.bool_and("guess").alias("guess"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))
    merged = merged.select("s", "t", "kind", F.array_join(ordered, ",").alias("label"), "guess", "lines")
    tables = uses.select("table_name").union(triggers.select("trigger_on")).union(feeds.select("src")).union(feeds.select("dst")).distinct().select(F.col("table_name").alias("id"), F.lit("table").alias("type"))
    return keyed.groupBy("id").agg(F.max("type").alias("type")).unionByName(tables), merged


def view(of: DataFrame, edges: DataFrame, center: str | None = None, depth: int | None = None, direction: str = "both", hidden: tuple[str, ...] = (), flows: bool = True, calls: bool = True, copies: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, ref, type, lane, copy, center, more), edges) of the part of a diagram round a node.

    Without a direction all nodes within `depth` steps and every edge between them; `up` or `down` only what lies on the way, two steps a level, since code and tables
    alternate. `more` marks nodes with edges that aren't shown. Tables that are written stand in the lane 2, others in 0, code in 1; one that is written and read
    too is copied into lane 0, where its outgoing edges begin.
    """
    seen = edges.filter(~F.col("s").isin(*hidden) & ~F.col("t").isin(*hidden)) if hidden else edges
    lines = seen.filter((F.col("kind") != "flow") | F.lit(flows)).filter((F.col("kind") != "call") | F.lit(calls))
    if center is None:
        keep = lines.select(F.col("s").alias("id")).union(lines.select("t")).distinct()
        shown_lines = lines
    else:
        start = of.sparkSession.createDataFrame([(center,)], "node string")
        ahead = lines.select(F.col("s").alias("src"), F.col("t").alias("dst"))
        if direction == "up":
            ahead = ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        hops = None if depth is None else depth if direction == "both" else 2 * depth
        found = reach(ahead, start, hops, both_ways=direction == "both").select(F.col("node").alias("id"), "depth")
        keep = found.select("id")
        at = found.select(F.col("id").alias("_i"), "depth")
        if direction == "both":
            shown_lines = lines.join(keep.toDF("_a"), F.col("s") == F.col("_a"), "left_semi").join(keep.toDF("_b"), F.col("t") == F.col("_b"), "left_semi")
        else:
            shown_lines = lines.join(at.filter(F.col("depth") < hops) if hops is not None else at, F.col("t" if direction == "up" else "s") == F.col("_i"), "left_semi")
    inside = lambda df, end: df.join(keep.toDF("_k"), F.col(end) == F.col("_k"), "left").withColumn(f"_in_{end}", F.col("_k").isNotNull()).drop("_k")
    marked = inside(inside(seen, "s"), "t")
    if direction == "up" and center is not None:
        more = marked.filter("_in_t AND NOT _in_s AND kind <> 'call'").select(F.col("t").alias("_m"))
    elif direction == "down" and center is not None:
        more = marked.filter("_in_s AND NOT _in_t AND kind <> 'call'").select(F.col("s").alias("_m"))
    else:
        more = marked.filter("_in_s <> _in_t").select(F.when(F.col("_in_s"), F.col("s")).otherwise(F.col("t")).alias("_m"))
    tables = of.filter("type = 'table'").select(F.col("id").alias("_t"))
    written = shown_lines.filter("kind IN ('write', 'flow')").select(F.col("t").alias("_w")).distinct().join(tables, F.col("_w") == F.col("_t"), "left_semi")
    out = shown_lines.join(written, F.col("s") == F.col("_w"), "left").withColumn("_copied", F.col("_w").isNotNull() & F.lit(copies)).drop("_w")
    copied = out.filter("_copied").select(F.col("s").alias("_c")).distinct()
    out = out.withColumn("s", F.when(F.col("_copied"), F.concat("s", F.lit("@in"))).otherwise(F.col("s"))).drop("_copied")
    base = of.join(keep.toDF("_k"), F.col("id") == F.col("_k"), "left_semi").join(written, F.col("id") == F.col("_w"), "left").join(more.distinct(), F.col("id") == F.col("_m"), "left")
    lane = F.when(F.col("type") != "table", 1).when(F.col("_w").isNotNull(), 2).otherwise(0)
    boxes = base.select("id", F.col("id").alias("ref"), "type", lane.alias("lane"), F.lit(False).alias("copy"), (F.col("id").eqNullSafe(F.lit(center))).alias("center"), F.col("_m").isNotNull().alias("more"))
    twins = boxes.join(copied, F.col("id") == F.col("_c"), "left_semi").select(F.concat("id", F.lit("@in")).alias("id"), "ref", "type", F.lit(0).alias("lane"), F.lit(True).alias("copy"), "center", "more")
    return boxes.unionByName(twins), out


def report(of: DataFrame, edges: DataFrame, uses: DataFrame, found: DataFrame, most: int = 150) -> str:
    """A Markdown report of the whole, with a call graph of at most `most` edges; only what it shows is collected."""
    total = of.count()
    drawn = edges.filter("resolved").orderBy("src", "dst").limit(most + 1).collect()
    rows = lambda df, n=200: [tuple(r) for r in df.limit(n).collect()]
    out = ["# Code analysis", "", f"{total} subprograms, {edges.count()} calls, {uses.select('table_name').distinct().count()} tables", "", "## Findings", ""]
    out += [f"- {kind}: {n}" for kind, n in rows(counts_by_kind(found).orderBy("kind"))]
    out += ["", "## Tables", "", "| Table | Used by | Operations |", "|-|-|-|"]
    out += [f"| {t} | {n} | {ops} |" for t, n, ops in rows(uses.groupBy("table_name").agg(F.count("*").alias("n"), letters(F.collect_set("ops")).alias("ops")).orderBy(F.col("n").desc(), "table_name"))]
    names = {n: f"n{i}" for i, n in enumerate(sorted({x for r in drawn[:most] for x in (r.src, r.dst)}))}
    out += ["", "## Calls", "", "```mermaid", "graph LR", *[f'  {i}["{n}"]' for n, i in names.items()], *[f"  {names[r.src]} --> {names[r.dst]}" for r in drawn[:most]], "```"]
    if len(drawn) > most:
        out.append(f"Only the first {most} calls are drawn.")
    return "\n".join(out) + "\n"
