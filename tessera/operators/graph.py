"""Operators over nodes and edges: degrees, entries, reachability, components, impact, lineage, calls.

A graph of at most SMALL distinct edges (the check reads no more than that) is sent to the workers as arrays, and they search from their own
origins or tables. Beyond, frontiers are joined with the edges, round by round, each round checkpointed in the shared folder. Both ways have no bound on depth and
give the same rows. Neither makes pairs of nodes but where they are the result.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import checkpointed

#: Distinct edges that a worker holds at most (some 50 MB with names).
SMALL = 1_000_000


class Arrays:
    """A small graph: sorted names of nodes, and the ends of each node's edges."""

    def __init__(self, names: pa.Array, src: np.ndarray, dst: np.ndarray):
        order = np.lexsort((dst, src))
        self.names, self.src, self.ends = names, src[order], dst[order]
        self.first = np.searchsorted(self.src, np.arange(len(names) + 1))

    def reversed(self) -> Arrays:
        return Arrays(self.names, self.ends, self.src)

    def places(self, names) -> np.ndarray:
        """Where names stand among the nodes; -1: nowhere."""
        if not len(self.names):
            return np.full(len(names), -1)
        found = pc.index_in(names.cast(self.names.type), self.names)
        return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def next(self, nodes: np.ndarray) -> np.ndarray:
        """The ends of all edges from some nodes."""
        a, n = self.first[nodes], self.first[nodes + 1] - self.first[nodes]
        total = int(n.sum())
        if not total:
            return np.zeros(0, np.int64)
        return self.ends[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)]

    def search(self, start: np.ndarray, seen: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes reached, steps to each) from some nodes, themselves at 0. `seen` is all False before and after."""
        now = np.unique(start)
        seen[now] = True
        found, depth = [now], 0
        while len(now) and depth != most:
            now = self.next(now)
            now = np.unique(now[~seen[now]])
            seen[now] = True
            depth += 1
            found.append(now)
        nodes = np.concatenate(found)
        seen[nodes] = False
        return nodes, np.repeat(np.arange(len(found)), [len(f) for f in found])


def arrays(edges: DataFrame) -> Arrays | None:
    """The distinct edges (src, dst) as arrays if there are at most SMALL, else None; no more are read than that check needs."""
    kind = edges.schema["src"].dataType
    got = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", F.col("dst").cast(kind).alias("dst")).distinct().limit(SMALL + 1).toArrow()
    if got.num_rows > SMALL:
        return None
    src, dst = (got.column(c).combine_chunks() for c in ("src", "dst"))
    names = pc.unique(pa.concat_arrays([src, dst]))
    names = names.take(pc.sort_indices(names))
    at = lambda c: pc.index_in(c, names).to_numpy(zero_copy_only=False).astype(np.int64) if len(c) else np.zeros(0, np.int64)
    return Arrays(names, at(src), at(dst))


def edges_of(df: DataFrame, src: str, dst: str, line: str | None = None) -> DataFrame:
    """Edges once each, with their sorted lines."""
    grouped = df.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return grouped.agg(F.sort_array(F.collect_set(line)).alias("lines")) if line else grouped.agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out) without edges of a node to itself."""
    own = edges.filter("src <> dst")
    ends = own.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(own.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def entries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no other node calls."""
    return nodes.join(edges.filter("src <> dst").select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def reach(edges: DataFrame, start: DataFrame, most: int | None = None, both_ways: bool = False) -> DataFrame:
    """(origin, node, depth) from each start node, itself included at depth 0: until nothing is new, or for `most` steps."""
    steps = edges.select("src", "dst")
    if both_ways:
        steps = steps.union(steps.select("dst", "src"))
    origins = start.select(F.col("node").alias("origin")).filter("origin IS NOT NULL").distinct()
    small = arrays(steps)
    return _reach_apart(steps, origins, most) if small is None else _reach_small(small, origins, most)


def _reach_small(graph: Arrays, origins: DataFrame, most: int | None) -> DataFrame:
    shared = origins.sparkSession.sparkContext.broadcast(graph)

    def search(batches):
        g = shared.value
        seen = np.zeros(len(g.names), bool)
        for batch in batches:
            column = batch.column(0)
            for i, place in enumerate(g.places(column)):
                nodes, depth = g.search(np.array([place]), seen, most) if place >= 0 else (np.zeros(0, np.int64), np.zeros(1, np.int64))
                found = g.names.take(pa.array(nodes)) if place >= 0 else column[i : i + 1]
                yield pa.RecordBatch.from_arrays([column.take(pa.array(np.full(len(found), i))), found.cast(column.type), pa.array(depth, pa.int32())], names=["origin", "node", "depth"])

    kind = origins.schema["origin"].dataType.simpleString()
    return origins.mapInArrow(search, f"origin {kind}, node {kind}, depth int")


def _reach_apart(steps: DataFrame, origins: DataFrame, most: int | None) -> DataFrame:
    # every round joins with the steps, so they are computed once
    steps = checkpointed(steps.distinct())
    seen = origins.select("origin", F.col("origin").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for depth in count(1) if most is None else range(1, most + 1):
        found = frontier.join(steps, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct()
        found = found.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("depth", F.lit(depth))
        found = checkpointed(found)
        if found.isEmpty():
            break
        seen = seen.unionByName(found)
        if depth % 10 == 0:
            seen = checkpointed(seen)
        frontier = found
    return seen


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of those that reach each other; only components of two nodes or more, or with a loop."""
    small = arrays(edges)
    if small is None:
        return _components_apart(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    label = _tarjan(small)
    sizes = np.bincount(label, minlength=len(label))
    loops = np.zeros(len(label), bool)
    loops[small.src[small.src == small.ends]] = True
    some = np.flatnonzero((sizes[label] > 1) | loops) if len(label) else np.zeros(0, np.int64)
    kind = edges.schema["src"].dataType
    table = pa.table({"node": small.names.take(pa.array(some)), "component": small.names.take(pa.array(label[some]))})
    return edges.sparkSession.createDataFrame(table, T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))


def _tarjan(graph: Arrays) -> np.ndarray:
    """The least member of each node's strong component, without recursion."""
    n = len(graph.names)
    first, ends = graph.first.tolist(), graph.ends.tolist()
    order, low, label, stack, waiting, clock = [-1] * n, [0] * n, [-1] * n, [], [], 0
    for root in range(n):
        if order[root] >= 0:
            continue
        waiting.append((root, first[root]))
        while waiting:
            node, at = waiting.pop()
            if order[node] < 0:
                order[node] = low[node] = clock
                clock += 1
                stack.append(node)
            pushed = False
            while at < first[node + 1]:
                other = ends[at]
                at += 1
                if order[other] < 0:
                    waiting += [(node, at), (other, first[other])]
                    pushed = True
                    break
                if label[other] < 0:
                    low[node] = min(low[node], order[other])
            if pushed:
                continue
            if low[node] == order[node]:
                members = []
                while True:
                    members.append(stack.pop())
                    if members[-1] == node:
                        break
                least = min(members)
                for m in members:
                    label[m] = least
            if waiting:
                above = waiting[-1][0]
                low[above] = min(low[above], low[node])
    return np.array(label, np.int64)


def _spread(labels: DataFrame, steps: DataFrame) -> DataFrame:
    """(node, label): the least label that reaches each node along steps (src, dst), its own included."""
    now = labels
    while True:
        moved = now.join(steps, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.min("label").alias("other"))
        after = now.join(moved, F.col("node") == F.col("to"), "left").select("node", F.least("label", "other").alias("label"), F.coalesce(F.col("other") < F.col("label"), F.lit(False)).alias("less"))
        after = checkpointed(after)
        if after.filter("less").isEmpty():
            return after.select("node", "label")
        now = after.select("node", "label")


def _components_apart(edges: DataFrame) -> DataFrame:
    """Forward colours, and from each colour's own node backwards within the colour: those found are a component and leave the graph."""
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct()
    rest = checkpointed(edges.filter("src <> dst"))
    found = None
    while not rest.isEmpty():
        inner = rest.select(F.col("src").alias("node")).intersect(rest.select(F.col("dst").alias("node")))
        inner = checkpointed(inner)  # nodes without an edge in or out are in no cycle
        rest = rest.join(inner.select(F.col("node").alias("src")), "src", "left_semi").join(inner.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
        rest = checkpointed(rest)
        if rest.isEmpty():
            break
        colours = _spread(inner.select("node", F.col("node").alias("label")), rest)
        of = lambda end: colours.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        back = rest.join(of("src"), "src").join(of("dst"), "dst").filter("src_label = dst_label").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        back = checkpointed(back)
        mine = _reach_marked(colours.filter("node = label").select("node"), back)
        part = checkpointed(colours.join(mine, "node", "left_semi").withColumnRenamed("label", "component"))
        found = part if found is None else found.unionByName(part)
        gone = part.select("node")
        rest = checkpointed(rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    loops = loops.select("node", F.col("node").alias("component"))
    if found is None:
        return loops
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")
    many = found.join(sizes, "component", "left_semi").select("node", "component")
    return many.unionByName(loops.join(many, "node", "left_anti"))


def _reach_marked(start: DataFrame, steps: DataFrame) -> DataFrame:
    """Nodes reached from any start node along steps (src, dst)."""
    seen = frontier = checkpointed(start.distinct())
    while True:
        found = frontier.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        found = checkpointed(found)
        if found.isEmpty():
            return seen
        seen, frontier = seen.unionByName(found), found


def impacted(edges: DataFrame, origins: DataFrame, use: DataFrame) -> DataFrame:
    """(table_name, origin): which origins (node) reach a node that writes a table; use has (node, table_name, op).

    The search goes backwards from the writers of each table, so that no pair of nodes is made.
    """
    writes = use.filter(F.col("op").isin("C", "U", "D")).select("table_name", "node").distinct()
    steps = edges.select("src", "dst")
    small = arrays(steps)
    reached = _writers_apart(steps, writes) if small is None else _writers_small(small.reversed(), writes)
    return reached.join(origins.select("node").distinct(), "node", "left_semi").select("table_name", F.col("node").alias("origin"))


def _writers_small(back: Arrays, writes: DataFrame) -> DataFrame:
    shared = writes.sparkSession.sparkContext.broadcast(back)

    def search(rows: pa.Table) -> pa.Table:
        g, nodes = shared.value, rows.column("node").combine_chunks()
        places = g.places(nodes)
        found, _ = g.search(places[places >= 0], np.zeros(len(g.names), bool))
        apart = nodes.filter(pa.array(places < 0))  # writers without edges
        all_of = pa.concat_arrays([g.names.take(pa.array(found)).cast(nodes.type), apart])
        return pa.table({"table_name": pa.array([rows.column("table_name")[0].as_py()] * len(all_of), rows.schema.field("table_name").type), "node": all_of})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in writes.schema)
    return writes.groupBy("table_name").applyInArrow(search, kinds)


def _writers_apart(steps: DataFrame, writes: DataFrame) -> DataFrame:
    back = checkpointed(steps.select(F.col("dst").alias("_from"), F.col("src").alias("_to")).distinct())
    seen = frontier = checkpointed(writes)
    while True:
        found = frontier.join(back, F.col("node") == F.col("_from")).select("table_name", F.col("_to").alias("node")).distinct()
        found = checkpointed(found.join(seen, ["table_name", "node"], "left_anti"))
        if found.isEmpty():
            return seen
        seen, frontier = seen.unionByName(found), found


def impact(edges: DataFrame, origins: DataFrame, use: DataFrame) -> DataFrame:
    """(table_name, n_origins): how many origins reach a node that writes a table."""
    return impacted(edges, origins, use).groupBy("table_name").agg(F.count("*").alias("n_origins"))


def crud_matrix(use: DataFrame) -> DataFrame:
    """(table_name, node, ops) with the letters in the order C, R, U, D."""
    ops = F.concat(*[F.when(F.array_contains("_ops", op), F.lit(op)).otherwise(F.lit("")) for op in "CRUD"])
    return use.groupBy("table_name", "node").agg(F.collect_set("op").alias("_ops")).select("table_name", "node", ops.alias("ops"))


def lineage_steps(use: DataFrame) -> DataFrame:
    """(src, dst): tables read and written by the same node."""
    reads = use.filter("op = 'R'").select("node", F.col("table_name").alias("src")).distinct()
    writes = use.filter(F.col("op").isin("C", "U", "D")).select("node", F.col("table_name").alias("dst")).distinct()
    return reads.join(writes, "node").filter("src <> dst").select("src", "dst").distinct()


def lineage(use: DataFrame, table: str, up: bool = True, depth: int = 3) -> DataFrame:
    """(level, table_name, node, ops, others): by levels from a table, the nodes that write it and the tables these read (up), or that read it and the tables
    these write (down). The table is at level 1; a table met before isn't followed again; only C and U count as writes.
    """
    ops = use.filter(F.col("op").isin("C", "R", "U")).select("node", "table_name", F.when(F.col("op") == "R", "R").otherwise("W").alias("way"), "op").distinct()
    here, there = ("W", "R") if up else ("R", "W")
    own = ops.filter(F.col("way") == here).groupBy("node", "table_name").agg(F.array_join(F.sort_array(F.collect_set("op")), "").alias("ops"))
    other = ops.filter(F.col("way") == there).select(F.col("node").alias("_n"), F.col("table_name").alias("_o")).distinct()
    steps = own.join(other, F.col("node") == F.col("_n")).filter("_o <> table_name").select(F.col("table_name").alias("src"), F.col("_o").alias("dst"))
    start = use.sparkSession.createDataFrame([(table,)], "node string")
    levels = reach(steps, start, max(0, min(depth, 10) - 1)).select(F.col("node").alias("_t"), (F.col("depth") + 1).alias("level"))
    met = own.join(levels, F.col("table_name") == F.col("_t"))
    others = other.groupBy(F.col("_n")).agg(F.sort_array(F.collect_set("_o")).alias("_others"))
    out = met.join(others, F.col("node") == F.col("_n"), "left")
    return out.select("level", "table_name", "node", "ops", F.array_remove(F.coalesce("_others", F.array().cast("array<string>")), F.col("table_name")).alias("others"))


#: Names of the system's packages.
SYSTEM = r"^(SYS\.|((SYS|PUBLIC)\.)?(DBMS_|UTL_|OWA|HTP|HTF|APEX_|CTX_|SDO_|STANDARD(\.|$)))"


def node_id(owner: str = "owner", unit: str = "unit", unit_type: str = "unit_type", path: str = "path"):
    """The node of a subprogram: by its path alone in a standalone unit, by its unit for a trigger, by both in a package."""
    alone, trigger = F.col(unit_type).isin("PROCEDURE", "FUNCTION"), F.col(unit_type) == "TRIGGER"
    return F.when(alone, F.concat_ws(".", owner, path)).when(trigger, F.concat_ws(".", owner, unit)).otherwise(F.concat_ws(".", owner, unit, path))


def resolve_calls(calls: DataFrame, members: DataFrame) -> DataFrame:
    """(owner, unit, unit_type, path, callee, target, status) for calls (owner, unit, unit_type, path, callee) among members (owner, unit, unit_type, path).

    A bare name is looked for in the caller's unit, from its own scope outwards, then among the standalone units of its owner. `a.b` is the caller's own
    unit `a`; else a package `a` of its owner, which alone decides if there is one; else the standalone unit `b` of owner `a`; else the
    package `a` if one owner only has one. `o.a.b` is in the package `a` of owner `o`. Packages are units whose type ends with BODY.
    """
    m = members.select("owner", "unit", "unit_type", "path", node_id().alias("node")).distinct()
    within = m.select(F.col("owner").alias("_o"), F.col("unit").alias("_u"), F.col("unit_type").alias("_t"), F.col("path").alias("_p"), F.col("node").alias("_node"))
    bodies = m.filter("unit_type LIKE '%BODY'")
    alone = m.filter("unit_type NOT LIKE '%BODY' AND instr(path, '.') = 0").select(F.col("owner").alias("_o"), F.col("path").alias("_p"), F.col("node").alias("_node"))
    c = calls.select("owner", "unit", "unit_type", "path", "callee").distinct().withColumn("_parts", F.split("callee", "\\."))
    key = ["owner", "unit", "unit_type", "path", "callee"]
    same_unit = (F.col("owner") == F.col("_o")) & (F.col("unit") == F.col("_u")) & (F.col("unit_type") == F.col("_t"))

    one = c.filter(F.size("_parts") == 1)
    scopes = F.split("path", "\\.")
    inner = F.transform(F.sequence(F.lit(0), F.size(scopes)), lambda k: F.struct(k.alias("rank"), F.concat_ws(".", F.slice(scopes, F.lit(1), F.size(scopes) - k), F.array(F.col("callee"))).alias("at")))
    tried = one.select(*key, F.explode(inner).alias("s")).select(*key, "s.rank", "s.at")
    found = tried.join(within, same_unit & (F.col("at") == F.col("_p"))).select(*key, "rank", "_node")
    found = found.unionByName(one.join(alone, (F.col("owner") == F.col("_o")) & (F.col("callee") == F.col("_p"))).select(*key, F.lit(1000).alias("rank"), "_node"))

    two = c.filter(F.size("_parts") == 2).withColumn("_a", F.col("_parts")[0]).withColumn("_b", F.col("_parts")[1])
    in_body = bodies.select(F.col("owner").alias("_o"), F.col("unit").alias("_u"), F.col("path").alias("_p"), F.col("node").alias("_node"))
    packages = bodies.select(F.col("owner").alias("_o"), F.col("unit").alias("_u")).distinct()
    own = two.join(within, same_unit & (F.col("_a") == F.col("unit")) & (F.col("_b") == F.col("_p"))).select(*key, F.lit(1).alias("rank"), "_node")
    # a package of the same owner decides, whether it holds the name or not
    decided = two.join(packages, (F.col("owner") == F.col("_o")) & (F.col("_a") == F.col("_u")), "left_semi")
    beside = decided.join(in_body, (F.col("owner") == F.col("_o")) & (F.col("_a") == F.col("_u")) & (F.col("_b") == F.col("_p")), "left").select(*key, F.lit(2).alias("rank"), "_node")
    far = two.join(alone, (F.col("_a") == F.col("_o")) & (F.col("_b") == F.col("_p"))).select(*key, F.lit(3).alias("rank"), "_node")
    only = packages.groupBy("_u").agg(F.count("*").alias("_n"), F.min("_o").alias("_only")).filter("_n = 1")
    other = two.join(only, F.col("_a") == F.col("_u")).drop("_u").join(in_body, (F.col("_only") == F.col("_o")) & (F.col("_a") == F.col("_u")) & (F.col("_b") == F.col("_p"))).select(*key, F.lit(4).alias("rank"), "_node")

    three = c.filter(F.size("_parts") == 3)
    full = three.join(in_body, (F.col("_parts")[0] == F.col("_o")) & (F.col("_parts")[1] == F.col("_u")) & (F.col("_parts")[2] == F.col("_p"))).select(*key, F.lit(1).alias("rank"), "_node")
    for more in (own, beside, far, other, full):
        found = found.unionByName(more)
    best = found.groupBy(*key).agg(F.min(F.struct("rank", "_node")).alias("best")).select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("best._node").alias("target"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    status = F.when(F.col("target").isNotNull(), "resolved").when(F.col("callee").rlike(SYSTEM), "system").otherwise("unknown")
    return c.join(best, same, "left").select(*key, "target", status.alias("status"))


def busiest(edges: DataFrame) -> DataFrame:
    return degrees(edges).withColumn("degree", F.col("n_in") + F.col("n_out")).orderBy(F.col("degree").desc(), "node").select("node", "degree").limit(1)


def three_way(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """both, a_only or b_only for each key."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return left.join(right, key, "full").select(key, F.when(F.col("_b").isNull(), "a_only").when(F.col("_a").isNull(), "b_only").otherwise("both").alias("side"))
