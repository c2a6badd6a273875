"""Graph operators, in arrays and round by round, on deep graphs and against brute force."""

import random

import pytest

from tessera.operators import graph


@pytest.fixture(params=["arrays", "rounds"])
def way(request, monkeypatch):
    if request.param == "rounds":
        monkeypatch.setattr(graph, "SMALL", 0)
    return request.param


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src int, dst int")


def closure(pairs):
    out = {}
    for n in {x for p in pairs for x in p}:
        seen, todo = {n: 0}, [n]
        while todo:
            todo2 = []
            for x in todo:
                for a, b in pairs:
                    if a == x and b not in seen:
                        seen[b] = seen[x] + 1
                        todo2.append(b)
            todo = todo2
        out[n] = seen
    return out


def test_long_paths_are_followed_to_their_end(spark, way):
    n = 200 if way == "arrays" else 14
    chain = edges_of(spark, [(i, i + 1) for i in range(n)])
    got = {r.node: r.depth for r in graph.reach(chain, spark.createDataFrame([(0,), (500,)], "node int")).filter("origin = 0").collect()}
    assert got == {i: i for i in range(n + 1)}
    assert graph.reach(chain, spark.createDataFrame([(0,)], "node int"), 2).count() == 3
    assert [tuple(r) for r in graph.reach(chain, spark.createDataFrame([(500,)], "node int")).collect()] == [(500, 500, 0)]


@pytest.mark.parametrize("n", [30, 1000])
def test_large_cycles_are_one_component(spark, n):
    ring = edges_of(spark, [(i, (i + 1) % n) for i in range(n)] + [(n - 1, n + 99)])
    assert {(r.node, r.component) for r in graph.strong_components(ring).collect()} == {(i, 0) for i in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_reach_and_impact_against_brute_force(spark, way, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(18), rng.randrange(18)) for _ in range(24)]
    to = closure(pairs)
    want = {}
    for n in to:
        mates = [m for m in to[n] if n in to[m]]
        if len(mates) > 1 or (n, n) in pairs:
            want[n] = min(mates)
    e = edges_of(spark, pairs)
    assert {r.node: r.component for r in graph.strong_components(e).collect()} == want
    starts = spark.createDataFrame([(n,) for n in range(25)], "node int")
    got = {(r.origin, r.node): r.depth for r in graph.reach(e, starts).collect()}
    assert got == {(n, m): d for n in range(25) for m, d in to.get(n, {n: 0}).items()}
    use = [(rng.randrange(20), f"t{rng.randrange(4)}", rng.choice("CRUD")) for _ in range(20)]
    hit = {(t, n) for n in range(25) for m, t, op in use if op != "R" and m in to.get(n, {n: 0})}
    found = graph.impacted(e, starts, spark.createDataFrame(use, "node int, table_name string, op string"))
    assert {(r.table_name, r.origin) for r in found.collect()} == hit


def test_empty_graphs(spark, way):
    none = edges_of(spark, [])
    assert graph.strong_components(none).count() == 0
    assert [tuple(r) for r in graph.reach(none, spark.createDataFrame([(7,)], "node int")).collect()] == [(7, 7, 0)]
    assert graph.impacted(none, spark.createDataFrame([(7,)], "node int"), spark.createDataFrame([(7, "t", "C")], "node int, table_name string, op string").limit(0)).count() == 0


def test_strings_order_by_their_bytes(spark):
    e = spark.createDataFrame([("é", "z"), ("z", "é"), ("a", "é")], "src string, dst string")
    assert {tuple(r) for r in graph.strong_components(e).collect()} == {("é", "z"), ("z", "z")}


def test_names_of_calls(spark):
    body = "PACKAGE BODY"
    members = spark.createDataFrame(
        [("A", "P", body, "X"), ("A", "P", body, "X.Y"), ("A", "P", body, "Y"), ("A", "Q", body, "Z"), ("B", "P", body, "Y"), ("B", "R", body, "W"), ("C", "S", body, "V"), ("D", "S", body, "V"), ("A", "F", "FUNCTION", "F"), ("B", "G", "PROCEDURE", "G")],
        "owner string, unit string, unit_type string, path string",
    )
    calls = [
        ("A", "P", body, "X.Y", "Y"), ("A", "P", body, "X", "Y"), ("B", "P", body, "X", "Y"), ("A", "P", body, "X", "F"), ("A", "P", body, "X", "G"), ("A", "P", body, "X", "P.Y"), ("A", "P", body, "X", "Q.Z"),
        ("A", "P", body, "X", "Q.NONE"), ("A", "P", body, "X", "B.G"), ("A", "P", body, "X", "R.W"), ("A", "P", body, "X", "S.V"), ("A", "P", body, "X", "D.S.V"), ("A", "P", body, "X", "DBMS_OUTPUT.PUT_LINE"), ("A", "P", body, "X", "SYS.X"),
    ]
    got = {(r.owner, r.path, r.callee): (r.target, r.status) for r in graph.resolve_calls(spark.createDataFrame(calls, "owner string, unit string, unit_type string, path string, callee string"), members).collect()}
    assert got == {
        ("A", "X.Y", "Y"): ("A.P.X.Y", "resolved"), ("A", "X", "Y"): ("A.P.X.Y", "resolved"), ("B", "X", "Y"): ("B.P.Y", "resolved"), ("A", "X", "F"): ("A.F", "resolved"), ("A", "X", "G"): (None, "unknown"),
        ("A", "X", "P.Y"): ("A.P.Y", "resolved"), ("A", "X", "Q.Z"): ("A.Q.Z", "resolved"), ("A", "X", "Q.NONE"): (None, "unknown"), ("A", "X", "B.G"): ("B.G", "resolved"), ("A", "X", "R.W"): ("B.R.W", "resolved"),
        ("A", "X", "S.V"): (None, "unknown"), ("A", "X", "D.S.V"): ("D.S.V", "resolved"), ("A", "X", "DBMS_OUTPUT.PUT_LINE"): (None, "system"), ("A", "X", "SYS.X"): (None, "system"),
    }


def test_lineage_by_levels(spark):
    use = spark.createDataFrame([("n1", "a", "R"), ("n1", "b", "C"), ("n2", "b", "R"), ("n2", "c", "U"), ("n2", "d", "D"), ("n3", "c", "R"), ("n3", "a", "C")], "node string, table_name string, op string")
    down = {(r.level, r.table_name, r.node, r.ops, tuple(r.others)) for r in graph.lineage(use, "a", up=False).collect()}
    assert down == {(1, "a", "n1", "R", ("b",)), (2, "b", "n2", "R", ("c",)), (3, "c", "n3", "R", ("a",))}
    up = {(r.level, r.table_name, r.node, r.ops, tuple(r.others)) for r in graph.lineage(use, "c", depth=2).collect()}
    assert up == {(1, "c", "n2", "U", ("b",)), (2, "b", "n1", "C", ("a",))}
