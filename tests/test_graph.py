"""Traversal, search, roll-ups, writes and joins on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.model import EDGE_SCHEMA, NODE_SCHEMA, Graph
from lattica.operators import architecture as A, community, incremental, joins, search as S, traverse as T, upsert


def plain(nodes, edges, make_graph):
    return make_graph([(n, "Function", n, f"t.{n}", "a.go", 1, 2, "{}") for n in nodes], [(a, b, k, "{}") for a, b, k in edges])


def start(spark, i):
    return spark.createDataFrame([(i,)], "id long")


def test_chain_and_risk(spark, make_graph):
    g, ids = plain("ABCD", [("A", "B", "CALLS"), ("B", "C", "CALLS"), ("C", "D", "CALLS")], make_graph)
    found = T.trace(g, start(spark, ids["A"]), "outbound", 3)
    assert [(r["name"], r["hop"], r["risk"]) for r in found.orderBy("hop").collect()] == [("B", 1, "CRITICAL"), ("C", 2, "HIGH"), ("D", 3, "MEDIUM")]
    edges = T.bfs_edges(g, start(spark, ids["A"]), ("CALLS",), "out", 2)
    assert sorted((r["from_name"], r["to_name"]) for r in edges.collect()) == [("A", "B"), ("B", "C")]


def test_random_graphs_against_set_walks(spark, make_graph):
    rng = random.Random(4)
    names = [f"n{i}" for i in range(12)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(22)})
    g, ids = plain(names, [(a, b, "CALLS") for a, b in pairs], make_graph)
    for direction in ("out", "in", "any"):
        steps = {"out": pairs, "in": [(b, a) for a, b in pairs], "any": pairs + [(b, a) for a, b in pairs]}[direction]
        now, want = {"n0"}, set()
        for hop in range(1, 5):
            now = {b for a, b in steps if a in now}
            want |= {(n, hop) for n in now}
        got = {(r["name"], r["hop"]) for r in T.bfs(g, start(spark, ids["n0"]), ("CALLS",), direction, 4).collect()}
        assert got == want, direction


def test_impact_takes_the_nearest_change(spark, make_graph):
    g, ids = plain("ABCDX", [("A", "B", "CALLS"), ("B", "C", "CALLS"), ("A", "X", "CALLS"), ("C", "C", "CALLS")], make_graph)
    changed = spark.createDataFrame([(ids["C"],), (ids["X"],)], "id long")
    rows = T.impact(g, changed, 3)
    assert sorted((r["name"], r["hop"], r["changed_by"]) for r in rows.collect()) == [("A", 1, "t.X"), ("B", 1, "t.C")]
    assert T.impact_summary(rows, g.edges).first().asDict() == {"critical": 2, "high": 0, "medium": 0, "low": 0, "total": 2, "cross_service": False}


def test_degrees_and_dead_code(make_graph):
    g, _ = plain("ABC", [("A", "B", "CALLS"), ("A", "C", "CALLS"), ("B", "C", "CALLS"), ("A", "C", "USAGE")], make_graph)
    both = {r["name"]: (r["in_degree"], r["out_degree"]) for r in S.with_degrees(g, g.nodes).collect()}
    calls = {r["name"]: (r["in_degree"], r["out_degree"]) for r in S.with_degrees(g, g.nodes, ("CALLS",)).collect()}
    assert both == {"A": (0, 3), "B": (1, 1), "C": (3, 0)} and calls == {"A": (0, 2), "B": (1, 1), "C": (2, 0)}
    assert [r["name"] for r in S.dead_code(g).collect()] == ["A"]
    assert {r["name"] for r in S.search(g, max_degree=0, direction="inbound").collect()} == {"A"}


def test_search_page_and_relevance(make_graph):
    g, _ = make_graph([("a", "Function", "SubmitOrder", "t.main.SubmitOrder", "main.go", 1, 2, "{}"), ("b", "Function", "ProcessOrder", "t.service.ProcessOrder", "service.go", 1, 2, "{}"), ("c", "Class", "OrderService", "t.service.OrderService", "service.go", 1, 2, "{}"), ("d", "Community", "order", "t.order", "", 0, 0, "{}")], [])
    assert S.search(g, label="Function").count() == 2 and S.search(g, name_pattern=".*submit.*").count() == 1 and S.search(g, file_pattern="service*").count() == 2
    page = S.page(S.search(g, name_pattern="order"), S.relevance("order"), 0, 1).first()
    assert page["name"] == "OrderService" and page["total"] == 3


def test_architecture(make_graph):
    files = [(f"f{i}", "File", n, f"p.{n}.__file__", n, 0, 0, "{}") for i, n in enumerate(["main.go", "handler.go", "service.go", "model.py", "utils.js"])]
    fn = lambda k, pkg, path: (k, "Function", k, f"p.cmd.{pkg}.{k}", path, 1, 9, '{"is_entry_point":true}' if k == "main" else "{}")
    g, _ = make_graph(
        [*files, fn("main", "server", "main.go"), fn("HandleRequest", "handler", "handler.go"), fn("ProcessOrder", "service", "service.go"), fn("ValidateOrder", "service", "service.go"), fn("formatDate", "utils", "utils.js"), fn("TestHandleRequest", "handler", "handler_test.go"), ("R", "Route", "POST /api/orders", "p.cmd.handler.route", "", 0, 0, '{"method":"POST","path":"/api/orders"}')],
        [("main", "HandleRequest", "CALLS", "{}"), ("HandleRequest", "ProcessOrder", "CALLS", "{}"), ("ProcessOrder", "ValidateOrder", "CALLS", "{}"), ("ProcessOrder", "formatDate", "CALLS", "{}"), ("TestHandleRequest", "HandleRequest", "CALLS", "{}"), ("HandleRequest", "R", "HANDLES", "{}")],
    )
    assert {(r["language"], r["files"]) for r in A.languages(g).collect()} == {("Go", 3), ("Python", 1), ("JavaScript", 1)}
    assert {(r["from_package"], r["to_package"]) for r in A.boundaries(g).collect()} == {("server", "handler"), ("handler", "service"), ("service", "utils")}
    assert A.routes(g).first().asDict() == {"method": "POST", "path": "/api/orders", "handler": "HandleRequest"}
    assert A.hotspots(g).first()["name"] == "HandleRequest" and [r["name"] for r in A.entry_points(g).collect()] == ["main"]
    layers = {r["package"]: r["layer"] for r in A.layers(g).collect()}
    assert layers["handler"] == "api" and layers["server"] == "entry" and layers["utils"] == "leaf"
    assert A.patterns(g).where("type = 'HANDLES'").first()["pattern"] == "(:Function)-[:HANDLES]->(:Route) [1x]"
    assert A.file_tree(g).count() == 5


def test_upserts_and_deletes(spark, make_graph):
    g, ids = make_graph([("A", "Function", "a", "t.a", "x.go", 1, 2, '{"k":1}'), ("B", "Function", "b", "t.b", "y.go", 1, 2, "{}")], [("A", "B", "CALLS", '{"n":1,"s":"x","o":{"a":[1,2]}}')])
    columns = "id long, project string, label string, name string, qualified_name string, file_path string, start_line int, end_line int, properties string, seq long"
    writes = spark.createDataFrame([(9, "test", "Method", "a2", "t.a", "z.go", 3, 4, None, 1), (8, "test", "Class", "a3", "t.a", "z.go", 3, 4, None, 2)], columns)
    done = {r["qualified_name"]: r for r in upsert.upsert_nodes(g.nodes, writes).collect()}
    assert done["t.a"]["name"] == "a3" and done["t.a"]["properties"] == '{"k":1}' and len(done) == 2
    w = g.edges.withColumns({"properties": F.lit('{"s":"y","n":null,"z":true}'), "seq": F.lit(1).cast("long")})
    assert upsert.upsert_edges(g.edges, w).first()["properties"] == '{"n":1,"o":{"a":[1,2]},"s":"y","z":true}'
    assert upsert.delete_nodes(g, F.col("name") == "b").edges.count() == 0
    assert upsert.delete_edges_from_file(g, "x.go").edges.count() == 0 and upsert.delete_edges_from_file(g, "y.go").edges.count() == 1


def test_overlap(spark, make_graph):
    g, _ = make_graph([("a", "Function", "funcA", "t.a", "src/main.go", 1, 10, "{}"), ("b", "Function", "funcB", "t.b", "src/main.go", 12, 25, "{}"), ("c", "Function", "funcC", "t.c", "other.go", 1, 50, "{}"), ("m", "Module", "m", "t.m", "src/main.go", 1, 100, "{}")], [])
    for path, a, b, want in (("main.go", 5, 8, {"funcA"}), ("src/main.go", 8, 15, {"funcA", "funcB"}), ("main.go", 26, 30, set()), ("other.go", 1, 50, {"funcC"}), ("ain.go", 1, 50, set())):
        hunks = spark.createDataFrame([(path, a, b)], "path string, start_line int, end_line int")
        assert {r["name"] for r in joins.overlapping(g.nodes, hunks).collect()} == want, path
    files = spark.createDataFrame([("other.go",)], "path string")
    assert {r["name"] for r in joins.changed_symbols(g.nodes, hunks, files).collect()} == {"funcC"}


def test_coupling(spark):
    rows = [(h, f) for h, fs in {"aaa": "abc", "bbb": "ab", "ccc": "ab", "ddd": "ac", "eee": "de"}.items() for f in fs] + [("big", f"f{i}") for i in range(25)]
    found = joins.change_coupling(spark.createDataFrame(rows, "hash string, file string")).collect()
    assert [(r["file_a"], r["file_b"], r["changes"], r["score"]) for r in found] == [("a", "b", 3, 1.0)]


@pytest.mark.parametrize("values, want", [(list(range(10, 101, 10)), 100), ([42], 42), (list(range(1, 101)), 100), ([5] * 300 + [9], 5)])
def test_p99(spark, values, want):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v long")
    assert joins.p99_by(df, "k", "v").first()["p99"] == want


def test_incremental(spark):
    schema = "project string, rel_path string, sha256 string, mtime_ns long, size long"
    old = spark.createDataFrame([("p", "a", "1", 1, 1), ("p", "b", "1", 1, 1), ("p", "c", "1", 1, 1), ("p", "gone", "1", 1, 1)], schema)
    new = spark.createDataFrame([("p", "a", "1", 1, 1), ("p", "b", "1", 2, 1), ("p", "c", "2", 2, 1), ("p", "new", "1", 1, 1)], schema)
    assert {r["rel_path"]: r["status"] for r in incremental.classify(new, old).collect()} == {"a": "unchanged", "b": "unchanged", "c": "changed", "new": "new", "gone": "removed"}


def test_empty_graph(spark):
    g = Graph(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))
    assert A.layers(g).count() == 0 and community.louvain(g).count() == 0 and S.search(g).count() == 0
