"""The query language on small graphs."""

import pytest

from lattica.plans.builder import compile_query
from lattica.plans.syntax import CypherError, lex, parse


@pytest.fixture(scope="module")
def orders(make_graph):
    sig = '{"signature":"f()"}'
    return make_graph(
        [
            ("A", "Function", "HandleOrder", "test.main.HandleOrder", "main.go", 10, 30, sig),
            ("B", "Function", "ValidateOrder", "test.service.ValidateOrder", "service.go", 5, 20, sig),
            ("C", "Function", "SubmitOrder", "test.service.SubmitOrder", "service.go", 25, 50, sig),
            ("D", "Module", "main", "test.main", "main.go", 0, 0, "{}"),
            ("E", "Function", "LogError", "test.util.LogError", "util.go", 1, 5, "{}"),
        ],
        [("A", "B", "CALLS", "{}"), ("B", "C", "CALLS", "{}"), ("A", "E", "CALLS", "{}"), ("D", "A", "DEFINES", "{}")],
    )[0]


@pytest.fixture(scope="module")
def calls(make_graph):
    return make_graph(
        [("S", "Function", "SendOrder", "t.SendOrder", "caller/client.go", 1, 2, "{}"), ("H", "Function", "HandleOrder", "t.HandleOrder", "handler/routes.go", 1, 2, "{}"), ("P", "Function", "HandleHealth", "t.HandleHealth", "handler/health.go", 1, 2, "{}")],
        [("S", "H", "HTTP_CALLS", '{"url_path":"/api/orders","confidence":0.85,"method":"POST","validated":true}'), ("S", "P", "HTTP_CALLS", '{"url_path":"/health","confidence":0.45}')],
    )[0]


def rows(graph, query, **kw):
    return sorted(tuple(r) for r in compile_query(graph, query, **kw).collect())


@pytest.mark.parametrize(
    "query, expected",
    [
        ("MATCH (f:Function) RETURN f.name", [("HandleOrder",), ("LogError",), ("SubmitOrder",), ("ValidateOrder",)]),
        ("MATCH (f:Function)-[:CALLS]->(g:Function) RETURN f.name, g.name", [("HandleOrder", "LogError"), ("HandleOrder", "ValidateOrder"), ("ValidateOrder", "SubmitOrder")]),
        ('MATCH (f:Function) WHERE f.name =~ ".*Order" RETURN f.name', [("HandleOrder",), ("SubmitOrder",), ("ValidateOrder",)]),
        ('MATCH (f:Function) WHERE f.name STARTS WITH "Submit" RETURN f.name', [("SubmitOrder",)]),
        ('MATCH (f:Function) WHERE f.name CONTAINS "order" RETURN f.name', []),
        ("MATCH (f:Function) WHERE f.start_line > 10 RETURN f.name", [("SubmitOrder",)]),
        ('MATCH (f:Function {name:"HandleOrder"})-[:CALLS*1..2]->(g:Function) RETURN g.name', [("LogError",), ("SubmitOrder",), ("ValidateOrder",)]),
        ('MATCH (f:Function {name:"HandleOrder"})-[:CALLS*3]->(g) RETURN g.name', [("LogError",), ("SubmitOrder",), ("ValidateOrder",)]),
        ('MATCH (f)<-[:CALLS]-(g) WHERE f.name="ValidateOrder" RETURN g.name', [("HandleOrder",)]),
        ("MATCH (f:Function) RETURN DISTINCT f.label", [("Function",)]),
        ('MATCH (f:Function) WHERE f.name = "HandleOrder" OR f.name = "LogError" RETURN f.name', [("HandleOrder",), ("LogError",)]),
        ('MATCH (f:Function) WHERE f.name = "HandleOrder" OR f.name = "LogError" AND f.start_line > 3 RETURN f.name', [("HandleOrder",)]),
        ('MATCH (f:Function) WHERE NOT (f.name CONTAINS "Order") RETURN f.name', [("LogError",)]),
        ("MATCH (a:Function)-[:CALLS]->(b)-[:CALLS]->(c) RETURN a.name, COUNT(c)", [("HandleOrder", 1)]),
        ("MATCH (a:Function)-[:CALLS]->(b) RETURN COUNT(b)", [(3,)]),
        ("MATCH (a:Class)-[:CALLS]->(b) RETURN COUNT(*) AS n", [(0,)]),
        ("MATCH (f:Function) WHERE f.signature IS NULL RETURN f.name", [("LogError",)]),
        ("MATCH (f:Function)-[r:CALLS|DEFINES]-(x) WHERE f.name = 'HandleOrder' RETURN r.type, x.name", [("CALLS", "LogError"), ("CALLS", "ValidateOrder"), ("DEFINES", "main")]),
        ("MATCH (f:Function) WHERE f.name <> 'LogError' AND f.start_line IN [5, 10] RETURN f.name // done", [("HandleOrder",), ("ValidateOrder",)]),
        ("MATCH (f:Function) WHERE f.name ENDS WITH 'Error' RETURN f.name", [("LogError",)]),
    ],
)
def test_orders(orders, query, expected):
    assert rows(orders, query) == expected


@pytest.mark.parametrize(
    "where, expected",
    [("r.confidence >= 0.6", ["HandleOrder"]), ("r.confidence < 0.5", ["HandleHealth"]), ("r.method = 'DELETE'", []), ("r.type='HTTP_CALLS'", ["HandleHealth", "HandleOrder"]), ("r.validated = true", ["HandleOrder"]), ("r.url_path CONTAINS 'orders'", ["HandleOrder"]), ("r.method > 5", [])],
)
def test_edge_properties(calls, where, expected):
    assert [g for (g,) in rows(calls, f"MATCH (f)-[r:HTTP_CALLS]->(g) WHERE {where} RETURN g.name")] == expected


def test_order_limit_and_cap(orders):
    top = compile_query(orders, "MATCH (f:Function)-[:CALLS]->(g:Function) RETURN f.name, COUNT(g) AS n ORDER BY n DESC LIMIT 1").collect()
    assert [tuple(r) for r in top] == [("HandleOrder", 2)]
    assert [r[0] for r in compile_query(orders, "MATCH (f:Function) RETURN f.name ORDER BY f.start_line DESC").collect()] == ["SubmitOrder", "HandleOrder", "ValidateOrder", "LogError"]
    assert len(rows(orders, "MATCH (f) RETURN f.name", max_rows=2)) == 2
    assert len(rows(orders, "MATCH (f) RETURN f.name LIMIT 4", max_rows=2)) == 4


def test_default_projection_and_whole(orders):
    out = compile_query(orders, "MATCH (d:Module)-[r:DEFINES]->(f)")
    assert out.columns == ["d.label", "d.name", "d.qualified_name", "f.label", "f.name", "f.qualified_name", "r.type"]
    whole = compile_query(orders, "MATCH (d:Module)-[r:DEFINES]->(f) RETURN d, r").first()
    assert whole["d"]["name"] == "main" and whole["r"]["type"] == "DEFINES"


@pytest.mark.parametrize(
    "query",
    ["RETURN 1", "MATCH (f", "MATCH (f) RETURN g.name", "MATCH (f) WHERE f.name RETURN f", "MATCH (f) RETURN f.name extra", "MATCH (f) WHERE f.name =~ '(' RETURN f.name", "MATCH (f) WHERE f.start_line > 'x' RETURN f.name", "MATCH (f)-[r:A*1..2]->(g) RETURN r", "MATCH (a)-[:X]->(a) RETURN a.name", "MATCH (f) RETURN f.name LIMIT x", "MATCH (f)-[:A*3..1]->(g) RETURN g.name"],
)
def test_errors(orders, query):
    with pytest.raises(CypherError):
        compile_query(orders, query)


def test_lexer_and_labels_like_keywords():
    assert [t.kind for t in lex("MATCH (a:Order) /* x */ 'it\\'s' 1.5 *1..3")] == ["keyword", "sign", "word", "sign", "keyword", "sign", "string", "number", "sign", "number", "sign", "number", "end"]
    assert parse("match (o:Order) return o.name").nodes[0].label == "Order"
    assert parse("MATCH (a)-[:T*]->(b)").rels[0].high is None and parse("MATCH (a)-[:T*..4]->(b)").rels[0].high == 4


def test_closed_graphs_take_ids_from_edges(orders):
    from lattica.model import Graph

    closed = Graph(orders.nodes, orders.edges, closed=True)
    for query in (
        "MATCH (a)-[:CALLS]->(b)-[:CALLS]->(c) RETURN COUNT(c)", "MATCH (a)-[:CALLS]->(b) RETURN COUNT(DISTINCT b) AS n", "MATCH (a)-[:CALLS]-(b:Function) RETURN b.name, COUNT(a)", "MATCH ()-[r]->() RETURN r.type, COUNT(*)",
        "MATCH (a)-[:CALLS]->(b)", "MATCH (a)-[:CALLS]->(b) RETURN a", "MATCH (a:Function)-[:CALLS*1..2]->(b) RETURN a.name, COUNT(b)", "MATCH (a)-[:CALLS]->(b) WHERE a.name = 'HandleOrder' RETURN COUNT(b)",
    ):
        assert rows(closed, query) == rows(orders, query), query
    plan = lambda g: compile_query(g, "MATCH (a)-[:CALLS]->(b) RETURN COUNT(b)")._jdf.queryExecution().optimizedPlan().toString()
    assert plan(closed).count("Join") == 0 < plan(orders).count("Join")
