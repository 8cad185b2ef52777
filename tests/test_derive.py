"""Resolution, links, traces, git text, files, endpoints and refresh."""

import json

import pytest
from pyspark.sql import functions as F

from lattica.functions import adr, names
from lattica.operators import code_search, derive, http, resolve
from lattica.sources import otlp, text
from lattica.sources.files import IgnoreRules, json_urls, python_facts

REF = "ref_id long, project string, callee string, module_qn string, imports map<string,string>"


def known(spark, *qns):
    return spark.createDataFrame([("p", q, q.split(".")[-1], "Function") for q in qns], "project string, qualified_name string, name string, label string")


@pytest.mark.parametrize(
    "callee, imports, qns, want",
    [
        ("u.Parse", {"u": "p.util"}, ["p.util.Parse", "p.x.Parse"], ("p.util.Parse", "import_map", 0.95)),
        ("u.Parse", {"u": "p.util"}, ["p.util.deep.Parse"], ("p.util.deep.Parse", "import_map_suffix", 0.85)),
        ("Run", None, ["p.m.Run", "p.x.Run"], ("p.m.Run", "same_module", 0.90)),
        ("Only", None, ["p.far.Only"], ("p.far.Only", "unique_name", 0.75)),
        ("Only", {"z": "p.other"}, ["p.far.Only"], ("p.far.Only", "unique_name", 0.375)),
        ("Only", {}, ["p.far.Only"], ("p.far.Only", "unique_name", 0.375)),
        ("Two", None, ["p.m.sub.Two", "p.zzz.Two"], ("p.m.sub.Two", "suffix_match", 0.55)),
        ("a.Many", None, [f"p.k{i}.Many" for i in range(6)], ("p.k0.Many", "suffix_match", 0.275)),
        ("Gone", None, ["p.x.Other"], None),
    ],
)
def test_resolver_tiers(spark, callee, imports, qns, want):
    refs = spark.createDataFrame([(1, "p", callee, "p.m", imports)], REF)
    found = resolve.resolve(refs, known(spark, *qns)).first()
    assert (found is None) if want is None else (found["target_qn"], found["strategy"], round(found["confidence"], 4)) == want


def test_fuzzy(spark):
    refs = spark.createDataFrame([(1, "p", "x.One", "p.m", None), (2, "p", "Two", "p.m", None), (3, "p", "One", "p.m", {"q": "p.q"})], REF)
    out = {r["ref_id"]: (r["target_qn"], round(r["confidence"], 3)) for r in resolve.fuzzy_resolve(refs, known(spark, "p.a.One", "p.m.x.Two", "p.b.Two")).collect()}
    assert out == {1: ("p.a.One", 0.4), 2: ("p.m.x.Two", 0.3), 3: ("p.a.One", 0.2)}


@pytest.mark.parametrize(
    "call, route, low, high",
    [("/api/orders", "/api/orders", 0.7, 0.95), ("/host/api/orders", "/api/orders", 0.5, 0.75), ("/api/orders/123", "/api/orders/{id}", 0.85, 0.95), ("/api/:x/b", "/api/a/b", 0.3, 0.55), ("/api/users", "/api/orders", 0, 0), ("/x", "/x", 0.6, 0.65), ("", "/x", 0, 0), ("/a/b/c", "/a/b", 0, 0)],
)
def test_path_score(spark, call, route, low, high):
    df = spark.createDataFrame([(call, route)], "a string, b string").select(http.path_score(http.normal_path("a"), http.normal_path("b")).alias("s"))
    assert low <= df.first()["s"] <= high


def test_match_equals_all_pairs(spark):
    paths = ["/api/orders", "/api/orders/1", "/v1/api/orders/", "/api/{x}/items", "/API/:id/items", "/health", "/a", "/*/b", "/c/b", "/x/a", "/a/b/c/d", "b", "/"]
    sites = spark.createDataFrame([(p, m, f"s{i}", "Function" if i % 2 else "Module", False) for i, p in enumerate(paths) for m in ("", "GET")], "path string, method string, source_qualified_name string, source_label string, is_async boolean")
    routes = spark.createDataFrame([(p, m, f"r{i}") for i, p in enumerate(paths) for m in ("", "POST", "GET")], "path string, method string, qualified_name string")
    got = {(r["source_qualified_name"], r["route_qn"], r["method"], round(r["confidence"], 6)) for r in http.match(sites, routes).collect()}
    s, r = sites.withColumn("c", http.normal_path("path")), routes.select("qualified_name", F.col("method").alias("rm"), http.normal_path("path").alias("t"))
    every = s.crossJoin(r).withColumn("b", http.path_score(F.col("c"), F.col("t"))).where("b > 0 and t <> '/health'")
    bonus = F.when((F.col("method") == "") | (F.col("rm") == ""), 0.0).when(F.col("method") == F.col("rm"), 0.10).otherwise(-0.15)
    every = every.withColumn("k", F.least(F.lit(1.0), F.col("b") * F.when(F.col("source_label") == "Function", 1.0).otherwise(0.85) + bonus)).where("k >= 0.25")
    assert got == {(x["source_qualified_name"], x["qualified_name"], x["method"], round(x["k"], 6)) for x in every.collect()} and got


def test_routes_and_sites(spark):
    src = [("py", "python", '@app.get("/items/{id}")\n@ws.websocket("/live")'), ("go", "go", 'r.GET("/ping2", Handle)\nv1 := r.Group("/v1")'), ("js", "javascript", "app.post('/orders', create)\napp.get('x')"), ("java", "java", '@GetMapping("/u")\n@RequestMapping("/all")'), ("rs", "rust", '#[put("/r")]'), ("php", "php", "Route::delete('/d', 'C@m')"), ("cs", "csharp", '[HttpPatch("p")]'), ("kt", "kotlin", 'get("/k") { }')]
    df = spark.createDataFrame(src, "qualified_name string, language string, text string")
    found = {(r["qualified_name"], r["method"], r["path"]) for r in http.extract_routes(df).collect()}
    assert found == {("py", "GET", "/items/{id}"), ("py", "WS", "/live"), ("go", "GET", "/ping2"), ("js", "POST", "/orders"), ("java", "GET", "/u"), ("java", "", "/all"), ("rs", "PUT", "/r"), ("php", "DELETE", "/d"), ("cs", "PATCH", "/p"), ("kt", "GET", "/k")}
    assert http.group_prefixes(df).first().asDict() == {"qualified_name": "go", "variable": "v1", "prefix": "/v1"}
    sites = spark.createDataFrame([("f", "Function", 'requests.post("http://svc.local/api/orders", x); fetch("https://github.com/a/b")'), ("g", "Function", "no call '/api/x'"), ("m", "Module", 'URL = "/api/y"')], "qualified_name string, label string, text string")
    assert {(r["source_qualified_name"], r["path"], r["method"]) for r in http.call_sites(sites).collect()} == {("f", "/api/orders", "POST"), ("m", "/api/y", "")}


def test_traces(spark, tmp_path):
    span = {"name": "x", "kind": 2, "startTimeUnixNano": "1000", "endTimeUnixNano": "50001000", "attributes": [{"key": "http.method", "value": {"stringValue": "GET"}}, {"key": "http.url", "value": {"stringValue": "http://svc/api/orders?x=1"}}]}
    doc = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}, "scopeSpans": [{"spans": [span]}]}]}
    (tmp_path / "t.json").write_text(json.dumps(doc, indent=1))
    spans = otlp.read_spans(spark, str(tmp_path))
    assert spans.first().asDict() == {"service_name": "svc", "method": "GET", "path": "/api/orders", "status_code": "", "span_kind": 2, "duration_ns": 50_000_000}
    edges = spark.createDataFrame([(1, "p", 1, 2, "HTTP_CALLS", '{"url_path":"/api/orders","confidence":0.5}'), (2, "p", 1, 3, "CALLS", "{}")], "id long, project string, source_id long, target_id long, type string, properties string")
    out = otlp.enrich(edges, otlp.span_stats(spans)).collect()
    assert len(out) == 1 and json.loads(out[0]["properties"]) == {"confidence": 0.65, "confidence_band": "high", "p99_latency_ns": 50_000_000, "trace_call_count": 1, "url_path": "/api/orders", "validated_by_trace": True}


def test_git_text(spark):
    diff = "diff --git a/x b/x\n--- a/x.go\n+++ b/x.go\n@@ -1,2 +3,4 @@ f\n+a\n@@ -9 +12 @@\n@@ -20,2 +21,0 @@\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@"
    assert [tuple(r) for r in text.git_hunks(text.numbered(spark, diff)).collect()] == [("x.go", 3, 6), ("x.go", 12, 12), ("x.go", 21, 21)]
    status = "M\ta.go\nR100\told.go\tnew.go\nD\tgone.go\nnot a status"
    assert [tuple(r) for r in text.git_names(text.numbered(spark, status)).collect()] == [("M", "a.go", None), ("R", "new.go", "old.go"), ("D", "gone.go", None)]
    log = "COMMIT:aaa\na.go\nnode_modules/x.js\n\nCOMMIT:bbb\nb.go\npackage-lock.json"
    assert sorted(tuple(r) for r in text.git_log(text.numbered(spark, log)).collect()) == [("aaa", "a.go"), ("bbb", "b.go")]
    env = spark.createDataFrame([("Dockerfile", 'ENV API_URL=http://svc:80/x\nARG SECRET_URL=http://s/\n'), ("c.yaml", "  base_url: https://b.local/api # x")], "rel_path string, text string")
    assert sorted(tuple(r) for r in text.env_bindings(env).collect()) == [("Dockerfile", "API_URL", "http://svc:80/x"), ("c.yaml", "base_url", "https://b.local/api")]


def test_code_search_and_snippets(spark, make_graph):
    files = spark.createDataFrame([("src/a.go", "one\n  Two words\nthree " + "x" * 300), ("lib/b.py", "two words")], "file string, text string")
    assert [tuple(r)[:2] for r in code_search.search_code(files, "Two").collect()] == [("src/a.go", 2)]
    assert code_search.search_code(files, "two", case_sensitive=False, file_glob="*.py").count() == 1 and code_search.search_code(files, r"^two", regex=True, case_sensitive=False, file_glob="lib/**").count() == 1
    assert code_search.search_code(files, "three").first()["content"].endswith("x...")
    page = code_search.page(code_search.search_code(files, "wo"), 0, 1).first()
    assert page["file"] == "lib/b.py" and page["total"] == 2 and page["has_more"]
    g, _ = make_graph([("f", "Function", "Foo", "t.a.Foo", "src/a.go", 2, 9, "{}"), ("g", "Function", "Foo", "t.b.Foo", "x_test.go", 1, 1, "{}")], [])
    assert code_search.snippets(g.nodes, files).first()["code"] == "   2 |   Two words\n   3 | three " + "x" * 300 + "\n"
    assert [r["tier"] for r in code_search.find_symbol(g, "t.a.Foo").collect()] == [1] and [r["qualified_name"] for r in code_search.find_symbol(g, "Foo").collect()] == ["t.a.Foo", "t.b.Foo"]
    assert [r["tier"] for r in code_search.find_symbol(g, "b.Foo").collect()] == [2] and code_search.find_symbol(g, "oo").count() == 2


def test_names_and_adr(spark):
    df = spark.createDataFrame([("p.cmd.server.main",), ("p.x",), ("p",)], "q string")
    assert [r[0] for r in df.select(names.package_of("q")).collect()] == ["server", "x", ""]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(names.module_qn(F.lit("p"), F.lit("a/b/__init__.py"))) == "p.a.b" and one(names.module_qn(F.lit("p"), F.lit("a/index.ts"))) == "p.a"
    assert one(names.camel_words(F.lit("getHTTPUrl_fooBar"))) == ["get", "httpurl", "foo", "bar"]
    assert names.glob_to_like("src/**/x*.g?") == "src/%x%.g_"
    assert one(names.ngram_overlap(F.lit("night"), F.lit("nacht"), 2)) == 0.25 and one(names.ngram_overlap(F.lit("a"), F.lit("b"))) == 0
    assert one(derive.tested_path(F.lit("a/test_x.py"))) == "a/x.py" and one(derive.tested_path(F.lit("a/x_test.go"))) == "a/x.go" and one(derive.tested_path(F.lit("a/x.go"))) is None
    whole = adr.render({s: f"about {s}" for s in adr.SECTIONS})
    assert adr.validate(whole) == [] and adr.parse(whole)["STACK"] == "about STACK" and adr.validate("x" * 9000)
    assert "new" in adr.merge(whole, {"STACK": "new"})
    with pytest.raises(ValueError):
        adr.merge(whole, {"NOPE": "x"})
    rules = IgnoreRules(["*.log", "/build/", "!keep.log", "docs/**/tmp", "# c"])
    assert [rules.ignores(p) for p in ("a/b.log", "build/x", "src/build/x", "a/keep.log", "docs/a/b/tmp", "x.py")] == [True, True, False, False, True, False]
    assert json_urls('{"api":{"base_url":"http://s/x","name":"http://no"},"n":[{"path":"/p"}]}') == [("api.base_url", "http://s/x"), ("n.path", "/p")] or json_urls("x") == []


def test_index_and_endpoints(spark, tmp_path):
    from lattica.api import Engine, as_json

    repo = tmp_path / "repo"
    (repo / "pkg").mkdir(parents=True)
    (repo / "pkg/__init__.py").write_text("")
    (repo / "pkg/base.py").write_text("class Base:\n    def go(self):\n        return help_out()\n\ndef help_out():\n    raise ValueError('x')\n")
    (repo / "pkg/app.py").write_text("from pkg.base import Base, help_out\n\nclass App(Base):\n    def run(self):\n        self.stop()\n        help_out()\n    def stop(self):\n        pass\n")
    (repo / "test_app.py").write_text("from pkg.app import App\n\ndef test_run():\n    a = App()\n    a.run()\n")
    (repo / "Dockerfile").write_text("FROM python:3\nEXPOSE 80\nENV TOKEN=x\nENV MODE=y\n")
    (repo / "node_modules").mkdir()
    (repo / "node_modules/x.py").write_text("def hidden(): pass\n")
    engine = Engine(spark, str(tmp_path / "store"))
    assert engine.index_repository(str(repo), "p") == {"new": 5}
    assert engine.index_repository(str(repo), "p") == {"unchanged": 5}
    q = lambda c: sorted(tuple(r) for r in engine.query_graph(c, "p").collect())
    assert q("MATCH (a)-[:CALLS]->(b) WHERE a.name = 'run' RETURN b.name") == [("help_out",), ("stop",)]
    assert q("MATCH (a)-[:INHERITS]->(b) RETURN a.name, b.name") == [("App", "Base")]
    assert q("MATCH (c:Class)-[:DEFINES_METHOD]->(m) WHERE c.name = 'App' RETURN m.name") == [("run",), ("stop",)]
    assert q("MATCH (a)-[:TESTS]->(b) RETURN a.name, b.name") == [("test_run", "App"), ("test_run", "run")]
    assert q("MATCH (f:InfraFile) RETURN f.name, f.ports") == [("Dockerfile", '["80"]')] and q("MATCH (f:Function) WHERE f.name = 'hidden' RETURN f.name") == []
    assert q("MATCH (p:Package)-[:CONTAINS_FILE]->(f) RETURN f.name") == [("__init__.py",), ("app.py",), ("base.py",)]
    trace = engine.trace_call_path("help_out", "p", "inbound")
    assert {r["name"] for r in trace["nodes"].collect()} >= {"run", "go"} and trace["edges"].count() >= 2
    assert engine.trace_call_path("help", "p")["suggestions"].count() == 1
    changes = engine.detect_changes("M\tpkg/base.py", "+++ b/pkg/base.py\n@@ -5 +5 @@\n", "p")
    assert [r["name"] for r in changes["symbols"].collect()] == ["help_out"] and {r["name"] for r in changes["impacted"].collect()} >= {"go", "run"}
    assert set(engine.get_architecture("p")) == set(__import__("lattica.api", fromlist=["ASPECTS"]).ASPECTS)
    assert json.loads(as_json(engine.search_graph("p", name_pattern="help", label="Function")))[0]["name"] == "help_out"
    (repo / "pkg/base.py").write_text("def help_out():\n    pass\n")
    (repo / "test_app.py").unlink()
    assert engine.index_repository(str(repo), "p") == {"changed": 1, "removed": 1, "unchanged": 3}
    assert q("MATCH (a)-[:TESTS]->(b) RETURN a.name") == [] and engine.list_projects().first()["name"] == "p"
    assert engine.index_status("p").first()["nodes"] > 5 and engine.get_graph_schema("p")["labels"].count() > 3
    whole = adr.render({s: "x" for s in adr.SECTIONS})
    assert engine.manage_adr("store", "p", whole) == whole and "## STACK\ny" in engine.manage_adr("update", "p", sections={"STACK": "y"}) and engine.manage_adr("get", "p")
    engine.delete_project("p")
    assert engine.graph.nodes.count() == 0 and engine.manage_adr("get", "p") is None


def test_python_facts_of_broken_and_empty_files(spark):
    df = spark.createDataFrame([("p", "a.py", "def ("), ("p", "b.py", ""), ("p", "c.py", None), ("p", "d.txt", "x")], "project string, rel_path string, text string")
    assert python_facts(df).count() == 0


def test_watch_and_stream(spark, tmp_path):
    from lattica.streaming.refresh import Watch, interval, stream_spans

    assert interval(0) == 5 and interval(5000) == 15 and interval(10**6) == 60
    schema = "project string, rel_path string, sha256 string, mtime_ns long, size long"
    state = {"rows": [("p", "a", "1", 1, 1)]}
    seen = []
    watch = Watch(lambda: spark.createDataFrame(state["rows"], schema), lambda c: seen.extend((r["rel_path"], r["status"]) for r in c.collect()), spark.createDataFrame([], schema))
    assert watch.look() and not watch.look()
    state["rows"] = [("p", "a", "2", 2, 1), ("p", "b", "1", 1, 1)]
    assert watch.look() and sorted(seen) == [("a", "changed"), ("a", "new"), ("b", "new")]
    (tmp_path / "in").mkdir()
    span = {"startTimeUnixNano": "0", "endTimeUnixNano": "9", "attributes": [{"key": "http.route", "value": {"stringValue": "/r/1"}}]}
    (tmp_path / "in/a.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span, span]}]}]}))
    got = []
    query = stream_spans(spark, str(tmp_path / "in"), lambda df, n: got.extend(tuple(r) for r in df.collect()), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert got == [("/r/*", 2, 9)]


def test_structure_definitions_and_implements(spark, make_graph):
    files = spark.createDataFrame([("p", "a/b/x.py"), ("p", "a/package.json"), ("p", "y.go")], "project string, rel_path string")
    nodes, edges = derive.structure(files)
    assert {(r["label"], r["qualified_name"]) for r in nodes.where("label <> 'File'").collect()} == {("Project", "p"), ("Package", "p.a"), ("Folder", "p.a.b")}
    assert {(r["source_qn"], r["target_qn"], r["type"]) for r in edges.where("type <> 'CONTAINS_FILE'").collect()} == {("p", "p.a", "CONTAINS_PACKAGE"), ("p.a", "p.a.b", "CONTAINS_FOLDER")}
    fn = lambda k, label, qn: (k, label, qn.split(".")[-1], qn, "x.go", 1, 2, "{}")
    g, _ = make_graph([fn("I", "Interface", "t.I"), fn("i1", "Method", "t.I.Go"), fn("i2", "Method", "t.I.Stop"), fn("A", "Class", "t.A"), fn("a1", "Method", "t.A.Go"), fn("a2", "Method", "t.A.Stop"), fn("B", "Class", "t.B"), fn("b1", "Method", "t.B.Go")], [(a, b, "DEFINES_METHOD", "{}") for a, b in (("I", "i1"), ("I", "i2"), ("A", "a1"), ("A", "a2"), ("B", "b1"))])
    implements, overrides = derive.implement_edges(g)
    assert [(r["source_qn"], r["target_qn"]) for r in implements.collect()] == [("t.A", "t.I")] and overrides.count() == 2
    assert [r["tags"] for r in derive.word_tags(spark.createDataFrame([(1, ["ab", "cd"]), (2, ["ab"])], "id long, w array<string>"), "id", F.col("w")).collect()] == [["ab"], ["ab"]]


def test_same_service_and_protocol(spark):
    pairs = [("a.b.c.mod.Func1", "a.b.c.mod.Func2", True), ("a.b.c.mod.Func1", "a.b.x.mod.Func2", False), ("short.x", "short.y", False), ("a.b", "a.b", False), ("a.b.c", "a.b.c", True), ("a.b.c", "x.b.c", False)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    assert [r[0] for r in df.select(http.same_service(F.col("a"), F.col("b"))).collect()] == [p[2] for p in pairs]
    texts = spark.createDataFrame([("ws.on(\"connection\", f)",), ("yield EventSourceResponse()",), ("x",)], "t string")
    assert [r[0] for r in texts.select(http.protocol("t")).collect()] == ["ws", "sse", ""]


def test_config_links(spark, make_graph):
    from lattica.operators.config import configure_edges, with_env_urls

    v = lambda k, name, qn, path, label="Variable": (k, label, name, qn, path, 1, 1, "{}")
    g, ids = make_graph(
        [v("k", "database_url", "t.conf.database_url", "app.toml"), v("short", "db_url", "t.conf.db_url", "app.toml"), v("f", "getDatabaseUrl", "t.m.getDatabaseUrl", "m.go", "Function"), v("d", "requests", "t.package.dependencies.requests", "package.json"), v("o", "version", "t.package.version", "package.json"),
         v("m", "m", "t.m", "m.go", "Module"), v("r", "requests", "ext.requests", "", "Module"), v("c", "app", "t.app", "conf/app.toml", "Module")],
        [("m", "r", "IMPORTS", "{}")],
    )
    strings = spark.createDataFrame([(ids["f"], "conf/app.toml"), (ids["m"], "other/app.toml"), (ids["m"], "x.toml")], "id long, value string")
    got = {(r["source_id"], r["target_id"], json.loads(r["properties"])["confidence"]) for r in configure_edges(g, strings).collect()}
    assert got == {(ids["k"], ids["f"], 0.75), (ids["d"], ids["m"], 0.95), (ids["c"], ids["f"], 0.9), (ids["c"], ids["m"], 0.7)}
    constants = spark.createDataFrame([("p", "a.py", ["X = 1"])], "project string, rel_path string, constants array<string>")
    urls = spark.createDataFrame([("p", "a.py", "U", "http://s"), ("p", "b.sh", "V", "http://t")], "project string, rel_path string, key string, value string")
    assert {r["rel_path"]: r["constants"] for r in with_env_urls(constants, urls).collect()} == {"a.py": ["X = 1", "U = http://s"], "b.sh": ["V = http://t"]}
