"""Derived edges, lookups on changes and configuration, resolution helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import EDGE_SCHEMA, NODE_SCHEMA, Graph
from ..operators import architecture, derive, http, joins, resolve, search, traverse
from ..sources import otlp
from ..sources.star import PROJECT, graph_query, star_graph, table
from ..sources.text import is_secret
from .derived import SQL as DERIVED_SQL, _page_sites


def _nodes(rows: DataFrame, **columns) -> DataFrame:
    """Nodes of the star's project with the given columns, the rest being empty."""
    given = {"project": F.lit(PROJECT), "name": F.lit(""), "qualified_name": F.lit(""), "file_path": F.lit(""), "start_line": F.lit(0), "end_line": F.lit(0), "properties": F.lit("{}")} | columns
    return rows.select(*(given[c].cast(NODE_SCHEMA[c].dataType).alias(c) for c in NODE_SCHEMA.names))


def _edges(rows: DataFrame, kind: str, source, target, properties=None) -> DataFrame:
    given = {"id": F.xxhash64(F.lit(kind), source, target), "project": F.lit(PROJECT), "source_id": source, "target_id": target, "type": F.lit(kind), "properties": F.lit("{}") if properties is None else properties}
    return rows.select(*(given[c].cast(EDGE_SCHEMA[c].dataType).alias(c) for c in EDGE_SCHEMA.names))


def _nearest(s: SparkSession, d: str) -> DataFrame:
    graph = star_graph(s, d)
    starts = graph.nodes.where("label in ('Region', 'Nation')").select("id")
    return traverse.nearest(traverse.bfs(graph, starts, ("IN_REGION", "IN_NATION", "PLACED"), "in", 3)).select("id", "hop")


def _confident(s: SparkSession, d: str) -> DataFrame:
    quantity = F.get_json_object("properties", "$.quantity").cast("double").cast("long")
    edges = star_graph(s, d).typed("CONTAINS").withColumn("confidence", (quantity % 10) / 10)
    return traverse.confident(edges, 0.5).select("source_id", "target_id", "confidence")


def _changed(s: SparkSession, d: str) -> DataFrame:
    """Files staged and not, one of them in both lists; two of them with hunks."""
    hunks = s.createDataFrame([("part/3/file.js", 100, 130), ("part/3/file.js", 120, 140), ("supplier/2/file.py", 1, 40)], "path string, start_line int, end_line int")
    files = s.createDataFrame([("part/3/file.js",), ("customer/4/file.go",)], "path string").union(s.createDataFrame([("supplier/2/file.py",), ("customer/4/file.go",), ("nation/1/file.tf",)], "path string")).distinct()
    return joins.changed_symbols(star_graph(s, d).nodes, hunks, files).select("qualified_name")


def _dependencies(s: SparkSession, d: str) -> DataFrame:
    """Nations and regions as dependencies; who lies in a nation imports it."""
    graph = star_graph(s, d)
    names = graph.nodes.select(F.col("id").alias("target_id"), "name")
    regions = graph.typed("IN_REGION").select(F.col("source_id").alias("nation_id"), "target_id").join(names, "target_id").select(F.col("nation_id").alias("target_id"), F.concat(F.lit("lib."), "name").alias("qualified_name"))
    imports = graph.typed("IN_NATION").select("source_id", "target_id").join(names, "target_id").join(regions, "target_id")
    return joins.dependency_imports(graph.nodes.where("label in ('Nation', 'Region')").select("id", "name"), imports)


def _config_files(s: SparkSession, d: str) -> DataFrame:
    """Each node names its file, by the whole path or in another folder."""
    nodes = star_graph(s, d).nodes
    value = F.when(F.col("id") % 2 == 0, F.col("file_path")).otherwise(F.concat(F.lit("etc/"), F.substring_index("file_path", "/", -1)))
    return joins.config_file_refs(nodes.select("id", value.alias("value")), nodes.groupBy("file_path").agg(F.min("id").alias("id")))


def _strategies(s: SparkSession, d: str) -> DataFrame:
    graph = star_graph(s, d)
    place = F.col("source_id") % 10
    how = F.when(place < 3, '{"resolution_strategy":"import_map"}').when(place < 9, '{"resolution_strategy":"lsp_direct"}').otherwise("{}")
    return architecture.calls_by_strategy(Graph(graph.nodes, graph.typed("CONTAINS").withColumns({"type": F.lit("CALLS"), "properties": how})))


def _imports(s: SparkSession, d: str) -> DataFrame:
    """Orders import parts, by name and by path."""
    key = F.col("l_partkey").cast("string")
    path = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit(f"{PROJECT}.part."), key)).otherwise(F.concat(F.lit("./part/"), key, F.lit(".js")))
    rows = table(s, d, "lineitem").select(F.lit(PROJECT).alias("project"), F.concat(F.lit(f"{PROJECT}.order."), F.col("l_orderkey").cast("string")).alias("module_qn"), F.concat(F.lit("p"), key).alias("local_name"), path.alias("module_path"))
    return derive.import_edges(rows, star_graph(s, d)).select("source_id", "target_id", F.get_json_object("properties", "$.alias").alias("alias"))


def _throws(s: SparkSession, d: str) -> DataFrame:
    tail = F.element_at(F.array(F.lit("Exception"), F.lit("RuntimeException"), F.lit("Error")), (F.col("p_partkey") % 3 + 1).cast("int"))
    name = F.concat(F.lit("lib."), F.translate(F.initcap("p_name"), " ", ""), tail)
    return table(s, d, "part").select("p_partkey", derive.throw_kind(name).alias("kind"))


def _tests(s: SparkSession, d: str) -> DataFrame:
    """Orders call parts: of orders a third are tests in test files, a third lie in test
    files only; of parts a quarter lies in test files."""
    graph = star_graph(s, d)
    order, part, third = F.col("label") == "Order", F.col("label") == "Part", F.col("id") % 3
    path = F.when(order & (third < 2), F.concat(F.lit("tests/"), "file_path")).when(part & (F.col("id") % 4 == 0), F.lit("pkg/part_test.js")).otherwise(F.col("file_path"))
    nodes = graph.nodes.withColumns({"name": F.when(order & (third == 0), F.concat(F.lit("test_"), "name")).otherwise(F.col("name")), "file_path": path})
    return derive.test_edges(Graph(nodes, graph.typed("CONTAINS").withColumn("type", F.lit("CALLS")))).select("source_qn", "target_qn")


def _test_files(s: SparkSession, d: str) -> DataFrame:
    """A file for each customer; tests of every other one are named after it, the rest
    import it."""
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    key, even = F.col("k").cast("string"), F.col("k") % 2 == 0
    files = _nodes(rows, id=2 * F.col("k"), label=F.lit("File"), file_path=F.concat(F.lit("customer/"), key, F.lit(".go")))
    path = F.when(even, F.concat(F.lit("customer/"), key, F.lit("_test.go"))).otherwise(F.concat(F.lit("spec/c"), key, F.lit("_spec.go")))
    tests = _nodes(rows, id=2 * F.col("k") + 1, label=F.lit("File"), file_path=path)
    return derive.test_file_edges(Graph(files.unionByName(tests), _edges(rows, "IMPORTS", 2 * F.col("k") + 1, 2 * F.col("k")))).select("source_path", "target_path")


def _by_url(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "pages")
    path = F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)
    edges = _edges(pages, "HTTP_CALLS", F.col("page_id"), F.col("page_id"), F.to_json(F.struct(path.alias("url_path"))))
    return search.edges_by_url(edges, "/es/").select("source_id")


def _stubs(s: SparkSession, d: str) -> DataFrame:
    """Targets: parts, which are there, suppliers as methods and nations as functions."""
    graph = star_graph(s, d)
    named = lambda name, key, head: table(s, d, name).select(F.lit(PROJECT).alias("project"), F.concat(F.lit(head), F.col(key).cast("string")).alias("target_qn"))
    targets = named("part", "p_partkey", f"{PROJECT}.part.").unionByName(named("lineitem", "l_suppkey", "ext.supplier.s")).unionByName(named("customer", "c_nationkey", "ext.n"))
    return resolve.with_stubs(graph, targets).nodes.where("label in ('Method', 'Function')").select("qualified_name", "label", "name")


def _fuzzy(s: SparkSession, d: str) -> DataFrame:
    """Parts as definitions of their brand's module; each is called from there by name."""
    name, brand = F.translate("p_name", " ", "_"), F.translate("p_brand", "#", "")
    part = table(s, d, "part")
    known = part.select(F.lit(PROJECT).alias("project"), F.concat_ws(".", F.lit(PROJECT), brand, name).alias("qualified_name"), name.alias("name"))
    refs = part.select(F.col("p_partkey").alias("ref_id"), F.lit(PROJECT).alias("project"), F.concat(F.lit("x."), name).alias("callee"), F.concat_ws(".", F.lit(PROJECT), brand).alias("module_qn"), F.lit(None).cast("map<string,string>").alias("imports"))
    return resolve.fuzzy_resolve(refs, known).select("ref_id", "target_qn", F.round("confidence", 6).alias("confidence"), "candidates")


def _typed(s: SparkSession, d: str) -> DataFrame:
    """Orders call parts; types have resolved what even suppliers supply."""
    text = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    rows = table(s, d, "lineitem").select(F.lit(PROJECT).alias("project"), text("order.", "l_orderkey").alias("source_qn"), text("x.part", "l_partkey").alias("callee"), text("pkg.part", "l_partkey").alias("target_qn"), "l_suppkey")
    return resolve.without_typed(rows.select("project", "source_qn", "callee").distinct(), rows.where("l_suppkey % 2 = 0")).select("source_qn", "callee")


def _documents(s: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("docs/adr/"), key, F.lit(".md"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("lib/"), key, F.lit("/README.md"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("src/readme"), key, F.lit(".py"))).otherwise(F.concat(F.lit("notes/"), key, F.lit(".md")))
    files = _nodes(table(s, d, "documents"), id=F.col("doc_id"), label=F.lit("File"), file_path=path)
    return architecture.documents(Graph(files, s.createDataFrame([], EDGE_SCHEMA)))


def _secrets(s: SparkSession, d: str) -> DataFrame:
    key = F.element_at(F.array(F.lit("API_KEY"), F.lit("HOST"), F.lit("DB_PASSWORD")), (F.col("page_id") % 3 + 1).cast("int"))
    value = F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", "://", "://user:word@")).otherwise(F.col("url"))
    return table(s, d, "pages").where("url is not null").select("page_id", is_secret(key, value).alias("secret"))


def _coupled_files(s: SparkSession, d: str) -> DataFrame:
    events = table(s, d, "events")
    commits = events.select(F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("hash"), F.col("event_type").alias("file"))
    files = _nodes(events.select("event_type").distinct(), id=F.xxhash64("event_type"), label=F.lit("File"), file_path=F.col("event_type"))
    edges = joins.coupling_edges(Graph(files, s.createDataFrame([], EDGE_SCHEMA)), joins.change_coupling(commits, limit=None))
    a, b = files.select(F.col("id").alias("source_id"), F.col("file_path").alias("file_a")), files.select(F.col("id").alias("target_id"), F.col("file_path").alias("file_b"))
    return edges.join(a, "source_id").join(b, "target_id").select("file_a", "file_b", F.get_json_object("properties", "$.co_changes").cast("long").alias("co_changes"))


def _http_edges(s: SparkSession, d: str) -> DataFrame:
    """HTTP_CALLS between pages as functions, callers and routes."""
    sites, routes = _page_sites(s, d)
    pages = table(s, d, "pages")
    nodes = None
    for n, kind in enumerate(("page", "caller", "route")):
        some = _nodes(pages, id=3 * F.col("page_id") + n, label=F.lit("Function"), qualified_name=F.concat(F.lit(f"{kind}."), F.col("page_id").cast("string")))
        nodes = some if nodes is None else nodes.unionByName(some)
    found = http.links(sites, routes, Graph(nodes, s.createDataFrame([], EDGE_SCHEMA)))
    return found.select("source_id", "target_id", "type", F.col("p.confidence_band").alias("band"))


def _routes(s: SparkSession, d: str) -> DataFrame:
    """The first routes, a page each; every other one has a handler."""
    pages = table(s, d, "pages")
    key = F.lpad(F.col("page_id").cast("string"), 12, "0")
    nodes = _nodes(pages, id=2 * F.col("page_id"), label=F.lit("Route"), name=key, properties=F.to_json(F.struct(F.lit("GET").alias("method"), F.concat(F.lit("/p/"), key).alias("path"))))
    nodes = nodes.unionByName(_nodes(pages, id=2 * F.col("page_id") + 1, label=F.lit("Function"), name=F.concat(F.lit("show"), key)))
    edges = _edges(pages.where("page_id % 2 = 0"), "HANDLES", 2 * F.col("page_id") + 1, 2 * F.col("page_id"))
    return architecture.routes(Graph(nodes, edges), 20)


QUERIES = {
    "nearest_hop": _nearest,
    "confident_edges": _confident,
    "changed_symbols": _changed,
    "dependency_imports": _dependencies,
    "config_file_refs": _config_files,
    "calls_by_strategy": _strategies,
    "import_edges": _imports,
    "throw_kinds": _throws,
    "test_edges": _tests,
    "test_file_edges": _test_files,
    "edges_by_url": _by_url,
    "stub_nodes": _stubs,
    "fuzzy_resolve": _fuzzy,
    "typed_calls_win": _typed,
    "architecture_documents": _documents,
    "secret_detection": _secrets,
    "url_path": lambda s, d: table(s, d, "pages").select("page_id", otlp.url_path("url").alias("path")),
    "file_coupling_edges": _coupled_files,
    "http_call_edges": _http_edges,
    "route_handlers": _routes,
}

_PAGE_PATH = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"

SQL = {
    "nearest_hop": graph_query("WITH r AS (SELECT id AS node, 0 AS hop FROM nodes WHERE label IN ('Region', 'Nation') UNION SELECT e.source_id, hop + 1 FROM r JOIN edges e ON e.target_id = r.node WHERE e.type IN ('IN_REGION', 'IN_NATION', 'PLACED') AND hop < 3) SELECT node AS id, CAST(min(hop) AS INT) AS hop FROM r WHERE hop > 0 GROUP BY node"),
    "confident_edges": graph_query("WITH c AS (SELECT source_id, target_id, CAST((CAST(trunc(CAST(properties->>'$.quantity' AS DOUBLE)) AS BIGINT) % 10) / 10.0 AS DOUBLE) AS confidence FROM edges WHERE type = 'CONTAINS') SELECT * FROM c WHERE confidence = 0 OR confidence >= 0.5"),
    "changed_symbols": graph_query("WITH h AS (SELECT * FROM (VALUES ('part/3/file.js', 100, 130), ('part/3/file.js', 120, 140), ('supplier/2/file.py', 1, 40), ('customer/4/file.go', 0, 999999), ('nation/1/file.tf', 0, 999999)) t(p, a, b)) SELECT DISTINCT qualified_name FROM nodes JOIN h ON (file_path = p OR ends_with(file_path, '/' || p)) AND start_line <= b AND end_line >= a"),
    "dependency_imports": graph_query("SELECT d.id AS dependency_id, e.source_id, e.target_id, CAST(CASE WHEN d.name = n.name THEN 0.95 ELSE 0.80 END AS DOUBLE) AS confidence FROM edges e JOIN nodes n ON n.id = e.target_id JOIN edges g ON g.source_id = n.id AND g.type = 'IN_REGION' JOIN nodes r ON r.id = g.target_id JOIN nodes d ON d.label IN ('Nation', 'Region') AND d.name IN (n.name, r.name) WHERE e.type = 'IN_NATION'"),
    "config_file_refs": graph_query("WITH f AS (SELECT file_path AS p, min(id) AS id FROM nodes GROUP BY 1), b AS (SELECT regexp_extract(p, '[^/]*$') AS base, min(id) AS id FROM f GROUP BY 1) SELECT n.id AS node_id, CASE WHEN n.id % 2 = 0 THEN f.id ELSE b.id END AS file_id, CAST(CASE WHEN n.id % 2 = 0 THEN 0.90 ELSE 0.70 END AS DOUBLE) AS confidence FROM nodes n JOIN f ON f.p = n.file_path JOIN b ON b.base = regexp_extract(n.file_path, '[^/]*$')"),
    "calls_by_strategy": graph_query("WITH c AS (SELECT CASE WHEN source_id % 10 < 3 THEN 'import_map' WHEN source_id % 10 < 9 THEN 'lsp_direct' ELSE 'unset' END AS strategy, count(*) AS calls FROM edges WHERE type = 'CONTAINS' GROUP BY 1) SELECT strategy, calls, round(CAST(100 * calls AS DOUBLE) / (SELECT sum(calls) FROM c), 1) AS percent FROM c"),
    "import_edges": graph_query("SELECT source_id, target_id, 'p' || (target_id % 1000000000000) AS alias FROM edges WHERE type = 'CONTAINS'"),
    "throw_kinds": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'THROWS' ELSE 'RAISES' END AS kind FROM part",
    "test_edges": graph_query("SELECT DISTINCT o.qualified_name AS source_qn, p.qualified_name AS target_qn FROM edges e JOIN nodes o ON o.id = e.source_id JOIN nodes p ON p.id = e.target_id WHERE e.type = 'CONTAINS' AND o.id % 3 = 0 AND p.id % 4 <> 0"),
    "test_file_edges": "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'customer/' || c_custkey || '_test.go' ELSE 'spec/c' || c_custkey || '_spec.go' END AS source_path, 'customer/' || c_custkey || '.go' AS target_path FROM customer",
    "edges_by_url": f"SELECT page_id AS source_id FROM pages WHERE contains({_PAGE_PATH}, '/es/')",
    "stub_nodes": "SELECT DISTINCT 'ext.supplier.s' || l_suppkey AS qualified_name, 'Method' AS label, 's' || l_suppkey AS name FROM lineitem UNION ALL SELECT DISTINCT 'ext.n' || c_nationkey, 'Function', 'n' || c_nationkey FROM customer",
    "fuzzy_resolve": "WITH k AS (SELECT DISTINCT 'tpch.' || replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') AS qn, p_name FROM part), z AS (SELECT p_name, count(*) AS n FROM k GROUP BY 1) SELECT p_partkey AS ref_id, 'tpch.' || replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') AS target_qn, round(CAST(CASE WHEN n = 1 THEN 0.40 ELSE 0.30 END * least(1.0, 3.0 / n) AS DOUBLE), 6) AS confidence, n AS candidates FROM part JOIN z USING (p_name)",
    "typed_calls_win": "SELECT 'order.' || l_orderkey AS source_qn, 'x.part' || l_partkey AS callee FROM lineitem GROUP BY l_orderkey, l_partkey HAVING NOT bool_or(l_suppkey % 2 = 0)",
    "architecture_documents": "SELECT DISTINCT CASE WHEN doc_id % 4 = 0 THEN 'docs/adr/' || doc_id || '.md' ELSE 'lib/' || doc_id || '/README.md' END AS file_path FROM documents WHERE doc_id % 4 < 2",
    "secret_detection": "SELECT page_id, page_id % 3 <> 1 OR page_id % 5 = 0 AS secret FROM pages WHERE url IS NOT NULL",
    "url_path": f"SELECT page_id, CASE WHEN url IS NULL THEN NULL WHEN {_PAGE_PATH} = '' THEN '/' ELSE {_PAGE_PATH} END AS path FROM pages",
    "file_coupling_edges": "SELECT file_a, file_b, changes AS co_changes FROM (" + DERIVED_SQL["change_coupling"] + ")",
    "http_call_edges": "SELECT 3 * CAST(split_part(source_qualified_name, '.', 2) AS BIGINT) + CASE WHEN starts_with(source_qualified_name, 'caller') THEN 1 ELSE 0 END AS source_id, 3 * CAST(split_part(route_qn, '.', 2) AS BIGINT) + 2 AS target_id, 'HTTP_CALLS' AS type, CASE WHEN max(confidence) >= 0.7 THEN 'high' WHEN max(confidence) >= 0.45 THEN 'medium' ELSE 'speculative' END AS band FROM (" + DERIVED_SQL["http_route_match"] + ") GROUP BY source_qualified_name, route_qn",
    "route_handlers": "SELECT 'GET' AS method, '/p/' || lpad(CAST(page_id AS VARCHAR), 12, '0') AS path, CASE WHEN page_id % 2 = 0 THEN 'show' || lpad(CAST(page_id AS VARCHAR), 12, '0') END AS handler FROM pages ORDER BY page_id LIMIT 20",
}
