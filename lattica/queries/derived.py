"""Writes, incremental comparison, range and set joins, links and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.names import camel_words
from ..model import Graph
from ..operators import derive, http, incremental, joins, resolve, upsert
from ..sources import otlp
from ..sources.star import PROJECT, graph_query, node_id, star_graph, table


def _node_upsert(s: SparkSession, d: str) -> DataFrame:
    nodes = star_graph(s, d).labelled("Customer")
    writes = nodes.where("start_line % 3 = 0").withColumns({"name": F.concat(F.lit("new "), "name"), "properties": F.lit(None).cast("string"), "seq": F.lit(1).cast("long")})
    again = writes.where("start_line % 2 = 0").withColumns({"name": F.concat(F.lit("newer "), "name"), "seq": F.lit(2).cast("long")})
    done = upsert.upsert_nodes(nodes, writes.unionByName(again))
    return done.select("qualified_name", "name", F.get_json_object("properties", "$.segment").alias("segment"))


def _edge_upsert(s: SparkSession, d: str) -> DataFrame:
    edges = star_graph(s, d).typed("CONTAINS")
    writes = edges.where("source_id % 20 = 1").withColumns({"properties": F.lit('{"note":"b","quantity":null}'), "seq": F.lit(1).cast("long")})
    done = upsert.upsert_edges(edges, writes)
    return done.select("source_id", "target_id", F.get_json_object("properties", "$.note").alias("note"), (F.get_json_object("properties", "$.quantity").cast("double")).alias("quantity"))


def _cascade(s: SparkSession, d: str) -> DataFrame:
    graph = star_graph(s, d)
    some = Graph(graph.nodes, graph.typed("PLACED", "CONTAINS"))
    return upsert.delete_nodes(some, (F.col("label") == "Order") & (F.col("start_line") < 500)).edges.groupBy("type").count()


def _semi_delete(s: SparkSession, d: str) -> DataFrame:
    graph = star_graph(s, d)
    return upsert.delete_edges_from_file(Graph(graph.nodes, graph.typed("PLACED", "IN_NATION")), "customer/3/file.go").edges.groupBy("type").count()


def _hashes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(s, d, "documents")
    base = docs.select(F.lit("p").alias("project"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("rel_path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), (F.col("doc_id") * 10).alias("mtime_ns"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("size"), "doc_id")
    stored = base.where("doc_id % 7 <> 0").drop("doc_id")
    touched = F.col("doc_id") % 5 == 0
    current = base.where("doc_id % 11 <> 0").withColumns({"mtime_ns": F.when(touched, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")), "sha256": F.when(F.col("doc_id") % 10 == 0, F.lit("x")).otherwise(F.col("sha256"))}).drop("doc_id")
    return current, stored


def _dependents(s: SparkSession, d: str) -> DataFrame:
    """Orders import parts: which order files depend on the changed part files."""
    graph = star_graph(s, d)
    imports = graph.typed("CONTAINS").withColumn("type", F.lit("IMPORTS"))
    nodes = graph.nodes.withColumns({"qualified_name": F.when(F.col("label") == "Part", F.concat(F.lit("tpch.part."), (F.col("id") % 16).cast("string"), F.lit(".file"))).otherwise(F.col("qualified_name"))})
    changed = s.createDataFrame([(PROJECT, "part/3/file.js")], "project string, rel_path string")
    return incremental.dependents(Graph(nodes, imports), changed)


def _overlap(s: SparkSession, d: str) -> DataFrame:
    nodes = star_graph(s, d).nodes.where("label in ('Part', 'Supplier')")
    hunks = s.createDataFrame([("part/3/file.js", 100, 130), ("part/5/file.js", 7, 7), ("3/file.py", 1, 40), ("file.py", 10, 12)], "path string, start_line int, end_line int")
    return joins.overlapping(nodes, hunks).select("qualified_name", "hunk_path", "hunk_start")


def _hunks(s: SparkSession, d: str) -> DataFrame:
    """Documents as diffs: a line of an odd number opens a file, others are hunks."""
    from ..sources.text import git_hunks, lines

    docs = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = lines(docs)
    content = F.when(F.col("line") % 2 == 1, F.concat(F.lit("+++ b/f"), F.length("content").cast("string"))).otherwise(F.concat(F.lit("@@ -1 +"), F.length("content").cast("string"), F.lit(",3 @@")))
    return git_hunks(rows.withColumn("content", content), "doc_id")


def _division(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem").select("l_orderkey", "l_partkey").join(table(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    have = lines.join(parts, "l_partkey").select(F.col("o_custkey").alias("owner"), F.col("p_brand").alias("item")).distinct()
    need = s.createDataFrame([("a", "Brand#1"), ("a", "Brand#2"), ("a", "Brand#3"), ("b", "Brand#11"), ("b", "Brand#12")], "grp string, item string")
    return joins.covering(have, need, "owner", "grp", "item")


def _substring(s: SparkSession, d: str) -> DataFrame:
    parts = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.translate("p_name", " ", "_").alias("name"))
    words = table(s, d, "part").select(F.substring_index("p_name", " ", 1).alias("key")).distinct()
    return joins.containing(parts, words, "name", "key").select("id", "key")


def _config(s: SparkSession, d: str) -> DataFrame:
    config = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    code = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.initcap("p_name"), F.lit(" Handler")).alias("name"))
    code = code.withColumn("name", F.translate("name", " ", "")).unionByName(config)
    return joins.config_key_symbols(config, code)


def _page_sites(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = table(s, d, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))).alias("path")).where("path <> ''")
    sites = links.select("path", F.lit("").alias("method"), F.concat(F.lit("page."), F.col("page_id").cast("string")).alias("source_qualified_name"), F.lit("Function").alias("source_label"), F.lit(False).alias("is_async"))
    path = F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)
    routes = pages.select(path.alias("path"), F.lit("GET").alias("method"), F.concat(F.lit("route."), F.col("page_id").cast("string")).alias("qualified_name"))
    own = pages.select(path.alias("path"), F.lit("GET").alias("method"), F.concat(F.lit("caller."), F.col("page_id").cast("string")).alias("source_qualified_name"), F.lit("Module").alias("source_label"), F.lit(False).alias("is_async"))
    return sites.unionByName(own), routes


def _http(s: SparkSession, d: str) -> DataFrame:
    sites, routes = _page_sites(s, d)
    return http.match(sites, routes, digits=6).select("source_qualified_name", "route_qn", "confidence", "band")


def _urls(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "pages")
    text = F.concat(F.lit('x = "'), F.regexp_replace("url", r"example\.(net|org|com)", "service.local"), F.lit('"'))
    return pages.select("page_id", F.explode(http.urls_in(text)).alias("path"))


def _coupling(s: SparkSession, d: str) -> DataFrame:
    events = table(s, d, "events")
    commits = events.select(F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("hash"), F.col("event_type").alias("file"))
    return joins.change_coupling(commits).select("file_a", "file_b", "changes", F.round("score", 9).alias("score"))


def _p99(s: SparkSession, d: str) -> DataFrame:
    return joins.p99_by(table(s, d, "events"), "event_type", "value")


def _enrich(s: SparkSession, d: str) -> DataFrame:
    events = table(s, d, "events")
    edges = s.createDataFrame([(i, PROJECT, 1, i, "HTTP_CALLS", f'{{"url_path":"/{t}","confidence":{c}}}') for i, (t, c) in enumerate([("view", 0.5), ("click", 0.95), ("error", 0.8), ("view/", 0.3)])], "id long, project string, source_id long, target_id long, type string, properties string")
    rows = events.select(F.concat(F.lit("/"), "event_type").alias("path"), (F.col("value") * 1000).cast("long").alias("duration_ns"))
    done = otlp.enrich(edges, otlp.span_stats(rows))
    get = lambda n: F.get_json_object("properties", f"$.{n}")
    return done.select("id", F.round(get("confidence").cast("double"), 4).alias("confidence"), get("trace_call_count").cast("long").alias("calls"), get("validated_by_trace").alias("validated"), get("p99_latency_ns").cast("long").alias("p99"))


def _tags(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "part").select(F.col("p_partkey").alias("id"), camel_words("p_name").alias("w"))
    return derive.word_tags(rows, "id", F.col("w")).select("id", F.array_join("tags", "|").alias("tags"))


def _ladder(s: SparkSession, d: str) -> DataFrame:
    """Parts as definitions, modules by brand; references by name, from suppliers."""
    part = table(s, d, "part")
    name = F.translate("p_name", " ", "_")
    known = part.select(F.lit(PROJECT).alias("project"), F.concat_ws(".", F.lit(PROJECT), F.translate("p_brand", "#", ""), name).alias("qualified_name"), name.alias("name"), F.lit("Function").alias("label")).distinct()
    refs = part.select(
        F.col("p_partkey").alias("ref_id"), F.lit(PROJECT).alias("project"), F.when(F.col("p_partkey") % 8 == 0, name).otherwise(F.concat(F.lit("m."), name)).alias("callee"),
        F.concat_ws(".", F.lit(PROJECT), F.lit("Brand1")).alias("module_qn"), F.create_map(F.lit("m"), F.concat(F.lit(f"{PROJECT}."), F.translate("p_brand", "#", ""))).alias("imports"),
    )
    return resolve.resolve(refs, known).select("ref_id", "target_qn", "strategy", F.round("confidence", 6).alias("confidence"))


def _structure(s: SparkSession, d: str) -> DataFrame:
    files = star_graph(s, d).nodes.select("project", F.col("file_path").alias("rel_path")).distinct()
    nodes, edges = derive.structure(files)
    return nodes.groupBy(F.col("label").alias("kind")).count().unionByName(edges.groupBy(F.col("type").alias("kind")).count())


QUERIES = {
    "node_upsert_last_wins": _node_upsert,
    "edge_upsert_merge": _edge_upsert,
    "delete_cascade": _cascade,
    "semi_delete": _semi_delete,
    "anti_removed": lambda s, d: incremental.removed(*reversed(_hashes(s, d))).select("rel_path"),
    "incremental_classify": lambda s, d: incremental.classify(*_hashes(s, d)).select("rel_path", "status"),
    "dependents": _dependents,
    "overlap_join": _overlap,
    "hunk_carry_forward": _hunks,
    "relational_division": _division,
    "substring_join": _substring,
    "config_key_match": _config,
    "http_route_match": _http,
    "url_extract": _urls,
    "change_coupling": _coupling,
    "p99_by_type": _p99,
    "trace_enrich": _enrich,
    "decorator_tags": _tags,
    "resolve_ladder": _ladder,
    "structure_counts": _structure,
}

_HASHES = """WITH b AS (SELECT 'doc/' || doc_id AS rel_path, sha256(coalesce(text, '')) AS h, doc_id * 10 AS m, n_chars AS z, doc_id FROM documents),
st AS (SELECT * FROM b WHERE doc_id % 7 <> 0),
cu AS (SELECT rel_path, CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE h END AS h, CASE WHEN doc_id % 5 = 0 THEN m + 1 ELSE m END AS m, z FROM b WHERE doc_id % 11 <> 0)
"""
_NORMAL = "lower(regexp_replace(regexp_replace({p}, '/+$', ''), '/\\d+(/|$)', '/*\\1', 'g'))"
_SCORE = """
WITH sites AS (
  SELECT DISTINCT * FROM (
    SELECT unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1)) AS path, '' AS m, 'page.' || page_id AS src, 1.0::DOUBLE AS w FROM pages
    UNION ALL SELECT regexp_extract(url, '://[^/?#]*([^?#]*)', 1), 'GET', 'caller.' || page_id, 0.85::DOUBLE FROM pages) WHERE path <> ''
), s AS (SELECT DISTINCT {call} AS c, m, src, w, path FROM sites),
r AS (SELECT DISTINCT {route} AS t, 'route.' || page_id AS dst, path FROM (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages) WHERE lower(regexp_replace(path, '/+$', '')) NOT IN ('/health', '/healthz', '/ready', '/readyz', '/metrics', '/favicon.ico')),
x AS (
  SELECT *, CASE WHEN c = t THEN 0.95 WHEN ends_with(c, t) THEN 0.75
      WHEN len(string_split(c, '/')) = len(string_split(t, '/')) AND list_bool_and(list_transform(range(1, len(string_split(c, '/')) + 1), lambda i: string_split(c, '/')[i] = string_split(t, '/')[i] OR string_split(c, '/')[i] = '*' OR string_split(t, '/')[i] = '*')) THEN 0.55 ELSE 0 END::DOUBLE AS base,
    list_filter(string_split(CASE WHEN c <> t AND ends_with(c, t) THEN t ELSE c END, '/'), lambda v: v <> '') AS a, list_filter(string_split(t, '/'), lambda v: v <> '') AS b
  FROM s, r WHERE c <> '' AND t <> ''
), y AS (
  SELECT *, list_distinct(list_filter(a, lambda v: v <> '*')) AS ka, list_distinct(list_filter(b, lambda v: v <> '*')) AS kb FROM x WHERE base > 0
), z AS (
  SELECT src, dst, least(1.0, least(1.0, base * (0.5 * CASE WHEN len(list_distinct(ka || kb)) = 0 THEN 0 ELSE len(list_intersect(ka, kb)) / len(list_distinct(ka || kb)) END + 0.5 * least(1.0, len(b) / 3.0::DOUBLE))) * w + CASE WHEN m = '' THEN 0 ELSE 0.10 END) AS confidence FROM y
)
SELECT src AS source_qualified_name, dst AS route_qn, round(confidence::DOUBLE, 6) AS confidence, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.45 THEN 'medium' ELSE 'speculative' END AS band FROM z WHERE confidence >= 0.25
""".replace("{call}", _NORMAL.format(p="path")).replace("{route}", _NORMAL.format(p="path"))

SQL = {
    "node_upsert_last_wins": graph_query("SELECT qualified_name, CASE WHEN start_line % 6 = 0 THEN 'newer new ' || name WHEN start_line % 3 = 0 THEN 'new ' || name ELSE name END AS name, properties->>'$.segment' AS segment FROM nodes WHERE label = 'Customer'"),
    "edge_upsert_merge": graph_query("SELECT source_id, target_id, CASE WHEN source_id % 20 = 1 THEN 'b' END AS note, CAST(properties->>'$.quantity' AS DOUBLE) AS quantity FROM edges WHERE type = 'CONTAINS'"),
    "delete_cascade": graph_query("WITH gone AS (SELECT id FROM nodes WHERE label = 'Order' AND start_line < 500) SELECT type, count(*) AS count FROM edges WHERE type IN ('PLACED', 'CONTAINS') AND source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone) GROUP BY type"),
    "semi_delete": graph_query("SELECT type, count(*) AS count FROM edges WHERE type IN ('PLACED', 'IN_NATION') AND source_id NOT IN (SELECT id FROM nodes WHERE file_path = 'customer/3/file.go') GROUP BY type"),
    "anti_removed": _HASHES + "SELECT rel_path FROM st WHERE rel_path NOT IN (SELECT rel_path FROM cu)",
    "incremental_classify": _HASHES + "SELECT coalesce(cu.rel_path, st.rel_path) AS rel_path, CASE WHEN cu.rel_path IS NULL THEN 'removed' WHEN st.rel_path IS NULL THEN 'new' WHEN (cu.m = st.m AND cu.z = st.z) OR cu.h = st.h THEN 'unchanged' ELSE 'changed' END AS status FROM cu FULL JOIN st ON cu.rel_path = st.rel_path",
    "dependents": graph_query("SELECT DISTINCT 'tpch' AS project, o.file_path AS rel_path FROM edges e JOIN nodes o ON o.id = e.source_id JOIN nodes p ON p.id = e.target_id WHERE e.type = 'CONTAINS' AND p.id % 16 = 3"),
    "overlap_join": graph_query("WITH h AS (SELECT * FROM (VALUES ('part/3/file.js', 100, 130), ('part/5/file.js', 7, 7), ('3/file.py', 1, 40), ('file.py', 10, 12)) t(p, a, b)) SELECT qualified_name, p AS hunk_path, CAST(a AS INT) AS hunk_start FROM nodes JOIN h ON (file_path = p OR ends_with(file_path, '/' || p)) AND start_line <= b AND end_line >= a WHERE label IN ('Part', 'Supplier')"),
    "hunk_carry_forward": "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS c, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents) SELECT h.doc_id, 'f' || length(f.c) AS path, CAST(length(h.c) AS INT) AS start_line, CAST(length(h.c) + 2 AS INT) AS end_line FROM l h JOIN l f ON f.doc_id = h.doc_id AND f.n = h.n - 1 WHERE h.n % 2 = 0",
    "relational_division": "WITH have AS (SELECT DISTINCT o_custkey AS owner, p_brand AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey), need AS (SELECT * FROM (VALUES ('a', 'Brand#1'), ('a', 'Brand#2'), ('a', 'Brand#3'), ('b', 'Brand#11'), ('b', 'Brand#12')) t(grp, item)) SELECT owner, grp FROM have JOIN need USING (item) GROUP BY owner, grp HAVING count(*) = (SELECT count(*) FROM need n WHERE n.grp = need.grp)",
    "substring_join": "WITH k AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS key FROM part) SELECT p_partkey AS id, key FROM part, k WHERE contains('_' || replace(p_name, ' ', '_') || '_', '_' || key || '_')",
    "config_key_match": "WITH c AS (SELECT p_partkey AS id, p_name AS n FROM part WHERE len(string_split(p_name, ' ')) >= 2 AND len(list_filter(string_split(p_name, ' '), lambda w: length(w) < 3)) = 0), s AS (SELECT p_partkey AS id, p_name || ' handler' AS n FROM part UNION ALL SELECT p_partkey, p_name FROM part) SELECT c.id AS config_id, s.id AS code_id, CAST(CASE WHEN c.n = s.n THEN 0.85 ELSE 0.75 END AS DOUBLE) AS confidence FROM c JOIN s ON contains('_' || replace(s.n, ' ', '_') || '_', '_' || replace(c.n, ' ', '_') || '_')",
    "http_route_match": _SCORE,
    "url_extract": "SELECT page_id, regexp_extract(url, '://[^/]*(/[A-Za-z0-9_./{}:-]*)', 1) AS path FROM pages WHERE regexp_matches(url, '://[^/]*/[^/?#]')",
    "change_coupling": "WITH c AS (SELECT DISTINCT user_id || '|' || strftime(ts, '%Y-%m-%d') AS h, event_type AS f FROM events), n AS (SELECT f, count(*) AS t FROM c GROUP BY f), p AS (SELECT a.f AS fa, b.f AS fb, count(*) AS k FROM c a JOIN c b ON a.h = b.h AND a.f < b.f GROUP BY ALL HAVING count(*) >= 3) SELECT fa AS file_a, fb AS file_b, k AS changes, round(k / least(x.t, y.t), 9) AS score FROM p JOIN n x ON x.f = fa JOIN n y ON y.f = fb WHERE k / least(x.t, y.t) >= 0.3",
    "p99_by_type": "SELECT event_type, count(*) AS n, list_sort(list(value))[least(CAST(floor(0.99 * count(*)) AS BIGINT), count(*) - 1) + 1] AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "trace_enrich": "WITH e AS (SELECT * FROM (VALUES (1, 'click', 0.95), (2, 'error', 0.95), (3, 'view', 0.45)) t(id, k, c)), s AS (SELECT event_type AS k, count(*) AS calls, list_sort(list(d) FILTER (d > 0)) AS l FROM (SELECT event_type, CAST(trunc(value * 1000) AS BIGINT) AS d FROM events) GROUP BY 1) SELECT CAST(id AS BIGINT) AS id, CAST(c AS DOUBLE) AS confidence, calls, 'true' AS validated, l[least(CAST(floor(0.99 * len(l)) AS BIGINT), len(l) - 1) + 1] AS p99 FROM e JOIN s USING (k)",
    "decorator_tags": "WITH w AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(lower(p_name), ' ')) AS word FROM part), c AS (SELECT word FROM w WHERE length(word) > 1 GROUP BY word HAVING count(*) >= 2) SELECT id, string_agg(word, '|' ORDER BY word) AS tags FROM w JOIN c USING (word) GROUP BY id",
    "resolve_ladder": """WITH known AS (SELECT DISTINCT 'tpch.' || replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') AS qn, replace(p_name, ' ', '_') AS name FROM part),
sizes AS (SELECT name, count(*) AS n FROM known GROUP BY name),
refs AS (SELECT p_partkey AS ref_id, replace(p_name, ' ', '_') AS name, 'tpch.' || replace(p_brand, '#', '') AS reach, p_partkey % 8 = 0 AS bare FROM part),
pick AS (SELECT ref_id, bare, r.name, n, reach, 'tpch.Brand1.' || r.name AS same, EXISTS (SELECT 1 FROM known WHERE qn = 'tpch.Brand1.' || r.name) AS in_module FROM refs r JOIN sizes s ON s.name = r.name)
SELECT ref_id, CASE WHEN NOT bare THEN reach || '.' || name WHEN in_module THEN same ELSE reach || '.' || name END AS target_qn,
  CASE WHEN NOT bare THEN 'import_map' WHEN in_module THEN 'same_module' WHEN n = 1 THEN 'unique_name' ELSE 'suffix_match' END AS strategy,
  round(CASE WHEN NOT bare THEN 0.95 WHEN in_module THEN 0.90 WHEN n = 1 THEN 0.75 ELSE 0.55 * least(1.0, 3.0 / n) END::DOUBLE, 6) AS confidence FROM pick WHERE NOT bare OR in_module OR n = 1 OR 0.55 * least(1.0, 3.0 / n) >= 0.1""",
    "structure_counts": graph_query("WITH f AS (SELECT DISTINCT file_path FROM nodes), g AS (SELECT DISTINCT split_part(file_path, '/', 1) AS d FROM f UNION SELECT DISTINCT split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) FROM f) SELECT 'Project' AS kind, CAST(1 AS BIGINT) AS count UNION ALL SELECT 'File', count(*) FROM f UNION ALL SELECT 'CONTAINS_FILE', count(*) FROM f UNION ALL SELECT 'Folder', count(*) FROM g UNION ALL SELECT 'CONTAINS_FOLDER', count(*) FROM g"),
}
