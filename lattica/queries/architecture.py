"""Search, schema statistics and architecture roll-ups over the star graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import architecture as A, community, search as S
from ..sources.star import graph_query, star_graph

_DEGREES = """WITH deg AS (SELECT id, sum(i) AS i, sum(o) AS o FROM (SELECT source_id AS id, 0 AS i, 1 AS o FROM edges{w} UNION ALL SELECT target_id, 1, 0 FROM edges{w}) GROUP BY id),
f AS (SELECT n.*, CAST(coalesce(i, 0) AS BIGINT) AS in_degree, CAST(coalesce(o, 0) AS BIGINT) AS out_degree FROM nodes n LEFT JOIN deg USING (id))
"""


def _degrees(kind: str | None = None) -> str:
    return _DEGREES.replace("{w}", f" WHERE type = '{kind}'" if kind else "")


def _search_page(spark: SparkSession, d: str) -> DataFrame:
    rows = S.search(star_graph(spark, d), label="Part", name_pattern=".*red.*", min_degree=1)
    return S.page(rows, S.relevance(".*red.*"), 5, 10).select("qualified_name", "in_degree", "out_degree", "total")


def _connected(spark: SparkSession, d: str) -> DataFrame:
    graph = star_graph(spark, d)
    found = S.connected_names(graph, graph.labelled("Supplier"), ("IN_NATION", "SUPPLIED_BY"), 10)
    return found.select("id", F.array_join("names", "|").alias("names"))


def _dead(spark: SparkSession, d: str) -> DataFrame:
    return S.dead_code(star_graph(spark, d), ("Customer", "Order"), ("PLACED",)).select("qualified_name")


def _louvain(spark: SparkSession, d: str) -> DataFrame:
    graph = star_graph(spark, d)
    return community.louvain(graph, ("IN_REGION", "IN_NATION"), None)


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    graph = star_graph(spark, d)
    return community.cluster_summary(graph, community.louvain(graph, ("IN_REGION", "IN_NATION"), None), ("IN_REGION", "IN_NATION"))


QUERIES = {
    "search_basic": lambda s, d: S.search(star_graph(s, d), label="Supplier", file_pattern="supplier/1*").select("qualified_name", "in_degree", "out_degree"),
    "search_regex_ci": lambda s, d: S.search(star_graph(s, d), label="Part", name_pattern="^RED").select("qualified_name", "name"),
    "search_degree_range": lambda s, d: S.search(star_graph(s, d), label="Customer", relationship="PLACED", direction="outbound", min_degree=8, max_degree=12).select("qualified_name", "out_degree"),
    "search_dead_code": _dead,
    "search_relevance_page": _search_page,
    "search_connected_names": _connected,
    "schema_labels": lambda s, d: A.label_counts(star_graph(s, d)),
    "schema_types": lambda s, d: A.type_counts(star_graph(s, d)),
    "schema_patterns": lambda s, d: A.patterns(star_graph(s, d)),
    "arch_hotspots": lambda s, d: A.hotspots(star_graph(s, d), 10, ("CONTAINS",), ("Part",)),
    "arch_boundaries": lambda s, d: A.boundaries(star_graph(s, d), 10, ("IN_REGION", "IN_NATION", "PLACED", "CONTAINS", "SUPPLIED_BY")),
    "arch_services": lambda s, d: A.services(star_graph(s, d), 10, ("PLACED", "CONTAINS", "NEXT")),
    "arch_layers": lambda s, d: A.layers(star_graph(s, d), ("IN_REGION", "IN_NATION", "PLACED", "CONTAINS", "SUPPLIED_BY")),
    "arch_packages": lambda s, d: A.packages(star_graph(s, d), 15, ("IN_NATION", "PLACED", "CONTAINS"), ("Customer", "Order", "Part", "Nation")),
    "arch_languages": lambda s, d: A.languages(star_graph(s, d), 10, None),
    "arch_file_tree": lambda s, d: A.file_tree(star_graph(s, d), 3, None),
    "louvain_communities": _louvain,
    "cluster_summary": _clusters,
}

_PACKAGE = "split_part({q}, '.', 2)"
_CROSS = "WITH c AS (SELECT split_part(s.qualified_name, '.', 2) AS f, split_part(t.qualified_name, '.', 2) AS g, e.type FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id)"

SQL = {k: graph_query(v) for k, v in {
    "search_basic": _degrees() + "SELECT qualified_name, in_degree, out_degree FROM f WHERE label = 'Supplier' AND file_path ILIKE 'supplier/1%'",
    "search_regex_ci": "SELECT qualified_name, name FROM nodes WHERE label = 'Part' AND regexp_matches(name, '(?i)^RED')",
    "search_degree_range": _degrees("PLACED") + "SELECT qualified_name, out_degree FROM f WHERE label = 'Customer' AND out_degree BETWEEN 8 AND 12",
    "search_dead_code": "SELECT qualified_name FROM nodes WHERE label IN ('Customer', 'Order') AND id NOT IN (SELECT target_id FROM edges WHERE type = 'PLACED')",
    "search_relevance_page": _degrees() + "SELECT qualified_name, in_degree, out_degree, total FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY name = 'red' DESC, starts_with(name, 'red') DESC, in_degree + out_degree DESC, qualified_name) AS k FROM f WHERE label = 'Part' AND name LIKE '%red%' AND in_degree + out_degree >= 1) WHERE k BETWEEN 6 AND 15",
    "search_connected_names": "WITH p AS (SELECT source_id AS id, target_id AS o FROM edges WHERE type IN ('IN_NATION', 'SUPPLIED_BY') UNION SELECT target_id, source_id FROM edges WHERE type IN ('IN_NATION', 'SUPPLIED_BY')), q AS (SELECT DISTINCT p.id, x.name FROM p JOIN nodes s ON s.id = p.id AND s.label = 'Supplier' JOIN nodes x ON x.id = p.o), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name) AS k FROM q) SELECT id, string_agg(name, '|' ORDER BY name) AS names FROM r WHERE k <= 10 GROUP BY id",
    "schema_labels": "SELECT label, count(*) AS count FROM nodes GROUP BY label",
    "schema_types": "SELECT type, count(*) AS count FROM edges GROUP BY type",
    "schema_patterns": "SELECT *, '(:' || source_label || ')-[:' || type || ']->(:' || target_label || ') [' || count || 'x]' AS pattern FROM (SELECT s.label AS source_label, e.type, t.label AS target_label, count(*) AS count FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id GROUP BY ALL)",
    "arch_hotspots": "SELECT n.id, n.name, n.qualified_name, count(*) AS fan_in FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.type = 'CONTAINS' GROUP BY ALL ORDER BY fan_in DESC, n.qualified_name LIMIT 10",
    "arch_boundaries": _CROSS + " SELECT f AS from_package, g AS to_package, count(*) AS calls FROM c WHERE f <> g AND type <> 'NEXT' GROUP BY ALL ORDER BY calls DESC, f, g LIMIT 10",
    "arch_services": _CROSS + " SELECT f AS from_package, g AS to_package, type, count(*) AS calls FROM c WHERE type IN ('PLACED', 'CONTAINS', 'NEXT') GROUP BY ALL",
    "arch_layers": _CROSS + ", b AS (SELECT f, g FROM c WHERE f <> g AND type <> 'NEXT'), p AS (SELECT package, sum(i) AS fan_in, sum(o) AS fan_out FROM (SELECT g AS package, 1 AS i, 0 AS o FROM b UNION ALL SELECT f, 0, 1 FROM b) GROUP BY package) SELECT package, CAST(fan_in AS BIGINT) AS fan_in, CAST(fan_out AS BIGINT) AS fan_out, CAST(0 AS BIGINT) AS routes, false AS entry, CASE WHEN fan_in > fan_out AND fan_in > 3 THEN 'core' WHEN fan_out = 0 AND fan_in > 0 THEN 'leaf' WHEN fan_in = 0 AND fan_out > 0 THEN 'entry' ELSE 'internal' END AS layer FROM p",
    "arch_packages": _CROSS + ", x AS (SELECT f, g FROM c WHERE f <> g AND type IN ('IN_NATION', 'PLACED', 'CONTAINS')), n AS (SELECT split_part(qualified_name, '.', 2) AS package, count(*) AS nodes FROM nodes WHERE label IN ('Customer', 'Order', 'Part', 'Nation') GROUP BY 1) SELECT package, nodes, (SELECT count(*) FROM x WHERE g = package) AS fan_in, (SELECT count(*) FROM x WHERE f = package) AS fan_out FROM n",
    "arch_languages": "SELECT CASE split_part(file_path, '/file', 2) WHEN '.tf' THEN 'HCL' WHEN '.go' THEN 'Go' WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.java' THEN 'Java' WHEN '.rs' THEN 'Rust' END AS language, count(DISTINCT file_path) AS files FROM nodes GROUP BY 1",
    "arch_file_tree": "WITH p AS (SELECT DISTINCT split_part(file_path, '/', 1) AS a, split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) AS b, file_path AS c FROM nodes) SELECT a AS path, 'dir' AS kind, count(DISTINCT b) AS children FROM p GROUP BY a UNION ALL SELECT b, 'dir', count(DISTINCT c) FROM p GROUP BY b UNION ALL SELECT DISTINCT c, 'file', CAST(0 AS BIGINT) FROM p",
}.items()}
