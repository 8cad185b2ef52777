"""Cypher patterns and traversals over the star graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import traverse
from ..plans.builder import compile_query
from ..sources.star import BASE, LABELS, graph_query, star_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _cypher(name: str, query: str, sql: str | None, **columns: str) -> None:
    """Register a Cypher query; `columns` maps new names to returned ones."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compile_query(star_graph(spark, sf_dir), query)

    QUERIES[name] = run
    if sql:
        SQL[name] = graph_query(sql)


_HOP = "JOIN edges {r} ON {r}.source_id = {a}.id AND {r}.type = '{t}' JOIN nodes {b} ON {b}.id = {r}.target_id"


def _hop(a: str, r: str, t: str, b: str) -> str:
    return _HOP.format(a=a, r=r, t=t, b=b)


FLAGSHIP = "MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) WHERE o.status = 'F' RETURN p.name AS part, COUNT(o) AS n ORDER BY n DESC, part LIMIT 20"

_cypher("scan_label", "MATCH (n:Nation) RETURN n.name AS name, n.qualified_name AS qualified_name, n.start_line AS start_line", "SELECT name, qualified_name, start_line FROM nodes WHERE label = 'Nation'")
_cypher("scan_inline_props", "MATCH (p:Part {brand: 'Brand#12'}) RETURN p.qualified_name AS qn", "SELECT qualified_name AS qn FROM nodes WHERE label = 'Part' AND properties->>'$.brand' = 'Brand#12'")
_cypher("filter_eq", "MATCH (o:Order) WHERE o.status = 'F' RETURN o.qualified_name AS qn", "SELECT qualified_name AS qn FROM nodes WHERE label = 'Order' AND properties->>'$.status' = 'F'")
_cypher("filter_contains", "MATCH (n:Nation) WHERE n.name CONTAINS '_1' RETURN n.name AS name", "SELECT name FROM nodes WHERE label = 'Nation' AND contains(name, '_1')")
_cypher("filter_starts_with", "MATCH (p:Part) WHERE p.kind STARTS WITH 'PROMO' RETURN p.qualified_name AS qn, p.kind AS kind", "SELECT qualified_name AS qn, properties->>'$.kind' AS kind FROM nodes WHERE label = 'Part' AND starts_with(properties->>'$.kind', 'PROMO')")
_cypher("filter_regex", "MATCH (c:Customer) WHERE c.name =~ '0{3}[13]$' RETURN c.name AS name", "SELECT name FROM nodes WHERE label = 'Customer' AND regexp_matches(name, '0{3}[13]$')")
_cypher("filter_numeric", "MATCH (p:Part) WHERE p.size >= 40 AND p.start_line < 100 RETURN p.qualified_name AS qn", "SELECT qualified_name AS qn FROM nodes WHERE label = 'Part' AND CAST(properties->>'$.size' AS DOUBLE) >= 40 AND start_line < 100")
_cypher("filter_or_and_not", "MATCH (c:Customer) WHERE (c.segment = 'BUILDING' OR c.segment = 'MACHINERY') AND NOT c.acctbal < 5000 RETURN c.qualified_name AS qn", "SELECT qualified_name AS qn FROM nodes WHERE label = 'Customer' AND properties->>'$.segment' IN ('BUILDING', 'MACHINERY') AND NOT CAST(properties->>'$.acctbal' AS DOUBLE) < 5000")
_cypher("filter_neq_isnull", "MATCH (c:Customer) WHERE c.segment <> 'BUILDING' AND c.missing IS NULL AND c.segment IS NOT NULL RETURN c.qualified_name AS qn", "SELECT qualified_name AS qn FROM nodes WHERE label = 'Customer' AND properties->>'$.segment' <> 'BUILDING'")
_cypher("filter_in_list", "MATCH (o:Order) WHERE o.priority IN ['1-URGENT', '2-HIGH'] AND o.total > 300000 RETURN o.qualified_name AS qn", "SELECT qualified_name AS qn FROM nodes WHERE label = 'Order' AND properties->>'$.priority' IN ('1-URGENT', '2-HIGH') AND CAST(properties->>'$.total' AS DOUBLE) > 300000")
_cypher("expand_out", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.name AS nation, r.name AS region", f"SELECT n.name AS nation, r.name AS region FROM nodes n {_hop('n', 'e', 'IN_REGION', 'r')} WHERE n.label = 'Nation' AND r.label = 'Region'")
_cypher("expand_in", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WHERE r.name = 'ASIA' RETURN n.name AS nation", f"SELECT n.name AS nation FROM nodes n {_hop('n', 'e', 'IN_REGION', 'r')} WHERE r.name = 'ASIA'")
_cypher("expand_any", "MATCH (n:Nation)-[e]-(x) WHERE n.start_line < 3 RETURN n.name AS nation, e.type AS type, x.qualified_name AS other", "SELECT n.name AS nation, e.type AS type, x.qualified_name AS other FROM nodes n JOIN edges e ON n.id IN (e.source_id, e.target_id) JOIN nodes x ON x.id = CASE WHEN e.source_id = n.id THEN e.target_id ELSE e.source_id END WHERE n.label = 'Nation' AND n.start_line < 3")
_cypher("expand_multi_type", "MATCH (a)-[e:IN_REGION|IN_NATION]->(b) RETURN e.type AS type, b.name AS name, COUNT(a) AS n", "SELECT e.type AS type, b.name AS name, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE e.type IN ('IN_REGION', 'IN_NATION') GROUP BY ALL")
_cypher("expand_two_hop", "MATCH (s:Supplier)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN s.name AS supplier, n.name AS nation, r.name AS region", f"SELECT s.name AS supplier, n.name AS nation, r.name AS region FROM nodes s {_hop('s', 'e', 'IN_NATION', 'n')} {_hop('n', 'f', 'IN_REGION', 'r')} WHERE s.label = 'Supplier'")
_cypher("expand_three_hop", "MATCH (o:Order)<-[:PLACED]-(c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, COUNT(o) AS n", f"SELECT r.name AS region, count(*) AS n FROM nodes c {_hop('c', 'p', 'PLACED', 'o')} {_hop('c', 'e', 'IN_NATION', 'n')} {_hop('n', 'f', 'IN_REGION', 'r')} GROUP BY ALL")
_cypher("edge_property_filter", "MATCH (o:Order)-[e:CONTAINS]->(p:Part) WHERE e.quantity > 60 RETURN o.qualified_name AS o, p.qualified_name AS p", f"SELECT o.qualified_name AS o, p.qualified_name AS p FROM nodes o {_hop('o', 'e', 'CONTAINS', 'p')} WHERE CAST(e.properties->>'$.quantity' AS DOUBLE) > 60")
_cypher("json_property_filter", "MATCH (e:Event) WHERE e.k >= 90 AND e.name = 'error' RETURN e.qualified_name AS qn, e.k AS k", "SELECT qualified_name AS qn, properties->>'$.k' AS k FROM nodes WHERE label = 'Event' AND CAST(properties->>'$.k' AS DOUBLE) >= 90 AND name = 'error'")
_cypher("count_group", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.segment AS segment, o.status AS status, COUNT(o) AS n", f"SELECT c.properties->>'$.segment' AS segment, o.properties->>'$.status' AS status, count(*) AS n FROM nodes c {_hop('c', 'e', 'PLACED', 'o')} GROUP BY ALL")
_cypher("count_global", "MATCH (o:Order)-[:CONTAINS]->(p) RETURN COUNT(p) AS n", f"SELECT count(*) AS n FROM nodes o {_hop('o', 'e', 'CONTAINS', 'p')}")
_cypher("count_global_empty", "MATCH (o:Order)-[:MISSING]->(p) RETURN COUNT(*) AS n", "SELECT CAST(0 AS BIGINT) AS n")
_cypher("count_two_hop", "MATCH (c:Customer)-[:PLACED]->(o)-[:CONTAINS]->(p) RETURN c.name AS name, COUNT(p) AS n", f"SELECT c.name AS name, count(*) AS n FROM nodes c {_hop('c', 'e', 'PLACED', 'o')} {_hop('o', 'f', 'CONTAINS', 'p')} GROUP BY ALL")
_cypher("count_distinct", "MATCH (o:Order)-[:CONTAINS]->(p:Part) RETURN p.brand AS brand, COUNT(DISTINCT p) AS parts, COUNT(*) AS n", f"SELECT p.properties->>'$.brand' AS brand, count(DISTINCT p.id) AS parts, count(*) AS n FROM nodes o {_hop('o', 'e', 'CONTAINS', 'p')} GROUP BY ALL")
_cypher("count_any_direction", "MATCH (n:Nation)-[:IN_REGION|IN_NATION]-(x) RETURN n.name AS name, COUNT(x) AS n", "SELECT n.name AS name, count(*) AS n FROM nodes n JOIN edges e ON n.id IN (e.source_id, e.target_id) AND e.type IN ('IN_REGION', 'IN_NATION') WHERE n.label = 'Nation' GROUP BY ALL")
_cypher("return_distinct", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN DISTINCT c.segment AS segment, o.priority AS priority", f"SELECT DISTINCT c.properties->>'$.segment' AS segment, o.properties->>'$.priority' AS priority FROM nodes c {_hop('c', 'e', 'PLACED', 'o')}")
_cypher("default_projection", "MATCH (n:Nation)-[e:IN_REGION]->(r:Region)", f"""SELECT e.type AS "e.type", n.label AS "n.label", n.name AS "n.name", n.qualified_name AS "n.qualified_name", r.label AS "r.label", r.name AS "r.name", r.qualified_name AS "r.qualified_name" FROM nodes n {_hop('n', 'e', 'IN_REGION', 'r')}""")
_cypher("order_by_limit", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.qualified_name AS qn, COUNT(o) AS n ORDER BY n DESC, qn LIMIT 15", f"SELECT c.qualified_name AS qn, count(*) AS n FROM nodes c {_hop('c', 'e', 'PLACED', 'o')} GROUP BY ALL ORDER BY n DESC, qn LIMIT 15")
_cypher("order_by_non_projected", "MATCH (p:Part) RETURN p.name AS name ORDER BY p.start_line DESC, p.qualified_name LIMIT 12", "SELECT name FROM nodes WHERE label = 'Part' ORDER BY start_line DESC, qualified_name LIMIT 12")
_cypher("flagship_two_hop", FLAGSHIP, f"SELECT p.name AS part, count(*) AS n FROM nodes c {_hop('c', 'e', 'PLACED', 'o')} {_hop('o', 'f', 'CONTAINS', 'p')} WHERE o.properties->>'$.status' = 'F' GROUP BY ALL ORDER BY n DESC, part LIMIT 20")
_cypher("var_length_1_3", "MATCH (e:Event {k: 7})-[:NEXT*1..3]->(f:Event) RETURN e.qualified_name AS a, f.qualified_name AS b", """WITH w AS (
  SELECT id AS origin, id AS node, 0 AS hop FROM nodes WHERE label = 'Event' AND properties->>'$.k' = '7' UNION
  SELECT w.origin, e.target_id, w.hop + 1 FROM w JOIN edges e ON e.source_id = w.node AND e.type = 'NEXT' WHERE w.hop < 3)
SELECT a.qualified_name AS a, b.qualified_name AS b FROM w JOIN nodes a ON a.id = w.origin JOIN nodes b ON b.id = w.node WHERE hop > 0""")
_cypher("var_length_unbounded_10", "MATCH (e:Event {k: 13})-[:NEXT*]->(f:Event) WHERE f.name = 'purchase' RETURN e.qualified_name AS a, COUNT(f) AS n", """WITH w AS (
  SELECT id AS origin, id AS node, 0 AS hop FROM nodes WHERE label = 'Event' AND properties->>'$.k' = '13' UNION
  SELECT w.origin, e.target_id, w.hop + 1 FROM w JOIN edges e ON e.source_id = w.node AND e.type = 'NEXT' WHERE w.hop < 10)
SELECT a.qualified_name AS a, count(*) AS n FROM w JOIN nodes a ON a.id = w.origin JOIN nodes b ON b.id = w.node WHERE hop > 0 AND b.name = 'purchase' GROUP BY ALL""")


@lambda f: QUERIES.__setitem__("return_whole_node", f)
def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_query(star_graph(spark, sf_dir), "MATCH (n:Nation) WHERE n.name STARTS WITH 'NATION_2' RETURN n").select("n.*")


SQL["return_whole_node"] = graph_query("SELECT name, qualified_name, label, file_path, start_line, end_line FROM nodes WHERE label = 'Nation' AND starts_with(name, 'NATION_2')")

_START = LABELS["Region"] * BASE + 2
_WALK = """WITH w AS (SELECT CAST({start} AS BIGINT) AS node, 0 AS hop UNION SELECT {there}, w.hop + 1 FROM w JOIN {edges} e ON {on} WHERE w.hop < {depth})"""


def _walk(direction: str, depth: int, types: str) -> str:
    pairs = {
        "out": f"(SELECT source_id AS a, target_id AS b FROM edges WHERE type IN ({types}))",
        "in": f"(SELECT target_id AS a, source_id AS b FROM edges WHERE type IN ({types}))",
        "any": f"(SELECT source_id AS a, target_id AS b FROM edges WHERE type IN ({types}) UNION SELECT target_id, source_id FROM edges WHERE type IN ({types}))",
    }[direction]
    return _WALK.format(start=_START, there="e.b", edges=pairs, on="e.a = w.node", depth=depth)


def _starts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(_START,)], "id long")


def _bfs(name: str, direction: str, depth: int, types: tuple[str, ...]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return traverse.bfs(star_graph(spark, sf_dir), _starts(spark), types, direction, depth).select("qualified_name", "hop")

    QUERIES[name] = run
    listed = ", ".join(f"'{t}'" for t in types)
    SQL[name] = graph_query(f"{_walk(direction, depth, listed)} SELECT DISTINCT n.qualified_name, CAST(hop AS INT) AS hop FROM w JOIN nodes n ON n.id = w.node WHERE hop > 0")


_bfs("bfs_in", "in", 3, ("IN_REGION", "IN_NATION", "PLACED"))
_bfs("bfs_any", "any", 3, ("IN_REGION", "IN_NATION"))


def _bfs_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    starts = graph.labelled("Nation").where("start_line < 5").select("id")
    return traverse.bfs(graph, starts, ("IN_REGION",), "out", 2).select("qualified_name", "hop")


QUERIES["bfs_out"] = _bfs_out
SQL["bfs_out"] = graph_query("SELECT DISTINCT r.qualified_name, CAST(1 AS INT) AS hop FROM edges e JOIN nodes n ON n.id = e.source_id JOIN nodes r ON r.id = e.target_id WHERE e.type = 'IN_REGION' AND n.start_line < 5")


def _bfs_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.bfs_edges(star_graph(spark, sf_dir), _starts(spark), ("IN_REGION", "IN_NATION"), "in", 2)


QUERIES["bfs_edges"] = _bfs_edges
SQL["bfs_edges"] = graph_query(_walk("in", 2, "'IN_REGION', 'IN_NATION'") + " SELECT DISTINCT s.name AS from_name, t.name AS to_name, e.type AS type, CAST(0 AS DOUBLE) AS confidence FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.type IN ('IN_REGION', 'IN_NATION') AND e.target_id IN (SELECT node FROM w WHERE hop < 2)")


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    starts = graph.labelled("Nation").where("name = 'CHINA' or name = 'NATION_3'").select("id").union(graph.labelled("Nation").where("start_line = 7").select("id"))
    return traverse.trace(graph, starts, "both", 3, ("IN_REGION", "IN_NATION", "PLACED")).select("direction", "hop", "risk", "qualified_name")


QUERIES["trace_both_risk"] = _trace
SQL["trace_both_risk"] = graph_query("""WITH s AS (SELECT id FROM nodes WHERE label = 'Nation' AND (name IN ('CHINA', 'NATION_3') OR start_line = 7)),
o AS (SELECT id AS node, 0 AS hop FROM s UNION SELECT e.target_id, o.hop + 1 FROM o JOIN edges e ON e.source_id = o.node AND e.type IN ('IN_REGION', 'IN_NATION', 'PLACED') WHERE o.hop < 3),
i AS (SELECT id AS node, 0 AS hop FROM s UNION SELECT e.source_id, i.hop + 1 FROM i JOIN edges e ON e.target_id = i.node AND e.type IN ('IN_REGION', 'IN_NATION', 'PLACED') WHERE i.hop < 3)
SELECT d AS direction, CAST(hop AS INT) AS hop, CASE hop WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk, n.qualified_name
FROM (SELECT 'outbound' AS d, * FROM o UNION ALL SELECT 'inbound', * FROM i) x JOIN nodes n ON n.id = x.node WHERE hop > 0""")

_IMPACT_SQL = """WITH s AS (SELECT id, qualified_name FROM nodes WHERE label = 'Part' AND start_line < 3),
w AS (SELECT id AS node, 0 AS hop, qualified_name AS q FROM s UNION SELECT e.source_id, w.hop + 1, w.q FROM w JOIN edges e ON e.target_id = w.node AND e.type IN ('CONTAINS', 'PLACED') WHERE w.hop < 2),
b AS (SELECT node, hop, q, row_number() OVER (PARTITION BY node ORDER BY hop, q) AS k FROM w WHERE hop > 0 AND node NOT IN (SELECT id FROM s)),
i AS (SELECT n.qualified_name, CAST(b.hop AS INT) AS hop, b.q AS changed_by, CASE b.hop WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM b JOIN nodes n ON n.id = b.node WHERE k = 1)
"""


def _impacted(spark: SparkSession, sf_dir: str) -> tuple:
    graph = star_graph(spark, sf_dir)
    changed = graph.labelled("Part").where("start_line < 3").select("id")
    return graph, traverse.impact(graph, changed, 2, ("CONTAINS", "PLACED"))


QUERIES["impact_multi_source"] = lambda spark, d: _impacted(spark, d)[1].select("qualified_name", "hop", "changed_by", "risk")
SQL["impact_multi_source"] = graph_query(_IMPACT_SQL + "SELECT * FROM i")


def _impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, rows = _impacted(spark, sf_dir)
    return traverse.impact_summary(rows, graph.edges)


QUERIES["impact_summary"] = _impact_summary
SQL["impact_summary"] = graph_query(_IMPACT_SQL + "SELECT count(*) FILTER (risk = 'CRITICAL') AS critical, count(*) FILTER (risk = 'HIGH') AS high, count(*) FILTER (risk = 'MEDIUM') AS medium, count(*) FILTER (risk = 'LOW') AS low, count(*) AS total, false AS cross_service FROM i")
