"""Bounded traversal: a frontier of distinct (origin, node) rows, one join a hop.

The nodes that walks of k steps reach depend on the nodes of k - 1 steps alone, so
distinct frontiers give the rows (node, hop) of all walks without enumerating them.
Every hop is written, which keeps plans short and makes a lost executor cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..model import Graph, json_number
from ..storage import Cuts

CALL_TYPES = ("CALLS",)


def steps(edges: DataFrame, types: tuple[str, ...], direction: str) -> DataFrame:
    """(here, there): one hop along edges of the types, without repetition."""
    rows = edges.where(F.col("type").isin(*types)) if types else edges
    out = rows.select(F.col("source_id").alias("here"), F.col("target_id").alias("there"))
    back = rows.select(F.col("target_id").alias("here"), F.col("source_id").alias("there"))
    return (out if direction == "out" else back if direction == "in" else out.union(back)).distinct()


def reach(edges: DataFrame, origins: DataFrame, types: tuple[str, ...], direction: str, depth: int) -> DataFrame:
    """(origin, node, hop): every node that some walk of `hop` steps from an origin
    (column origin) ends in, for hop from 1 to `depth`. An origin comes again
    through cycles; a node may have several hops."""
    cuts = Cuts(edges.sparkSession, "reach")
    along = steps(edges, types, direction)
    if depth > 1:
        along = cuts.cut(along)
    frontier = origins.select("origin", F.col("origin").alias("node")).distinct()
    found = frontier.where(F.lit(False)).withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        frontier = frontier.join(along, F.col("node") == F.col("here")).select("origin", F.col("there").alias("node")).distinct()
        if depth > 1:
            frontier = cuts.cut(frontier)
        found = found.unionByName(frontier.withColumn("hop", F.lit(hop)))
        if depth > 1 and frontier.isEmpty():
            break
    return found


def bfs(graph: Graph, starts: DataFrame, types: tuple[str, ...] = CALL_TYPES, direction: str = "out", depth: int = 3, limit: int | None = None) -> DataFrame:
    """Visited nodes with their hops, by hop and name: the columns of nodes and hop.
    `starts` has a column id."""
    hops = reach(graph.edges, starts.select(F.col("id").alias("origin")), types, direction, depth).select("node", "hop").distinct()
    rows = graph.nodes.join(hops, F.col("id") == F.col("node")).drop("node")
    return rows.orderBy("hop", "name", "id").limit(limit) if limit else rows


def bfs_edges(graph: Graph, starts: DataFrame, types: tuple[str, ...] = CALL_TYPES, direction: str = "out", depth: int = 3) -> DataFrame:
    """Distinct (from_name, to_name, type, confidence) of edges that leave a node
    visited before the last hop; a missing confidence is 0."""
    hops = reach(graph.edges, starts.select(F.col("id").alias("origin")), types, direction, depth)
    inside = hops.where(F.col("hop") < depth).select("node").union(starts.select(F.col("id").alias("node"))).distinct()
    rows = graph.typed(*types).withColumn("confidence", F.coalesce(json_number(F.col("properties"), "confidence"), F.lit(0.0)))
    ends = {"out": ("source_id",), "in": ("target_id",), "any": ("source_id", "target_id")}[direction]
    kept = rows.join(inside, F.col(ends[0]) == F.col("node"), "left_semi")
    for end in ends[1:]:
        kept = kept.union(rows.join(inside, F.col(end) == F.col("node"), "left_semi"))
    src = graph.nodes.select(F.col("id").alias("source_id"), F.col("name").alias("from_name"))
    dst = graph.nodes.select(F.col("id").alias("target_id"), F.col("name").alias("to_name"))
    return kept.join(src, "source_id").join(dst, "target_id").select("from_name", "to_name", "type", "confidence").distinct()


def nearest(visited: DataFrame) -> DataFrame:
    """One row for each node, at its least hop."""
    return visited.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("hop"))).where("_n = 1").drop("_n")


def risk(hop: Column) -> Column:
    """How near a change is: CRITICAL, HIGH, MEDIUM, LOW for 1, 2, 3 and more hops."""
    return F.when(hop == 1, "CRITICAL").when(hop == 2, "HIGH").when(hop == 3, "MEDIUM").otherwise("LOW")


def confident(edges: DataFrame, least: float) -> DataFrame:
    """Edges without a confidence, or with at least this one."""
    return edges.where((F.col("confidence") == 0) | (F.col("confidence") >= least))


def trace(graph: Graph, starts: DataFrame, direction: str = "both", depth: int = 3, types: tuple[str, ...] = CALL_TYPES) -> DataFrame:
    """Callees and callers of the starts: direction, hop, risk and the node; depth is
    held between 1 and 5."""
    depth = max(1, min(5, depth))
    sides = [("outbound", "out"), ("inbound", "in")] if direction == "both" else [(direction, "out" if direction == "outbound" else "in")]
    out = None
    for name, way in sides:
        rows = bfs(graph, starts, types, way, depth).withColumns({"direction": F.lit(name), "risk": risk(F.col("hop"))})
        out = rows if out is None else out.unionByName(rows)
    return out


def impact(graph: Graph, changed: DataFrame, depth: int = 3, types: tuple[str, ...] = CALL_TYPES) -> DataFrame:
    """Nodes that reach a changed one (column id): the columns of nodes, hop, risk and
    changed_by, the changed node of the least hop, then least qualified name. Changed
    nodes themselves are left out."""
    hops = reach(graph.edges, changed.select(F.col("id").alias("origin")), types, "in", depth)
    names = graph.nodes.select(F.col("id").alias("origin"), F.col("qualified_name").alias("changed_by"))
    best = hops.join(names, "origin").join(changed.select(F.col("id").alias("node")), "node", "left_anti").groupBy("node").agg(F.min(F.struct("hop", "changed_by")).alias("b"))
    rows = graph.nodes.join(best, F.col("id") == F.col("node")).select(graph.nodes["*"], F.col("b.hop").alias("hop"), F.col("b.changed_by").alias("changed_by"))
    return rows.withColumn("risk", risk(F.col("hop")))


def impact_summary(impacted: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes of each risk, all, and whether a call between services is touched."""
    crossing = edges.where(F.col("type").isin("HTTP_CALLS", "ASYNC_CALLS")).select(F.col("source_id").alias("id")).union(edges.where(F.col("type").isin("HTTP_CALLS", "ASYNC_CALLS")).select(F.col("target_id").alias("id"))).distinct().withColumn("crosses", F.lit(True))
    one = impacted.join(crossing, "id", "left")
    counts = {r.lower(): F.count_if(F.col("risk") == r) for r in ("CRITICAL", "HIGH", "MEDIUM", "LOW")}
    return one.agg(*(c.alias(n) for n, c in counts.items()), F.count(F.lit(1)).alias("total"), F.coalesce(F.bool_or("crosses"), F.lit(False)).alias("cross_service"))
