"""Writes without unique constraints: last write wins, properties merge, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..model import EDGE_SCHEMA, NODE_SCHEMA, Graph


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one of the largest `order`; summed up before the
    shuffle, so a key written very often is no heavy group."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*rows.columns)


def upsert_nodes(nodes: DataFrame, writes: DataFrame, order: str = "seq") -> DataFrame:
    """Nodes after writes (node columns and `order`), by project and qualified name. A
    write replaces every column but null properties, which leave the old ones."""
    old = nodes.withColumn(order, F.lit(-1).cast("long"))
    both = old.unionByName(writes.select(*old.columns))
    kept = both.groupBy("project", "qualified_name").agg(
        F.max_by(F.struct(*(c for c in NODE_SCHEMA.names if c not in ("project", "qualified_name", "properties"))), F.col(order)).alias("_r"),
        F.max_by("properties", F.when(F.col("properties").isNotNull(), F.col(order))).alias("properties"),
    )
    return kept.select("project", "qualified_name", "_r.*", "properties").select(*NODE_SCHEMA.names)


def merge_json(rows: DataFrame, keys: list[str], json: str, order: str) -> DataFrame:
    """(keys, json): objects of equal keys merged; of each member the last value that is
    not null stays, as it was written. Members come in order of their names."""
    raw = F.from_json(json, "map<string,variant>")
    members = rows.select(*keys, order, F.explode_outer(raw).alias("_k", "_v")).withColumn("_v", F.to_json("_v"))
    last = members.groupBy(*keys, "_k").agg(F.max_by("_v", F.when(F.col("_v").isNotNull() & (F.col("_v") != "null"), F.col(order))).alias("_v"))
    member = F.when(F.col("_k").isNotNull() & F.col("_v").isNotNull(), F.concat(F.lit('"'), F.regexp_replace("_k", r'(["\\])', r"\\$1"), F.lit('":'), F.col("_v")))
    return last.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(member)), ","), F.lit("}")).alias(json))


def upsert_edges(edges: DataFrame, writes: DataFrame, order: str = "seq") -> DataFrame:
    """Edges after writes (edge columns and `order`), one for each source, target and
    type; properties of writes merge into the old ones."""
    old = edges.withColumn(order, F.lit(-1).cast("long"))
    both = old.unionByName(writes.select(*old.columns))
    keys = ["source_id", "target_id", "type"]
    first = both.groupBy(*keys).agg(F.min_by(F.struct("id", "project"), F.col(order)).alias("_r"))
    return first.join(merge_json(both, keys, "properties", order), keys).select("_r.id", "_r.project", *keys, "properties").select(*EDGE_SCHEMA.names)


def live(graph: Graph) -> Graph:
    """Without edges whose ends are gone."""
    ids = graph.nodes.select("id")
    edges = graph.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return Graph(graph.nodes, edges.select(*graph.edges.columns))


def delete_nodes(graph: Graph, gone: Column) -> Graph:
    """Without the nodes of a condition, and without their edges."""
    return live(Graph(graph.nodes.where(~F.coalesce(gone, F.lit(False))), graph.edges))


def delete_project(graph: Graph, project: str) -> Graph:
    return Graph(graph.nodes.where(F.col("project") != project), graph.edges.where(F.col("project") != project))


def delete_edges_from_file(graph: Graph, path: str, types: tuple[str, ...] = ()) -> Graph:
    """Without edges (of the types) that leave a node of the file."""
    sources = graph.nodes.where(F.col("file_path") == path).select(F.col("id").alias("source_id"))
    hit = graph.edges.join(sources, "source_id", "left_semi").where(F.col("type").isin(*types) if types else F.lit(True)).select("id")
    return Graph(graph.nodes, graph.edges.join(hit, "id", "left_anti"))


def delete_edges_by_type(graph: Graph, *types: str) -> Graph:
    return Graph(graph.nodes, graph.edges.where(~F.col("type").isin(*types)))
