"""Parameterised node search with degrees, relevance and exact pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import glob_to_like, is_test_path
from ..model import Graph, json_property

HIDDEN_LABELS = ("Community",)


def degrees(edges: DataFrame, types: tuple[str, ...] = ()) -> DataFrame:
    """(id, in_degree, out_degree) of nodes that have edges; one shuffle of both ends,
    summed before it."""
    rows = edges.where(F.col("type").isin(*types)) if types else edges
    ends = rows.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def with_degrees(graph: Graph, nodes: DataFrame, types: tuple[str, ...] = ()) -> DataFrame:
    """Nodes with in_degree and out_degree. Edges with no end between the least and the
    largest of their ids are dropped before they are built and counted, which spares most
    of them where a label's ids lie together."""
    zero = F.lit(0).cast("long")
    low, high = nodes.agg(F.min("id"), F.max("id")).first()
    near = lambda c: F.col(c).between(F.lit(low).cast("long"), F.lit(high).cast("long"))
    counted = degrees(graph.edges.where(near("source_id") | near("target_id")), types).where(near("id"))
    return nodes.join(counted, "id", "left").withColumns({c: F.coalesce(c, zero) for c in ("in_degree", "out_degree")})


def search(
    graph: Graph,
    label: str | None = None,
    name_pattern: str | None = None,
    qn_pattern: str | None = None,
    file_pattern: str | None = None,
    exclude_labels: tuple[str, ...] = HIDDEN_LABELS,
    relationship: str | None = None,
    direction: str = "any",
    min_degree: int | None = None,
    max_degree: int | None = None,
    exclude_entry_points: bool = False,
    case_sensitive: bool = False,
) -> DataFrame:
    """Nodes that pass all given filters, with in_degree and out_degree.

    Patterns are regular expressions that may match anywhere; file_pattern is a glob.
    `relationship` limits which edges count; `direction` is any (in and out),
    inbound or outbound."""
    rows = graph.nodes
    if label:
        rows = rows.where(F.col("label") == label)
    if exclude_labels:
        rows = rows.where(~F.col("label").isin(*exclude_labels))
    if file_pattern:
        rows = rows.where(F.col("file_path").ilike(glob_to_like(file_pattern)))
    for column, pattern in (("name", name_pattern), ("qualified_name", qn_pattern)):
        if pattern:
            rows = rows.where(F.col(column).rlike(pattern if case_sensitive else f"(?i){pattern}"))
    if exclude_entry_points:
        rows = rows.where(F.coalesce(json_property(F.col("properties"), "is_entry_point"), F.lit("false")) != "true")
    rows = with_degrees(graph, rows, (relationship,) if relationship else ())
    degree = {"inbound": F.col("in_degree"), "outbound": F.col("out_degree"), "any": F.col("in_degree") + F.col("out_degree")}[direction]
    if min_degree is not None:
        rows = rows.where(degree >= min_degree)
    if max_degree is not None:
        rows = rows.where(degree <= max_degree)
    return rows


def dead_code(graph: Graph, labels: tuple[str, ...] = ("Function", "Method"), types: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    """Nodes that nothing points to and that are neither entry points nor tests."""
    called = graph.typed(*types).select(F.col("target_id").alias("id")).distinct()
    rows = graph.nodes.where(F.col("label").isin(*labels) & ~F.coalesce(is_test_path("file_path"), F.lit(False)))
    entry = F.coalesce(json_property(F.col("properties"), "is_entry_point"), F.lit("false")) == "true"
    return rows.where(~entry).join(called, "id", "left_anti")


def literal_of(pattern: str) -> str:
    """The text that a name pattern is after: without anchors and wildcards."""
    return re.sub(r"\.\*|[\^$()?+*\\]", "", pattern or "").lower()


def relevance(pattern: str | None) -> list[Column]:
    """Exact names first, then prefixes, then by total degree, then by name."""
    text, low = literal_of(pattern or ""), F.lower("name")
    ties = [(F.col("in_degree") + F.col("out_degree")).desc(), F.col("qualified_name"), F.col("id")]
    return [(low == text).desc(), low.startswith(text).desc(), *ties] if text else ties


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 10) -> DataFrame:
    """One page with a column total, the number of all rows. Rows are ordered by a
    bounded top-k; the total is a sum that rides along."""
    total = rows.groupBy().agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).limit(offset + limit).offset(offset).crossJoin(F.broadcast(total))  # one row


def connected_names(graph: Graph, nodes: DataFrame, types: tuple[str, ...] = (), most: int = 10) -> DataFrame:
    """(id, names): of each node the least `most` names of neighbours on either side."""
    edges = graph.typed(*types)
    ends = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).union(edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("other")))
    ends = ends.join(nodes.select("id").distinct(), "id", "left_semi").distinct()
    named = ends.join(graph.nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other").select("id", "other_name").distinct()
    first = named.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("other_name"))).where(F.col("n") <= most)
    return first.groupBy("id").agg(F.array_sort(F.collect_list("other_name")).alias("names"))


def neighbour_names(graph: Graph, node_id: int, direction: str = "outbound", types: tuple[str, ...] = ("CALLS",), limit: int = 10) -> DataFrame:
    """Distinct names of callees or callers of one node, in order."""
    near, far = ("source_id", "target_id") if direction == "outbound" else ("target_id", "source_id")
    ends = graph.typed(*types).where(F.col(near) == node_id).select(F.col(far).alias("id"))
    return graph.nodes.join(ends, "id", "left_semi").select("name").distinct().orderBy("name").limit(limit)


def edges_by_url(edges: DataFrame, part: str) -> DataFrame:
    """Edges whose url_path property contains a text."""
    return edges.where(json_property(F.col("properties"), "url_path").contains(part))
