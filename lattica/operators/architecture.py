"""Roll-ups of a graph: schema statistics, hotspots, boundaries, layers, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import is_test_path, language_of, package_of, top_package_of
from ..model import Graph, json_property

CALLS = ("CALLS",)
SERVICE_TYPES = ("HTTP_CALLS", "ASYNC_CALLS")


def _flag(name: str) -> Column:
    return F.coalesce(json_property(F.col("properties"), name), F.lit("false")) == "true"


#: Joins of edges with so many nodes at most are left to Spark.
FEW_NODES = 500_000


def _with_ends(nodes: DataFrame, edges: DataFrame, value: Column, name: str) -> DataFrame:
    """(source_id, target_id, type, source_<name>, target_<name>): edges with a value of the
    nodes at both ends. Where nodes are many, a task holds its share of them in a hash table
    and passes its edges by: those, several times as many, are neither sorted nor held."""
    many = nodes.count() > FEW_NODES
    ends = (nodes.select(F.col("id").alias(f"{side}_id"), value.alias(f"{side}_{name}")) for side in ("source", "target"))
    src, dst = (rows.hint("shuffle_hash") if many else rows for rows in ends)
    return edges.select("source_id", "target_id", "type").join(src, "source_id").join(dst, "target_id")


def label_counts(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("label").count().orderBy(F.desc("count"), "label")


def type_counts(graph: Graph) -> DataFrame:
    return graph.edges.groupBy("type").count().orderBy(F.desc("count"), "type")


def patterns(graph: Graph, limit: int | None = 25) -> DataFrame:
    """(source_label, type, target_label, count, pattern), most frequent first."""
    rows = _with_ends(graph.nodes, graph.edges, F.col("label"), "label").groupBy("source_label", "type", "target_label").count()
    rows = rows.withColumn("pattern", F.format_string("(:%s)-[:%s]->(:%s) [%dx]", "source_label", "type", "target_label", "count")).orderBy(F.desc("count"), "source_label", "type", "target_label")
    return rows.limit(limit) if limit else rows


def languages(graph: Graph, limit: int = 10, label: str | None = "File") -> DataFrame:
    """Files by language; files of unknown languages don't count."""
    rows = graph.labelled(label) if label else graph.nodes
    files = rows.select("file_path").where("file_path is not null and file_path <> ''").distinct()
    return files.select(language_of("file_path").alias("language")).where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "language").limit(limit)


def packages(graph: Graph, limit: int = 15, types: tuple[str, ...] = CALLS, labels: tuple[str, ...] = ("Function", "Method", "Class")) -> DataFrame:
    """(package, nodes, fan_in, fan_out): nodes of the labels by package, and edges
    that come from and go to other packages."""
    named = graph.nodes.where(F.col("label").isin(*labels)).select("id", package_of("qualified_name").alias("package")).where("package <> ''")
    sizes = named.groupBy("package").agg(F.count(F.lit(1)).alias("nodes"))
    cross = boundaries(graph, None, types)
    into = cross.groupBy(F.col("to_package").alias("package")).agg(F.sum("calls").alias("fan_in"))
    out = cross.groupBy(F.col("from_package").alias("package")).agg(F.sum("calls").alias("fan_out"))
    zero = F.lit(0).cast("long")
    rows = sizes.join(into, "package", "left").join(out, "package", "left").select("package", "nodes", F.coalesce("fan_in", zero).alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"))
    return rows.orderBy(F.desc("nodes"), "package").limit(limit)


def hotspots(graph: Graph, limit: int = 10, types: tuple[str, ...] = CALLS, labels: tuple[str, ...] = ("Function", "Method")) -> DataFrame:
    """Nodes with the most incoming edges, tests left out."""
    fan_in = graph.typed(*types).groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    rows = graph.nodes.where(F.col("label").isin(*labels) & ~F.coalesce(is_test_path("file_path") | _flag("is_test"), F.lit(False)))
    return rows.join(fan_in, "id").select("id", "name", "qualified_name", "fan_in").orderBy(F.desc("fan_in"), "qualified_name", "id").limit(limit)


def _rolled(graph: Graph, types: tuple[str, ...], package) -> DataFrame:
    rows = _with_ends(graph.nodes, graph.typed(*types), package("qualified_name"), "package").withColumnsRenamed({"source_package": "from_package", "target_package": "to_package"})
    return rows.where("from_package <> '' and to_package <> ''")


def boundaries(graph: Graph, limit: int | None = 10, types: tuple[str, ...] = CALLS) -> DataFrame:
    """Calls between different packages."""
    rows = _rolled(graph, types, package_of).where("from_package <> to_package").groupBy("from_package", "to_package").agg(F.count(F.lit(1)).alias("calls"))
    return rows.orderBy(F.desc("calls"), "from_package", "to_package").limit(limit) if limit else rows


def services(graph: Graph, limit: int = 10, types: tuple[str, ...] = SERVICE_TYPES) -> DataFrame:
    """Calls between top packages by type; a package's own calls count too."""
    rows = _rolled(graph, types, top_package_of).groupBy("from_package", "to_package", "type").agg(F.count(F.lit(1)).alias("calls"))
    return rows.orderBy(F.desc("calls"), "from_package", "to_package", "type").limit(limit)


def layers(graph: Graph, types: tuple[str, ...] = CALLS) -> DataFrame:
    """(package, layer, fan_in, fan_out, routes, entry): from all boundaries.

    The first that fits: entry has entry points and only calls others; api has routes;
    core is called more often than it calls, and more than three times; leaf is only
    called; entry only calls; internal is the rest.
    """
    cross = boundaries(graph, None, types)
    ends = cross.select(F.explode(F.array(F.struct(F.col("to_package").alias("package"), F.col("calls").alias("i"), F.lit(0).cast("long").alias("o")), F.struct(F.col("from_package").alias("package"), F.lit(0).cast("long").alias("i"), F.col("calls").alias("o")))).alias("e"))
    flow = ends.groupBy("e.package").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    marks = graph.nodes.select(package_of("qualified_name").alias("package"), "label", _flag("is_entry_point").alias("entry")).where("package <> ''").groupBy("package").agg(F.count_if(F.col("label") == "Route").alias("routes"), F.bool_or("entry").alias("entry"))
    rows = flow.join(marks.where("routes > 0 or entry"), "package", "full").select("package", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("fan_in", "fan_out", "routes")), F.coalesce("entry", F.lit(False)).alias("entry"))
    i, o = F.col("fan_in"), F.col("fan_out")
    calls_only = (i == 0) & (o > 0)
    layer = F.when(F.col("entry") & calls_only, "entry").when(F.col("routes") > 0, "api").when((i > o) & (i > 3), "core").when((o == 0) & (i > 0), "leaf").when(calls_only, "entry").otherwise("internal")
    return rows.withColumn("layer", layer)


def file_tree(graph: Graph, depth: int = 3, label: str | None = "File") -> DataFrame:
    """(path, kind, children): directories down to `depth` with their distinct children."""
    rows = graph.labelled(label) if label else graph.nodes
    files = rows.where("file_path is not null and file_path <> ''").select(F.split("file_path", "/").alias("p")).distinct()
    n = F.size("p")
    links = files.select(F.explode(F.transform(F.sequence(F.lit(0), F.least(n, F.lit(depth)) - 1), lambda i: F.struct(F.array_join(F.slice("p", 1, i), "/").alias("parent"), F.array_join(F.slice("p", 1, i + 1), "/").alias("path"), F.when(i + 1 == n, "file").otherwise("dir").alias("kind")))).alias("l")).select("l.*").distinct()
    children = links.groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("children"))
    return links.select("path", "kind").distinct().join(children, "path", "left").select("path", "kind", F.coalesce("children", F.lit(0).cast("long")).alias("children"))


def entry_points(graph: Graph, limit: int = 20) -> DataFrame:
    return graph.nodes.where(_flag("is_entry_point") & ~F.coalesce(is_test_path("file_path"), F.lit(False))).select("name", "qualified_name", "file_path").orderBy("qualified_name").limit(limit)


def routes(graph: Graph, limit: int = 20) -> DataFrame:
    """Route nodes with method, path and the handler that HANDLES names."""
    rows = graph.labelled("Route").select("id", "name", json_property(F.col("properties"), "method").alias("method"), json_property(F.col("properties"), "path").alias("path"))
    handled = graph.typed("HANDLES").groupBy(F.col("target_id").alias("id")).agg(F.min("source_id").alias("handler_id"))
    names = graph.nodes.select(F.col("id").alias("handler_id"), F.col("name").alias("handler"))
    return rows.join(handled, "id", "left").join(names, "handler_id", "left").select("method", "path", "handler").orderBy("path", "method").limit(limit)


def documents(graph: Graph) -> DataFrame:
    """Files that describe the architecture, by their names."""
    return graph.nodes.where(F.lower("file_path").rlike(r"(^|/)(architecture|adr|design|readme)[^/]*\.md$|(^|/)(docs?/)?(adr|architecture|decisions)/[^/]+\.md$")).select("file_path").distinct().orderBy("file_path")


def calls_by_strategy(graph: Graph) -> DataFrame:
    """(strategy, calls, percent): how CALLS edges were resolved."""
    rows = graph.typed("CALLS").groupBy(F.coalesce(json_property(F.col("properties"), "resolution_strategy"), F.lit("unset")).alias("strategy")).agg(F.count(F.lit(1)).alias("calls"))
    total = rows.groupBy().agg(F.sum("calls").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("strategy", "calls", F.round(100 * F.col("calls") / F.col("total"), 1).alias("percent"))  # one row
