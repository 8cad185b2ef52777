"""Communities by the Louvain method, and what they hold.

Local moving is bulk-synchronous: in a round every node weighs the communities of its
neighbours by the volumes of the round before, and of those that would move a half, drawn by
hash, does, so that neighbours don't swap places for ever. When no node would move,
communities become nodes, and again. Each round is a join, two sums and a written table;
nothing of a project is in one place. Draws depend on ids alone, so results repeat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.names import package_of
from ..model import Graph
from ..storage import cutter

TYPES = ("CALLS", "HTTP_CALLS", "ASYNC_CALLS")
LABEL_PRIORITY = ("Class", "Interface", "Type", "Function", "Method")


#: Levels of communities of communities.
LEVELS = 8


def _dealt(rows: DataFrame) -> DataFrame:
    """A table as large as the graph, to be joined by a shuffle: the files of such tables are
    small, and Spark would judge by them and send the rows through the driver."""
    return rows.hint("merge")


def _moved(links: DataFrame, state: DataFrame, turn: int) -> DataFrame:
    """The state (project, id, community, degree, total, wants, moved) after one round."""
    volume = state.groupBy("community").agg(F.sum("degree").alias("volume"))
    near = links.join(_dealt(state.select(F.col("id").alias("b"), "community")), "b").groupBy(F.col("a").alias("id"), "community").agg(F.sum("w").alias("w"))
    own = state.select("id", F.col("community").alias("own"), "degree", "total")
    mine = F.col("community") == F.col("own")
    gain = F.col("w") - F.col("degree") * (F.col("volume") - F.when(mine, F.col("degree")).otherwise(0.0)) / F.col("total")
    weighed = near.join(_dealt(own), "id").join(volume, "community").withColumn("gain", gain)
    best = weighed.groupBy("id").agg(F.max(F.when(~mine, F.struct("gain", (-F.col("community")).alias("to")))).alias("best"), F.max(F.when(mine, F.col("gain"))).alias("stay"))
    # A node without a neighbour in its own community still weighs the others there.
    rows = state.join(_dealt(best), "id", "left").join(volume, "community")
    stay = F.coalesce("stay", -F.col("degree") * (F.col("volume") - F.col("degree")) / F.col("total"))
    wants = F.coalesce(F.col("best.gain") > stay + 1e-9, F.lit(False))
    drawn = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0
    rows = rows.withColumns({"wants": wants, "moved": F.col("moved") | (wants & drawn)})
    return rows.select("project", "id", F.when(F.col("wants") & drawn, -F.col("best.to")).otherwise(F.col("community")).alias("community"), "degree", "total", "wants", "moved")


def louvain(graph: Graph, types: tuple[str, ...] = TYPES, labels: tuple[str, ...] | None = ("Function", "Method"), rounds: int = 10, drop_singletons: bool = False, cut: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """(project, id, community): community is its least node's id. Nodes without an
    edge of the types are not in any. A level has `rounds` rounds at most, twice over, as a
    half of the nodes moves in each. Fifty rounds over CALLS alone with singletons dropped
    is the form that index runs use. `cut` writes a table and gives it back."""
    cut = cut or cutter(graph.nodes.sparkSession, "louvain")
    edges = graph.typed(*types).select("project", "source_id", "target_id")
    if labels:
        keep = graph.nodes.where(F.col("label").isin(*labels)).select("id")
        edges = edges.join(keep.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(keep.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    pairs = cut("pairs", edges.groupBy("project", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("w")))
    member = None
    for level in range(LEVELS):
        links = cut("links", pairs.where("a <> b").select("a", "b", "w").unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
        each = pairs.select("project", F.explode(F.array("a", "b")).alias("id"), "w")  # a loop counts twice
        degree = each.groupBy("project", "id").agg(F.sum("w").alias("degree"))
        total = each.groupBy("project").agg(F.sum("w").alias("total"))
        state = degree.join(total, "project").select("project", "id", F.col("id").alias("community"), "degree", "total", F.lit(True).alias("wants"), F.lit(False).alias("moved"))
        state = cut("state", state)
        for turn in range(2 * rounds):
            state = cut("state", _moved(links, state, turn))
            if not state.agg(F.coalesce(F.max("wants"), F.lit(False))).first()[0]:
                break
        now = state.select("project", "id", "community")
        member = now if member is None else member.withColumnRenamed("community", "_at").join(_dealt(now.select(F.col("id").alias("_at"), "community")), "_at").select("project", "id", "community")
        if not state.agg(F.coalesce(F.max("moved"), F.lit(False))).first()[0]:
            break
        member = cut("member", member)
        at = lambda name: _dealt(now.select(F.col("id").alias(name), F.col("community").alias(f"_{name}")))
        ends = {"a": F.least("_a", "_b"), "b": F.greatest("_a", "_b")}
        pairs = cut("pairs", pairs.join(at("a"), "a").join(at("b"), "b").withColumns(ends).groupBy("project", "a", "b").agg(F.sum("w").alias("w")))
    sizes = member.groupBy("community").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
    out = member.join(sizes, "community")
    return (out.where("size > 1") if drop_singletons else out).select("project", "id", F.col("least").alias("community"))


def modularity(graph: Graph, members: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """(project, modularity) of communities (project, id, community) over the edges among
    their members."""
    m = members.select("id", "community")
    edges = graph.typed(*types).select("project", "source_id", "target_id").join(m.select(F.col("id").alias("source_id"), F.col("community").alias("ca")), "source_id").join(m.select(F.col("id").alias("target_id"), F.col("community").alias("cb")), "target_id")
    total = edges.groupBy("project").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("ca") == F.col("cb")).alias("inside"))
    volume = edges.select("project", F.explode(F.array("ca", "cb")).alias("c")).groupBy("project", "c").agg(F.count(F.lit(1)).alias("d"))
    squares = volume.groupBy("project").agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("s"))
    return total.join(squares, "project").select("project", (F.col("inside") / F.col("m") - F.col("s") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"))


def cluster_summary(graph: Graph, members: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """(community, members, cohesion, top, packages, name): cohesion is the share of
    touching edges that stay inside, top the five names of the largest fan-in, name
    the package of most members."""
    m = members.select("id", "community")
    a, b = (_dealt(m.select(F.col("id").alias(end), F.col("community").alias(c))) for end, c in (("source_id", "ca"), ("target_id", "cb")))
    edges = graph.typed(*types).select("source_id", "target_id").join(a, "source_id", "left").join(b, "target_id", "left")
    touching = edges.select(F.explode(F.array_distinct(F.filter(F.array("ca", "cb"), lambda c: c.isNotNull()))).alias("community"), (F.col("ca") == F.col("cb")).alias("inside"))
    cohesion = touching.groupBy("community").agg((F.count_if("inside") / F.count(F.lit(1))).alias("cohesion"))
    fan = edges.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    named = _dealt(m).join(graph.nodes.select("id", "name", "qualified_name", package_of("qualified_name").alias("package")), "id").join(fan, "id", "left").fillna(0, ["fan_in"])
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("fan_in"), "qualified_name"))
    top = named.withColumn("k", rank).where("k <= 5").groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("top"))
    sizes = named.groupBy("community", "package").count()
    packages = sizes.groupBy("community").agg(F.sum("count").alias("members"), F.array_sort(F.collect_set("package")).alias("packages"), F.max(F.struct("count", "package"))["package"].alias("name"))
    return packages.join(cohesion, "community", "left").join(top, "community")


def community_graph(graph: Graph, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Community nodes (symbol_count, the five names that come first by label, then
    name) and MEMBER_OF edges, both in the graph's own columns."""
    order = F.coalesce(F.array_position(F.array(*(F.lit(x) for x in LABEL_PRIORITY)), F.col("label")), F.lit(0))
    named = members.join(graph.nodes.select("id", "name", "label"), "id").withColumn("p", F.when(order == 0, 99).otherwise(order))
    rank = F.row_number().over(Window.partitionBy("community").orderBy("p", "name", "id"))
    top = named.withColumn("k", rank).where("k <= 5").groupBy("project", "community").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("top_symbols"))
    rows = named.groupBy("project", "community").agg(F.count(F.lit(1)).alias("symbol_count")).join(top, ["project", "community"])
    qn = F.concat(F.col("project"), F.lit(".__community__."), F.col("community").cast("string"))
    node_id = F.xxhash64("project", qn)
    nodes = rows.select(node_id.alias("id"), "project", F.lit("Community").alias("label"), F.concat(F.lit("community-"), F.col("community").cast("string")).alias("name"), qn.alias("qualified_name"), F.lit("").alias("file_path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.to_json(F.struct("symbol_count", "top_symbols")).alias("properties"))
    edges = members.select(F.xxhash64(F.lit("MEMBER_OF"), "id", node_id).alias("id"), "project", F.col("id").alias("source_id"), node_id.alias("target_id"), F.lit("MEMBER_OF").alias("type"), F.lit("{}").alias("properties"))
    return nodes, edges
