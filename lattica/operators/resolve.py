"""Resolution of names to definitions: a ladder of equi-joins on a registry.

Every step joins on a key (an exact qualified name, or a simple name) and offers
candidates with a tier; one aggregation picks, for each reference, the best tier,
then the longest prefix in common with the caller's module, then the least name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import simple_name
from ..model import Graph

REGISTRY_LABELS = ("Function", "Method", "Class", "Interface", "Enum", "Type", "Macro", "Variable")
#: Confidence by strategy.
CONFIDENCE = {"import_map": 0.95, "import_map_suffix": 0.85, "same_module": 0.90, "unique_name": 0.75, "suffix_match": 0.55}
LEAST = 0.10
#: Candidates beyond so many lower the confidence in proportion.
FREE_CANDIDATES = 3
#: A name of more candidates than this can't reach LEAST but by what is imported.
MOST_CANDIDATES = int(FREE_CANDIDATES * CONFIDENCE["suffix_match"] / LEAST)


def registry(graph: Graph) -> DataFrame:
    """(project, qualified_name, name, label) of what references can mean."""
    rows = graph.nodes.where(F.col("label").isin(*REGISTRY_LABELS))
    return rows.select("project", "qualified_name", simple_name("qualified_name").alias("name"), "label").distinct()


def count_penalty(n: Column) -> Column:
    return F.when(n <= FREE_CANDIDATES, F.lit(1.0)).otherwise(F.lit(float(FREE_CANDIDATES)) / n)


def common_parts(a: Column, b: Column) -> Column:
    """How many leading parts two dotted names share."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def reachable(qn: Column, imports: Column) -> Column:
    """Whether a name lies under an import, or an import under it; null imports reach
    everything, an empty list nothing."""
    return imports.isNull() | F.exists(imports, lambda m: (qn == m) | qn.startswith(F.concat(m, F.lit("."))) | m.startswith(F.concat(qn, F.lit("."))))


def resolve(refs: DataFrame, known: DataFrame, fuzzy: bool | str = True) -> DataFrame:
    """`refs` (ref_id, project, callee, module_qn, imports map<string,string>) with
    target_qn, strategy, confidence and candidates; unresolved ones are left out.

    `imports` maps local names to qualified names; null means unknown. A reference meets
    the definitions of its short name only where those are few enough to count; of
    others it meets those below what it imports, by the imported name. Without `fuzzy`,
    or where the column of this name is false, a short name alone isn't enough.
    """
    r = refs.select(
        "ref_id", "project", "callee", "module_qn", F.map_values("imports").alias("reach"),
        F.substring_index("callee", ".", 1).alias("head"),
        F.when(F.contains("callee", F.lit(".")), F.regexp_replace("callee", r"^[^.]*\.", "")).otherwise("").alias("rest"),
        F.try_element_at("imports", F.substring_index("callee", ".", 1)).alias("imported"),
        (F.lit(fuzzy) if isinstance(fuzzy, bool) else F.col(fuzzy)).alias("loose"),
    )
    names = known.select("project", F.col("qualified_name").alias("qn"), "name").distinct()
    exact = F.array_compact(
        F.array(
            F.when(F.col("imported").isNotNull(), F.struct(F.lit(1).alias("tier"), F.when(F.col("rest") != "", F.concat_ws(".", "imported", "rest")).otherwise(F.col("imported")).alias("qn"))),
            F.struct(F.lit(3).alias("tier"), F.concat_ws(".", "module_qn", "callee").alias("qn")),
            F.when(F.col("rest") != "", F.struct(F.lit(4).alias("tier"), F.concat_ws(".", "module_qn", "rest").alias("qn"))),
        )
    )
    direct = r.select("ref_id", "project", F.explode(exact).alias("e")).select("ref_id", "project", "e.tier", "e.qn").join(names.select("project", "qn"), ["project", "qn"]).select("ref_id", "qn", "tier", F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("weight"), F.lit(0).alias("prefix"))
    sizes = names.groupBy("project", "name").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.when(F.col("rest") != "", F.col("rest")).otherwise(F.col("callee"))
    short, sized = r.withColumn("name", simple_name(wanted)), names.join(sizes, ["project", "name"])
    parts = F.split("qn", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    many = sized.where((F.col("n") > MOST_CANDIDATES) & F.contains("qn", F.lit("."))).withColumn("imported", F.explode(above))
    below = short.where(F.col("imported").isNotNull() & (F.col("rest") != "")).join(many, ["project", "name", "imported"])
    named = short.join(sized.where(F.col("n") <= MOST_CANDIDATES), ["project", "name"])
    named = named.unionByName(below.select(*named.columns))
    seen = reachable(F.col("qn"), F.col("reach"))
    whole, tail = F.col("qn").endswith(F.concat(F.lit("."), "callee")), F.col("qn").endswith(F.concat(F.lit("."), wanted))
    tier = (
        F.when(F.col("imported").isNotNull() & (F.col("rest") != "") & F.col("qn").startswith(F.concat("imported", F.lit("."))) & tail, 2)
        .when(F.col("n") == 1, 5).when((F.col("rest") != "") & whole, 6).when((F.col("rest") != "") & tail & seen, 7).when(seen, 8).otherwise(9)
    )
    weight = F.when(F.col("reach").isNotNull() & ~seen & (tier != 2), 0.5).otherwise(1.0)
    by_name = named.select("ref_id", "qn", tier.alias("tier"), "n", weight.alias("weight"), common_parts(F.col("qn"), F.col("module_qn")).alias("prefix"), "loose").where("tier <= 7 or loose").drop("loose")
    best = direct.unionByName(by_name).groupBy("ref_id").agg(F.min(F.struct("tier", (-F.col("prefix")).alias("far"), "qn", "n", "weight")).alias("b"))
    strategy = F.when(F.col("b.tier") == 1, "import_map").when(F.col("b.tier") == 2, "import_map_suffix").when(F.col("b.tier") <= 4, "same_module").when(F.col("b.tier") == 5, "unique_name").otherwise("suffix_match")
    base = F.when(F.col("b.tier") == 1, CONFIDENCE["import_map"]).when(F.col("b.tier") == 2, CONFIDENCE["import_map_suffix"]).when(F.col("b.tier") <= 4, CONFIDENCE["same_module"]).when(F.col("b.tier") == 5, CONFIDENCE["unique_name"]).otherwise(CONFIDENCE["suffix_match"])
    penalty = F.when(F.col("b.tier") >= 6, count_penalty(F.col("b.n"))).otherwise(1.0)
    out = best.select("ref_id", F.col("b.qn").alias("target_qn"), strategy.alias("strategy"), (base * F.col("b.weight") * penalty).alias("confidence"), F.col("b.n").alias("candidates"))
    return out.where(F.col("confidence") >= LEAST)


def fuzzy_resolve(refs: DataFrame, known: DataFrame) -> DataFrame:
    """By the simple name alone: 0.40 for one candidate (or one within reach), 0.30 for
    the nearest of several; half of it where none is within reach.

    A name may have very many definitions, so no reference meets them all. Of the
    definitions of a name below each prefix their number and the least are kept; a module
    looks up its own prefixes, of which the longest that is there has the nearest ones, and
    an import looks up itself and the module's prefixes below it. Of imports that lie below
    one another the uppermost counts.
    """
    names = known.select("project", F.col("qualified_name").alias("qn"), "name").distinct()
    sizes = names.groupBy("project", "name").agg(F.count(F.lit(1)).alias("n"), F.min("qn").alias("least"))
    r = refs.select("ref_id", "project", "module_qn", F.map_values("imports").alias("reach"), simple_name("callee").alias("name")).join(sizes, ["project", "name"])
    heads = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, r"\."))), lambda i: F.array_join(F.slice(F.split(c, r"\."), 1, i), "."))
    below = names.select("project", "name", "qn", F.explode(heads("qn")).alias("prefix")).groupBy("project", "name", "prefix").agg(F.count(F.lit(1)).alias("here"), F.min("qn").alias("qn"))
    closest = lambda qn: F.min(F.struct((-common_parts(qn, F.col("module_qn"))).alias("far"), qn.alias("qn")))["qn"]
    near = r.select("ref_id", "project", "name", "module_qn", F.explode(heads("module_qn")).alias("prefix")).join(below, ["project", "name", "prefix"]).groupBy("ref_id").agg(closest(F.col("qn")).alias("near"))
    under = lambda a, b: a.startswith(F.concat(b, F.lit(".")))
    top = F.filter(F.array_distinct("reach"), lambda m: ~F.exists("reach", lambda o: under(m, o)))
    asked = r.where("reach is not null").select("ref_id", "project", "name", "module_qn", F.explode(top).alias("import"))
    inside = asked.withColumn("prefix", F.explode(F.array_union(F.array("import"), F.filter(heads("module_qn"), lambda p: under(p, F.col("import")))))).join(below, ["project", "name", "prefix"])
    inside = inside.select("ref_id", "module_qn", "qn", F.when(F.col("prefix") == F.col("import"), F.col("here")).otherwise(0).alias("here"))
    above = asked.withColumn("qn", F.explode(heads("import"))).where("qn <> import").select("ref_id", "project", "name", "module_qn", "qn").distinct().join(names, ["project", "name", "qn"]).select("ref_id", "module_qn", "qn", F.lit(1).cast("long").alias("here"))
    seen = inside.unionByName(above).groupBy("ref_id").agg(F.sum("here").alias("within"), closest(F.col("qn")).alias("reached"))
    rows = r.join(seen, "ref_id", "left").join(near, "ref_id", "left")
    within = F.when(F.col("reach").isNull(), F.col("n")).otherwise(F.coalesce("within", F.lit(0)))
    rows = rows.withColumns({"within": within, "qn": F.coalesce("reached", "near", "least")})
    base = F.when((F.col("n") == 1) | (F.col("within") == 1), 0.40).otherwise(0.30)
    return rows.select("ref_id", F.col("qn").alias("target_qn"), F.lit("fuzzy").alias("strategy"), (base * F.when(F.col("within") == 0, 0.5).otherwise(1.0) * count_penalty(F.col("n"))).alias("confidence"), F.col("n").alias("candidates"))


def without_typed(refs: DataFrame, typed: DataFrame) -> DataFrame:
    """References (project, source_qn, callee) but for those whose source and short name
    types have resolved (project, source_qn, target_qn)."""
    known = typed.select("project", "source_qn", simple_name("target_qn").alias("_short")).distinct()
    return refs.withColumn("_short", simple_name("callee")).join(known, ["project", "source_qn", "_short"], "left_anti").drop("_short")


def edges_of(resolved: DataFrame, graph: Graph, kind: str | Column, source: str = "source_qn", props: Column | None = None) -> DataFrame:
    """Edges of rows (project, source, target_qn) whose both ends exist; one for each
    source, target and type."""
    ids = graph.nodes.select("project", "qualified_name", "id")
    src = ids.select("project", F.col("qualified_name").alias(source), F.col("id").alias("source_id"))
    dst = ids.select("project", F.col("qualified_name").alias("target_qn"), F.col("id").alias("target_id"))
    type_ = F.lit(kind) if isinstance(kind, str) else kind
    rows = resolved.withColumns({"type": type_, "properties": F.lit("{}") if props is None else props}).join(src, ["project", source]).join(dst, ["project", "target_qn"])
    one = rows.groupBy("project", "source_id", "target_id", "type").agg(F.min("properties").alias("properties"))
    return one.select(F.xxhash64("type", "source_id", "target_id").alias("id"), "project", "source_id", "target_id", "type", "properties")


def stub_rows(targets: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes for targets (project, target_qn) that `names` (project, qualified_name) lacks: a
    Method where the name has two dots or more, else a Function."""
    known = names.select("project", F.col("qualified_name").alias("target_qn"))
    new = targets.select("project", "target_qn").distinct().join(known, ["project", "target_qn"], "left_anti")
    label = F.when(F.size(F.split("target_qn", r"\.")) >= 3, "Method").otherwise("Function")
    return new.select(F.xxhash64("project", "target_qn").alias("id"), "project", label.alias("label"), simple_name("target_qn").alias("name"), F.col("target_qn").alias("qualified_name"), F.lit("").alias("file_path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit('{"stub":true}').alias("properties"))


def with_stubs(graph: Graph, targets: DataFrame) -> Graph:
    """With a node for each target (project, target_qn) that has none."""
    return Graph(graph.nodes.unionByName(stub_rows(targets, graph.nodes)), graph.edges)
