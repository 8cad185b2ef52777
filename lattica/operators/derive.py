"""Passes that make nodes and edges from facts: structure, definitions, relations.

Facts are tables keyed by rel_path; every pass is a select or a join, and every edge
is first addressed by qualified names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import base_name, camel_words, folder_qn, is_test_name, is_test_path, module_qn, parent_name, simple_name
from ..model import EDGE_SCHEMA, Graph, json_property
from ..storage import cutter
from .joins import covering
from .resolve import edges_of, registry, resolve

CLASS_LABELS = ("Class", "Type", "Interface")
#: Calls that a chain of assignments is followed through at most.
RETURN_ROUNDS = 5
#: Files that make a folder a package.
PACKAGE_FILES = ("__init__.py", "go.mod", "package.json", "Cargo.toml", "pom.xml", "build.gradle", "composer.json", "setup.py", "pyproject.toml")


def _node(project: Column, label: Column | str, name: Column, qn: Column, path: Column, props: Column | None = None, start: Column | None = None, end: Column | None = None) -> list[Column]:
    zero = F.lit(0)
    return [
        F.xxhash64(project, qn).alias("id"), project.alias("project"), (F.lit(label) if isinstance(label, str) else label).alias("label"), name.alias("name"), qn.alias("qualified_name"),
        path.alias("file_path"), (zero if start is None else start).cast("int").alias("start_line"), (zero if end is None else end).cast("int").alias("end_line"), (F.lit("{}") if props is None else props).alias("properties"),
    ]


def structure(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes Project, Folder, Package and File, and (project, source_qn, target_qn,
    type) of CONTAINS_FOLDER, CONTAINS_PACKAGE and CONTAINS_FILE. `files` has project
    and rel_path; a folder that holds a package file is a package."""
    parts = F.split("rel_path", "/")
    dirs = files.select("project", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i - 1), "/"))).alias("path")).where("path <> ''").distinct()
    packages = files.where(base_name("rel_path").isin(*PACKAGE_FILES)).select("project", F.regexp_replace("rel_path", r"/?[^/]*$", "").alias("path")).distinct().withColumn("package", F.lit(True))
    dirs = dirs.join(packages, ["project", "path"], "left").withColumn("label", F.when(F.col("package"), "Package").otherwise("Folder"))
    project, path, rel = F.col("project"), F.col("path"), F.col("rel_path")
    file_qn = F.concat(module_qn(project, rel), F.lit(".__file__"))
    nodes = (
        files.select("project").distinct().select(*_node(project, "Project", project, project, F.lit("")))
        .unionByName(dirs.select(*_node(project, F.col("label"), base_name(path), folder_qn(project, path), path)))
        .unionByName(files.select("project", "rel_path").distinct().select(*_node(project, "File", base_name(rel), file_qn, rel)))
    )
    up = lambda c: folder_qn(project, F.regexp_replace(c, r"/?[^/]*$", ""))
    edges = dirs.select("project", up("path").alias("source_qn"), folder_qn(project, path).alias("target_qn"), F.when(F.col("package"), "CONTAINS_PACKAGE").otherwise("CONTAINS_FOLDER").alias("type"))
    return nodes, edges.unionByName(files.select("project", up("rel_path").alias("source_qn"), file_qn.alias("target_qn"), F.lit("CONTAINS_FILE").alias("type")).distinct())


def definitions(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of definitions and of their modules, and DEFINES, DEFINES_METHOD and
    DEFINES_FIELD. `facts` has project, rel_path, name, qualified_name, label,
    start_line, end_line, parent_class and any of the optional columns."""
    project, rel = F.col("project"), F.col("rel_path")
    optional = [c for c in ("signature", "return_type", "receiver", "docstring", "parent_class", "decorators", "base_classes", "param_names", "param_types", "complexity", "is_exported", "is_abstract", "is_test", "is_entry_point") if c in facts.columns]
    props = F.to_json(F.struct(*optional)) if optional else F.lit("{}")
    module = module_qn(project, rel)
    nodes = facts.select(*_node(project, F.col("label"), F.col("name"), F.col("qualified_name"), rel, props, F.col("start_line"), F.col("end_line")))
    modules = facts.select("project", "rel_path").distinct().select(*_node(project, "Module", simple_name(module), module, rel))
    owner = F.when(F.coalesce(F.col("parent_class"), F.lit("")) != "", F.col("parent_class")).otherwise(module)
    kind = F.when(F.col("label") == "Field", "DEFINES_FIELD").when((F.col("label") == "Method") & (owner != module), "DEFINES_METHOD").otherwise("DEFINES")
    return nodes.unionByName(modules), facts.select("project", owner.alias("source_qn"), F.col("qualified_name").alias("target_qn"), kind.alias("type"))


def import_maps(imports: DataFrame) -> DataFrame:
    """(project, module_qn, imports): local names of a module to what they mean. A
    module's imports are few."""
    return imports.groupBy("project", "module_qn").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("local_name", "module_path")))).alias("imports"))


def import_rows(imports: DataFrame, names: DataFrame) -> DataFrame:
    """Imports with target_qn: the name as written, else the name that a path stands for,
    within the project. `names` has project and qualified_name."""
    names = names.select("project", F.col("qualified_name").alias("target_qn"), F.lit(True).alias("found"))
    path = F.concat_ws(".", "project", F.translate(F.regexp_replace("module_path", r"^[./]+|\.[A-Za-z]+$", ""), "/", "."))
    rows = imports.withColumn("target_qn", F.col("module_path")).join(names, ["project", "target_qn"], "left")
    return rows.withColumn("target_qn", F.when(F.col("found"), F.col("module_path")).when(F.startswith("module_path", F.concat("project", F.lit("."))), F.col("module_path")).otherwise(path)).drop("found")


def import_edges(imports: DataFrame, graph: Graph) -> DataFrame:
    """IMPORTS edges with their alias."""
    return edges_of(import_rows(imports, graph.nodes), graph, "IMPORTS", "module_qn", F.to_json(F.struct(F.col("local_name").alias("alias"))))


def resolved_references(refs: DataFrame, maps: DataFrame, known: DataFrame) -> DataFrame:
    """References (project, rel_path, source_qn, module_qn, callee, kind, fuzzy) with
    target_qn, strategy and confidence, `kind` being CALLS, USAGE, READS, WRITES, USES_TYPE,
    THROWS and the like: all are resolved in one go."""
    ids = F.xxhash64("project", "rel_path", "source_qn", "module_qn", "callee", "kind")
    r = refs.join(maps, ["project", "module_qn"], "left").withColumn("ref_id", ids).dropDuplicates(["ref_id"])
    found = resolve(r, known, "fuzzy").join(r.select("ref_id", "project", "rel_path", "source_qn", "kind"), "ref_id")
    return found.select("project", "rel_path", "source_qn", "target_qn", "kind", "strategy", F.round("confidence", 4).alias("confidence"))


def throw_kind(name: Column | str) -> Column:
    """THROWS for checked exceptions, whose names end in Exception, but for those of run
    time; RAISES for others."""
    short = simple_name(name)
    return F.when(short.endswith("Exception") & ~F.contains(short, F.lit("Runtime")), "THROWS").otherwise("RAISES")


def decorator_name(text: Column | str) -> Column:
    return F.regexp_extract(text, r"^\s*[@#\[]*\s*([A-Za-z_][\w.:]*)", 1)


def decorations(defs: DataFrame) -> DataFrame:
    """(project, rel_path, source_qn, module_qn, callee): what the decorators of definitions
    name."""
    rows = defs.select("project", "rel_path", F.col("qualified_name").alias("source_qn"), "module_qn", F.explode("decorators").alias("text"))
    return rows.select("project", "rel_path", "source_qn", "module_qn", decorator_name("text").alias("callee")).where("callee <> ''")


def word_tags(rows: DataFrame, key: str, text: Column, least: int = 2) -> DataFrame:
    """(key, tags): of each row the words of a text that at least `least` rows have."""
    words = rows.select(key, F.explode(F.array_distinct(text)).alias("word")).where("length(word) > 1")
    common = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("word")
    return words.join(common, "word").groupBy(key).agg(F.array_sort(F.collect_set("word")).alias("tags"))


def decorator_tags(nodes: DataFrame) -> DataFrame:
    decorators = F.from_json(json_property(F.col("properties"), "decorators"), "array<string>")
    return word_tags(nodes.where(decorators.isNotNull()), "id", F.flatten(F.transform(decorators, lambda d: camel_words(d))))


def implement_edges(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """IMPLEMENTS where a class has every method of an interface (and it has some), and
    OVERRIDE from its methods to the interface's, as (project, source_qn, target_qn)."""
    owned = graph.typed("DEFINES_METHOD").select("source_id", "target_id")
    ids = graph.nodes.select("id", "project", "label", "name", "qualified_name")
    methods = owned.join(ids.select(F.col("id").alias("target_id"), F.col("name").alias("method"), F.col("qualified_name").alias("method_qn")), "target_id")
    owners = ids.select(F.col("id").alias("source_id"), "project", F.col("label").alias("owner_label"), F.col("qualified_name").alias("owner_qn"))
    rows = methods.join(owners, "source_id").select("project", "owner_label", "owner_qn", "method", "method_qn").distinct()
    key = F.struct("project", "method").alias("item")
    need = rows.where("owner_label = 'Interface'").select("project", F.col("owner_qn").alias("interface_qn"), key, F.struct("project", "owner_qn").alias("interface"), F.col("method_qn").alias("interface_method"))
    have = rows.where("owner_label in ('Class', 'Type')").select(F.col("owner_qn").alias("class_qn"), key, F.struct("project", "owner_qn").alias("class"), F.col("method_qn").alias("class_method"))
    whole = covering(have, need, "class", "interface", "item")
    implements = whole.select("interface.project", F.col("class.owner_qn").alias("source_qn"), F.col("interface.owner_qn").alias("target_qn"))
    over = whole.join(need, "interface").join(have, ["class", "item"]).select("project", F.col("class_method").alias("source_qn"), F.col("interface_method").alias("target_qn"))
    return implements, over.distinct()


def explicit_implement_edges(graph: Graph) -> DataFrame:
    """IMPLEMENTS from declared bases, as INHERITS edges have them, that are interfaces."""
    interfaces = graph.labelled("Interface").select(F.col("id").alias("target_id"))
    rows = graph.typed("INHERITS").join(interfaces, "target_id", "left_semi").withColumn("type", F.lit("IMPLEMENTS"))
    return rows.withColumn("id", F.xxhash64("type", "source_id", "target_id")).select(*EDGE_SCHEMA.names)


def test_edges(graph: Graph) -> DataFrame:
    """TESTS: calls from test functions in test files to what isn't in a test file, as
    (project, source_qn, target_qn)."""
    n = graph.nodes.select("id", "project", "name", "qualified_name", "file_path")
    src = n.select(F.col("id").alias("source_id"), "project", F.col("name").alias("s_name"), F.col("qualified_name").alias("source_qn"), F.col("file_path").alias("s_path"))
    dst = n.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("target_qn"), F.col("file_path").alias("t_path"))
    rows = graph.typed("CALLS").select("source_id", "target_id").join(src, "source_id").join(dst, "target_id")
    return rows.where(is_test_path("s_path") & is_test_name("s_name") & ~is_test_path("t_path")).select("project", "source_qn", "target_qn").distinct()


def tested_path(path: Column | str) -> Column:
    """The file that a test file's name is made from; null for other files."""
    path = F.col(path) if isinstance(path, str) else path
    name = base_name(path)
    plain = F.regexp_replace(F.regexp_replace(name, r"^test_", ""), r"(_test|\.test|\.spec|_spec|Test|Tests)(\.[^.]+)$", "$2")
    folder = F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"(^|/)(tests?|__tests__|spec)/$", "$1")
    return F.when(plain != name, F.concat(folder, plain))


def test_file_edges(graph: Graph) -> DataFrame:
    """TESTS_FILE from test files to the file of the same name, else to the files of
    what they import, as (project, source_path, target_path)."""
    files = graph.labelled("File").select("project", "file_path")
    tests = files.where(is_test_path("file_path"))
    named = tests.withColumn("target_path", tested_path("file_path")).join(files.select("project", F.col("file_path").alias("target_path")), ["project", "target_path"]).select("project", F.col("file_path").alias("source_path"), "target_path")
    rest = tests.join(named.select("project", F.col("source_path").alias("file_path")), ["project", "file_path"], "left_anti")
    n = graph.nodes.select("id", "project", "file_path")
    through = graph.typed("IMPORTS").select("source_id", "target_id").join(n.select(F.col("id").alias("source_id"), "project", F.col("file_path").alias("source_path")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("file_path").alias("target_path")), "target_id")
    through = through.join(rest.select("project", F.col("file_path").alias("source_path")), ["project", "source_path"], "left_semi").where((F.col("target_path") != "") & ~is_test_path("target_path"))
    return named.unionByName(through.select("project", "source_path", "target_path").distinct())


def is_env_name(name: Column | str) -> Column:
    return (F.col(name) if isinstance(name, str) else name).rlike(r"^[A-Z][A-Z0-9_]{2,}$")


def set_key(text: Column | str) -> Column:
    """The name that KEY = VALUE or KEY: VALUE sets; empty for other texts."""
    return F.regexp_extract(text, r"^\s*(?:export\s+)?([A-Z][A-Z0-9_]*)\s*[:=]", 1)


def env_rows(env_reads: DataFrame, setters: DataFrame) -> DataFrame:
    """(project, source_qn, target_qn, name): from modules and variables that set a name
    (project, setter_qn, name) to functions that read it from the environment
    (project, source_qn, name)."""
    read = env_reads.select("project", "name", F.col("source_qn").alias("target_qn"))
    return read.join(setters.distinct(), ["project", "name"]).select("project", F.col("setter_qn").alias("source_qn"), "target_qn", "name").distinct()


def type_map(assigns: DataFrame, known: DataFrame) -> DataFrame:
    """(project, module_qn, variable, class_qn): variables whose assigned type is a
    class of the registry; of several the least name."""
    classes = known.where(F.col("label").isin(*CLASS_LABELS)).select("project", "name", F.col("qualified_name").alias("class_qn"))
    rows = assigns.select("project", "module_qn", "variable", simple_name("type_name").alias("name")).join(classes, ["project", "name"])
    return rows.groupBy("project", "module_qn", "variable").agg(F.min("class_qn").alias("class_qn"))


def variable_types(assigns: DataFrame, returns: DataFrame, known: DataFrame, maps: DataFrame, cut=None, rounds: int = RETURN_ROUNDS) -> DataFrame:
    """(project, module_qn, variable, class_qn): type_map, and variables that hold what a
    call returns: of a function, or of a method of a variable whose class is known by then.

    `assigns` has project, module_qn, variable and type_name (the callee as written),
    `returns` project, qualified_name and type_name. Each round of joins follows chains of
    assignments one call further; it ends when a round finds nothing. A function is the one
    that the module imports by that name, else one of the module, else the only one of
    the name. Classes are found by their simple name, the least of several. `cut` writes a
    table and gives it back.
    """
    cut = cut or cutter(assigns.sparkSession, "types")
    classes = known.where(F.col("label").isin(*CLASS_LABELS)).groupBy("project", "name").agg(F.min("qualified_name").alias("class_qn"))
    returned = returns.select("project", "qualified_name", simple_name("type_name").alias("name")).join(classes, ["project", "name"]).groupBy("project", "qualified_name").agg(F.min("class_qn").alias("class_qn"))
    returned = cut("returned", returned.withColumn("short", simple_name("qualified_name")))
    found = type_map(assigns, known)
    calls = assigns.select("project", "module_qn", "variable", F.col("type_name").alias("callee")).distinct()
    # Functions: their candidates are those that return a known class.
    counts = returned.groupBy("project", "short").agg(F.count(F.lit(1)).alias("n"))
    plain = calls.withColumn("short", simple_name("callee")).join(maps, ["project", "module_qn"], "left").join(returned.join(counts, ["project", "short"]), ["project", "short"])
    head, rest = F.substring_index("callee", ".", 1), F.when(F.contains("callee", F.lit(".")), F.regexp_replace("callee", r"^[^.]*\.", ""))
    meant = F.concat_ws(".", F.try_element_at("imports", head), rest)
    tier = F.when(F.col("qualified_name") == meant, 1).when(F.col("qualified_name") == F.concat_ws(".", "module_qn", "callee"), 2).when((F.col("n") == 1) & ~F.contains("callee", F.lit(".")), 3)
    direct = plain.withColumn("tier", tier).where("tier is not null").groupBy("project", "module_qn", "variable").agg(F.min(F.struct("tier", "class_qn"))["class_qn"].alias("class_qn"))
    key = ["project", "module_qn", "variable"]
    found = cut("types0", found.unionByName(direct.join(found.select(*key), key, "left_anti")))
    dotted = calls.where(F.col("callee").rlike(r"^[^.()]+\.[^.]+$")).withColumns({"holder": F.substring_index("callee", ".", 1), "method": F.substring_index("callee", ".", -1)})
    for turn in range(1, rounds + 1):
        held = found.select("project", "module_qn", F.col("variable").alias("holder"), F.col("class_qn").alias("held"))
        met = dotted.join(found.select(*key), key, "left_anti").join(held, ["project", "module_qn", "holder"]).withColumn("qualified_name", F.concat_ws(".", "held", "method"))
        new = cut(f"types{turn}", met.join(returned.select("project", "qualified_name", "class_qn"), ["project", "qualified_name"]).groupBy(*key).agg(F.min("class_qn").alias("class_qn")))
        if new.isEmpty():
            break
        found = found.unionByName(new)
    return found


def method_calls(refs: DataFrame, types: DataFrame, known: DataFrame) -> DataFrame:
    """Calls on self or on a variable of a known class (project, source_qn, module_qn,
    callee) that the class defines: project, source_qn, target_qn, confidence 0.90."""
    r = refs.where(F.contains("callee", F.lit(".")) & ~F.startswith("callee", F.lit("()"))).withColumns({"variable": F.substring_index("callee", ".", 1), "method": F.substring_index("callee", ".", -1)})
    own = r.where("variable in ('self', 'this', 'cls')").withColumn("class_qn", parent_name("source_qn"))
    other = r.join(types, ["project", "module_qn", "variable"]).select(*own.columns)
    names = known.select("project", F.col("qualified_name").alias("target_qn"))
    both = own.unionByName(other).withColumn("target_qn", F.concat_ws(".", "class_qn", "method"))
    rest = [c for c in ("rel_path",) if c in refs.columns]
    return both.join(names, ["project", "target_qn"], "left_semi").select("project", *rest, "source_qn", "target_qn", F.lit("type_dispatch").alias("strategy"), F.lit(0.90).alias("confidence"))
