"""CONFIGURES edges: what configuration keys, manifests and file names point to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import base_name, extension, module_qn
from ..model import EDGE_SCHEMA, Graph
from ..sources.text import carried, lines
from .joins import config_file_refs, config_key_symbols, dependency_imports

#: Extensions of configuration files; manifests and their sections.
CONFIG_EXTENSIONS = (".env", ".toml", ".ini", ".yaml", ".yml", ".cfg", ".properties", ".json", ".xml", ".conf")
MANIFESTS = ("Cargo.toml", "package.json", "go.mod", "requirements.txt", "Gemfile", "build.gradle", "pom.xml", "composer.json")
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "dev-dependencies", "build-dependencies")
#: Names of configuration files in quotes.
FILE_NAMES = r"[\"']([\w./\-]+\.(?:toml|ini|ya?ml|cfg|properties|json|xml|conf|env))[\"']"
CODE_LABELS = ("Function", "Variable", "Class")


def is_config(path: Column | str) -> Column:
    name = base_name(path)
    return extension(path).isin(*CONFIG_EXTENSIONS) | (name == ".env")


def _edges(pairs: DataFrame, source: str, target: str, strategy: str) -> DataFrame:
    props = F.to_json(F.struct(F.lit(strategy).alias("strategy"), "confidence"))
    return pairs.select("project", F.col(source).alias("source_id"), F.col(target).alias("target_id"), "confidence", props.alias("properties"))


def configure_edges(graph: Graph, strings: DataFrame | None = None) -> DataFrame:
    """CONFIGURES edges of three kinds, one for each pair of nodes, the most certain:
    from a configuration variable to a symbol of its name; from a manifest's
    dependency to a module that imports it; and, for `strings` (id, value) that
    name a configuration file, from the file's module to the node of the string."""
    n = graph.nodes
    project = n.select(F.col("id").alias("source_id"), "project")
    config = n.where((F.col("label") == "Variable") & is_config("file_path")).select("id", "name")
    code = n.where(F.col("label").isin(*CODE_LABELS) & ~is_config("file_path")).select("id", "name")
    found = _edges(config_key_symbols(config, code).withColumn("source_id", F.col("config_id")).join(project, "source_id"), "config_id", "code_id", "key_symbol")

    in_section = F.exists(F.split(F.lower("qualified_name"), r"[.\[\]]"), lambda p: p.isin(*(s.lower() for s in SECTIONS)))
    deps = n.where((F.col("label") == "Variable") & base_name("file_path").isin(*MANIFESTS) & in_section).select("id", "name")
    targets = n.select(F.col("id").alias("target_id"), "name", "qualified_name")
    pairs = dependency_imports(deps, graph.typed("IMPORTS").select("source_id", "target_id").join(targets, "target_id"))
    pairs = pairs.select(F.col("dependency_id"), F.col("source_id").alias("importer_id"), "confidence").withColumn("source_id", F.col("dependency_id")).join(project, "source_id")
    found = found.unionByName(_edges(pairs, "dependency_id", "importer_id", "dependency_import"))

    if strings is not None:
        files = n.where((F.col("label") == "Module") & is_config("file_path")).select("id", "file_path")
        refs = config_file_refs(strings, files).withColumn("source_id", F.col("file_id")).join(project, "source_id")
        found = found.unionByName(_edges(refs, "file_id", "node_id", "file_reference"))
    best = found.where("source_id <> target_id").groupBy("project", "source_id", "target_id").agg(F.max_by("properties", F.struct("confidence", "properties")).alias("properties"))
    return best.select(F.xxhash64(F.lit("CONFIGURES"), "source_id", "target_id").alias("id"), "project", "source_id", "target_id", F.lit("CONFIGURES").alias("type"), "properties").select(*EDGE_SCHEMA.names)


def with_env_urls(constants: DataFrame, bindings: DataFrame, most: int | None = 50) -> DataFrame:
    """(project, rel_path, constants): module constants (project, rel_path, constants
    array) with the URLs that environment files set (project, rel_path, key, value),
    as KEY = URL, `most` new ones of a file at most, by key; None takes all."""
    found = F.array_sort(F.collect_set(F.concat_ws(" = ", "key", "value")))
    new = bindings.groupBy("project", "rel_path").agg((found if most is None else F.slice(found, 1, most)).alias("new"))
    rows = constants.join(new, ["project", "rel_path"], "full")
    nothing = F.array().cast("array<string>")
    return rows.select("project", "rel_path", F.array_union(F.coalesce("constants", nothing), F.coalesce("new", nothing)).alias("constants"))


def config_variables(files: DataFrame) -> DataFrame:
    """(project, rel_path, name, qualified_name, start_line, value) of the keys that
    configuration files (project, rel_path, text) set line by line, under their
    section, and of the dependencies of JSON manifests."""
    rows = lines(files.where(is_config("rel_path") & ~extension("rel_path").isin(".json", ".xml")).select("project", "rel_path", "text"))
    section = F.nullif(F.regexp_extract("content", r"^\s*\[+([^\[\]]+)\]+\s*$", 1), F.lit(""))
    rows = rows.withColumn("section", carried(section, "line", "project", "rel_path"))
    pattern = r"""^\s*(?:-\s+)?(?:export\s+)?["']?([A-Za-z_][\w.\-]*)["']?\s*[=:]\s*["']?([^"'#]*)"""
    keys = rows.select("project", "rel_path", "section", F.regexp_extract("content", pattern, 1).alias("name"), F.col("line").cast("int").alias("start_line"), F.trim(F.regexp_extract("content", pattern, 2)).alias("value")).where("name <> ''")
    kinds = [s for s in SECTIONS if "-" not in s]
    tree = F.from_json("text", ", ".join(f"{k} map<string,string>" for k in kinds))
    some = files.where(base_name("rel_path").isin(*(m for m in MANIFESTS if m.endswith(".json")))).withColumn("tree", tree)
    for k in kinds:
        more = some.select("project", "rel_path", F.lit(k).alias("section"), F.explode(f"tree.{k}").alias("name", "value")).select("project", "rel_path", "section", "name", F.lit(0).alias("start_line"), "value")
        keys = keys.unionByName(more)
    qn = F.concat_ws(".", module_qn("project", "rel_path"), "section", "name")
    return keys.select("project", "rel_path", "name", qn.alias("qualified_name"), "start_line", "value").dropDuplicates(["project", "qualified_name"])
