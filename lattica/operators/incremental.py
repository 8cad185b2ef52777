"""Which files changed, which others depend on them, and which are gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.names import folder_qn, module_qn
from ..model import Graph


def classify(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(project, rel_path, status): current files (project, rel_path, sha256, mtime_ns,
    size) against stored ones. Equal time and size are unchanged without looking at
    the hash; else the hash decides; files not stored are new, files only stored
    removed."""
    keys = ["project", "rel_path"]
    old = stored.select(*keys, F.col("sha256").alias("old_hash"), F.col("mtime_ns").alias("old_mtime"), F.col("size").alias("old_size"), F.lit(True).alias("was"))
    both = current.withColumn("now", F.lit(True)).join(old, keys, "full")
    same = ((F.col("mtime_ns") == F.col("old_mtime")) & (F.col("size") == F.col("old_size"))) | (F.col("sha256") == F.col("old_hash"))
    status = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "new").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    return both.select(*keys, status.alias("status"))


def removed(stored: DataFrame, current: DataFrame) -> DataFrame:
    return stored.join(current.select("project", "rel_path"), ["project", "rel_path"], "left_anti").select("project", "rel_path")


def dependents(graph: Graph, changed: DataFrame) -> DataFrame:
    """(project, rel_path): unchanged files that import a changed file's module or the
    folder it lies in. `changed` has project and rel_path."""
    folder = F.regexp_replace("rel_path", r"/?[^/]*$", "")
    targets = changed.select(F.explode(F.array(module_qn("project", "rel_path"), folder_qn("project", folder))).alias("qualified_name")).distinct()
    ids = graph.nodes.join(targets, "qualified_name", "left_semi").select(F.col("id").alias("target_id"))
    sources = graph.typed("IMPORTS").join(ids, "target_id", "left_semi").select(F.col("source_id").alias("id"))
    files = graph.nodes.join(sources, "id", "left_semi").where("file_path <> ''").select("project", F.col("file_path").alias("rel_path")).distinct()
    return files.join(changed.select("project", "rel_path"), ["project", "rel_path"], "left_anti")
