"""Text search over lines, and snippets with line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import base_name, glob_to_regex
from ..model import Graph
from ..sources.text import lines
from .search import with_degrees

#: Bytes of a line that a match shows.
SHOWN = 200


def search_code(files: DataFrame, pattern: str, regex: bool = False, case_sensitive: bool = True, file_glob: str | None = None) -> DataFrame:
    """(file, line, content) of lines of `files` (file, text) that hold a literal or match
    a regular expression; content is trimmed and cut. A glob with a slash is matched
    with the path, another with the base name. Whole texts are tested first, so only
    those that can match are cut into lines."""
    if file_glob:
        path = F.col("file") if "/" in file_glob else base_name("file")
        files = files.where(path.rlike(glob_to_regex(file_glob)))
    needle = pattern if case_sensitive else pattern.lower()

    def hit(text: Column) -> Column:
        if regex:
            return text.rlike(("" if case_sensitive else "(?i)") + pattern)
        return F.contains(text if case_sensitive else F.lower(text), F.lit(needle))

    first = files.select("file", "text")
    if not regex:
        first = first.where(hit(F.col("text")))
    rows = lines(first).where(hit(F.col("content")))
    content = F.trim(F.regexp_replace("content", r"^\s+|\s+$", ""))
    return rows.select("file", "line", F.when(F.length(content) > SHOWN, F.concat(F.substring(content, 1, SHOWN), F.lit("..."))).otherwise(content).alias("content"))


def page(rows: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page in order of file and line, with total and has_more."""
    total = rows.groupBy().agg(F.count(F.lit(1)).alias("total"))
    some = rows.orderBy("file", "line").limit(offset + limit).offset(offset)
    return some.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)  # one row


def snippets(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, code): of nodes (id, file_path, start_line, end_line) their lines in `files`
    (file, text), each as number and text. Cut by array, without exploding lines."""
    rows = nodes.join(files, nodes["file_path"] == files["file"]).select("id", "start_line", "end_line", F.split("text", "\n").alias("l"))
    last = F.least("end_line", F.size("l"))
    part = F.slice("l", F.greatest("start_line", F.lit(1)), F.greatest(last - F.greatest("start_line", F.lit(1)) + 1, F.lit(0)))
    shown = F.transform(part, lambda x, i: F.format_string("%4d | %s\n", i + F.greatest("start_line", F.lit(1)), x))
    return rows.select("id", F.array_join(shown, "").alias("code"))


def find_symbol(graph: Graph, name: str) -> DataFrame:
    """Candidates for a name, with tier: 1 an exact qualified name, 2 a suffix of one at
    a dot, 3 a simple name, 4 a part of a name. Only the best tier is given; in it,
    what isn't a test comes first, then by degree and qualified name."""
    qn, simple = F.col("qualified_name"), F.col("name")
    tier = F.when(qn == name, 1).when(qn.endswith("." + name), 2).when(simple == name, 3).when(F.contains(F.lower(simple), F.lit(name.lower())), 4)
    rows = graph.nodes.withColumn("tier", tier).where("tier is not null")
    best = rows.groupBy().agg(F.min("tier").alias("best"))
    rows = rows.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best")  # one row
    from ..functions.names import is_test_path

    ranked = with_degrees(graph, rows, ("CALLS",)).withColumn("is_test_file", F.coalesce(is_test_path("file_path"), F.lit(False)))
    return ranked.orderBy("is_test_file", (F.col("in_degree") + F.col("out_degree")).desc(), "qualified_name")


def line_numbers(rows: DataFrame, order: str, *within: str) -> DataFrame:
    return rows.withColumn("line", F.row_number().over(Window.partitionBy(*within).orderBy(order)))
