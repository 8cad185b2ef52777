"""Code search, snippets and similarity of names over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import names
from ..operators import code_search
from ..sources.star import table


def _files(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), F.coalesce("text", F.lit("")).alias("text"))


def _snippets(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    nodes = docs.select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.lit(2).alias("start_line"), F.lit(3).alias("end_line"))
    return code_search.snippets(nodes, _files(s, d))


def _similarity(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    rows = part.select("p_partkey", F.col("p_name").alias("a")).join(other, "p_partkey")
    return rows.select("p_partkey", F.levenshtein("a", "b").alias("distance"), F.round(names.normal_levenshtein("a", "b"), 6).alias("similarity"), F.round(names.ngram_overlap("a", "b", 2), 6).alias("overlap"))


QUERIES = {
    "code_search_literal": lambda s, d: code_search.search_code(_files(s, d), "license", case_sensitive=False).select("file", "line"),
    "code_search_regex": lambda s, d: code_search.search_code(_files(s, d), r"[Tt]he [a-z]{4} [a-z]+\.$", regex=True, file_glob="src1*/**").select("file", "line"),
    "code_search_page": lambda s, d: code_search.page(code_search.search_code(_files(s, d), "the"), 20, 25).select("file", "line", "total", "has_more"),
    "snippet_lines": _snippets,
    "string_similarity": _similarity,
}

_LINES = "WITH l AS (SELECT source || '/' || doc_id || '.txt' AS file, CAST(generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS INT) AS line, unnest(string_split(coalesce(text, ''), chr(10))) AS c FROM documents) "
_GRAMS = "list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)))"

SQL = {
    "code_search_literal": _LINES + "SELECT file, line FROM l WHERE contains(lower(c), 'license')",
    "code_search_regex": _LINES + r"SELECT file, line FROM l WHERE regexp_matches(c, '[Tt]he [a-z]{4} [a-z]+\.$') AND regexp_matches(file, '^src1[^/]*/')",
    "code_search_page": _LINES + "SELECT file, line, total, total > 45 AS has_more FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY file, line) AS k FROM l WHERE contains(c, 'the')) WHERE k BETWEEN 21 AND 45",
    "snippet_lines": "WITH d AS (SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) SELECT id, CASE WHEN len(l) >= 2 THEN '   2 | ' || l[2] || chr(10) ELSE '' END || CASE WHEN len(l) >= 3 THEN '   3 | ' || l[3] || chr(10) ELSE '' END AS code FROM d",
    "string_similarity": f"WITH p AS (SELECT a.p_partkey, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey - 1 = a.p_partkey) SELECT p_partkey, CAST(levenshtein(a, b) AS INT) AS distance, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS similarity, round(len(list_intersect({_GRAMS.format(x='a')}, {_GRAMS.format(x='b')})) / least(len({_GRAMS.format(x='a')}), len({_GRAMS.format(x='b')})), 6) AS overlap FROM p",
}
