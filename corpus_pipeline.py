"""A corpus pipeline: language, quality, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows
that its predecessor kept, and all stages but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lattica.llm import exact_dedup, language_id, near_dedup, packing, quality
from lattica.llm.common import Workspace, held_out, sized


def _judged(docs: DataFrame, judge: Callable[[DataFrame, list[str], str], DataFrame], keeps: str) -> DataFrame:
    """Rows of docs for which the judge's columns pass `keeps`, whatever names docs has."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())
    text = plain if docs.schema["text"].dataType.typeName() == "string" else plain.withColumn(names["text"], F.col(names["text"]).cast("string"))
    return judge(text, [*names.values()], names["text"]).where(keeps).select(*names.values()).toDF(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the classifier tells; those it rejects go: no
    letter, or too far from every centroid. It learns from docs themselves."""
    model = language_id.train(docs, ~held_out())
    return _judged(docs, lambda d, keep, text: language_id.identify(d, model, keep, text), "not rejected")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality classifier predicts to be good. Its trusted
    positives are those of the table `labels` that are still in docs."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _judged(docs, lambda d, keep, text: quality.score_documents(d, model, keep, text), "predicted = 1")


#: Documents that a task writes at least.
DOCUMENT_ROWS = 5_000
_MARK, _ID = "_pipeline_mark", "_pipeline_id"


def _deduplicated(spark: SparkSession, docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of docs that the operator keeps. A row is known by id and a hash of its
    text; rows that repeat both are told apart only where there are any."""
    marked = docs.withColumn(_MARK, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    space = Workspace(spark, "pipeline")
    found = operator(marked.select("doc_id", "text", _MARK)).groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("kept"))
    n = docs.count()
    found = space.table("judged", found.where("kept < rows").withColumnRenamed("doc_id", _ID), rows=n)
    here = lambda d: (F.col(_MARK) == d["mark"]) & F.col("doc_id").cast("long").eqNullSafe(d[_ID])
    gone, repeated = found.where("kept = 0"), found.where("kept > 0")
    left = marked.join(gone, here(gone), "left_anti")
    if not repeated.isEmpty():
        once = left.join(repeated, here(repeated), "left_semi").dropDuplicates(["doc_id", _MARK])
        left = left.join(repeated, here(repeated), "left_anti").unionByName(once)
    return sized(left.select(*docs.columns), n, DOCUMENT_ROWS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    return _deduplicated(spark, docs, lambda d: exact_dedup.exact_duplicates(spark, d, mark=_MARK))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return _deduplicated(spark, docs, lambda d: near_dedup.near_duplicates(spark, d, mark=_MARK))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the rest into sequences; one row for each piece."""
    packed = packing.pack_documents(spark, docs, carry={"ids_crc32": F.crc32("ids")}, special_as_text=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

#: Classifiers and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`, each written and read again."""
    space = Workspace(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        out = space.table(name, stage(spark, docs, sf_dir))
        if n:
            space.drop(STAGES[n - 1][0])
        docs = out
    return docs
