"""OTLP trace exports: spans, and what they say about HTTP edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..model import json_number, json_property
from ..operators.http import normal_path
from ..operators.joins import p99_by

_ATTRIBUTE = "array<struct<key:string,value:struct<stringValue:string,intValue:string>>>"
SCHEMA = (
    f"resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTE}>,scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,"
    f"startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRIBUTE}>>>>>>"
)


def _attribute(attributes: Column, *names: str) -> Column:
    """The last attribute of one of the names, as text."""
    found = F.filter(attributes, lambda a: a["key"].isin(*names))
    return F.coalesce(F.try_element_at(found, F.lit(-1))["value"]["stringValue"], F.lit(""))


def url_path(url: Column | str) -> Column:
    """The path of a URL, without query and fragment; / where a URL has none."""
    url = F.col(url) if isinstance(url, str) else url
    bare = F.regexp_replace(url, r"[?#].*$", "")
    after = F.regexp_extract(bare, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*(/.*)?$", 1)
    return F.when(~bare.contains("://"), bare).when(after == "", F.when(bare == "", "").otherwise("/")).otherwise(after)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """HTTP spans of JSON exports, one document a file: service_name, method, path,
    status_code, span_kind, duration_ns (0 where not positive)."""
    docs = spark.read.schema(SCHEMA).json(path, multiLine=True)
    return spans(docs)


def spans(docs: DataFrame) -> DataFrame:
    resources = docs.select(F.explode("resourceSpans").alias("r"))
    scopes = resources.select(_attribute(F.col("r.resource.attributes"), "service.name").alias("service_name"), F.explode("r.scopeSpans").alias("s"))
    s = scopes.select("service_name", F.explode("s.spans").alias("s")).select("service_name", "s.*")
    path = F.coalesce(F.nullif(_attribute(F.col("attributes"), "http.route"), F.lit("")), url_path(_attribute(F.col("attributes"), "http.target", "url.path", "http.url", "url.full")))
    start, end = F.col("startTimeUnixNano").try_cast("long"), F.col("endTimeUnixNano").try_cast("long")
    rows = s.select("service_name", _attribute(F.col("attributes"), "http.method", "http.request.method").alias("method"), path.alias("path"), _attribute(F.col("attributes"), "http.status_code", "http.response.status_code").alias("status_code"), F.col("kind").alias("span_kind"), F.greatest(F.coalesce(end - start, F.lit(0).cast("long")), F.lit(0).cast("long")).alias("duration_ns"))
    return rows.where("path <> '' and path is not null")


def span_stats(rows: DataFrame) -> DataFrame:
    """(path, calls, p99_ns) by normalised path; p99 of the positive durations."""
    keyed = rows.withColumn("path", normal_path("path"))
    calls = keyed.groupBy("path").agg(F.count(F.lit(1)).alias("calls"))
    slow = p99_by(keyed.where("duration_ns > 0"), "path", "duration_ns").select("path", F.col("p99").alias("p99_ns"))
    return calls.join(slow, "path", "left")


def enrich(edges: DataFrame, stats: DataFrame) -> DataFrame:
    """HTTP_CALLS edges that spans confirm, with their new properties: validated, the
    number of calls, p99, and 0.15 more confidence below 0.9, 1.0 at most. Of several
    edges of a path the one of the largest id is confirmed."""
    from ..operators.upsert import merge_json

    http = edges.where("type = 'HTTP_CALLS'").withColumn("path", normal_path(json_property(F.col("properties"), "url_path")))
    last = http.groupBy("path").agg(F.max("id").alias("id"))
    hit = http.join(last, ["path", "id"], "left_semi").join(stats, "path")
    old = F.coalesce(json_number(F.col("properties"), "confidence"), F.lit(0.0))
    new = F.when(old < 0.9, F.least(F.lit(1.0), old + 0.15)).otherwise(old)
    more = F.to_json(F.struct(F.lit(True).alias("validated_by_trace"), F.col("calls").alias("trace_call_count"), F.round(new, 4).alias("confidence"), F.lit("high").alias("confidence_band"), F.col("p99_ns").alias("p99_latency_ns")))
    keys = [c for c in edges.columns if c != "properties"]
    both = hit.select(*keys, "properties", F.lit(0).alias("seq")).unionByName(hit.select(*keys, more.alias("properties"), F.lit(1).alias("seq")))
    return merge_json(both, keys, "properties", "seq").select(*edges.columns)
