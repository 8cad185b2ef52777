"""The tables of a star schema as a property graph.

Labels and types are literals of a union's branches, so a query's filter on them
leaves only the branches that it needs, and only their columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..model import EDGE_SCHEMA, NODE_SCHEMA, Graph

PROJECT = "tpch"
#: Node ids are the label's number here times this, plus the table's own key.
BASE = 10**12
LABELS = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "User": 7, "Event": 8}
_SUFFIX = {"Region": ".tf", "Nation": ".tf", "Customer": ".go", "Supplier": ".py", "Part": ".js", "Order": ".java", "User": ".go", "Event": ".rs"}
EDGE_BASE = {"IN_REGION": 1, "IN_NATION": 2, "PLACED": 3, "CONTAINS": 4, "SUPPLIED_BY": 5, "NEXT": 6}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(rows: DataFrame, label: str, key: str, name: Column, **props: str) -> DataFrame:
    number = F.col(key).cast("long")
    low = label.lower()
    start = (number % 1000).cast("int")
    return rows.select(
        (F.lit(LABELS[label] * BASE) + number).alias("id"),
        F.lit(PROJECT).alias("project"),
        F.lit(label).alias("label"),
        name.cast("string").alias("name"),
        F.concat(F.lit(f"{PROJECT}.{low}."), number.cast("string")).alias("qualified_name"),
        F.concat(F.lit(f"{low}/"), (number % 16).cast("string"), F.lit(f"/file{_SUFFIX[label]}")).alias("file_path"),
        start.alias("start_line"),
        (start + (number % 50).cast("int")).alias("end_line"),
        F.to_json(F.struct(*(F.col(c).alias(k) for k, c in props.items()))).alias("properties") if props else F.lit("{}").alias("properties"),
    )


def node_id(label: str, key: str) -> Column:
    return F.lit(LABELS[label] * BASE) + F.col(key).cast("long")


def _edge(rows: DataFrame, kind: str, source: tuple[str, str], target: tuple[str, str], props: Column | None = None) -> DataFrame:
    src, dst = node_id(*source), node_id(*target)
    return rows.select(
        F.xxhash64(F.lit(kind), src, dst).alias("id"), F.lit(PROJECT).alias("project"), src.alias("source_id"), dst.alias("target_id"),
        F.lit(kind).alias("type"), (F.lit("{}") if props is None else props).alias("properties"),
    )


#: Rows of a task, about, where a large table is dealt out before it is grouped.
DEALT_ROWS = 250_000


def _dealer(rows: DataFrame) -> Callable[..., DataFrame]:
    """Gives rows to be grouped by keys that hardly any two of them share. A table of more
    than DEALT_ROWS a core is dealt out first, over all shuffle partitions at most: an
    aggregate in the scan would hold nearly all rows of its split and make them no fewer, and
    Spark would then put partitions together until few are left, however many groups each holds."""
    spark, n = rows.sparkSession, rows.count()
    if n <= DEALT_ROWS * spark.sparkContext.defaultParallelism:
        return lambda *keys: rows
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // DEALT_ROWS))
    return lambda *keys: rows.repartition(tasks, *keys)


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers, parts, orders, users and events."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}
    nodes = [
        _node(t["region"], "Region", "r_regionkey", F.col("r_name")),
        _node(t["nation"], "Nation", "n_nationkey", F.col("n_name")),
        _node(t["customer"], "Customer", "c_custkey", F.col("c_name"), segment="c_mktsegment", acctbal="c_acctbal"),
        _node(t["supplier"], "Supplier", "s_suppkey", F.col("s_name"), acctbal="s_acctbal"),
        _node(t["part"], "Part", "p_partkey", F.col("p_name"), brand="p_brand", kind="p_type", size="p_size", price="p_retailprice"),
        _node(t["orders"], "Order", "o_orderkey", F.col("o_orderkey"), status="o_orderstatus", priority="o_orderpriority", total="o_totalprice"),
        _node(t["events"].select("user_id").distinct(), "User", "user_id", F.col("user_id")),
        _node(t["events"].withColumn("k", F.get_json_object("props", "$.k").cast("long")), "Event", "event_id", F.col("event_type"), k="k", value="value"),
    ]
    items = _dealer(t["lineitem"])
    contains = items("l_orderkey", "l_partkey").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    chain = t["events"].select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_id")).where("next_id is not null")
    edges = [
        _edge(t["nation"], "IN_REGION", ("Nation", "n_nationkey"), ("Region", "n_regionkey")),
        _edge(t["customer"], "IN_NATION", ("Customer", "c_custkey"), ("Nation", "c_nationkey")),
        _edge(t["supplier"], "IN_NATION", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey")),
        _edge(t["orders"], "PLACED", ("Customer", "o_custkey"), ("Order", "o_orderkey")),
        _edge(contains, "CONTAINS", ("Order", "l_orderkey"), ("Part", "l_partkey"), F.to_json(F.struct("quantity"))),
        _edge(items("l_partkey", "l_suppkey").select("l_partkey", "l_suppkey").distinct(), "SUPPLIED_BY", ("Part", "l_partkey"), ("Supplier", "l_suppkey")),
        _edge(chain, "NEXT", ("Event", "event_id"), ("Event", "next_id")),
    ]
    return Graph(reduce(DataFrame.unionByName, nodes).select(*NODE_SCHEMA.names), reduce(DataFrame.unionByName, edges).select(*EDGE_SCHEMA.names), closed=True)


def _sql_node(label: str, source: str, key: str, name: str, props: str = "'{}'") -> str:
    low, k = label.lower(), f"CAST({key} AS BIGINT)"
    return (
        f"SELECT {LABELS[label] * BASE} + {k} AS id, 'tpch' AS project, '{label}' AS label, CAST({name} AS VARCHAR) AS name, 'tpch.{low}.' || CAST({k} AS VARCHAR) AS qualified_name, "
        f"'{low}/' || CAST({k} % 16 AS VARCHAR) || '/file{_SUFFIX[label]}' AS file_path, CAST({k} % 1000 AS INT) AS start_line, CAST({k} % 1000 + {k} % 50 AS INT) AS end_line, CAST({props} AS VARCHAR) AS properties FROM {source}"
    )


def _sql_edge(kind: str, source: str, src: tuple[str, str], dst: tuple[str, str], props: str = "'{}'") -> str:
    return f"SELECT {LABELS[src[0]] * BASE} + CAST({src[1]} AS BIGINT) AS source_id, {LABELS[dst[0]] * BASE} + CAST({dst[1]} AS BIGINT) AS target_id, '{kind}' AS type, CAST({props} AS VARCHAR) AS properties FROM {source}"


#: The same graph for DuckDB, as two common table expressions.
GRAPH_SQL = "nodes AS (\n" + "\nUNION ALL ".join([
    _sql_node("Region", "region", "r_regionkey", "r_name"),
    _sql_node("Nation", "nation", "n_nationkey", "n_name"),
    _sql_node("Customer", "customer", "c_custkey", "c_name", "json_object('segment', c_mktsegment, 'acctbal', c_acctbal)"),
    _sql_node("Supplier", "supplier", "s_suppkey", "s_name", "json_object('acctbal', s_acctbal)"),
    _sql_node("Part", "part", "p_partkey", "p_name", "json_object('brand', p_brand, 'kind', p_type, 'size', p_size, 'price', p_retailprice)"),
    _sql_node("Order", "orders", "o_orderkey", "o_orderkey", "json_object('status', o_orderstatus, 'priority', o_orderpriority, 'total', o_totalprice)"),
    _sql_node("User", "(SELECT DISTINCT user_id FROM events)", "user_id", "user_id"),
    _sql_node("Event", "events", "event_id", "event_type", "json_object('k', CAST(props->>'$.k' AS BIGINT), 'value', value)"),
]) + "\n), edges AS (\n" + "\nUNION ALL ".join([
    _sql_edge("IN_REGION", "nation", ("Nation", "n_nationkey"), ("Region", "n_regionkey")),
    _sql_edge("IN_NATION", "customer", ("Customer", "c_custkey"), ("Nation", "c_nationkey")),
    _sql_edge("IN_NATION", "supplier", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey")),
    _sql_edge("PLACED", "orders", ("Customer", "o_custkey"), ("Order", "o_orderkey")),
    _sql_edge("CONTAINS", "(SELECT l_orderkey, l_partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL)", ("Order", "l_orderkey"), ("Part", "l_partkey"), "json_object('quantity', quantity)"),
    _sql_edge("SUPPLIED_BY", "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)", ("Part", "l_partkey"), ("Supplier", "l_suppkey")),
    _sql_edge("NEXT", "(SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events) WHERE next_id IS NOT NULL", ("Event", "event_id"), ("Event", "next_id")),
]) + "\n)"


def graph_query(sql: str) -> str:
    """DuckDB SQL over nodes and edges; `sql` starts with SELECT, or with further
    expressions after "WITH "."""
    rest = f", {sql.strip()[5:]}" if sql.strip().upper().startswith("WITH ") else f"\n{sql}"
    return f"WITH RECURSIVE {GRAPH_SQL}{rest}"
