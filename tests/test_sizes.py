"""Work that is spread over tasks, however rows are dealt over keys."""

import pytest
from pyspark.sql import functions as F

from lattica.model import EDGE_SCHEMA, Graph
from lattica.operators import http, joins, search


def _shuffled(spark, df):
    """Rows that df writes to shuffles as it runs."""
    told = lambda: {x.stageId(): x.shuffleWriteRecords() for x in _stages(spark)}
    before = told()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for k, n in told().items() if k not in before)


def _stages(spark):
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


def _one_path(spark, n):
    """Sites and routes that all have one path."""
    ids = spark.range(n).select(F.col("id").cast("string").alias("k"), F.concat(F.lit("/api/o"), (F.col("id") * 0).cast("string")).alias("path"))
    sites = ids.select("path", F.lit("GET").alias("method"), F.concat(F.lit("s"), "k").alias("source_qualified_name"), F.lit("Function").alias("source_label"), F.lit(False).alias("is_async"))
    return sites, ids.select("path", F.lit("GET").alias("method"), F.concat(F.lit("r"), "k").alias("qualified_name"))


def test_pairs_of_one_path_are_spread(spark):
    """Two thousand sites and routes of one path: all pairs, and no task makes most of them."""
    found = http.match(*_one_path(spark, 2000)).groupBy(F.spark_partition_id()).agg(F.count("route_qn").alias("n")).collect()
    assert sum(r["n"] for r in found) == 4_000_000 and max(r["n"] for r in found) <= 3_000_000


def _many_paths(spark, n, wild):
    """Sites and routes of n paths each: on the side that is `wild` they are one path when
    normalised, on the other all differ, and each two match."""
    one, other = F.concat(F.lit("/en/"), F.col("id").cast("string")), F.concat(F.lit("/en/p"), F.col("id").cast("string"), F.lit(".html"))
    call, route = (one, other) if wild == "sites" else (other, one)
    rows = spark.range(n)
    sites = rows.select(call.alias("path"), F.lit("GET").alias("method"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source_qualified_name"), F.lit("Function").alias("source_label"), F.lit(False).alias("is_async"))
    return sites, rows.select(route.alias("path"), F.lit("GET").alias("method"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("qualified_name"))


@pytest.mark.parametrize("wild", ["sites", "routes"])
def test_sites_are_not_sent_to_each_path(spark, wild):
    """A path that a thousand others match: rows are dealt once, not once for each of them."""
    found = http.match(*_many_paths(spark, 1000, wild), digits=6)
    told = found.groupBy("confidence", "band").count().collect()
    assert [(r["confidence"], r["band"], r["count"]) for r in told] == [(0.420833, "speculative", 1_000_000)]
    assert _shuffled(spark, found) <= 60_000


def _named(spark, names):
    return Graph(spark.createDataFrame([(i, "p", q) for i, q in enumerate(names)], "id long, project string, qualified_name string"), spark.createDataFrame([], EDGE_SCHEMA))


def test_edges_of_one_path_are_spread(spark):
    """The most certain match of each pair, and no task that makes most of them."""
    sites, routes = _one_path(spark, 300)
    more = spark.createDataFrame([("/x/api/o0", "GET", "s1", "Function", False), ("/api/o0/", "POST", "s2", "Function", False), ("/api/o0", "", "s3", "Function", True)], sites.schema)
    more_routes = spark.createDataFrame([("/api/o0", "POST", "r1"), ("/x/api/o0", "GET", "r2")], routes.schema)
    names = [f"{k}{i}" for k in "sr" for i in range(300)]
    edges = http.link_edges(sites.union(more), routes.union(more_routes), _named(spark, names))
    best = {}
    for x in http.match(sites.union(more), routes.union(more_routes)).collect():
        k = (x["source_qualified_name"], x["route_qn"], x["type"])
        best[k] = max(best.get(k, (0, "")), (round(x["confidence"], 4), x["url_path"]))
    p = lambda n: F.get_json_object("properties", f"$.{n}")
    got = edges.select("source_id", "target_id", "type", p("confidence").cast("double").alias("c"), p("url_path").alias("u")).collect()
    assert {(names[x["source_id"]], names[x["target_id"]], x["type"]): (x["c"], x["u"]) for x in got} == best and len(got) == len(best)
    found = http.link_edges(*_one_path(spark, 2000), _named(spark, [f"{k}{i}" for k in "sr" for i in range(2000)])).groupBy(F.spark_partition_id()).agg(F.count("target_id").alias("n")).collect()
    assert sum(r["n"] for r in found) == 4_000_000 and max(r["n"] for r in found) <= 3_000_000


@pytest.mark.parametrize("wild", ["sites", "routes"])
def test_linked_sites_are_not_sent_to_each_path(spark, wild):
    """The same for edges."""
    found = http.link_edges(*_many_paths(spark, 1000, wild), _named(spark, [f"{k}{i}" for k in "sr" for i in range(1000)]))
    assert [tuple(r) for r in found.groupBy(F.get_json_object("properties", "$.confidence")).count().collect()] == [("0.4208", 1_000_000)]
    assert _shuffled(spark, found) <= 120_000


def test_edges_are_not_written_as_json_to_be_read_again(spark):
    from lattica.queries import links

    plan = links.QUERIES["http_call_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "json" not in plan


def test_keys_of_one_name_are_spread(spark):
    """Two thousand keys and symbols of one name: all pairs, and no task makes most of them."""
    rows = spark.range(2000).select("id", F.concat(F.lit("base"), F.translate((F.col("id") * 0).cast("string"), "0", "_"), F.lit("limit")).alias("name"))
    found = joins.config_key_symbols(rows, rows).groupBy(F.spark_partition_id()).agg(F.count("code_id").alias("n"), F.count_if(F.col("confidence") == 0.85).alias("k")).collect()
    assert sum(r["n"] for r in found) == sum(r["k"] for r in found) == 4_000_000 and max(r["n"] for r in found) <= 3_000_000


def test_keys_of_one_name_travel_as_lists(spark):
    """Six thousand keys of one name: rows are dealt once, not once for each block they meet."""
    rows = spark.range(6000).select("id", F.concat(F.lit("base"), F.translate((F.col("id") * 0).cast("string"), "0", "_"), F.lit("limit")).alias("name"))
    found = joins.config_key_symbols(rows, rows)
    assert found.count() == 36_000_000 and _shuffled(spark, found) <= 40_000


def test_different_names_are_normalised_once(spark):
    """No step that meets every row has a regular expression in it."""
    rows = spark.sql("SELECT id, concat('base_', id % 2, 'limit') AS name FROM range(100) WHERE id < 50")
    plan = joins.config_key_symbols(rows, rows)._jdf.queryExecution().optimizedPlan().toString()
    over = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "regexp_replace" in line:
            under = next(x for x in lines[i + 1 :] if over(x) > over(line) and not x.lstrip(" :+-").startswith(("Filter", "Project")))
            assert under.lstrip(" :+-").startswith("Aggregate")


def test_nodes_of_few_hunks_are_not_shuffled(spark, make_graph, monkeypatch):
    """Few hunks go to the nodes; with many, the result is the same."""
    g, _ = make_graph([(f"n{i}", "Function", "f", f"t.f{i}", "src/main.js", i, i, "{}") for i in range(50)], [])
    hunks = spark.createDataFrame([("main.js", 3, 5), ("src/main.js", 40, 90)], "path string, start_line int, end_line int")
    few = joins.overlapping(g.nodes, hunks)
    monkeypatch.setattr(joins, "SENT_HUNKS", 1)
    many = joins.overlapping(g.nodes, hunks)
    assert sorted(r["start_line"] for r in few.collect()) == sorted(r["start_line"] for r in many.collect()) == [3, 4, 5, *range(40, 50)]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_degrees_of_one_label_read_its_edges_only(spark, make_graph):
    """Edges of other labels aren't counted; loops and nodes without edges are right."""
    g, ids = make_graph([(k, label, k, k, "a.py", 1, 1, "{}") for k, label in (("a", "A"), ("b", "A"), ("c", "A"), ("x", "B"), ("y", "B"))], [("a", "b", "E", "{}"), ("b", "b", "E", "{}"), ("b", "x", "E", "{}"), ("x", "y", "E", "{}"), ("y", "x", "F", "{}")])
    found = lambda **k: {r["name"]: (r["in_degree"], r["out_degree"]) for r in search.search(g, **k).collect()}
    assert found(label="A") == {"a": (0, 1), "b": (2, 2), "c": (0, 0)} and found(label="none") == {}
    assert found(label="B", relationship="E") == {"x": (1, 1), "y": (1, 0)}
    counted = search.search(g, label="A").where("in_degree + out_degree > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert f"<= {ids['c']}" in counted


def test_summary_sends_no_members(spark, make_graph):
    """Members are joined by a shuffle, however small their files are."""
    from lattica.operators import community

    g, ids = make_graph([(k, "Function", k, f"p.{k}", "a.py", 1, 1, "{}") for k in "ab"], [("a", "b", "CALLS", "{}")])
    members = spark.sql(f"SELECT 'test' AS project, id, {ids['a']}L AS community FROM VALUES ({ids['a']}L), ({ids['b']}L) t(id)")
    rows = community.cluster_summary(g, members)
    assert [(r["members"], r["cohesion"], r["top"]) for r in rows.collect()] == [(2, 1.0, ["b", "a"])]


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_edges_are_not_sorted_to_meet_their_ends(spark, make_graph, monkeypatch):
    """With many nodes each task holds nodes alone; the result is that of few nodes. An end
    that is no node doesn't count, a node that is there twice counts twice."""
    from lattica.operators import architecture

    g, ids = make_graph([(k, label, k, f"t.{k}.f", "a.py", 1, 1, "{}") for k, label in (("a", "A"), ("b", "A"), ("x", "B"))], [("a", "b", "E", "{}"), ("b", "b", "E", "{}"), ("b", "x", "F", "{}"), ("a", "x", "F", "{}")])
    lost = g.edges.limit(1).withColumn("target_id", F.lit(99).cast("long"))
    g = Graph(g.nodes.union(g.nodes.where("name = 'x'")), g.edges.union(lost))
    few = architecture.patterns(g).collect(), sorted(architecture.boundaries(g, None, ("E", "F")).collect())
    monkeypatch.setattr(architecture, "FEW_NODES", 1)
    many, crossed = architecture.patterns(g), architecture.boundaries(g, None, ("E", "F"))
    assert (many.collect(), sorted(crossed.collect())) == few
    assert [r["pattern"] for r in few[0]] == ["(:A)-[:F]->(:B) [4x]", "(:A)-[:E]->(:A) [2x]"]
    for rows in (many, crossed):
        assert "ShuffledHashJoin" in _plan(rows) and "SortMergeJoin" not in _plan(rows)


def test_large_tables_are_dealt_before_they_are_grouped(spark, monkeypatch):
    """Edges of a large lineitem: all partitions stay, and the result is that of a small one."""
    from lattica.sources import star

    kinds = "type in ('CONTAINS', 'SUPPLIED_BY')"
    rows = lambda: star.star_graph(spark, "/root/testdata/sf0.001").edges.where(kinds)
    small = rows()
    monkeypatch.setattr(star, "DEALT_ROWS", 100)
    large = rows()
    assert sorted(small.collect()) == sorted(large.collect())
    plan = _plan(large)
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert large.groupBy("type", F.spark_partition_id()).count().count() == 2 * tasks
