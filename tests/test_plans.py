"""Plans: what is scanned, what is pushed down, what is shuffled."""

import re

import pytest

from lattica.plans.builder import compile_query
from lattica.sources.star import star_graph

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plan(spark):
    graph = star_graph(spark, SF)
    return lambda query: compile_query(graph, query)._jdf.queryExecution().executedPlan().toString()


def scans(text):
    return sorted(set(re.findall(rf"{SF}/(\w+)\.parquet", text)))


def test_a_label_leaves_one_branch_and_its_columns(plan):
    text = plan("MATCH (o:Order) WHERE o.status = 'F' RETURN o.name")
    assert scans(text) == ["orders"]
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string", text) and "o_orderdate" not in text


def test_types_leave_their_tables(plan):
    assert scans(plan("MATCH (s:Supplier)-[:IN_NATION]->(n:Nation) RETURN s.name, n.name")) == ["customer", "nation", "supplier"]
    assert scans(plan("MATCH (c)-[:PLACED]->(o)-[:CONTAINS]->(p) RETURN COUNT(p)")) == ["lineitem", "orders"]


def test_counts_are_summed_before_the_shuffle(plan):
    text = plan("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.segment, COUNT(o) AS n ORDER BY n DESC LIMIT 5")
    assert "partial_count" in text and "TakeOrderedAndProject" in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_id_ranges_reach_the_scan(plan):
    text = plan("MATCH (n:Nation) WHERE n.id > 2000000000005 RETURN n.name")
    assert scans(text) == ["nation"] and "n_nationkey" in text
