import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("OMP_NUM_THREADS", "2")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").config("spark.default.parallelism", "4")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def graph_of(spark, nodes, edges):
    """A small graph: nodes (key, label, name, qualified name, path, start, end, props),
    edges (source, target, type, props)."""
    from lattica.model import EDGE_SCHEMA, NODE_SCHEMA, Graph

    ids = {n[0]: i + 1 for i, n in enumerate(nodes)}
    n = [(ids[k], "test", label, name, qn, path, a, b, props) for k, label, name, qn, path, a, b, props in nodes]
    e = [(i + 1, "test", ids[s], ids[t], kind, props) for i, (s, t, kind, props) in enumerate(edges)]
    return Graph(spark.createDataFrame(n, NODE_SCHEMA), spark.createDataFrame(e, EDGE_SCHEMA)), ids


@pytest.fixture(scope="session")
def make_graph(spark):
    return lambda nodes, edges: graph_of(spark, nodes, edges)
