"""Edges that an index makes, and joins under skew."""

from pyspark.sql import functions as F

from lattica.operators import joins, resolve

SOURCES = {
    "shop/api.py": 'from fastapi import APIRouter\nfrom shop.model import Order\n\nrouter = APIRouter()\nLIMIT = 5\n\n@router.get("/orders/{order_id}")\ndef read_order(order_id: int) -> Order:\n    return LIMIT\n\ndef reset():\n    global LIMIT\n    LIMIT = 0\n\ndef local():\n    LIMIT = 1\n    return "conf/app.toml"\n',
    "shop/model.py": "class Order:\n    total: int = 0\n",
    "shop/late.py": "def late(request):\n    return request\n",
    "app/main.py": 'import os\nfrom shop.api import router as orders\nfrom shop.late import late\n\nDATABASE_URL = "x"\n\ndef setup(app):\n    app.include_router(orders, prefix="/v1")\n    app.add_api_route("/late", late)\n\ndef connect():\n    return os.getenv("DATABASE_URL")\n',
    "web/client.py": 'ORDERS = "http://orders.local/v1/orders/7"\n',
    "conf/app.toml": "[server]\nbase_limit = 3\n\n[dependencies]\nthing = 1\n",
    "conf/use.py": "def getBaseLimit():\n    return 1\n",
}


def test_index_links(spark, tmp_path):
    from lattica.api import Engine

    source = tmp_path / "source"
    for path, text in SOURCES.items():
        (source / path).parent.mkdir(parents=True, exist_ok=True)
        (source / path).write_text(text)
    commits = "".join(f"COMMIT:{i}a\nshop/api.py\nshop/model.py\n" for i in range(4)) + "COMMIT:ff\nweb/client.py\n"
    engine = Engine(spark, str(tmp_path / "graphs"))
    engine.index_repository(str(source), "p", commits)
    graph = engine.graph
    names = {r["id"]: r["qualified_name"].removeprefix("p.") for r in graph.nodes.collect()}
    rows = graph.edges.collect()
    of = lambda kind: {(names[r["source_id"]], names[r["target_id"]]) for r in rows if r["type"] == kind}
    assert of("HANDLES") == {("shop.api.read_order", "__route__.GET./v1/orders/{order_id}"), ("shop.late.late", "__route__.ANY./late")}
    assert ("app.main.setup", "shop.late.late") in of("CALLS")
    assert of("HTTP_CALLS") == {("web.client", "shop.api.read_order")}
    assert of("WRITES") == {("shop.api.reset", "shop.api.LIMIT")}
    assert ("shop.api.read_order", "shop.api.LIMIT") in of("READS")
    assert of("USES_TYPE") == {("shop.api.read_order", "shop.model.Order")}
    assert of("DEFINES_FIELD") == {("shop.model.Order", "shop.model.Order.total")}
    assert of("FILE_CHANGES_WITH") == {("shop.api.__file__", "shop.model.__file__")}
    assert of("CONFIGURES") == {("app.main", "app.main.connect"), ("app.main.DATABASE_URL", "app.main.connect"), ("conf.app.server.base_limit", "conf.use.getBaseLimit"), ("conf.app", "shop.api.local")}
    assert len({r["id"] for r in rows}) == len(rows)


def test_names_with_many_candidates(spark):
    """A name of very many definitions is met only below what is imported."""
    qns = [f"p.m{i}.sub.get" for i in range(2000)]
    known = spark.createDataFrame([("p", q, "get", "Function") for q in qns], "project string, qualified_name string, name string, label string")
    refs = spark.createDataFrame([(i, "p", "u.get", "p.x", {"u": f"p.m{i}"}) for i in range(300)] + [(1000, "p", "get", "p.x", None), (1001, "p", "u.get", "p.x", {"u": "p.none"})], "ref_id long, project string, callee string, module_qn string, imports map<string,string>")
    found = {r["ref_id"]: (r["target_qn"], r["strategy"], r["candidates"]) for r in resolve.resolve(refs, known).collect()}
    assert found == {i: (f"p.m{i}.sub.get", "import_map_suffix", 2000) for i in range(300)}
    few = known.limit(resolve.MOST_CANDIDATES)
    one = resolve.resolve(refs.where("ref_id = 1000"), few).first()
    assert one["strategy"] == "suffix_match" and one["confidence"] >= resolve.LEAST


def test_division_meets_on_the_rarest_item(spark):
    """An item that all have makes no pairs where the group has a rarer one."""
    have = spark.range(3000).select(F.col("id").alias("o"), F.explode(F.array(F.lit("all"), F.concat(F.lit("own"), F.col("id").cast("string")))).alias("i"))
    need = spark.range(3000).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("g"), F.explode(F.array(F.lit("all"), F.concat(F.lit("own"), F.col("id").cast("string")))).alias("i"))
    got = joins.covering(have, need.union(spark.createDataFrame([("lost", "all"), ("lost", "none"), ("null", None)], "g string, i string")), "o", "g", "i")
    assert got.count() == 3000 and got.where(F.col("g") != F.concat(F.lit("g"), F.col("o").cast("string"))).isEmpty()


def test_containing_and_overlapping(spark, make_graph):
    texts = spark.createDataFrame([(1, "get_user_name"), (2, "get"), (3, ""), (4, "user_get_user")], "id long, t string")
    keys = spark.createDataFrame([("get",), ("user_name",), ("user",), ("a_very_long_key",)], "k string")
    got = {(r["id"], r["k"]) for r in joins.containing(texts, keys, "t", "k").collect()}
    assert got == {(1, "get"), (1, "user_name"), (1, "user"), (2, "get"), (4, "user"), (4, "get")}
    assert joins.containing(texts, keys.limit(0), "t", "k").count() == 0
    g, _ = make_graph([(f"n{i}", "Function", "f", f"t.d{i}.f", f"d{i}/sub/index.js", 1, 9, "{}") for i in range(50)], [])
    hunks = spark.createDataFrame([("d7/sub/index.js", 2, 3), ("sub/index.js", 20, 30), ("b/index.js", 1, 1)], "path string, start_line int, end_line int")
    assert [r["file_path"] for r in joins.overlapping(g.nodes, hunks).collect()] == ["d7/sub/index.js"]
