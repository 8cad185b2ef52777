"""Files that are read, and what an index makes of them."""


def test_large_files_are_indexed(spark, tmp_path):
    from lattica.api import Engine
    from lattica.sources.files import discover

    source = tmp_path / "source"
    source.mkdir()
    (source / "small.py").write_text("def small():\n    return 1\n")
    (source / "large.py").write_text("def large():\n    return 2\n" + "# line\n" * 200_000)
    sizes = {r["rel_path"]: len(r["text"]) for r in discover(spark, str(source), "p").collect()}
    assert set(sizes) == {"small.py", "large.py"} and sizes["large.py"] > 1_000_000
    assert [r["rel_path"] for r in discover(spark, str(source), "p", most_bytes=1000).collect()] == ["small.py"]
    engine = Engine(spark, str(tmp_path / "graphs"))
    assert engine.index_repository(str(source), "p") == {"new": 2}
    names = {r["name"] for r in engine.graph.labelled("Function").select("name").collect()}
    assert names == {"small", "large"}


def test_ignored_files_are_not_indexed(spark, tmp_path):
    from lattica.sources.files import discover

    for path, text in {".gitignore": "*.tmp.py\nout/\n", "a.py": "", "b.tmp.py": "", "out/c.py": "", "sub/.gitignore": "/d.py\n!e.py\n", "sub/d.py": "", "sub/e.py": "", "sub/deep/d.py": ""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = {r["rel_path"] for r in discover(spark, str(tmp_path), "p").select("rel_path").collect()}
    assert found == {".gitignore", "a.py", "sub/.gitignore", "sub/e.py", "sub/deep/d.py"}


def test_communities_are_indexed(spark, tmp_path):
    from lattica.api import Engine

    source = tmp_path / "source"
    source.mkdir()
    (source / "a.py").write_text("def a1():\n    a2()\n\ndef a2():\n    a3()\n\ndef a3():\n    a1()\n")
    (source / "b.py").write_text("def b1():\n    b2()\n\ndef b2():\n    b1()\n\ndef alone():\n    pass\n")
    engine = Engine(spark, str(tmp_path / "graphs"))
    engine.index_repository(str(source), "p")
    rows = engine.query_graph("MATCH (f)-[:MEMBER_OF]->(c:Community) RETURN f.name, c.name", "p").collect()
    groups = {}
    for name, community in map(tuple, rows):
        groups.setdefault(community, set()).add(name)
    assert sorted(map(sorted, groups.values())) == [["a1", "a2", "a3"], ["b1", "b2"]]


def test_routes_and_usages_are_indexed(spark, tmp_path):
    from lattica.api import Engine

    source = tmp_path / "source"
    (source / "shop").mkdir(parents=True)
    (source / "web").mkdir()
    (source / "shop" / "api.py").write_text('app = make()\n\n@app.get("/orders/{order_id}")\ndef read_order(order_id):\n    return order_id\n')
    (source / "web" / "client.py").write_text('import requests\n\ndef fetch_order():\n    return requests.get("http://orders.local/orders/7")\n\ndef listed():\n    return [fetch_order]\n\ndef run():\n    return fetch_order()\n')
    engine = Engine(spark, str(tmp_path / "graphs"))
    engine.index_repository(str(source), "p")
    graph = engine.graph
    names = {r["id"]: (r["label"], r["name"]) for r in graph.nodes.collect()}
    edges = {(r["type"], names[r["source_id"]][1], names[r["target_id"]][1]) for r in graph.edges.where("type in ('HANDLES', 'HTTP_CALLS', 'USAGE')").collect()}
    assert edges == {("HANDLES", "read_order", "GET /orders/{order_id}"), ("HTTP_CALLS", "fetch_order", "read_order"), ("USAGE", "listed", "fetch_order")}
    assert [tuple(r) for r in engine.get_architecture("p", ("routes",))["routes"].collect()] == [("GET", "/orders/{order_id}", "read_order")]
    assert [r["name"] for r in engine.get_architecture("p", ("entry_points",))["entry_points"].collect()] == ["read_order"]
