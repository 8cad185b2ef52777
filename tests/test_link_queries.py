"""Queries of derived edges and lookups, against their SQL over whole tables."""

from collections import Counter

import pytest

from lattica.queries import links

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", links.QUERIES)
def test_query_equals_its_sql(spark, duck, name):
    found = links.QUERIES[name](spark, SF)
    told = duck.execute(links.SQL[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(found.columns)
    want, got = Counter(told.fetchall()), Counter(map(tuple, found.select(*columns).collect()))
    assert got == want and got
