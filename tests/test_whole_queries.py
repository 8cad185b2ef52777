"""Registered queries over whole tables, against their SQL over whole tables."""

from collections import Counter

import pytest

SF = "/root/testdata/sf0.01"
NAMES = ["hunk_carry_forward", "string_similarity", "edge_upsert_merge", "snippet_lines", "dependents", "config_key_match", "resolve_ladder", "search_dead_code"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", NAMES)
def test_query_covers_every_row(spark, duck, name):
    import __spark_entry__

    found = __spark_entry__.queries()[name](spark, SF)
    told = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in told.description]
    want, got = Counter(told.fetchall()), Counter(map(tuple, found.select(*columns).collect()))
    assert sum(got.values()) == sum(want.values()) and got == want
