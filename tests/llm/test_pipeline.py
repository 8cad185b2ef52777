"""The corpus pipeline and the registry."""

import random

from pyspark.sql import functions as F


def test_stages_keep_clean_documents_and_drop_the_rest(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    kinds = {"xx": "abcdefgh", "yy": "ijklmnop"}

    def text(k, n):
        return " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize() + "."

    rows = [(i, text(k, rng.randint(30, 80)), k, "s", 0) for i, k in enumerate(["xx", "yy"] * 150)]
    junk = [(1000 + i, "spam " * 80, "xx", "s", 0) if i % 2 else (1000 + i, text("xx", 40).upper().replace(" ", "!! "), "xx", "s", 0) for i in range(60)]
    copies = [(2000 + i, rows[i][1].replace(" ", "  "), rows[i][2], "s", 0) for i in range(10)]
    near = [(3000 + i, rows[20 + i][1] + " more", rows[20 + i][2], "s", 0) for i in range(10)]
    odd = [(4000, None, "xx", "s", 0), (4001, "", "xx", "s", 0), (4002, "12 34", "xx", "s", 0), rows[5], rows[5]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows + junk + copies + near + odd, schema).withColumn("score", F.lit("clash")).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] % 2] + [(j[0], 0, 0) for j in junk], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    clean = {r[0] for r in rows}
    assert not {4000, 4001, 4002} & set(kept["language_id"]) and clean <= set(kept["language_id"])
    assert len(clean & set(kept["quality"])) >= 0.98 * len(clean) and not {j[0] for j in junk} & set(kept["quality"])
    assert len(set(kept["exact_dedup"])) == len(kept["exact_dedup"]) and all((2000 + i in kept["exact_dedup"]) for i in range(10) if 2000 + i in kept["quality"])
    assert not {i for i in range(10) if 2000 + i in kept["exact_dedup"]} & set(kept["exact_dedup"])  # the copy has more code points
    pairs = [(20 + i, 3000 + i) for i in range(10)]
    assert all(len({a, b} & set(kept["near_dedup"])) == 1 for a, b in pairs if {a, b} <= set(kept["exact_dedup"]))
    assert sorted(set(kept["packing"])) == kept["near_dedup"]


def test_run_of_few_and_of_no_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)).capitalize() + "."
    rows = [(i, text(), "xx", "s", 0) for i in range(80)] + [(100, None, None, None, None), (None, text(), "xx", "s", 0)]
    for name, some in (("few", rows + rows[:3]), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)][: len(some)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    out = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "few")).collect()]
    assert len(out) == len(set(out)) and set(range(80)) - set(out) == set() and 100 not in out
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_registry_names():
    import __spark_entry__
    from lattica.llm.registry import ORACLE_SQL, QUERIES

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert all(isinstance(x, str) for x in __spark_entry__.oracle_sql().values())
    assert set(ORACLE_SQL) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)
