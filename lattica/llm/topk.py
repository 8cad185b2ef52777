"""Exact top-k search over binary codes by multi-index hashing (operator 9).

Codes are cut into segments, each with its own index. A round probes every segment
with all values at one more bit of distance from the query's. A code that no round
up to radius r has met differs by more than r bits in each of m segments, so by
m * (r + 1) bits at least: once a query's k-th verified distance is below that, it
is proven and the query leaves.

Rows with equal codes are one class with its smallest ids, so a frequent code is
one entry of the index; a candidate counts only where it is first met, so nothing
has to be made distinct.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Workspace, map_arrow

#: Neighbours of a query, and every how many ids one is a query (op9).
K = 10
QUERY_EVERY = 20
_SALTS = 64
#: Probes that a task makes, about.
_TASK_PROBES = 250_000


def segment_widths(bits: int, rows: int) -> list[int]:
    """Segments of about log2(rows) bits, so that an index entry holds about one row."""
    m = max(1, min(bits, round(bits / max(1.0, log2(max(rows, 2))))), ceil(bits / 62))
    return [bits * (i + 1) // m - bits * i // m for i in range(m)]


def binary_codes(vectors: DataFrame, widths: list[int]) -> DataFrame:
    """(vec_id, s0, s1, ...): the signs of the embedding's values, cut into segments.
    Missing values count as not positive; rows with a null embedding are left out."""
    bits, edges = sum(widths), np.cumsum([0, *widths])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            sizes = np.diff(rows.offsets.to_numpy())
            flat = rows.flatten().to_numpy(zero_copy_only=False)
            grid = np.zeros((batch.num_rows, bits), bool)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            grid[owner, place] = flat > 0  # false for null, which is NaN here
            segments = [grid[:, a:b] @ (1 << np.arange(b - a, dtype=np.int64)) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, segments)], names=["vec_id", *(f"s{i}" for i in range(len(widths)))])

    schema = "vec_id long, " + ", ".join(f"s{i} long" for i in range(len(widths)))
    some = vectors.where("embedding is not null and vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return map_arrow(some, run, schema)


def _probes(active: DataFrame, widths: list[int], radius: int) -> DataFrame:
    """The columns of active with segment and value: for every segment all values that
    differ in exactly `radius` bits, made in blocks."""
    names = [f"q{i}" for i in range(len(widths))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [np.array([sum(1 << b for b in c) for c in combinations(range(w), radius)], np.int64) if radius <= w else np.zeros(0, np.int64) for w in widths]
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            for i, mask in enumerate(masks):
                step = max(1, 200_000 // max(1, len(mask)))
                for at in range(0, batch.num_rows if len(mask) else 0, step):
                    part = [np.repeat(c[at : at + step], len(mask)) for c in columns]
                    value = (columns[i][at : at + step, None] ^ mask[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([*map(pa.array, part), pa.array(np.full(len(value), i, np.int32)), pa.array(value)], names=[*names, "segment", "value"])

    return map_arrow(active, run, ", ".join(f"{n} long" for n in names) + ", segment int, value long")


def _first_ids(codes: DataFrame, segments: list[str], most: int) -> DataFrame:
    """Each distinct code with its `most` smallest ids. Tasks keep no more of a code
    than that from a batch; salts spread what they send of a frequent one."""
    m = len(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches):
            columns = [batch.column(i).to_numpy() for i in range(m + 1)]
            order = np.lexsort((columns[0], *columns[:0:-1]))
            grid = np.stack(columns[1:])[:, order]
            fresh = np.concatenate(([True], (grid[:, 1:] != grid[:, :-1]).any(axis=0)))
            starts = np.flatnonzero(fresh)
            at = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
            kept = order[at < most]
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns], names=["vec_id", *segments])

    slim = map_arrow(codes, run, codes.schema)
    some = slim.groupBy(*segments, F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS)).alias("salt")).agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, most).alias("ids"))
    return some.groupBy(*segments).agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, most).alias("ids"))


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The `k` rows of `vectors` (vec_id, embedding) nearest to each row of `queries`
    (the same columns) by Hamming distance of their sign codes: vec_id, rank,
    neighbour_id, distance. Exact; ties go to the smaller id; a query's own id is
    not its neighbour. Fewer than k others give fewer rows. Null ids or embeddings
    are neither found nor answered; null values and NaN within one count as not
    positive, as do those that a shorter embedding lacks; of queries that repeat an id and a code one
    is answered. Empty tables give an empty result; other columns are ignored."""
    space = Workspace(spark, "topk")
    shape = vectors.select("embedding").union(queries.select("embedding")).agg(F.max(F.size("embedding")).alias("bits"), F.count(F.lit(1)).alias("n")).first()
    bits = max(1, shape["bits"] or 1)
    widths = segment_widths(bits, shape["n"])
    names = [f"s{i}" for i in range(len(widths))]
    classes = space.table("classes", _first_ids(binary_codes(vectors, widths), names, k + 1))
    asked = space.table("asked", binary_codes(queries, widths).distinct())
    postings = space.table("postings", classes.select(F.posexplode(F.array(*names)).alias("segment", "value"), *names, "ids"))
    q = [F.col(f"q{i}") for i in range(len(widths))]
    active = asked.select(*(F.col(s).alias(f"q{i}") for i, s in enumerate(names))).distinct()
    code = [f"q{i}" for i in range(len(widths))]
    schema = active.withColumns({"distance": F.lit(0), "id": F.lit(0).cast("long")}).schema
    best, done = spark.createDataFrame([], schema), []
    n_active = active.count()
    order = Window.partitionBy(*code).orderBy("distance", "id")
    for radius in range(max(widths) + 1):
        each = sum(comb(w, radius) for w in widths)
        probes = _probes(active.repartition(max(1, ceil(n_active * each / _TASK_PROBES))), widths, radius)
        apart: list[Column] = [F.bit_count(q[i].bitwiseXOR(F.col(s))) for i, s in enumerate(names)]
        # First met here: no segment is nearer, and none before this one as near.
        first = reduce(lambda a, b: a & b, [(d > radius) | ((d == radius) & (F.col("segment") <= i)) for i, d in enumerate(apart)])
        # Neither side has a bound, and the planner can't see how many probes come of a query.
        met = probes.join(postings.hint("merge"), ["segment", "value"]).where(first).select(*code, sum(apart[1:], apart[0]).cast("int").alias("distance"), F.explode("ids").alias("id"))
        ranked = best.join(active, code, "left_semi").unionByName(met).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
        state = space.table(f"best{radius}", ranked.drop("n"))
        if radius > 1:
            space.drop(f"best{radius - 2}", f"active{radius - 2}")
        proven = state.groupBy(*code).agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).where((F.col("n") > k) & (F.col("far") < len(widths) * (radius + 1))).select(*code)
        last = radius == max(widths)
        over = state if last else state.join(proven, code, "left_semi")
        done.append(space.table(f"done{radius}", over))
        if last:
            break
        active, best = space.table(f"active{radius}", active.join(proven, code, "left_anti")), state
        n_active = active.count()
        if not n_active:
            break
    found = reduce(DataFrame.unionByName, done)
    for i, s in enumerate(names):
        found = found.withColumnRenamed(f"q{i}", s)
    own = asked.join(found, names).where(F.col("id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("vec_id", *names).orderBy("distance", "id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", F.col("id").alias("neighbour_id"), "distance")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(spark, vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


OP9_SQL = """
WITH c AS (SELECT vec_id, list_reduce(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN 1::UBIGINT << (i - 1) ELSE 0::UBIGINT END), lambda a, b: a | b) AS code FROM embeddings),
d AS (SELECT q.vec_id, r.vec_id AS neighbour_id, bit_count(xor(q.code, r.code))::INT AS distance FROM c q JOIN c r ON r.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS n FROM d)
SELECT vec_id, n::INT AS rank, neighbour_id, distance FROM k WHERE n <= 10
"""
