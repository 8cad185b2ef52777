"""Near-duplicate groups by DartMinHash signatures (operator 2).

A text is a weighted set of word shingles. Darts are thrown, by hash, into the
plane of weight and rank of every shingle; those that land under its weight count,
and for each coordinate of the signature the earliest dart is kept. Two sets share
a coordinate with the probability of their weighted Jaccard similarity. Bands of
the signature bring candidates together, and every link is confirmed on the sets.

Copies with equal sets are one class, and a bucket is not paired off: its members
meet one hub, the member that most other texts share buckets with. Links join
classes to components. Members of buckets that still hold several components are
compared by their scarcest shingles: with shingles ordered from scarce to frequent,
two sets of the threshold's similarity share one of the first few of each, however
large a bucket is. Of the classes that have such a shingle, those outside the largest
component meet the rest; where these are many, as among letters of one form, the next
shingles they share tell them apart first.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import GOLD, Workspace, arrow_map, binary_rows, map_arrow, mix64, sized, text_or_empty
from .shingles import WORDS, shingle_hashes

THRESHOLD = 0.8
#: Bands and coordinates of a band. A pair of similarity 0.8 shares no band with
#: probability (1 - 0.8**5)**30 = 7e-6.
BANDS, ROWS = 30, 5
#: Classes outside the largest component of a key that meet all of its rows; the units that
#: keys of more are told apart by, at most.
FEW, DEPTH = 8, 16
#: Pairs to try that aren't worth another unit; keys on which it is tried whether one is.
LEAST_WORK, TRIED = 1_000_000, 64
#: Bits of the filter of candidate ids, a fixed size: beyond its reach it lets more
#: texts through, and the joins stay exact.
FILTER_BITS = 1 << 23

_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)])


def dart_signature(elements: np.ndarray, weights: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """`size` dart identifiers: for each coordinate the earliest dart that lands
    under the weight of an element. Weights should not be far below 1: the plane
    of an element is cut into cells of one unit of weight by one of rank, each
    holding darts by a Poisson law of mean 1, all drawn from the cell's hash."""
    found = np.zeros(size, np.uint64)
    missing = np.ones(size, bool)
    limit = (size * log(max(size, 2)) + 3 * size) / float(weights.sum())
    reach = np.ceil(weights).astype(np.int64)
    with np.errstate(over="ignore"):
        column = np.repeat(np.arange(len(elements)), reach)
        level = np.arange(len(column)) - np.repeat(np.cumsum(reach) - reach, reach)
        base = mix64(elements[column] ^ mix64(level.astype(np.uint64) * GOLD + np.uint64(seed)))
        low = 0
        while True:
            ranks = np.arange(low, ceil(limit), dtype=np.uint64)
            cell = mix64(base[:, None] + ranks[None, :] * GOLD).ravel()
            darts = np.searchsorted(_POISSON, (cell >> np.uint64(11)) * (2.0**-53), "right")
            owner = np.repeat(np.arange(len(cell)), darts)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(darts) - darts, darts)
            dart = mix64(cell[owner] + (nth.astype(np.uint64) + np.uint64(1)) * GOLD)
            place = owner // len(ranks)
            rank = ranks[owner % len(ranks)] + (dart >> np.uint64(32)) * 2.0**-32
            height = level[place] + (dart & np.uint64(0xFFFFFFFF)) * 2.0**-32
            under = (height < weights[column[place]]) & (rank <= limit)
            dart, rank = mix64(dart[under]), rank[under]
            coordinate = (dart % np.uint64(size)).astype(np.int64)
            order = np.argsort(-rank, kind="stable")
            fresh = np.zeros(size, bool)
            fresh[coordinate] = True
            earliest = np.zeros(size, np.uint64)
            earliest[coordinate[order]] = dart[order]  # the last write is the earliest dart
            take = fresh & missing
            found[take], missing[take] = earliest[take], False
            if not missing.any():
                return found
            low, limit = ceil(limit) - 1, limit * 2  # the cell that the limit cut is thrown anew
            low = max(0, low)


def weighted_shingles(text: str, weighting: str = "set", words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles and weights: 1 each ("set") or their counts ("count")."""
    found, counts = np.unique(shingle_hashes(text, words), return_counts=True)
    return found, counts.astype(np.float64) if weighting == "count" else np.ones(len(found))


def _fingerprint(elements: np.ndarray, weights: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes() + weights.tobytes())


def sketches(docs: DataFrame, weighting: str = "set", bands: int = BANDS, rows: int = ROWS, words: int = WORDS, mark: str | None = None) -> DataFrame:
    """(doc_id, mark, cls, total, bands): the class of equal sets, the weight of the set,
    and the band keys, which a worker gives with the first text of a class only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(2).to_pylist()
                cls, total, keys = [], [], []
                for text in texts:
                    elements, weights = weighted_shingles(text, weighting, words)
                    cls.append(name := _fingerprint(elements, weights))
                    total.append(float(weights.sum()))
                    if name in seen or not len(elements):
                        keys.append(None)
                        continue
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(name)
                    signature = dart_signature(elements, weights, bands * rows).reshape(bands, rows)
                    with np.errstate(over="ignore"):
                        key = np.arange(1, bands + 1, dtype=np.uint64)
                        for r in range(rows):
                            key = mix64(key * GOLD + signature[:, r])
                    keys.append(key.view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cls, pa.binary()), pa.array(total, pa.float64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "mark", "cls", "total", "bands"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(mark) if mark else F.lit(None)).cast("long").alias("mark"), text_or_empty().alias("text"))
    return map_arrow(some, run, "doc_id long, mark long, cls binary, total double, bands array<long>")


def _bits(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(mix64(ids.astype(np.uint64))[:, None] + np.arange(4, dtype=np.uint64) * GOLD) % np.uint64(FILTER_BITS)).astype(np.int64)


def _id_filter(ids: DataFrame) -> bytes:
    """A Bloom filter of ids, of fixed size; tasks send their bits, not ids."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            flags[_bits(batch.column(0).to_numpy(zero_copy_only=False)).ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in map_arrow(ids.coalesce(8), partial, "bits binary").collect():
        total |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return total.tobytes()


def _sets(docs: DataFrame, bloom: Broadcast, weighting: str, words: int) -> DataFrame:
    """(cls, elements, weights) of the texts whose id passes a filter of those wanted:
    sorted distinct shingles, 64 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(np.frombuffer(bloom.value, np.uint8)).astype(bool)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(flags[_bits(ids)].all(axis=1), pa.bool_()))
            for at in range(0, batch.num_rows, 500):
                sets = [weighted_shingles(t, weighting, words) for t in batch.column(1).slice(at, 500).to_pylist()]
                names = [_fingerprint(e, w) for e, w in sets]
                counts = [None if weighting == "set" else w.astype("<u4").tobytes() for _, w in sets]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), binary_rows([e.astype("<u8") for e, _ in sets]), pa.array(counts, pa.binary())], names=["cls", "elements", "weights"])

    some = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_arrow(some, run, "cls binary, elements binary, weights binary")


def _similarity(e1: bytes, w1: bytes | None, e2: bytes, w2: bytes | None) -> float:
    a, b = np.frombuffer(e1, "<u8"), np.frombuffer(e2, "<u8")
    if w1 is None:
        both = np.concatenate([a, b])
        both.sort(kind="stable")  # two sorted runs are merged
        common = int((both[1:] == both[:-1]).sum())
        return common / (len(a) + len(b) - common)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    x, y = np.frombuffer(w1, "<u4"), np.frombuffer(w2, "<u4")
    common = float(np.minimum(x[i], y[j]).sum())
    return common / (float(x.sum()) + float(y.sum()) - common)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs of classes. The hub's set joins first, while rows
    are narrow; a member's own set joins by the member, which is in few pairs."""

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        sims = [_similarity(*r) for r in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
        yield {"a": batch.column(0), "b": batch.column(1), "similarity": sims}

    hub = sets.select(F.col("cls").alias("b"), F.col("elements").alias("e2"), F.col("weights").alias("w2"))
    own = sets.select(F.col("cls").alias("a"), F.col("elements").alias("e1"), F.col("weights").alias("w1"))
    wide = pairs.select("a", "b").join(hub, "b").join(own, "a").select("a", "b", "e1", "w1", "e2", "w2")
    return arrow_map(wide, rows, "a binary, b binary, similarity double", 1000)


def _elements(sets: DataFrame) -> DataFrame:
    """(element, cls, weight): a row for each element of each set, by the upper half of its
    bits. Elements that are alike there only bring more classes together."""

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        elements = [np.frombuffer(e, "<u8") >> np.uint64(32) for e in batch.column(1).to_pylist()]
        weights = [np.ones(len(e)) if w is None else np.frombuffer(w, "<u4").astype(float) for e, w in zip(elements, batch.column(2).to_pylist())]
        owner = np.repeat(np.arange(len(elements)), [len(e) for e in elements])
        yield {"element": pa.array(np.concatenate([*elements, np.zeros(0, np.uint64)]).astype(np.int64)), "cls": batch.column(0).take(pa.array(owner)), "weight": pa.array(np.concatenate([*weights, np.zeros(0)]))}

    return arrow_map(sets.select("cls", "elements", "weights"), rows, "element long, cls binary, weight double", 200)


def _by_scarce_elements(space: Workspace, sets: DataFrame, left: DataFrame, threshold: float, n: int, few: int = FEW, depth: int = DEPTH) -> DataFrame:
    """Pairs (a, b) of the classes `left` (cls, total, root) of different roots that may have
    a similarity of `threshold`: all that do, and others that share their first units.

    Elements that the same classes hold are one unit, and units are ordered from scarce to
    frequent; those of one class alone come first of all and pair nothing off. What two
    similar sets have in common weighs t / (1 + t) of their totals at least, t being the
    threshold, and never less than t of either; so little of a set lies before its first
    common unit, and between that and the next ones. A key is a run of units taken to be
    the first common ones: a pair meets only at the key of those that really are. Keys that
    many classes of several roots share, as form letters do, are told apart by one more
    unit, where that is less work than pairing them off.
    """
    each = space.table("elements", _elements(sets.join(left.select("cls"), "cls", "left_semi")), rows=50 * n)
    mark = lambda seed: F.bit_xor(F.xxhash64("cls", F.lit(seed)))
    held = each.groupBy("element").agg(F.count(F.lit(1)).alias("n"), mark(1).alias("x"), mark(2).alias("y")).where("n > 1")
    common = each.join(held.select("element", "n", F.xxhash64("n", "x", "y").alias("unit")), "element")
    common = space.table("common", common.groupBy("cls", "unit").agg(F.sum("weight").alias("w"), F.first("n").alias("n")), rows=50 * n)
    met = common.groupBy("cls").agg(F.sum("w").alias("met"))
    able = left.join(met, "cls").where(F.col("met") + 1e-6 >= threshold * F.col("total")).select("cls", "total", "root")
    order = Window.partitionBy("cls").orderBy("n", "unit")
    units = common.join(able, "cls").withColumns({"at": F.row_number().over(order), "follows": F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    enough = lambda most: most + 1e-6 >= threshold * F.col("total")
    units = units.withColumn("reach", F.count_if(enough(F.col("follows"))).over(Window.partitionBy("cls")))
    units = space.table("units", units.select("unit", "cls", "total", "root", "at", "follows", (F.col("follows") - F.col("w")).alias("rest"), "reach"), rows=10 * n)
    space.drop("elements", "common")
    rows = units.where(enough(F.col("follows"))).withColumnsRenamed({"unit": "key", "follows": "most"})
    after = units.select("cls", F.col("unit").alias("next"), F.col("at").alias("next_at"), "follows", F.col("rest").alias("next_rest"))

    def longer(keys: DataFrame) -> DataFrame:
        """Rows of these keys with one more unit; what lies between the two is no longer in common."""
        most = F.col("most") - F.col("rest") + F.col("follows")
        more = rows.join(keys.select("key"), "key", "left_semi").join(after, "cls").where((F.col("next_at") > F.col("at")) & enough(most))
        return more.select(F.xxhash64("key", "next").alias("key"), "cls", "total", "root", F.col("next_at").alias("at"), most.alias("most"), F.col("next_rest").alias("rest"), "reach")

    def sizes(rows: DataFrame) -> DataFrame:
        parts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"), F.sum("reach").alias("reach"))
        keys = parts.groupBy("key").agg(F.max(F.struct("size", "root")).alias("m"), F.count(F.lit(1)).alias("roots"), F.sum("size").alias("size"), F.sum("reach").alias("reach"))
        return keys.withColumn("outside", F.col("size") - F.col("m.size"))

    pairs, turn = None, 0
    while True:
        keys = sizes(rows).where("roots > 1").withColumn("work", F.col("outside") * F.col("size"))
        deeper = (F.col("outside") > few) & (F.col("reach") < F.col("work")) & F.lit(turn + 1 < depth)
        keys = space.table(f"keys{turn}", keys.select("key", F.col("m.root").alias("main"), "work", deeper.alias("deeper")), rows=n)
        hot = keys.where("deeper")
        many, work = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("work"), F.lit(0))).first()
        go_on = work > LEAST_WORK
        if go_on:
            # Whether it pays is told by some of the keys; either way gives all pairs.
            some = hot if many < 16 * TRIED else hot.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(16)) == 0)
            now = some.agg(F.coalesce(F.sum("work"), F.lit(0))).first()[0]
            made, then = sizes(longer(some)).agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.col("outside") * F.col("size")), F.lit(0))).first()
            go_on = 1.5 * (3 * made + then) < now
        paired = keys.where("not deeper") if go_on else keys
        here = rows.join(paired.select("key", "main"), "key")
        outsiders = here.where("root != main").select("key", F.col("cls").alias("x"), F.col("total").alias("x_total"), F.col("root").alias("x_root"), F.col("most").alias("x_most"))
        fits = (F.least("total", "x_total") >= threshold * F.greatest("total", "x_total")) & (F.least("most", "x_most") + 1e-6 >= threshold / (1 + threshold) * (F.col("total") + F.col("x_total")))
        found = outsiders.join(rows, "key").where((F.col("root") != F.col("x_root")) & fits).select(F.greatest("x", "cls").alias("a"), F.least("x", "cls").alias("b"))
        pairs = found if pairs is None else pairs.union(found)
        if not go_on:
            break
        turn += 1
        rows = space.table(f"longer{turn}", longer(hot), rows=10 * n)
    return pairs.distinct()


def components(space: Workspace, edges: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """(node, root) of every node of `edges` (a, b): alternating large and small stars;
    each round is written, so a lost executor costs a re-read."""
    current = space.table(f"{name}0", edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows=rows)
    state, turn = None, 0
    while True:
        found = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state or not found[0]:
            break
        state, turn = tuple(found), turn + 1
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select("u", F.col("m").alias("v"))).distinct()
        current = space.table(f"{name}{turn}", small, rows=rows)
        if turn > 1:
            space.drop(f"{name}{turn - 2}")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, weighting: str = "set", bands: int = BANDS, rows: int = ROWS, words: int = WORDS, mark: str | None = None) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, group_id, group_size,
    links, kept, and with `mark` (a long column of `docs`) also mark. A group is what
    links of similarity `threshold` or more, counted on 64-bit shingles, connect; group_id is its smallest doc_id, whose row is kept; links counts the classes
    of different sets that the document's own class was confirmed to be linked to.

    Words are lower-cased runs of letters and digits; a text of fewer words than a
    shingle is one shingle. Null text counts as empty; texts without words are
    equal to each other and form one group. Of rows that repeat an id exactly one
    is kept; rows with a null id group by equal sets only. An empty table gives an
    empty result; other columns are ignored.
    """
    space = Workspace(spark, "near")
    table = space.table("sketches", sketches(docs, weighting, bands, rows, words, mark).withColumn("row", F.monotonically_increasing_id()))
    n = table.count()
    keys = table.where("bands is not null").select("cls", "total", F.explode("bands").alias("key"))
    full = keys.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo != hi").select("key", "size")
    members = space.table("members", keys.join(full, "key").distinct(), rows=bands * n)
    weight = members.groupBy("cls").agg(F.sum("size").alias("pull"))
    ranked = members.join(weight, "cls")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("pull", "cls", "total")).alias("h")).select("key", F.col("h.cls").alias("b"), F.col("h.total").alias("b_total"))
    stars = space.table("stars", members.join(hubs, "key").select("key", F.col("cls").alias("a"), "total", "b", "b_total"), rows=n)
    near = F.least("total", "b_total") >= threshold * F.greatest("total", "b_total")
    pairs = stars.where((F.col("a") != F.col("b")) & near).select("a", "b").distinct()
    # Ids of one text for each class that some pair needs.
    first = table.where("doc_id is not null").join(members.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    # Repeated rows and what passes the filter by chance give a class again: one of them stays.
    bloom = spark.sparkContext.broadcast(_id_filter(first.select("doc_id")))
    sets = space.table("sets", _sets(docs, bloom, weighting, words).join(members.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"]), rows=10 * n)
    bloom.destroy()
    told = space.table("told", _verified(pairs, sets).groupBy("a", "b").agg(F.max("similarity").alias("similarity")), rows=n)
    links = told.where(F.col("similarity") >= threshold).select("a", "b")
    roots = space.table("roots", components(space, links, "star", n), rows=n)

    # Buckets that still hold several components may hide links between them.
    placed = stars.join(roots.withColumnRenamed("node", "a"), "a", "left").select("key", F.col("a").alias("cls"), "total", F.coalesce("root", "a").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("key")
    left = space.table("left", placed.join(mixed, "key", "left_semi").select("cls", "total", "root").distinct(), rows=n)
    rest = _by_scarce_elements(space, sets, left, threshold, n)
    known = told.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = space.table("more", _verified(rest.join(known, ["a", "b"], "left_anti"), sets).groupBy("a", "b").agg(F.max("similarity").alias("similarity")).where(F.col("similarity") >= threshold).select("a", "b"), rows=n)
    both = links.union(more)
    if more.isEmpty():
        final = roots
    else:
        final = space.table("joined", components(space, roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "all", n), rows=n)
    degree = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().groupBy("a").agg(F.count(F.lit(1)).alias("links")).withColumnRenamed("a", "cls")
    classes = final.withColumnRenamed("node", "cls").join(degree, "cls", "left")
    named = table.select("doc_id", "mark", "row", "cls").join(classes, "cls", "left").select("doc_id", "mark", "row", F.coalesce("root", "cls").alias("root"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    named = space.table("named", named, rows=n)
    groups = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("odd"), "doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    out = named.join(groups, "root").select("doc_id", F.col("best.doc_id").alias("group_id"), "group_size", "links", (F.col("row") == F.col("best.row")).alias("kept"), *(["mark"] if mark else []))
    return sized(out, n)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "group_id", "group_size", "kept")


#: The exact groups, from all pairs that share a shingle: for small tables.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS g FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)
  UNION ALL SELECT v.doc_id, (SELECT min(doc_id) FROM w WHERE len(w) = 0) FROM w v WHERE len(v.w) = 0
), ends AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, ends.b FROM r JOIN ends ON ends.a = r.y),
g AS (SELECT x AS doc_id, min(y) AS group_id FROM r GROUP BY x)
SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, doc_id = group_id AS kept FROM g
"""
