"""Exact deduplication by a log-structured merge index (operator 7).

Each task keeps a memtable of digests and flushes it as a run sorted by digest,
with a Bloom filter. A run holds one row for each distinct text it saw, with the
ids of its rows, so copies within a memtable are byte-compared and folded before
anything is shuffled. Compaction merges all runs by ranges of the digest: a range is
read in order of digest, and of each digest the smallest identifier is kept. The result
is the next level, sorted by digest. A digest met in several runs is a hit: the bytes of
those run rows are compared too, and texts that only share a digest part ways. A filter
of the hits lets all other rows keep their bytes out of the shuffle. Filters of runs
decide in which runs later texts are looked up (`probe`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Workspace, map_arrow, mix64, sized, text_or_empty

#: A memtable is flushed at so many rows or bytes of text.
MEMTABLE_ROWS = 50_000
MEMTABLE_BYTES = 32 << 20
#: Rows of runs in a range of digests that one task merges, about.
RANGE_ROWS = 50_000
#: Digests that are looked up in the filters of runs at a time.
PROBE_ROWS = 4096
#: Bits of a filter for each entry. The filter of hits is broadcast and has between
#: the two numbers of bits below (4 MiB at most): where there are more hits than these
#: are for it lets more rows through, and the join stays exact.
RUN_FILTER_BITS = 12
LEAST_HIT_BITS, MOST_HIT_BITS = 1 << 20, 1 << 25
_HASHES = 4

#: Characters that do not count: space, tab, newline, vertical tab, form feed, return.
WHITE = bytes([0x20, *range(0x09, 0x0E)])

_RUN = "run long, digest binary, sha256 binary, best struct<odd:boolean,less:long,doc_id:long,run:long,pos:int>, n long, ids array<long>, marks array<long>, body binary, filter binary"


def normalise(text: str) -> bytes:
    return text.encode().translate(None, WHITE)


def filter_positions(digests: list[bytes], bits: int) -> np.ndarray:
    """Bit positions of each digest in a Bloom filter of `bits` bits (double hashing)."""
    head = np.frombuffer(b"".join(d[:8].ljust(8, b"\0") for d in digests), "<u8")
    with np.errstate(over="ignore"):
        step = mix64(head) | np.uint64(1)
        return (head[:, None] + step[:, None] * np.arange(_HASHES, dtype=np.uint64)) % np.uint64(bits)


def build_filter(digests: list[bytes], bits: int) -> bytes:
    flags = np.zeros(bits, bool)
    if digests:
        flags[filter_positions(digests, bits).ravel()] = True
    return np.packbits(flags).tobytes()


def may_contain(bloom: np.ndarray, digests: list[bytes]) -> np.ndarray:
    at = filter_positions(digests, len(bloom) * 8)
    return ((bloom[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1).astype(bool).all(axis=1)


class _Memtable:
    def __init__(self, digest_bytes: int):
        self.digest_bytes, self.rows, self.bytes = digest_bytes, 0, 0
        self.entries: dict[bytes, list[list]] = {}

    def add(self, doc_id: int | None, text: str, mark: int | None) -> None:
        body = normalise(text)
        sha = hashlib.sha256(body).digest()
        same = self.entries.setdefault(sha[: self.digest_bytes], [])
        entry = next((e for e in same if e[1] == body), None)  # the bytes decide, not the digest
        if entry is None:
            same.append(entry := [sha, body, [], None, []])
            self.bytes += len(body)
        rank = (doc_id is None, -len(text), doc_id or 0, len(entry[2]))
        entry[3] = min(rank, entry[3] or rank)
        entry[2].append(doc_id)
        entry[4].append(mark)
        self.rows += 1

    def flush(self, run: int) -> Iterator[dict]:
        digests = sorted(self.entries)
        bits = max(64, -(-len(digests) * RUN_FILTER_BITS // 8) * 8)
        rows, held = [], 0
        for n, digest in enumerate(digests):
            for sha, body, ids, (odd, less, doc_id, pos), marks in self.entries[digest]:
                best = {"odd": odd, "less": less, "doc_id": None if odd else doc_id, "run": run, "pos": pos}
                rows.append({"run": run, "digest": digest, "sha256": sha, "best": best, "n": len(ids), "ids": ids, "marks": marks, "body": body, "filter": None if n else build_filter(digests, bits)})
                held += len(body) + 16 * len(ids)
            if held > 4 << 20 or len(rows) >= 5000 or n == len(digests) - 1:
                yield rows
                rows, held = [], 0


def flush_runs(docs: DataFrame, digest_bytes: int = 32, mark: str | None = None) -> DataFrame:
    """Sorted runs of `docs` (doc_id, text): one row for each distinct text of a memtable.
    The column `mark`, a long, goes along with each id."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(_RUN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, memtable = TaskContext.get().partitionId() << 32, _Memtable(digest_bytes)
        for batch in batches:
            for doc_id, text, tag in zip(*(c.to_pylist() for c in batch.columns)):
                memtable.add(doc_id, text, tag)
                if memtable.rows >= MEMTABLE_ROWS or memtable.bytes >= MEMTABLE_BYTES:
                    for rows in memtable.flush(at):
                        yield pa.RecordBatch.from_pylist(rows, schema=out)
                    at, memtable = at + 1, _Memtable(digest_bytes)
        for rows in memtable.flush(at):
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), (F.col(mark) if mark else F.lit(None).cast("long")).alias("mark"))
    return map_arrow(some, run, _RUN)


def compact(runs: DataFrame, rows: int) -> DataFrame:
    """All runs merged into one level, sorted by digest: the smallest identifier, the
    rows, and how many runs met it. `rows`, of the runs, tells the number of ranges.

    A run has a digest once, so a range gets no more rows of it than there are runs,
    whatever the number of copies.
    """
    ranges = runs.select("digest", "best", "n").repartitionByRange(max(1, -(-rows // RANGE_ROWS)), "digest").sortWithinPartitions("digest")
    return ranges.groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("runs"))


def _hit_filter(hits: DataFrame) -> np.ndarray:
    """A filter of the digests of `hits`; tasks send their bits, not digests."""
    bits = min(MOST_HIT_BITS, max(LEAST_HIT_BITS, 1 << (RUN_FILTER_BITS * hits.count()).bit_length()))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits, bool)
        for batch in batches:
            if batch.num_rows:
                flags[filter_positions(batch.column(0).to_pylist(), bits).ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["bits"])

    bloom = np.zeros(bits // 8, np.uint8)
    for row in map_arrow(hits.select("digest").coalesce(8), partial, "bits binary").collect():
        bloom |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return bloom


def clashing(space: Workspace, runs: DataFrame, index: DataFrame) -> DataFrame:
    """Digests of several runs that stand for more than one text, by comparing the
    bytes of their run rows. Each run sends a text once, whatever its copies."""
    hits = index.where("runs > 1").select("digest")
    bloom = space.spark.sparkContext.broadcast(_hit_filter(hits).tobytes())

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bloom.value, np.uint8)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(may_contain(bits, batch.column(0).to_pylist())))

    shipped = map_arrow(runs.select("digest", "body"), passing, "digest binary, body binary").join(hits, "digest", "left_semi")
    across = shipped.groupBy("digest", "body").agg(F.lit(1).alias("one"))
    within = runs.groupBy("run", "digest").agg(F.count(F.lit(1)).alias("bodies")).where("bodies > 1").select("digest")
    found = across.groupBy("digest").agg(F.count(F.lit(1)).alias("bodies")).where("bodies > 1").select("digest").union(within).distinct()
    found = space.table("clashes", found, rows=0)
    bloom.destroy()
    return found


def exact_duplicates(spark: SparkSession, docs: DataFrame, digest_bytes: int = 32, mark: str | None = None) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, keep_id, group_size,
    kept, text_sha256, and with `mark` (a long column of `docs`) also mark.

    Texts are equal when the same without white space (WHITE). Of equal ones the
    row with the most code points stays, then the smallest doc_id; of rows that
    repeat an id and a text exactly one is kept. Null text counts as empty; a null
    doc_id stays only where no other row of its group has one. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    space = Workspace(spark, "exact")
    runs = space.table("runs", flush_runs(docs, digest_bytes, mark))
    n, entries = runs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    index = space.table("index", compact(runs, entries))
    clashes = clashing(space, runs, index)
    rows = runs.select("run", "digest", "sha256", "ids", "marks")
    plain = index.select("digest", F.col("best").alias("keep"), F.col("n").alias("group_size"))
    if clashes.isEmpty():
        found = rows.join(plain, "digest")
    else:
        # Texts that share a digest only: their groups go by the bytes themselves.
        apart = runs.join(clashes, "digest", "left_semi")
        groups = apart.groupBy("digest", "body").agg(F.min("best").alias("keep"), F.sum("n").alias("group_size"))
        found = rows.join(clashes, "digest", "left_anti").join(plain, "digest").unionByName(
            apart.join(groups, ["digest", "body"]).select("digest", "run", "sha256", "ids", "marks", "keep", "group_size")
        )
    each = found.select("run", "sha256", "keep", "group_size", "marks", F.posexplode("ids").alias("pos", "doc_id"))
    out = each.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("run") == F.col("keep.run")) & (F.col("pos") == F.col("keep.pos"))).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
        *([F.get("marks", "pos").alias("mark")] if mark else []),
    )
    return sized(out, n)


def probe(spark: SparkSession, runs: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of `batch` (doc_id, text) whose text some run of `runs` holds: doc_id,
    keep_id. Run filters decide which runs a digest is looked up in; bytes confirm.

    The batch is a stated set of queries: its digests meet every filter in blocks of
    PROBE_ROWS, so a task holds one block and one filter.
    """
    fresh = flush_runs(batch).select(F.col("digest").alias("asked"), F.col("body").alias("asked_body"), F.explode("ids").alias("doc_id"))
    filters = runs.where("filter is not null").select("run", "filter")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PROBE_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).slice(at, PROBE_ROWS).to_pylist()], pa.list_(pa.binary()))], names=["asked"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for asked, run, bloom in zip(*(c.to_pylist() for c in b.columns)):
                found = [d for d, hit in zip(asked, may_contain(np.frombuffer(bloom, np.uint8), asked)) if hit]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([run] * len(found), pa.int64())], names=["asked", "run"])

    blocks = map_arrow(fresh.select("asked").distinct(), block, "asked array<binary>")
    maybe = map_arrow(blocks.crossJoin(filters), test, "asked binary, run long")
    held = runs.select("run", F.col("digest").alias("asked"), "body", "best").join(maybe, ["run", "asked"], "left_semi")
    hits = fresh.join(held.withColumnRenamed("asked", "digest"), (F.col("asked") == F.col("digest")) & (F.col("asked_body") == F.col("body")))
    return hits.groupBy("doc_id").agg(F.min("best").alias("best")).select("doc_id", F.col("best.doc_id").alias("keep_id"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Equal texts for DuckDB; its `length` counts code points.
OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm, row_number() OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS k,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
