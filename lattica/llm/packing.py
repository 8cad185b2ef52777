"""Best-fit packing of token pieces into fixed-length sequences (operator 1).

Bulk-synchronous best fit. A few levels of lengths are placed one after another,
longest first. In each round the documents of the level and the open gaps are
range-sorted together by size; every partition sweeps its range and gives each
document the smallest gap that holds it (its successor). What a sweep leaves is
ranked: leftover documents of one partition take leftover gaps of the ranges
before it, the nearest first, by a plan over per-partition counts only. Documents
that no gap holds open new sequences. Gaps are updated and the next level starts.

Everything that reaches the driver or is broadcast is a count per partition.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Workspace, arrow_map, map_arrow, sized, text_or_empty

CAPACITY = 2048
#: Documents and gaps that one partition of a sweep holds.
SWEEP_ROWS = 400_000
#: And how many at least, where there are cores for more: each opens sequences of its own.
LEAST_ROWS = 5_000

_EVENT = "kind tinyint, id long, size int"
_SWEPT = "part string, kind string, id long, size int, rank int, bin long, gap int"


@lru_cache(maxsize=2)
def _encoder(vocabulary: str, special_as_text: bool):
    """text -> ids, from a tokenizers file of a byte-level BPE.

    In such a file each byte is written as one printable character, and ids are
    ranks of merges; the same vocabulary and merges run here by tiktoken, several
    times faster than by the library of the file, with the same ids (see tests).
    A string of the file's added tokens is cut out of a text first and becomes its own
    id, as the library does by itself, or is text like any other (`special_as_text`,
    the library's encode_special_tokens).
    """
    import public_tokenizers
    import tiktoken

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    with open(vocabulary, encoding="utf-8") as file:
        tokenizer = json.load(file)
    special = {t["content"]: t["id"] for t in tokenizer.get("added_tokens", ())}
    if any(t.get(k) for t in tokenizer.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{vocabulary}: added tokens that take the space beside them aren't handled")
    ranks = {bytes(byte[c] for c in token): rank for token, rank in tokenizer["model"]["vocab"].items() if token not in special}
    own = {} if special_as_text else special
    encoding = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=own)
    return lambda text: encoding.encode_to_numpy(text, allowed_special=set(own), disallowed_special=())


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0, special_as_text: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids followed by
    `end_id`, cut into pieces of `capacity` ids where it is longer.

    ids is binary, little-endian unsigned 32-bit. Of a longer document the first
    piece takes the remainder. Null text counts as empty and gives the piece
    [end_id]; every row of `docs` gives at least one piece; other columns of
    `docs` are ignored.
    """
    vocabulary = vocabulary or default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        encode = _encoder(vocabulary, special_as_text)
        doc, piece, start, length, ids = [], [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            packed = encode(text).astype("<u4").tobytes() + end
            cuts = [0, *range(len(packed) % width or min(width, len(packed)), len(packed) + 1, width)]
            for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                doc.append(key), piece.append(n), start.append(a // 4), length.append((b - a) // 4), ids.append(packed[a:b])
        yield {"doc_id": doc, "piece": piece, "start": start, "length": length, "ids": ids}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), rows, "doc_id long, piece int, start long, length long, ids binary", 256)


def _sweep(capacity: int):
    """Best fit within one sorted range. Rows come largest first, gaps before
    documents of their size. Emits D: a placed document with its bin and the gap
    it took; U: a document left over; G: a gap untouched; R: the rest of a gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None  # the place of the range's first row among all: ranges sort by it
        stacks: list[list[tuple[int, bool]]] = [[] for _ in range(capacity + 1)]
        full = 0  # bit g: there is a gap of size g
        unplaced = 0
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(columns, types))], names=["part", "kind", "id", "size", "rank", "bin", "gap"])

        for batch in batches:
            rows = []
            for kind, key, size in zip(*(c.to_pylist() for c in batch.columns)):
                if part is None:
                    part = f"{capacity - size:010d}.{kind}.{key:020d}"
                if kind == 0:
                    stacks[size].append((key, True))
                    full |= 1 << size
                elif not (above := full >> size):
                    rows.append(("U", key, size, unplaced, None, None))
                    unplaced += 1
                else:
                    gap = size + (above & -above).bit_length() - 1
                    bin_, _ = stacks[gap].pop()
                    if not stacks[gap]:
                        full &= ~(1 << gap)
                    rows.append(("D", key, size, None, bin_, gap))
                    if rest := gap - size:
                        stacks[rest].append((bin_, False))
                        full |= 1 << rest
            if rows:
                yield out(rows)
        rows, untouched = [], 0
        for g in range(capacity, 0, -1):
            for bin_, fresh in stacks[g]:
                rows.append(("G", bin_, g, untouched, None, None) if fresh else ("R", bin_, g, None, None, None))
                untouched += fresh
                if len(rows) >= 20_000:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    return run


def _plan(counts: dict[tuple[str, str], int]) -> tuple[list[tuple], dict[str, int]]:
    """Match leftover documents to leftover gaps across partitions, by rank.

    Gaps of a partition are larger than all sizes after it; the last of the
    nearest earlier partition is the smallest. Returns rows (part, from, to,
    gap_part, top): document of rank r takes the gap of rank top - r; and how
    many documents of each partition find a gap.
    """
    stack: list[list] = []
    rows, found = [], {}
    for part in sorted({p for p, _ in counts}):
        at, n = 0, counts.get((part, "U"), 0)
        while at < n and stack:
            gap_part, have = stack[-1]
            take = min(n - at, have)
            rows.append((part, at, at + take, gap_part, have - 1 + at))
            at += take
            stack[-1][1] -= take
            if not stack[-1][1]:
                stack.pop()
        found[part] = at
        if have := counts.get((part, "G"), 0):
            stack.append([part, have])
    return rows, found


def _open(capacity: int):
    """New sequences for the documents of one partition that no gap holds, in
    order of size; a partition's rows are bounded by SWEEP_ROWS."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        out, bin_, used = [], None, capacity + 1
        for key, size in zip(rows["id"].tolist(), rows["size"].tolist()):
            if used + size > capacity:
                if bin_ is not None and used < capacity:
                    out.append((None, bin_, None, capacity - used))
                bin_, used = key, 0
            out.append((key, bin_, used, None))
            used += size
        if bin_ is not None and used < capacity:
            out.append((None, bin_, None, capacity - used))
        return pd.DataFrame(out, columns=["item", "bin", "offset", "gap"]).astype({"item": "Int64", "bin": "Int64", "offset": "Int32", "gap": "Int32"})

    return run


def levels(capacity: int) -> list[int]:
    """Lower bounds of the lengths that each round places: as many as two, three, five and
    ten of which fill a sequence, the last open."""
    return [*dict.fromkeys([capacity // k for k in (2, 3, 5, 10) if capacity // k]), 0]


def best_fit(space: Workspace, items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(item, sequence_id, offset) for `items` (item long unique, length), each
    length from 1 to `capacity`. sequence_id is the item that opened it."""
    spark: SparkSession = space.spark
    items = items.select("item", F.col("length").cast("int").alias("size"))
    done = [items.where(F.col("size") == capacity).select("item", F.col("item").alias("bin"), F.lit(0).alias("offset"))]
    bounds = levels(capacity)
    bucket = F.lit(len(bounds) - 1)
    for i in reversed(range(len(bounds))):
        bucket = F.when(F.col("size") > bounds[i], i).otherwise(bucket)
    waiting = {r[0]: r[1] for r in items.where(F.col("size") < capacity).groupBy(bucket.alias("level")).count().collect()}
    gaps, n_gaps, high = None, 0, capacity
    for i, low in enumerate(bounds):
        if not waiting.get(i):
            high = low + 1
            continue
        events = items.where((F.col("size") > low) & (F.col("size") < high)).select(F.lit(1).cast("tinyint").alias("kind"), F.col("item").alias("id"), "size")
        if gaps is not None:
            events = events.unionByName(gaps.where(F.col("gap") > low).select(F.lit(0).cast("tinyint").alias("kind"), F.col("bin").alias("id"), F.col("gap").alias("size")))
        rows = waiting[i] + n_gaps
        parts = max(1, min(spark.sparkContext.defaultParallelism, rows // LEAST_ROWS), math.ceil(rows / SWEEP_ROWS))
        order = [F.col("size").desc(), F.col("kind"), F.col("id")]
        swept = space.table(f"swept{i}", map_arrow(events.repartitionByRange(parts, *order).sortWithinPartitions(*order), _sweep(capacity), _SWEPT), rows=rows)
        counts = {(r["part"], r["kind"]): r["count"] for r in swept.groupBy("part", "kind").count().collect()}
        plan, found = _plan(counts)
        taken = F.broadcast(spark.createDataFrame(plan, "part string, low int, high int, gap_part string, top int"))  # at most two rows a partition
        enough = F.broadcast(spark.createDataFrame(list(found.items()), "part string, found int"))
        left = swept.where("kind = 'U'").select("part", "id", "size", "rank")
        free = swept.where("kind = 'G'").select("part", F.col("id").alias("bin"), F.col("size").alias("gap"), "rank")
        asks = left.join(taken, (left["part"] == taken["part"]) & (left["rank"] >= taken["low"]) & (left["rank"] < taken["high"])).select("id", "size", F.col("gap_part").alias("part"), (F.col("top") - F.col("rank")).alias("rank"))
        across = free.join(asks, ["part", "rank"], "left")
        fresh = left.join(enough, "part").where(F.col("rank") >= F.col("found")).select("part", "id", "size", "rank").groupBy("part").applyInPandas(_open(capacity), "item long, bin long, offset int, gap int")
        after = (
            swept.where("kind = 'D'").select(F.col("id").alias("item"), "bin", (capacity - F.col("gap")).alias("offset"), F.lit(None).cast("int").alias("gap"))
            .unionByName(swept.where("kind = 'R'").select(F.lit(None).cast("long").alias("item"), F.col("id").alias("bin"), F.lit(None).cast("int").alias("offset"), F.col("size").alias("gap")))
            .unionByName(across.select(F.col("id").alias("item"), "bin", F.when(F.col("id").isNotNull(), capacity - F.col("gap")).alias("offset"), (F.col("gap") - F.coalesce("size", F.lit(0))).alias("gap")))
            .unionByName(fresh)
        )
        if gaps is not None:
            after = after.unionByName(gaps.where(F.col("gap") <= low).select(F.lit(None).cast("long").alias("item"), "bin", F.lit(None).cast("int").alias("offset"), "gap"))
        state = space.table(f"state{i}", after, rows=rows)
        space.drop(f"swept{i}")
        done.append(state.where(F.col("item").isNotNull()).select("item", "bin", "offset"))
        gaps = state.where(F.col("gap") > 0).select("bin", "gap")
        n_gaps += waiting[i]  # a bound: each gap began with a document
        high = low + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("item", F.col("bin").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def pack_documents(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, carry: dict[str, Column] | None = None, special_as_text: bool = True) -> DataFrame:
    """Pack every row of `docs` (doc_id, text) into sequences of at most `capacity`
    ids. Returns per piece doc_id, piece, start, length, the columns of `carry`
    (expressions over encode_pieces' columns; by default ids itself),
    sequence_id and offset.

    Null text counts as empty; an empty document is one piece of the end id.
    Repeated rows and ties of doc_id are packed each for itself. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    Strings of the vocabulary's added tokens are ordinary text, or with
    `special_as_text` false the ids of those tokens.
    """
    space = Workspace(spark, "packing")
    carry = carry or {"ids": F.col("ids")}
    pieces = encode_pieces(docs, capacity, vocabulary, special_as_text=special_as_text).select("doc_id", "piece", "start", "length", *(c.alias(k) for k, c in carry.items()), F.monotonically_increasing_id().alias("item"))
    pieces = space.table("pieces", pieces)
    placed = best_fit(space, pieces, capacity)
    return sized(pieces.join(placed, "item").drop("item"), pieces.count())


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of pack_documents' result with its ids: the
    sequences themselves; one holds `capacity` ids at most, so groups are small."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.aggregate(parts, F.expr("cast('' as binary)"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(spark, docs, carry={"ids_crc32": F.crc32("ids")}, special_as_text=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
