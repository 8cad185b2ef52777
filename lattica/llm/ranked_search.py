"""Ranked lexical search over a bit-sliced impact index (operator 11).

The index cuts the documents into blocks of a few thousand. A row holds one term of one
block: the places of the documents that hold it, and one bitmap for each bit of their
impacts, the part of a score that depends on the document. A search spreads a row's
bitmaps over the block, multiplies them by the term's weight (shifts and additions) and
adds them to the sums of every item that asks for the term, all documents of the block at
once, by bitwise carry arithmetic. The best k are then found from the most significant
slice of the sums down: where more than k documents are left, those with the bit go on.

Each block gives at most k rows for each item, which a window ranks. Statistics (documents,
terms, documents of a term) cover the whole table; no posting is left out of the index.

Terms are runs of ASCII letters, digits and all characters beyond ASCII; A to Z are lower-
cased. A null or empty text has none, isn't counted and can't be found. Equal scores rank by
ascending id, null ids last; repeated rows rank one by one. Repeated items (equal id and
text) are answered once. Empty tables give an empty result. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Workspace, bytes_of, map_arrow, text_or_empty

#: A block ends at this many documents, or after the document that reaches this many terms.
BLOCK_DOCUMENTS = 16_384
BLOCK_TERMS = 3_000_000
#: Items that a task answers at once; more become several groups.
GROUP_ITEMS = 128
#: Impacts lie below 10**6.
IMPACT_BITS = 20
#: The row of a block that lists its documents; no term is empty.
HEADER = ""

_TERM_BYTE = np.zeros(256, np.uint8)
_TERM_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: Bytes of terms as they are, A-Z lower-cased; all others are blanks.
_FOLD = bytes(b + 32 if 65 <= b < 91 else b if _TERM_BYTE[b] else 32 for b in range(256))


def term_counts(texts: pa.Array) -> np.ndarray:
    """The number of terms of each text."""
    data, offsets = bytes_of(texts)
    inside = _TERM_BYTE[data]
    starts = inside.copy()
    starts[1:] &= 1 - inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = inside[first]  # a text's first byte doesn't continue the text before
    out = np.zeros(len(texts), np.int64)
    if len(first):
        out[offsets[:-1] < offsets[1:]] = np.add.reduceat(starts, first, dtype=np.int64)
    return out


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class _Numbers(dict):
    """Numbers of terms, in the order of their first sight."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


class _Block:
    """Documents of a block as they are read; `rows` makes its index."""

    def __init__(self):
        self.ids, self.parts, self.sizes = [], [], []
        self.numbers, self.terms = _Numbers(), 0

    def add(self, key: int | None, text: bytes) -> None:
        found = terms_of(text)
        if found:
            self.ids.append(key)
            self.parts.append(np.fromiter(map(self.numbers.__getitem__, found), np.uint32, len(found)))
            self.sizes.append(len(found))
            self.terms += len(found)

    def rows(self, block: int, documents: int, terms: int) -> pa.Table:
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids, sizes = np.array([i or 0 for i in self.ids], np.int64), np.array(self.sizes, np.int64)
        order = np.lexsort((ids, 1 - known))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids, known, sizes = ids[order], known[order], sizes[order]
        words = sorted(self.numbers)
        rank = np.empty(len(words), np.int64)
        rank[[self.numbers[w] for w in words]] = np.arange(len(words))
        postings = rank[np.concatenate(self.parts)]
        self.parts.clear()
        postings <<= 16
        postings |= np.repeat(place, self.sizes)
        postings, tf = np.unique(postings, return_counts=True)
        at = (postings & 0xFFFF).astype(np.uint16)
        count = np.bincount(postings >> 16, minlength=len(words))
        del postings
        spread = 75 + (25 * sizes * documents) // terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * spread[at])
        ends = np.cumsum(count)
        width = -(-count // 8)  # bytes of a slice of a term
        wide = np.cumsum(width) - width
        bit = np.arange(len(at)) + np.repeat(8 * wide - (ends - count), count)
        owner = np.repeat(np.arange(len(words)), width)
        home = IMPACT_BITS * wide[owner] + np.arange(len(owner)) - wide[owner]
        slices = np.zeros(IMPACT_BITS * int(width.sum()), np.uint8)
        for s in range(IMPACT_BITS):
            bits = np.zeros(8 * len(owner), np.uint8)
            bits[bit] = (impact >> s) & 1
            slices[home + s * width[owner]] = np.packbits(bits, bitorder="little")
        column = lambda data, ends: pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data)])
        index = pa.table({
            "block": pa.array(np.full(len(words), block)), "term": pa.array(words, pa.binary()).cast(pa.string()), "documents": pa.array(count.astype(np.int32)),
            "places": column(at, 2 * ends), "slices": column(slices, IMPACT_BITS * np.cumsum(width)),
        })
        header = {"block": [block], "term": [HEADER], "documents": [len(ids)], "places": [ids.tobytes()], "slices": [known.tobytes()]}
        return pa.concat_tables([pa.table(header, schema=index.schema), index])


_INDEX = "block long, term string, documents int, places binary, slices binary"


@dataclass
class LexicalIndex:
    """The rows of an index, one for each term of each block, and the numbers of documents
    and of terms, of which impacts were made."""

    rows: DataFrame
    documents: int
    terms: int


def build_index(spark: SparkSession, docs: DataFrame, space: Workspace, key: str = "doc_id", text: str = "text", block_documents: int = BLOCK_DOCUMENTS, block_terms: int = BLOCK_TERMS) -> LexicalIndex:
    """Index every text of docs into the table `index` of the workspace. Two scans: one
    counts, one writes; nothing is shuffled."""
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("key"), text_or_empty(f"`{text}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = term_counts(batch.column(0))
            yield pa.RecordBatch.from_pydict({"documents": [int((found > 0).sum())], "terms": [int(found.sum())]})

    totals = map_arrow(plain.select("text"), count, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, terms = (int(v or 0) for v in totals)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, _Block()

        def done() -> Iterator[pa.RecordBatch]:
            if block.ids:
                yield from block.rows(number, documents, terms).to_batches(20_000)

        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            for at, doc in enumerate(batch.column(0).to_pylist()):
                block.add(doc, data[offsets[at] : offsets[at + 1]].tobytes())
                if len(block.ids) >= block_documents or block.terms >= block_terms:
                    yield from done()
                    number, block = number + 1, _Block()
        yield from done()

    return LexicalIndex(space.table("index", map_arrow(plain, index, _INDEX)), documents, terms)


def _add(total: np.ndarray, slices: np.ndarray, shift: int = 0) -> None:
    """total += slices << shift, where both hold a bitmap for each binary digit, the least
    first; `total` has room for the sum."""
    carry = None
    for s in range(shift, len(total)):
        if s - shift < len(slices):
            a, b = total[s], slices[s - shift]
            both = a & b
            a = a ^ b
            if carry is not None:
                both |= a & carry
                a ^= carry
            total[s], carry = a, both
        elif carry is None or not carry.any():
            return
        else:
            total[s], carry = total[s] ^ carry, total[s] & carry


def _ranges(starts: list[int], sizes: list[int]) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(np.array(starts) - (ends - sizes), sizes)


def times(slices: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Each column of slices times its factor: a shifted addition for each bit of factors,
    of the columns whose factor has that bit."""
    bits = int(factors.max(initial=0)).bit_length()
    out = np.zeros((len(slices) + bits, slices.shape[1]), np.uint64)
    for s in range(bits):
        has = -((factors >> s) & 1).astype(np.int64)
        _add(out, slices & has.view(np.uint64), s)
    return out


def spread(places: list[bytes], slices: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms' postings laid over the documents of a block: for each term the words of 64
    documents that it touches. Gives each word's term and number, and its bitmaps."""
    at = np.frombuffer(b"".join(places), np.uint16).astype(np.int64)
    count = np.array([len(p) // 2 for p in places])
    width = -(-count // 8)
    owner, first = np.repeat(np.arange(len(count)), width), np.cumsum(width) - width
    home = IMPACT_BITS * first[owner] + np.arange(len(owner)) - first[owner]
    packed = np.frombuffer(b"".join(slices), np.uint8)
    term = np.repeat(np.arange(len(count)), count)
    posting = np.arange(len(at)) + (8 * first - (np.cumsum(count) - count))[term]
    words, row = np.unique((term << 10) | (at >> 6), return_inverse=True)
    target = 64 * row + (at & 63)
    out = np.empty((IMPACT_BITS, len(words)), np.uint64)
    for s in range(IMPACT_BITS):
        bits = np.zeros(64 * len(words), np.uint8)
        bits[target] = np.unpackbits(packed[home + s * width[owner]], bitorder="little")[posting]
        out[s] = np.packbits(bits, bitorder="little").view(np.uint64)
    return words >> 10, words & 1023, out


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which documents have the k largest sums above 0, from slices (bit, item, word): those
    surely among them, and those that tie for the places left."""
    sure, left = np.zeros_like(total[0]), np.bitwise_or.reduce(total, axis=0)
    for slice_ in total[::-1]:
        more = sure | (left & slice_)
        many = (np.bitwise_count(more).sum(axis=1) > k)[:, None]
        left = np.where(many, left & slice_, left & ~slice_)
        sure = np.where(many, sure, more)
    return sure, left


_FOUND = "item long, doc_id long, score long"


def _answers(rows: pa.Table, k: int) -> pa.Table:
    """The best k documents of one block for each item of a group. Each round adds one term
    to every item that has terms left, the most frequent first."""
    empty = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    terms, asked = rows.column("term").to_pylist(), rows.column("asked").to_pylist()
    head = terms.index(HEADER)
    places, slices, documents = (rows.column(c).to_pylist() for c in ("places", "slices", "documents"))
    by_item: dict[int, list[tuple[int, int]]] = {}
    for n in sorted((n for n in range(len(terms)) if n != head), key=lambda n: (-documents[n], terms[n])):
        for a in asked[n]:
            by_item.setdefault(a["item"], []).append((n, a["factor"]))
    if not by_item:
        return empty.empty_table()
    ids, known = np.frombuffer(places[head], np.int64), np.frombuffer(slices[head], np.uint8)
    n_words = -(-len(ids) // 64)
    most = max(sum(factor for _, factor in some) for some in by_item.values()) << IMPACT_BITS
    items = sorted(by_item)
    total = np.zeros((most.bit_length(), len(items) * n_words), np.uint64)
    for turn in range(max(map(len, by_item.values()))):
        here = [(i, *by_item[item][turn]) for i, item in enumerate(items) if turn < len(by_item[item])]
        used = sorted({n for _, n, _ in here})
        owner, word, bitmaps = spread([places[n] for n in used], [slices[n] for n in used])
        begin = dict(zip(used, np.searchsorted(owner, np.arange(len(used) + 1)).tolist()))
        size = dict(zip(used, np.bincount(owner).tolist()))
        products, width = {}, 0  # a term with its factor is multiplied once, however many items ask for it
        for _, n, factor in here:
            if (n, factor) not in products:
                products[n, factor], width = width, width + size[n]
        source = _ranges([begin[n] for n, _ in products], [size[n] for n, _ in products])
        product = times(bitmaps[:, source], np.repeat([factor for _, factor in products], [size[n] for n, _ in products]))
        sizes = [size[n] for _, n, _ in here]
        column = _ranges([products[n, factor] for _, n, factor in here], sizes)
        target = np.repeat([i * n_words for i, _, _ in here], sizes) + word[source[column]]
        sums = total[:, target]
        _add(sums, product[:, column])
        total[:, target] = sums
    total = total.reshape(len(total), len(items), n_words)
    sure, left = best(total, k)
    unpack = lambda row: np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little"))
    columns: dict[str, list] = {"item": [], "doc_id": [], "score": []}
    for n, item in enumerate(items):
        first = unpack(sure[n])
        found = np.concatenate([first, unpack(left[n])[: k - len(first)]])
        digits = (total[:, n, found >> 6] >> (found & 63).astype(np.uint64)) & np.uint64(1)
        columns["score"].extend((digits << np.arange(len(total), dtype=np.uint64)[:, None]).sum(axis=0).astype(np.int64).tolist())
        columns["doc_id"].extend(int(ids[a]) if known[a] else None for a in found)
        columns["item"].extend([item] * len(found))
    return pa.table(columns, schema=empty)


def search(spark: SparkSession, index: LexicalIndex, items: DataFrame, k: int = 20, key: str = "item_id", text: str = "text", group_items: int = GROUP_ITEMS) -> DataFrame:
    """The k best documents for each item: item_id, rank, doc_id, score, for scores above 0."""
    asked = items.select(F.col(f"`{key}`").alias("item_id"), text_or_empty(f"`{text}`").alias("text"))
    asked = asked.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").distinct()
    groups = max(1, -(-asked.count() // group_items))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, one in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
                found, times = np.unique(np.array(terms_of(one.encode()), object), return_counts=True)
                yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(found), pa.int64()), "term": pa.array([t.decode() for t in found], pa.string()), "times": pa.array(times, pa.int64())})

    terms = map_arrow(asked.select("item", "text"), split, "item long, term string, times long")
    held = index.rows.where(F.col("term") != HEADER).select("term", "documents").join(terms.select("term").distinct(), "term", "left_semi")
    weights = held.groupBy("term").agg(F.sum("documents").alias("df"))
    ratio = F.lit(2 * index.documents + 2).cast("double") / (2 * F.col("df") + 1)
    weights = weights.select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("weight")).where("weight > 0")
    wanted = terms.join(weights, "term").groupBy(F.pmod("item", F.lit(groups)).cast("int").alias("grp"), "term").agg(
        F.collect_list(F.struct("item", (F.col("weight") * F.col("times")).alias("factor"))).alias("asked")
    )  # some group_items ask for a term in a group
    rows = index.rows.where(F.col("term") != HEADER).join(wanted, "term")
    heads = index.rows.where(F.col("term") == HEADER).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    rows = rows.unionByName(heads.withColumn("asked", F.lit(None).cast(wanted.schema["asked"].dataType)))
    found = rows.groupBy("block", "grp").applyInArrow(lambda table: _answers(table, k), _FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each item of `benchmark`, over all documents."""
    space = Workspace(spark, "ranked-search")
    index = build_index(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), space)
    return search(spark, index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS_SQL = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP11_SQL = rf"""
WITH words AS (SELECT doc_id, {_TERMS_SQL} AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS_SQL} AS term FROM benchmark) GROUP BY ALL),
weights AS (SELECT item_id, term, times * CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM asked JOIN df USING (term), totals),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nn) // ll))))) AS BIGINT) AS score
  FROM weights JOIN tf USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
) WHERE rank <= 20
"""
