"""Byte-level BPE encoding and decoding (operator 8).

Pre-tokens are found without regular expressions: an array of codepoint classes
gives the borders of runs, and the one thing that depends on what came before, a
contraction such as 're that ends within a run of letters, is carried by an
associative scan over transition functions. Slices between borders go through
merging by rank, once for each distinct slice that the cache doesn't hold.
Decoding gathers the bytes of all ids at once, by their offsets.
"""

from __future__ import annotations

import base64
import heapq
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_map, text_or_empty

#: Slices whose ids a worker keeps; when full, the cache starts anew.
CACHE_ENTRIES = 600_000

#: Slices of more characters than this are merged by a heap, each for itself.
LONG = 48
#: More than any rank: a pair that doesn't merge.
NONE = 1 << 40

LETTER, NUMBER, OTHER, SPACE = range(4)
#: The classes that the pattern of the rank files names.
_NAMED = {LETTER: r"\p{L}", NUMBER: r"\p{N}", SPACE: r"\s"}
_BLOCK = 64


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every codepoint: letter, number, other, white space. Python's own
    tables are of another Unicode version than tiktoken's, so tiktoken is asked once, by
    an encoding of single bytes for each class, which leaves out all other codepoints."""
    import tiktoken

    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for kind, pattern in _NAMED.items():
        probe = tiktoken.Encoding(f"class-{kind}", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = probe.encode_to_numpy(every, disallowed_special=()).astype(np.uint8).tobytes()
        table[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = kind
    return table


# States: no contraction, or 1 or 2 of its letters still to come. A transition
# function on them is a number of three base-3 digits; _THEN composes two.
_IDLE, _ONE, _TWO = 0 + 3 * 0 + 9 * 1, 1 + 3 * 0 + 9 * 1, 2 + 3 * 0 + 9 * 1
_THEN = np.array([[sum((g // 3 ** ((f // 3**s) % 3)) % 3 * 3**s for s in range(3)) for g in range(27)] for f in range(27)], np.uint8)


def scan_functions(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of transition functions. Composition is
    associative, so blocks are folded side by side, their totals are scanned by
    the same rule, and each block starts from the total of those before it."""
    n = len(functions)
    if n <= _BLOCK:
        out = functions.copy()
        for i in range(1, n):
            out[i] = _THEN[out[i - 1], functions[i]]
        return out
    blocks = -(-n // _BLOCK)
    identity = 0 + 3 * 1 + 9 * 2
    grid = np.full(blocks * _BLOCK, identity, np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(blocks, _BLOCK).T)
    for i in range(1, _BLOCK):
        grid[i] = _THEN[grid[i - 1], grid[i]]
    before = np.concatenate(([identity], scan_functions(grid[-1])[:-1])).astype(np.uint8)
    grid = _THEN[before[None, :], grid]
    return grid.T.ravel()[:n]


def borders(text: str) -> np.ndarray:
    """Where pre-tokens start, as codepoint positions, with the length at the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    if not n:
        return np.zeros(1, np.int64)
    kind = _classes()[codes]
    start = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    white = kind == SPACE
    last = white[:-1] & ~white[1:]  # the last of a run of white space, before something else
    start[:-1] |= last
    start[1:] &= ~(last & (codes[:-1] == 32))  # a blank goes with what follows it
    quotes = np.flatnonzero((codes == 39) & start)
    if len(quotes):
        at = lambda i: np.where(i < n, codes[np.minimum(i, n - 1)], 0)
        one, two = at(quotes + 1), at(quotes + 2)
        letters = np.isin(one, [ord(c) for c in "stmd"]) * 1
        letters[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))] = 2
        if letters.any():
            functions = np.full(n, _IDLE, np.uint8)
            functions[quotes] = np.array([_IDLE, _ONE, _TWO], np.uint8)[letters]
            after = scan_functions(functions) % 3  # the state after each codepoint, from state 0
            before = np.concatenate(([0], after[:-1]))
            start &= before == 0
            start[1:] |= (before[1:] == 0) & (before[:-1] > 0)  # what follows a contraction
    return np.append(np.flatnonzero(start), n)


class Codec:
    """Encoder and decoder over ranks: bytes -> id, an id being its rank of merging."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.cache: dict[str, bytes] = {}
        size = max(ranks.values()) + 1
        pieces = [b""] * size
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.lengths = np.fromiter(map(len, pieces), np.int64, size)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.single = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        self._index_pairs()

    @classmethod
    def read(cls, path: str) -> Codec:
        with open(path, "rb") as file:
            return cls({base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)})

    def _index_pairs(self) -> None:
        """A hash table, open to the right, from two adjacent ids to the rank of
        their bytes together."""
        ranks, keys, values = self.ranks, [], []
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                if (a := ranks.get(piece[:i])) is not None and (b := ranks.get(piece[i:])) is not None:
                    keys.append(a << 32 | b), values.append(rank)
        size = 1 << max(10, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.keys, self.values = np.full(size + 1, -1, np.int64), np.full(size + 1, NONE, np.int64)
        key, value = np.array(keys, np.int64), np.array(values, np.int64)
        at = self._slot(key)
        while len(key):
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = first[free[first]]
            self.keys[at[put]], self.values[at[put]] = key[put], value[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, value, at = key[rest], value[rest], (at[rest] + 1) % size

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at, out = self._slot(key), np.full(len(key), NONE, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            held = self.keys[at]
            same = held == key
            out[todo[same]] = self.values[at[same]]
            on = ~same & (held != -1)
            todo, key, at = todo[on], key[on], (at[on] + 1) % (len(self.keys) - 1)
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """merge() of many slices at once, packed: each round merges in every slice the
        leftmost pair of its least rank; slices without a pair leave."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        own = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(ids), NONE, np.int64)
        pair = np.flatnonzero(own[:-1] == own[1:])
        rank[pair] = self._pair_ranks(ids[pair], ids[pair + 1])
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(ids)))
            done = least == NONE
            if done.any():
                for n, a, k in zip(own[starts[done]].tolist(), starts[done].tolist(), lengths[done].tolist()):
                    out[n] = ids[a : a + k].astype("<u4").tobytes()
                on = np.repeat(~done, lengths)
                ids, own, rank = ids[on], own[on], rank[on]
                least, lengths = least[~done], lengths[~done]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, lengths))
            hit = hit[np.concatenate(([True], own[hit][1:] != own[hit][:-1]))]
            ids[hit] = least
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged parts are once the others have gone
            ids, own, rank = ids[keep], own[keep], rank[keep]
            rank[at] = NONE
            redo = np.concatenate([at, at - 1])
            redo = redo[(redo >= 0) & (redo < len(ids) - 1)]
            redo = redo[own[redo] == own[redo + 1]]
            rank[redo] = self._pair_ranks(ids[redo], ids[redo + 1])
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the adjacent pair of least rank is merged, the leftmost
        first, until none has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        return self._by_heap(piece)

    def _by_heap(self, piece: bytes) -> list[int]:
        """By a heap over a linked list, for slices of any length."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # the end of the part that starts here
        left = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or not alive[j] or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                left[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := left[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers."""
        cut = [borders(t).tolist() for t in texts]
        slices = [[t[a:b] for a, b in zip(at, at[1:])] for t, at in zip(texts, cut)]
        cache, every = self.cache, set().union(*slices)
        if missing := every.difference(cache):
            if len(cache) + len(missing) > CACHE_ENTRIES:
                cache.clear()
                missing = every
            short = [s for s in missing if len(s) <= LONG]
            cache.update(zip(short, self.merge_many([s.encode("utf-8", "replace") for s in short])))
            cache.update((s, np.array(self.merge(s.encode("utf-8", "replace")), "<u4").tobytes()) for s in missing if len(s) > LONG)
        return [b"".join(map(cache.__getitem__, own)) for own in slices]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def offsets(self, ids: bytes) -> np.ndarray:
        """The byte at which each id's text starts, with the length at the end."""
        return np.concatenate(([0], np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids, gathered by their offsets."""
        numbers = np.frombuffer(ids, "<u4")
        lengths, at = self.lengths[numbers], self.offsets(ids)
        return self.bytes[np.repeat(self.starts[numbers] - at[:-1], lengths) + np.arange(at[-1])].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec.read(path)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode_documents(docs: DataFrame, ranks: str | None = None, offsets: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row and whole text of `docs` (doc_id, text);
    ids is binary, little-endian unsigned 32-bit. With `offsets` also the byte at
    which each id starts, as unsigned 64-bit. Null text counts as empty and has no
    ids; repeated rows are encoded each; an empty table gives an empty result;
    other columns are ignored. No string is special."""
    ranks = ranks or default_ranks()

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        own = codec(ranks)
        ids = own.encode_many(batch.column(1).to_pylist())
        more = {"offsets": [own.offsets(i)[:-1].astype("<u8").tobytes() for i in ids]} if offsets else {}
        yield {"doc_id": batch.column(0), "n_tokens": [len(i) // 4 for i in ids], "ids": ids, **more}

    schema = "doc_id long, n_tokens long, ids binary" + ", offsets binary" * offsets
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), rows, schema, 256)


def decode_documents(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """`encoded` (doc_id, n_tokens, ids) with the decoded bytes."""
    ranks = ranks or default_ranks()

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        own = codec(ranks)
        yield {"doc_id": batch.column(0), "n_tokens": batch.column(1), "ids": batch.column(2), "decoded": [own.decode(i) for i in batch.column(2).to_pylist()]}

    return arrow_map(encoded.select("doc_id", "n_tokens", "ids"), rows, "doc_id long, n_tokens long, ids binary, decoded binary", 256)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decode_documents(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
