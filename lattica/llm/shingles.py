"""Word shingles of whole texts, hashed with numpy."""

from __future__ import annotations

import numpy as np

from .common import mix64

#: Words of a shingle.
WORDS = 5

_WORD_BYTE = np.zeros(256, np.uint8)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_STEP = 0x9E3779B97F4A7C15
_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    if n >= len(_powers["up"]):
        size = max(1 << 16, 1 << n.bit_length())
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[key] = np.multiply.accumulate(factors)
    return _powers["up"], _powers["down"]


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word: runs of a-z, 0-9 and all beyond ASCII, lower-cased."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD_BYTE[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _tables(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        return mix64((total[ends] - total[starts]) * down[starts])


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """A hash of each run of `words` words, in order; a shorter text that has words
    is one shingle of all of them, a text without words has none."""
    hashed = word_hashes(text)
    if not len(hashed):
        return hashed
    span = min(words, len(hashed))
    with np.errstate(over="ignore"):
        out = np.full(len(hashed) - span + 1, span, np.uint64)
        for j in range(span):
            out = out * np.uint64(_STEP) + hashed[j : len(hashed) - span + 1 + j]
    return mix64(out)
