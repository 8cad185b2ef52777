"""Quality classifier by positive-unlabelled learning (operator 10).

Trusted positives and unlabelled web text are all it learns from. The class prior
is estimated by the best-bin rule on a first classifier of positives against
unlabelled; a linear model then minimises the non-negative unbiased risk.
Features describe form, not words: n-grams of character classes, repetition, and
the worst stretch of a text, so that junk within good text shows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import arrow_map, binary_rows, held_out, mix64, with_text

#: The sample that the classifier is fitted on (the fit alone; every text is
#: scored): positives, unlabelled texts.
SAMPLE_POSITIVE = 4000
SAMPLE_UNLABELLED = 6000
#: A text with a score of at least this is predicted to be good.
THRESHOLD = 0.7

SHAPE_BITS = 9
_WINDOW = 40
_CHUNK = 1 << 20

_ASCII = np.zeros(128, np.uint8)
_ASCII[ord("a") : ord("z") + 1] = 1
_ASCII[ord("A") : ord("Z") + 1] = 2
_ASCII[ord("0") : ord("9") + 1] = 3
_ASCII[[9, 32]] = 4
_ASCII[[10, 13]] = 5
for _i, _c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _ASCII[ord(_c)] = 8 + _i


def _classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(codes), 6, np.uint8)  # other letters and signs
    plain = codes < 128
    out[plain] = _ASCII[codes[plain]]
    return out


def _worst(values: np.ndarray, width: int) -> float:
    """The largest mean over a stretch of `width` values."""
    if len(values) <= width:
        return float(values.mean()) if len(values) else 0.0
    total = np.concatenate(([0.0], np.cumsum(values)))
    return float((total[width:] - total[:-width]).max() / width)


STATS = 20


def features(text: str) -> np.ndarray:
    """Shape n-gram frequencies and statistics of one whole text."""
    out = np.zeros((1 << SHAPE_BITS) + STATS, np.float32)
    n = max(1, len(text))
    shape = out[STATS:]
    for at in range(0, len(text), _CHUNK):
        kind = _classes(text[at : at + _CHUNK + 2]).astype(np.uint64)
        for order in (1, 2, 3):
            if len(kind) >= order:
                key = np.full(len(kind) - order + 1, order, np.uint64)
                for i in range(order):
                    key = (key << np.uint64(6)) | kind[i : len(kind) - order + 1 + i]
                # Pieces overlap by two characters; an n-gram counts where it begins.
                shape += np.bincount((mix64(key[:_CHUNK]) >> np.uint64(64 - SHAPE_BITS)).astype(np.int64), minlength=1 << SHAPE_BITS)
    np.sqrt(shape / n, out=shape)
    words = text.split()
    m = len(words)
    if not m:
        out[0] = 1.0
        return out
    codes = np.fromiter(map(hash, words), np.int64, m)
    sizes = np.fromiter(map(len, words), np.int64, m)
    upper = np.fromiter((w.isupper() and len(w) > 1 for w in words), np.float32, m)
    sign = np.fromiter((not w[-1].isalnum() for w in words), np.float32, m)
    stray = np.fromiter((not w.strip(".,;:!?\"'()-").isalnum() for w in words), np.float32, m)
    same = np.concatenate(([0.0], codes[1:] == codes[:-1])).astype(np.float32)
    near = np.zeros(m, np.float32)  # a pair of words that came shortly before
    if m > 3:
        pair = codes[1:] * 31 + codes[:-1]
        order = np.argsort(pair, kind="stable")
        close = (pair[order][1:] == pair[order][:-1]) & (np.diff(order) < 120)
        near[order[1:][close]] = 1.0
    _, counts = np.unique(codes, return_counts=True)
    lines = text.split("\n")
    out[:STATS] = (
        0.0, np.log(m) / 10, np.log1p(sizes.mean()), np.log1p(sizes.std()),
        len(counts) / m, counts.max() / m, np.log(m / len(counts)),
        upper.mean(), _worst(upper, _WINDOW), sign.mean(), _worst(sign, _WINDOW),
        stray.mean(), _worst(stray, _WINDOW), same.mean(), _worst(same, _WINDOW),
        near.mean(), _worst(near, _WINDOW), len(set(lines)) / len(lines), 1.0 / m, np.log1p(sizes.max()),
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return _sigmoid(_expand(rows, self.mean, self.scale) @ self.weights + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _expand(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, bounded, and for the statistics also their excess both ways."""
    z = np.clip((rows - mean) / scale, -6, 6)
    s = z[:, :STATS]
    return np.hstack([z, np.maximum(s - 1, 0), np.maximum(-s - 1, 0), np.maximum(s - 3, 0)])


def _descend(gradient, size: int, steps: int, rate: float = 0.03) -> tuple[np.ndarray, float]:
    """Adam over weights and bias; gradient(w, b) -> (dw, db)."""
    w, b = np.zeros(size, np.float32), np.float32(0)
    m, v = np.zeros(size + 1, np.float32), np.zeros(size + 1, np.float32)
    for t in range(1, steps + 1):
        dw, db = gradient(w, b)
        g = np.append(dw, db).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - np.float32(step[-1])
    return w, b


def _against_unlabelled(p: np.ndarray, u: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    def gradient(w, b):
        gp, gu = _sigmoid(p @ w + b) - 1, _sigmoid(u @ w + b)
        return p.T @ gp / len(p) + u.T @ gu / len(u) + l2 * w, gp.mean() + gu.mean()

    return _descend(gradient, p.shape[1], steps)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, by the best bin: the least ratio of
    unlabelled to positive texts above a score, allowing for the size of each."""
    top = np.sort(np.concatenate([positive, unlabelled]))
    cuts = top[:: max(1, len(top) // 400)]
    qp = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    qu = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    used = qp > 0.3
    best = np.argmin((qu[used] + slack) / qp[used])
    return float(np.clip(qu[used][best] / qp[used][best], 0.05, 0.98))


def risk_of_positives(p: np.ndarray, prior: float, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
    """The share of positives times their log loss as such, with its gradient by w and b."""
    sp = _sigmoid(p @ w + b)
    return float(-prior * np.log(np.maximum(sp, 1e-12)).mean()), prior * (p.T @ (sp - 1)) / len(p), float(prior * (sp - 1).mean())


def risk_of_negatives(p: np.ndarray, u: np.ndarray, prior: float, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
    """The unbiased risk of negatives, with its gradient: the log loss of unlabelled rows as
    negatives, less what the positives among them, by the prior, add to it."""
    sp, su = _sigmoid(p @ w + b), _sigmoid(u @ w + b)
    risk = -np.log1p(-np.minimum(su, 1 - 1e-6)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-6)).mean()
    return float(risk), u.T @ su / len(u) - prior * (p.T @ sp) / len(p), float(su.mean() - prior * sp.mean())


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, l2: float = 1e-3, steps: int = 250) -> Model:
    """Fit on feature rows. Without positives or unlabelled texts every score is 1."""
    if not len(positive) or not len(unlabelled):
        size = (1 << SHAPE_BITS) + STATS
        return Model(np.zeros(size), np.ones(size), np.zeros(size + 3 * STATS), 40.0, 1.0)
    both = np.vstack([positive, unlabelled])
    mean, scale = positive.mean(axis=0), np.maximum(positive.std(axis=0), 0.25 * both.std(axis=0) + 1e-4)
    p, u = (_expand(x, mean, scale).astype(np.float32) for x in (positive, unlabelled))
    if prior is None:
        half = [np.arange(len(x)) % 2 == 0 for x in (p, u)]
        w, b = _against_unlabelled(p[half[0]], u[half[1]], 1e-2, 150)
        prior = estimate_prior(p[~half[0]] @ w + b, u[~half[1]] @ w + b) if min(len(p), len(u)) > 1 else 0.5

    def gradient(w, b):
        below, dw, db = risk_of_negatives(p, u, prior, w, b)
        if below < 0:  # the unbiased risk of negatives went below zero: step back
            return l2 * w - dw, -db
        _, pw, pb = risk_of_positives(p, prior, w, b)
        return dw + pw + l2 * w, db + pb

    w, b = _descend(gradient, p.shape[1], steps)
    return Model(mean, scale, w, float(b), prior)


def _rows(docs: DataFrame, most: int) -> np.ndarray:
    """Feature rows of `most` rows of a sample (h, text) at most, the first by h, in this
    order. Workers compute the features; the driver gets those alone."""

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"h": batch.column(0), "x": binary_rows([features(t) for t in batch.column(1).to_pylist()])}

    found = [bytes(r["x"]) for r in arrow_map(docs, rows, "h long, x binary", 64).orderBy("h").limit(most).collect()]
    return np.stack([np.frombuffer(x, np.float32) for x in found]) if found else np.zeros((0, (1 << SHAPE_BITS) + STATS), np.float32)


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None, positives: int = SAMPLE_POSITIVE, unlabelled: int = SAMPLE_UNLABELLED) -> Model:
    """Fit on rows of `docs` (doc_id, text) that pass `keep` (by default all outside
    the evaluation fold): `positives` of those that `labels` marks with quality 1, and
    `unlabelled` of all, whatever their label, at most. A hash of id and text picks
    and orders the rows, so rows that repeat an id are picked each by its text, and of
    equal rows no more than the bound. Rows without id or text are not learned from."""
    keep = ~held_out() if keep is None else keep
    unit = lambda seed: F.pmod(F.xxhash64(F.col("h"), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    usable = docs.where(keep & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = labels.where((F.col("quality") == 1) & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    n_all, n_good = usable.select("doc_id").count(), usable.select("doc_id").join(good, "doc_id", "left_semi").count()
    if not n_good or not n_all:
        return fit(np.zeros((0, 0)), np.zeros((0, 0)))
    hashed = usable.withColumn("h", F.xxhash64("doc_id", "text"))
    some = lambda rows, seed, most, n: rows.where(unit(seed) < (1.2 * most + 50) / n).select("h", "text")  # noqa: E731  some more than are wanted
    # Only what a sample of all rows needs is looked up among the labels, ids first.
    share = min(1.0, (1.2 * positives + 50) / n_good)
    picked = hashed.where(unit(7) < share).select("h", "doc_id").join(good, "doc_id", "left_semi").select("h").distinct().orderBy("h").limit(positives)
    p = _rows(hashed.where(unit(7) < share).join(F.broadcast(picked), "h", "left_semi").select("h", "text"), positives)  # `positives` rows at most
    u = _rows(some(hashed, 11, unlabelled, n_all), unlabelled)
    return fit(p, u)


def score_documents(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns `keep` of every row of `docs` with score (0 to 1) and predicted (1 from
    THRESHOLD). The whole text is read; null counts as empty, and empty texts are
    scored like any other. Equal texts get equal scores; an empty table gives an
    empty result."""
    keep = ["doc_id"] if keep is None else keep
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column(at).to_pylist()
        score = model.score(np.stack([features(t or "") for t in texts])) if texts else np.zeros(0)
        yield {**{c: batch.column(n) for n, c in enumerate(keep)}, "score": score.tolist(), "predicted": (score >= THRESHOLD).astype(int).tolist()}

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double, predicted int"])
    at, columns = with_text(docs, keep, text)
    return arrow_map(docs.select(*columns), rows, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out())
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs, train(docs, labels), ["doc_id", "held_out"])
