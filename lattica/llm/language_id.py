"""Language identification by nearest centroid (operator 3).

A text becomes a normalised TF-IDF vector of hashed character n-grams. Every
language has several centroids, clustered from its training texts; the language
of the centroid with the largest cosine is predicted, and a text much farther from it
than the training texts of its language were is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import arrow_map, binary_rows, held_out, mix64, with_text

#: Hashed n-gram dimensions, n-gram orders, centroids for each language.
DIMENSION_BITS = 12
DIMENSIONS = 1 << DIMENSION_BITS
ORDERS = (1, 2, 3)
CENTROIDS = 4
#: The sample that the classifier is fitted on (the fit alone; every text is
#: classified): rows of one language, and rows in all.
SAMPLE_PER_LANGUAGE = 800
SAMPLE_TOTAL = 8000
#: A text is rejected where its cosine is below this share of a low quantile of the
#: cosines that training texts of its length class had with their nearest centroid.
REJECT_SHARE, LOW = 0.75, 0.01
#: Length classes end at so many characters: a short text has few of a centroid's
#: n-grams, so its cosine is small by nature. A class of fewer training texts than
#: CLASS_TEXTS takes SHORTER of the next longer class's limit.
LENGTHS = (25, 50, 100, 200)
CLASS_TEXTS, SHORTER = 30, 0.7
_CHUNK = 1 << 21


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def _buckets(codes: np.ndarray, order: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.zeros(len(codes) - order + 1, np.uint64)
        for i in range(order):
            key = key * np.uint64(0x100000001B3) + codes[i : len(codes) - order + 1 + i]
        return (mix64(key + np.uint64(order << 56)) >> np.uint64(64 - DIMENSION_BITS)).astype(np.int64)


def term_counts(text: str) -> np.ndarray:
    """Counts of hashed character n-grams of a whole text, lower-cased, runs of
    other characters than letters folded to one space."""
    total = np.zeros(DIMENSIONS, np.float32)
    lowered = " " + text.lower() + " "
    before, seen = np.zeros(0, np.uint64), False  # the last codes of the piece before; whether it ended in a letter
    for at in range(0, len(lowered), _CHUNK):
        codes = np.frombuffer(lowered[at : at + _CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = ((codes >= 97) & (codes <= 122)) | (codes >= 0xAA)
        codes = np.where(letter, codes, 32)
        fresh = codes[np.concatenate(([at == 0 or seen or bool(letter[0])], letter[1:] | letter[:-1]))].astype(np.uint64)
        seen = bool(letter[-1])
        for order in ORDERS:  # n-grams that end in this piece
            own = np.concatenate([before[len(before) - min(len(before), order - 1) :], fresh])
            if len(own) >= order:
                total += np.bincount(_buckets(own, order), minlength=DIMENSIONS)
        before = np.concatenate([before, fresh])[-(max(ORDERS) - 1) :]
    return total


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: (1 + log tf) * idf."""
    counts = np.stack([term_counts(t) for t in texts])
    np.log1p(counts, out=counts)
    counts *= idf
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)
    return counts


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    vectors: np.ndarray  # centroids, unit length
    owner: np.ndarray  # language of each centroid
    least: np.ndarray  # lowest cosine that is accepted, by length class

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine, and whether the distance rejects the text."""
        cosine = vectors(texts, self.idf) @ self.vectors.T
        best = cosine.argmax(axis=1)
        score = cosine[np.arange(len(best)), best]
        kind = np.searchsorted(LENGTHS, [len(t) for t in texts], "right")
        return self.owner[best], np.clip(score, 0, 1), score < self.least[kind]


def _clusters(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from the rows farthest from those chosen before."""
    chosen = [rows.sum(axis=0)]
    chosen[0] /= max(np.linalg.norm(chosen[0]), 1e-12)
    while len(chosen) < min(k, len(rows)):
        chosen.append(rows[np.max(rows @ np.stack(chosen).T, axis=1).argmin()])
    centers = np.stack(chosen)
    for _ in range(rounds):
        nearest = (rows @ centers.T).argmax(axis=1)
        for c in range(len(centers)):
            if (nearest == c).any():
                mean = rows[nearest == c].sum(axis=0)
                centers[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centers


def limits(cosine: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The lowest cosine that is accepted in each length class, from those of training texts."""
    kind = np.searchsorted(LENGTHS, lengths, "right")
    least = np.full(len(LENGTHS) + 1, REJECT_SHARE * np.quantile(cosine, LOW))
    for k in reversed(range(len(least))):
        if (kind == k).sum() >= CLASS_TEXTS:
            least[k] = REJECT_SHARE * np.quantile(cosine[kind == k], LOW)
        elif k < len(LENGTHS):
            least[k] = SHORTER * least[k + 1]
    return least


def fit_centroids(counts: np.ndarray, languages: list[str], lengths: np.ndarray, k: int = CENTROIDS) -> Centroids:
    """Fit on the term counts and text lengths of a sample; idf comes from the sample too."""
    names = sorted(set(languages))
    if not names:
        return Centroids([], np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(len(LENGTHS) + 1))
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    rows = np.log1p(counts) * idf
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    tags = np.array(languages)
    centers, owner, cosine = [], [], np.zeros(len(rows))
    for n, name in enumerate(names):
        own = rows[tags == name]
        found = _clusters(own, k)
        near = own @ found.T
        cosine[tags == name] = near.max(axis=1)
        used = sorted(set(near.argmax(axis=1).tolist()))
        centers += [found[c] for c in used]
        owner += [n] * len(used)
    return Centroids(names, idf, np.stack(centers).astype(np.float32), np.array(owner), limits(cosine, lengths))


def train(docs: DataFrame, keep: Column, per_language: int = SAMPLE_PER_LANGUAGE, total: int = SAMPLE_TOTAL) -> Centroids:
    """Fit on rows of `docs` that pass `keep` and have a letter in their text and a lang.

    The sample has `per_language` rows of each language at most, fewer where there are
    so many languages that they would be more than `total` in all, but one row of each
    at least; of more than `total` languages, so many are learned, by a hash of
    their names. A hash of id and text picks and orders the rows, so rows that repeat an
    id, or have none, are picked each by its text, and of equal rows no more than the
    bound. Workers count the n-grams, so the driver gets vectors, not texts."""
    usable = docs.where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.xxhash64("lang"), "lang").limit(total).collect()
    each = max(1, min(per_language, total // max(1, len(sizes))))
    # More than are wanted, so that hardly a language falls short by chance.
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (1.5 * each + 30) / r["n"])) for r in sizes], "lang string, share double")
    unit = F.pmod(F.col("h"), F.lit(1_000_003)) / 1_000_003.0

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        found = [(h, lang, len(text), term_counts(text)) for h, lang, text in zip(*(c.to_pylist() for c in batch.columns)) if has_letter(text)]
        nonzero = [np.flatnonzero(v).astype("<u2") for *_, v in found]
        yield {"h": [f[0] for f in found], "lang": [f[1] for f in found], "size": [f[2] for f in found], "at": binary_rows(nonzero), "tf": binary_rows([f[3][i].astype("<f4") for f, i in zip(found, nonzero)])}

    some = usable.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(shares), "lang").where(unit < F.col("share"))  # `total` rows at most
    counted = arrow_map(some.select("h", "lang", "text"), rows, "h long, lang string, size long, at binary, tf binary", 64)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = counted.withColumn("k", rank).where(F.col("k") <= each).drop("k").collect()
    picked.sort(key=lambda r: (r["lang"], r["h"]))
    counts = np.zeros((len(picked), DIMENSIONS), np.float32)
    for n, r in enumerate(picked):
        counts[n, np.frombuffer(bytes(r["at"]), "<u2")] = np.frombuffer(bytes(r["tf"]), "<f4")
    return fit_centroids(counts, [r["lang"] for r in picked], np.array([r["size"] for r in picked]))


def identify(docs: DataFrame, model: Centroids, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns `keep` of every row of `docs` with lang_pred, score and rejected.

    The whole text is read. lang_pred is a learned language, or `und` where the
    text is null or has no letter or nothing was learned; those have score 0 and
    are rejected. Otherwise score is the cosine of the nearest centroid, and
    rejected tells that it is too far. Equal texts get equal answers; an empty
    table gives an empty result.
    """
    keep = ["doc_id"] if keep is None else keep
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double, rejected boolean"])
    at, columns = with_text(docs, keep, text)

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column(at).to_pylist()
        lang, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        told = [i for i, t in enumerate(texts) if t and has_letter(t)] if model.languages else []
        for n in range(0, len(told), 128):
            some = told[n : n + 128]
            for i, own, cosine, far in zip(some, *(x.tolist() for x in model.predict([texts[i] for i in some]))):
                lang[i], score[i], rejected[i] = model.languages[own], cosine, far
        yield {**{c: batch.column(n) for n, c in enumerate(keep)}, "lang_pred": lang, "score": score, "rejected": rejected}

    return arrow_map(docs.select(*columns), rows, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out())
    return identify(docs, train(docs, ~F.col("held_out")), ["doc_id", "held_out"])
