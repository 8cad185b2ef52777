"""Quality rules: cross-document line frequency (operator 12).

A task reads each text once: it counts words, symbols, repeated lines and repeated windows,
and hashes the text's normalised lines (A-Z lower-cased, digits as 0, white space as one
blank). The distinct texts that hold a line are counted for each host; equal texts count
once, since copies are for deduplication to find. A line above the limits of its host is
removed from the host's documents, and a document with too few words left is rejected.

A null or empty text has no words and fails. A null host is a host of its own. Repeated rows
get a row each. An empty table gives an empty result. Columns of the result replace kept
columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Workspace, arrow_map, byte_slices, text_or_empty

#: A line is removed from a host's documents where more distinct texts than this hold it ...
MOST_DOCUMENTS = 50
#: ... and more than this share of the host's distinct texts.
MOST_SHARE = 0.005
#: Words and share of its words that must be left to a document.
LEAST_WORDS = 10
LEAST_SHARE = 0.5
#: Bytes of texts that a task measures at once, but for one text.
BATCH_BYTES = 4 << 20
#: Windows that show repetition.
WINDOW = 5
#: Lines above the limits that are sent to all tasks; more are joined by shuffles.
BROADCAST_LINES = 300_000
#: A line with more than this part of all rows of lines is hot: there are fewer such lines
#: than its inverse.
HOT_PART = 10_000

_SYMBOLS = np.zeros(256, np.uint8)
_SYMBOLS[list(b"#*$%&|<>")] = 1
#: A-Z lower-cased, digits as 0; all other bytes as they are.
_NORMAL = bytes(b + 32 if 65 <= b < 91 else 48 if 48 <= b < 58 else b for b in range(256))


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.translate(_NORMAL).split())


def _line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def _rank(*keys: np.ndarray) -> np.ndarray:
    """A number for each row, equal for rows that are equal in both keys."""
    first, second = (k.astype(np.int64) for k in keys)
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1]


def repeated_words(words: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """How many words of each text lie in windows that the text holds twice or more; `words`
    are numbers, equal for equal words, and `owner` is the text of each."""
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.zeros(texts, np.int64)
    whole = owner[:n] == owner[WINDOW - 1 :]
    key = owner[:n]
    for at in range(WINDOW):  # ranks stay below the number of rows, so keys don't overflow
        key = _rank(key, words[at : at + n])
    count = np.bincount(key[whole], minlength=int(key.max()) + 1)
    twice = whole & (count[key] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + WINDOW, -1)
    return np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=texts)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _measures(texts: list[str]) -> dict[str, object]:
    """Counts of each text, its hash, and its distinct normalised lines with their words."""
    numbers, words, sizes, chars = _Numbers(), [], [], []
    out: dict[str, list] = {"n_symbols": [], "n_dup_lines": [], "text_hash": [], "lines": [], "line_words": []}
    for text in texts:
        data = text.encode()
        found = data.split()
        words.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
        sizes.append(len(found))
        raw = np.frombuffer(b"".join(found), np.uint8)
        chars.append(int(((raw & 0xC0) != 0x80).sum()))
        out["n_symbols"].append(int(_SYMBOLS[raw].sum()))
        lines = [line for line in data.split(b"\n") if line.strip()]
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        held: dict[int, int] = {}
        for line in lines:
            key = _line_hash(normal_line(line))
            held[key] = held.get(key, 0) + len(line.split())
        out["lines"].append(list(held))
        out["line_words"].append(list(held.values()))
        out["text_hash"].append(_line_hash(data))
    sizes_ = np.array(sizes, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes_)
    repeats = repeated_words(np.concatenate(words) if words else np.zeros(0, np.int64), owner, len(texts))
    return out | {"n_words": sizes, "word_chars": chars, "n_repeat_words": repeats.tolist()}


def _without(texts: list[str], gone: list[list[int] | None]) -> list[str]:
    """Texts without the lines of these hashes."""
    return [t if not g else "\n".join(line for line in t.split("\n") if not line.strip() or _line_hash(normal_line(line.encode())) not in set(g)) for t, g in zip(texts, gone)]


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "removed_lines", "kept", "clean_text"]


def base_failed() -> Column:
    """A text of few words, or one of which more than a fifth lies in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def frequent_lines(lines: DataFrame, hosts: DataFrame, most: int = MOST_DOCUMENTS, share: float = MOST_SHARE) -> DataFrame:
    """Lines above the limits of their hosts: host, line, documents. The count of distinct
    texts shuffles by line and text first, so a line that all documents hold is no hot key."""
    counted = lines.groupBy("host", "line").agg(F.count_distinct("text_hash").alias("documents")).where(F.col("documents") > most)
    limits = hosts.groupBy("host").agg(F.count_distinct("text_hash").alias("texts"))
    return counted.join(limits, "host").where(F.col("documents") > share * F.col("texts")).drop("texts")


def _in_frequent(lines: DataFrame, frequent: DataFrame, small: bool, hot: int) -> DataFrame:
    """Rows of lines that are in the table of frequent ones, which is sent to all tasks where
    it is small. Else only lines of more than `hot` texts are, so that no key is heavy."""
    on = ["host", "line"]
    if small:
        return lines.join(F.broadcast(frequent.select(*on)), on, "left_semi")
    most = F.broadcast(frequent.where(F.col("documents") > hot).select(*on))
    rest = frequent.where(F.col("documents") <= hot).select(*on)
    return lines.join(most, on, "left_semi").unionByName(lines.join(most, on, "left_anti").join(rest.hint("merge"), on, "left_semi"))


def line_rules(spark: SparkSession, docs: DataFrame, keep: list[str], text: str = "text", host: str = "source", most: int = MOST_DOCUMENTS, share: float = MOST_SHARE, clean: bool = False, broadcast_lines: int = BROADCAST_LINES, hot_part: int = HOT_PART) -> DataFrame:
    """Rows of docs with columns `keep`, the counts, base_failed, removed_words,
    removed_lines (hashes) and kept; with `clean` also clean_text, the text without the
    lines removed. Rows that fail the base rules count for lines like all others."""
    space = Workspace(spark, "quality-rules")
    names = {c: f"k{i}" for i, c in enumerate(c for c in keep if c not in _MADE)}
    plain = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in names.items()), F.xxhash64(F.col(f"`{host}`").cast("string")).alias("host"), text_or_empty(f"`{text}`").alias("text"))
    held = [f for f in plain.schema if clean or f.name != "text"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in held), COUNTS, "text_hash long, lines array<bigint>, line_words array<bigint>"])
    at = plain.columns.index("text")

    def measure(batch: pa.RecordBatch):
        for some in byte_slices(batch, at, BATCH_BYTES):
            yield {f.name: some.column(f.name) for f in held} | _measures(some.column(at).to_pylist())

    read = space.table("measured", arrow_map(plain, measure, schema, size=4096).withColumn("row", F.monotonically_increasing_id()))
    pairs = F.explode(F.arrays_zip(F.col("lines").alias("line"), F.col("line_words").alias("words")))
    lines = read.select("row", "host", "text_hash", pairs.alias("pair")).select("row", "host", "text_hash", "pair.*").toDF("row", "host", "text_hash", "line", "words")
    found = space.table("frequent", frequent_lines(lines, read, most, share))
    small = found.count() <= broadcast_lines
    hot = 0 if small else int(read.agg(F.sum(F.size("lines"))).first()[0] or 0) // hot_part
    gone = _in_frequent(lines, found, small, hot).groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_lines"))  # a document's own lines
    judged = read.drop("lines", "line_words", "host", "text_hash").join(gone, "row", "left")
    left = F.col("n_words") - F.col("removed_words")
    judged = judged.withColumns({"base_failed": base_failed(), "removed_words": F.coalesce("removed_words", F.lit(0))})
    judged = judged.withColumn("kept", ~F.col("base_failed") & (left >= LEAST_WORDS) & (left >= LEAST_SHARE * F.col("n_words")))
    if clean:
        columns = [f for f in judged.schema if f.name not in ("row", "text")]
        ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in columns), "clean_text string"])

        def strip(batch: pa.RecordBatch):
            yield {f.name: batch.column(f.name) for f in columns} | {"clean_text": _without(batch.column("text").to_pylist(), batch.column("removed_lines").to_pylist())}

        judged = arrow_map(judged.drop("row"), strip, ddl)
    made = [c for c in _MADE if c in judged.columns]
    return judged.select(*(F.col(a).alias(c) for c, a in names.items()), *made)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and verdict of every document; hosts are sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_rules(spark, docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP12_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs),
windows AS (
  SELECT r, place, count(*) OVER (PARTITION BY r, w) AS times
  FROM (SELECT r, unnest(range(1, len(ws) - {WINDOW - 2})) AS place, unnest([ws[i : i + {WINDOW - 1}] for i in range(1, len(ws) - {WINDOW - 2})]) AS w FROM split)
),
repeats AS (SELECT r, count(DISTINCT word) AS n FROM (SELECT r, unnest(range(place, place + {WINDOW})) AS word FROM windows WHERE times > 1) GROUP BY r),
lines AS (
  SELECT r, source, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    array_to_string(regexp_extract_all(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[^\x20\x09-\x0D]+'), ' ') AS normal
  FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
hosts AS (SELECT source, count(DISTINCT text) AS texts FROM docs GROUP BY source),
frequent AS (
  SELECT l.source, normal FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, normal, texts HAVING count(DISTINCT text) > {MOST_DOCUMENTS} AND count(DISTINCT text) > {MOST_SHARE} * texts
),
gone AS (SELECT r, sum(words) AS n FROM lines l JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.normal = f.normal GROUP BY r),
counted AS (
  SELECT doc_id, len(ws) AS n_words, list_sum(list_transform(ws, lambda x: length(x))) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, dups.n AS n_dup_lines, repeats.n AS n_repeat_words, len(ws) - coalesce(gone.n, 0) AS left_words
  FROM docs JOIN split USING (r) LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r) LEFT JOIN gone USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words) AND left_words >= {LEAST_WORDS} AND left_words >= {LEAST_SHARE} * n_words AS kept
FROM counted
"""
