"""Fill-in-the-middle by a parallel scan of automata (operator 13).

Units of a text (code points, words or lines) and the sentinels in it are found by small
automata over bytes. A text is cut into chunks; each chunk gives its transition function,
the state it ends in for every state it may be entered in, and the units it begins for each
of them. Functions compose associatively, so a scan of doublings tells every chunk's real
entry state and the units before it. A cut is then selected: the chunk in which the unit
begins, and within it the byte.

Within a task all chunks of a batch of texts advance side by side. A giant text is split
first: its parts are spread over tasks, which give a function a part; the functions are
composed, and the one part that holds a cut is scanned again from its entry state.

A null or empty text, and one that holds a sentinel, stays plain. A null id is drawn as an
empty one. Repeated rows are alike. Columns of the result replace kept columns of the same
name. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Workspace, arrow_map, byte_slices, bytes_of, text_or_empty

SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of a chunk of the scan within a task.
CHUNK = 256
#: A text of more bytes than this is scanned in parts of that many.
PART_BYTES = 1 << 20
#: Bytes of texts that a task scans at once, but for one text.
BATCH_BYTES = 4 << 20


@dataclass(frozen=True)
class Automaton:
    """next[state, class] and begins[state, class], with the class of each byte. The last
    class is of no byte: it fills chunks up, keeps every state and begins nothing."""

    classes: np.ndarray
    next: np.ndarray
    begins: np.ndarray

    @property
    def states(self) -> int:
        return len(self.next)


def _automaton(classes: np.ndarray, table: list[list[int]], begins: list[list[int]]) -> Automaton:
    states = len(table)
    padded = np.array([[*row, s] for s, row in enumerate(table)], np.uint8)
    return Automaton(classes.astype(np.uint8), padded, np.array([[*row, 0] for row in begins], np.uint16).reshape(states, -1))


def _by_range(*ranges: tuple[int, int, int]) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for first, last, value in ranges:
        out[first : last + 1] = value
    return out


def units(kind: str) -> Automaton:
    """Automaton that tells where units begin: `char` (code points of UTF-8), `word` (runs
    between ASCII white space) or `line` (after each line feed)."""
    if kind == "char":  # states: bytes that the code point still lacks; a stray one joins what is before it
        classes = _by_range((0x80, 0xBF, 1), (0xC0, 0xDF, 2), (0xE0, 0xEF, 3), (0xF0, 0xFF, 4))
        return _automaton(classes, [[0, max(s - 1, 0), 1, 2, 3] for s in range(4)], [[1, 0, 1, 1, 1]] * 4)
    if kind == "word":
        classes = _by_range((9, 13, 1), (32, 32, 1))
        return _automaton(classes, [[1, 0], [1, 0]], [[1, 0], [0, 0]])
    if kind == "line":  # state 0: a line begins here
        return _automaton(_by_range((10, 10, 1)), [[1, 0], [1, 0]], [[1, 1], [0, 0]])
    raise ValueError(f"unknown unit: {kind}")


def sentinels(words: tuple[str, ...]) -> Automaton:
    """Automaton that stays in its last state once it has read any of the words."""
    heads = sorted({w.encode()[:n] for w in words for n in range(len(w.encode()))})
    found = len(heads)
    table = np.zeros((found + 1, 256), np.int64)
    table[found] = found
    whole = [w.encode() for w in words]
    for s, head in enumerate(heads):
        for b in range(256):
            read = head + bytes([b])
            table[s, b] = found if any(read.endswith(w) for w in whole) else next(heads.index(read[i:]) for i in range(len(read) + 1) if read[i:] in heads)
    columns, classes = np.unique(table, axis=1, return_inverse=True)
    return _automaton(np.asarray(classes).reshape(-1), columns.tolist(), [[0] * columns.shape[1]] * (found + 1))


def _chunks(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, machine: Automaton) -> np.ndarray:
    """Classes of the bytes of each chunk, (byte, chunk); filled up to CHUNK."""
    at = starts[None, :] + np.arange(CHUNK)[:, None]
    inside = np.arange(CHUNK)[:, None] < sizes[None, :]
    filler = np.uint8(machine.next.shape[1] - 1)
    if not len(data):
        return np.full(at.shape, filler, np.uint8)
    return np.where(inside, machine.classes[data[np.minimum(at, len(data) - 1)]], filler)


def functions(classes: np.ndarray, machine: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk and each entry state: the state at its end, the units it begins."""
    width = machine.next.shape[1]
    after, begins = machine.next.reshape(-1), machine.begins.reshape(-1)
    state = np.repeat(np.arange(machine.states, dtype=np.uint8)[:, None], classes.shape[1], axis=1)
    count = np.zeros(state.shape, np.int64)
    for row in classes:
        move = state * np.uint8(width) + row
        if machine.begins.any():
            count += begins[move]
        state = after[move]
    return state, count


def compose(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The function that applies `first`, then `second`; associative. (state, chunk) each."""
    end, count = first
    return np.take_along_axis(second[0], end.astype(np.int64), axis=0), count + np.take_along_axis(second[1], end.astype(np.int64), axis=0)


def scan(end: np.ndarray, count: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive compositions of the chunks of each owner, in place order, by doubling."""
    end, count, step = end.copy(), count.copy(), 1
    while step < len(owner) and (same := np.flatnonzero(owner[step:] == owner[:-step])).size:
        e, c = compose((end[:, same], count[:, same]), (end[:, same + step], count[:, same + step]))
        end[:, same + step], count[:, same + step] = e, c
        step *= 2
    return end, count


class Scanned:
    """Texts of a batch, scanned: units of each, its last state, and selection of units.
    `entry` is the state in which a text is entered, 0 unless it is a part."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, machine: Automaton, entry: np.ndarray | None = None):
        size = np.diff(offsets)
        many = np.maximum(-(-size // CHUNK), 1)
        self.owner = np.repeat(np.arange(len(size)), many)
        self.first = np.cumsum(many) - many
        within = np.arange(len(self.owner)) - self.first[self.owner]
        self.starts = offsets[:-1][self.owner] + within * CHUNK
        sizes = np.minimum(offsets[1:][self.owner] - self.starts, CHUNK)
        self.machine, self.offsets = machine, offsets
        self.classes = _chunks(data, self.starts, sizes, machine)
        self.functions = scan(*functions(self.classes, machine), self.owner)
        last = self.first + many - 1
        self.end, self.count = (f[:, last] for f in self.functions)  # of whole texts, for each entry state
        self.entry = np.zeros(len(size), np.int64) if entry is None else entry

    def units(self) -> np.ndarray:
        return self.count[self.entry, np.arange(len(self.entry))]

    def last_state(self) -> np.ndarray:
        return self.end[self.entry, np.arange(len(self.entry))]

    def select(self, unit: np.ndarray) -> np.ndarray:
        """The byte of each text at which its unit of this number (from 0) begins; the
        text's end for a number beyond the last."""
        size, out = np.diff(self.offsets), np.diff(self.offsets).copy()
        ask = np.flatnonzero(unit < self.units())
        if not len(ask):
            return out
        entry = self.entry[self.owner]
        state, before = (f[entry, np.arange(len(entry))] for f in self.functions)
        # counts rise within a text: one search over all texts, each lifted above those before it
        lift = np.concatenate([[0], np.cumsum(self.units() + 1)[:-1]])
        chunk = np.searchsorted(before + lift[self.owner], unit[ask] + lift[ask], side="right")
        opens = chunk == self.first[ask]
        now = np.where(opens, self.entry[ask], state[np.maximum(chunk - 1, 0)]).astype(np.int64)
        seen = np.where(opens, 0, before[np.maximum(chunk - 1, 0)])
        place = np.full(len(ask), -1)
        for at, row in enumerate(self.classes[:, chunk]):
            begins = self.machine.begins[now, row].astype(np.int64)
            place = np.where((place < 0) & (begins > 0) & (seen == unit[ask]), at, place)
            seen, now = seen + begins, self.machine.next[now, row].astype(np.int64)
        out[ask] = self.starts[chunk] - self.offsets[:-1][ask] + place
        assert (out <= size).all()
        return out


def draws(key: str, seed: int) -> list[Column]:
    """Four numbers below 2**32 of a document: groups of the sha256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _cuts(h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = h1 % (n + 1), h2 % (n + 1)
    return np.minimum(one, two), np.maximum(one, two)


_SCAN = "n long, first_unit long, second_unit long, first_byte long, second_byte long, marked boolean"
_MADE = ["n", "form", "prefix_chars", "middle_chars", "output"]


def _small(docs: DataFrame, carried: list, unit: str, words: tuple[str, ...]) -> DataFrame:
    """Cuts of texts that a task scans whole."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in carried), _SCAN])

    def cut(batch: pa.RecordBatch):
        machine, guard = units(unit), sentinels(words)
        for some in byte_slices(batch, batch.schema.get_field_index("text"), BATCH_BYTES):
            data, offsets = bytes_of(some.column("text"))
            scanned = Scanned(data, offsets, machine)
            first, second = _cuts(*(some.column(h).to_numpy() for h in ("h1", "h2")), scanned.units())
            made = {"n": scanned.units(), "first_unit": first, "second_unit": second, "first_byte": scanned.select(first), "second_byte": scanned.select(second)}
            del scanned
            marked = Scanned(data, offsets, guard).last_state() == guard.states - 1
            yield {f.name: some.column(f.name) for f in carried} | {c: pa.array(v) for c, v in made.items()} | {"marked": pa.array(marked)}

    return arrow_map(docs, cut, schema, size=4096)


def _giant(spark: SparkSession, space: Workspace, docs: DataFrame, carried: list, unit: str, words: tuple[str, ...], part_bytes: int) -> DataFrame | None:
    """Cuts of texts that are scanned in parts, by many tasks each."""
    texts = space.table("giants", docs.withColumn("row", F.monotonically_increasing_id()))
    if texts.isEmpty():
        return None
    size = F.octet_length("text")
    parts = texts.select("row", "text", F.explode(F.sequence(F.lit(0), F.ceil(size / part_bytes).cast("int") - 1)).alias("part"))
    parts = parts.select("row", "part", F.substring(F.col("text").cast("binary"), F.col("part") * part_bytes + 1, part_bytes).alias("bytes"))
    parts = space.table("parts", parts.repartition("row", "part"))
    of = "array<bigint>"

    def functions_of(batch: pa.RecordBatch):
        machine, guard = units(unit), sentinels(words)
        data, offsets = bytes_of(batch.column("bytes"))
        one, two = Scanned(data, offsets, machine), Scanned(data, offsets, guard)
        yield {"row": batch.column("row"), "part": batch.column("part"), "ends": one.end.T.astype(np.int64).tolist(), "counts": one.count.T.tolist(), "guard": two.end.T.astype(np.int64).tolist()}

    maps = arrow_map(parts, functions_of, f"row long, part int, ends {of}, counts {of}, guard {of}", size=4)
    # a text of 2 GB, the most that a row holds, has 2,048 parts of 1 MiB
    listed = maps.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "ends", "counts", "guard"))).alias("parts"))
    start = F.struct(F.lit(0).cast("long").alias("state"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("mark"), F.array().cast("array<struct<state:bigint,before:bigint>>").alias("entries"))
    get = lambda array, at: F.element_at(array, (at + 1).cast("int"))
    step = lambda a, p: F.struct(
        get(p["ends"], a["state"]).alias("state"), (a["before"] + get(p["counts"], a["state"])).alias("before"), get(p["guard"], a["mark"]).alias("mark"),
        F.concat(a["entries"], F.array(F.struct(a["state"].alias("state"), a["before"].alias("before")))).alias("entries"),
    )
    whole = listed.select("row", F.aggregate("parts", start, step).alias("all"))
    whole = whole.select("row", F.col("all.before").alias("n"), (F.col("all.mark") == sentinels(words).states - 1).alias("marked"), F.col("all.entries").alias("entries"))
    drawn = texts.select("row", "h1", "h2").join(whole, "row")
    one, two = (F.col(h) % (F.col("n") + 1) for h in ("h1", "h2"))
    drawn = space.table("drawn", drawn.select("row", "n", "marked", F.least(one, two).alias("first_unit"), F.greatest(one, two).alias("second_unit"), "entries"))
    asked = drawn.select("row", "n", "entries", F.explode(F.array(F.struct(F.lit(0).alias("cut"), F.col("first_unit").alias("unit")), F.struct(F.lit(1).alias("cut"), F.col("second_unit").alias("unit")))).alias("c"))
    asked = asked.select("row", "c.*", "entries").where(F.col("c.unit") < F.col("n"))
    part = F.size(F.filter("entries", lambda e: e["before"] <= F.col("unit"))) - 1  # the last part that begins no later unit
    asked = asked.withColumn("part", part).select("row", "cut", "part", "unit", F.col("entries")[F.col("part")].alias("entry"))
    asked = asked.select("row", "cut", "part", (F.col("unit") - F.col("entry.before")).alias("unit"), F.col("entry.state").alias("entry"))

    def find(batch: pa.RecordBatch):
        machine = units(unit)
        data, offsets = bytes_of(batch.column("bytes"))
        at = Scanned(data, offsets, machine, batch.column("entry").to_numpy()).select(batch.column("unit").to_numpy())
        yield {"row": batch.column("row"), "cut": batch.column("cut"), "byte": pa.array(at + batch.column("part").to_numpy().astype(np.int64) * part_bytes)}

    found = arrow_map(parts.join(asked, ["row", "part"]), find, "row long, cut int, byte long", size=4)
    found = found.groupBy("row").agg(F.max(F.when(F.col("cut") == 0, F.col("byte"))).alias("first_byte"), F.max(F.when(F.col("cut") == 1, F.col("byte"))).alias("second_byte"))
    cuts = drawn.drop("entries").join(found, "row", "left")
    out = texts.join(cuts, "row")
    ends = {c: F.coalesce(F.col(c), F.octet_length("text").cast("long")) for c in ("first_byte", "second_byte")}  # beyond the last unit
    return out.select(*(f.name for f in carried), "n", "first_unit", "second_unit", *(v.alias(c) for c, v in ends.items()), "marked")


def fill_in_middle(
    spark: SparkSession, docs: DataFrame, keep: list[str], text: str = "text", key: str = "doc_id", unit: str = "char",
    seed: int = 1, plain_from: int = 90, suffix_first: int = 20, words: tuple[str, str, str] = SENTINELS, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Rows of docs with columns `keep` and n (units), form (plain, psm or spm),
    prefix_chars and middle_chars (units; null where plain) and output, the text in that
    form. Of a hundred texts some `plain_from` are cut, `suffix_first` in a hundred of these
    with the suffix first; the draws depend on seed and id alone."""
    names = {c: f"k{i}" for i, c in enumerate(c for c in keep if c not in _MADE)}
    plain = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in names.items()), text_or_empty(f"`{text}`").alias("text"), *(h.alias(f"h{i + 1}") for i, h in enumerate(draws(f"`{key}`", seed))))
    carried = list(plain.schema)
    size = F.octet_length("text")
    cut = _small(plain.where(size <= part_bytes), carried, unit, words)
    giant = _giant(spark, Workspace(spark, "fill-in-middle"), plain.where(size > part_bytes), carried, unit, words, part_bytes)
    if giant is not None:
        cut = cut.unionByName(giant)
    p, s, m = (F.lit(w) for w in words)
    stays = (F.col("text") == "") | F.col("marked") | (F.col("h3") % 100 >= plain_from)
    form = F.when(stays, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    part = lambda a, b: F.substring(F.col("text").cast("binary"), (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    first, second = F.col("first_byte"), F.col("second_byte")
    prefix, middle, suffix = part(F.lit(0), first), part(first, second), part(second, F.octet_length("text"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    told = lambda c: F.when(F.col("form") != "plain", c)
    cut = cut.withColumn("form", form)
    return cut.select(*(F.col(a).alias(c) for c, a in names.items()), "n", "form", told(F.col("first_unit")).alias("prefix_chars"), told(F.col("second_unit") - F.col("first_unit")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, words: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of. Sentinels begin and end with different
    characters, so none arises where a text and a sentinel meet."""
    parts = F.split(output, "|".join(re.sub(r"([^A-Za-z0-9])", r"\\\1", w) for w in words), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut over code points, with digests of the output and of the text
    rebuilt from it."""
    made = fill_in_middle(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP13_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
numbers AS (
  SELECT doc_id, text, n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM drawn
),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
),
parts AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN a END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN b - a END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
