"""Ranked search, quality rules and fill-in-the-middle: against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"


def docs(spark, rows, source="s"):
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else source, 0) for r in rows], SCHEMA)


# Ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def ranked(rows, items, k):
    held = [(i, terms(t)) for i, t in rows]
    held = [(i, t) for i, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, t in held:
            m, s = 75 + (25 * len(t) * n) // total, 0
            for w in terms(text):
                if tf := t.count(w):
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            if s:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def searched(spark, tmp_path, rows, items, k, parts=3, **sizes):
    from lattica.llm.common import Workspace
    from lattica.llm.ranked_search import build_index, search

    df = docs(spark, rows).repartition(parts).withColumns({"term": F.lit(1), "block": F.lit(2), "documents": F.lit("x")})
    index = build_index(spark, df, Workspace(spark, "t", str(tmp_path / "index")), **sizes)
    out = search(spark, index, spark.createDataFrame(items, ITEMS).withColumn("rank", F.lit(9)), k, group_items=4)
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_ranked_search_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Él", "él", "straße", "日本", "x٣", "A1"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice((5, 66))]) for _ in range(n))
    rows = [(rng.randrange(10**6) * rng.choice((1, -1)), text(rng.choice((1, 3, 20, 90)))) for _ in range(300)]
    rows += [(7, "W1, w1; W2-w3_w4"), (7, "W1, w1; W2-w3_w4"), (None, "w1 w2"), (None, "w1 w2"), (8, None), (9, ""), (10, " .,!\x7f"), (11, text(20_000)), (12, "w1 " * 70_000)]
    items = [(1, text(30)), (2, "w1"), (2, "w1"), (3, "nothing here is known"), (4, None), (5, ""), (6, text(200)), (7, "él ÉL w1 W1 w1 日本"), (8, text(3)), (9, text(12)), (None, "w2 w3")]
    want = ranked(rows, items, 20)
    assert searched(spark, tmp_path / "a", rows, items, 20) == want
    assert searched(spark, tmp_path / "b", rows, items, 20, block_documents=7, block_terms=500) == want
    assert searched(spark, tmp_path / "c", rows, items, 1000, parts=1) == ranked(rows, items, 1000)


def test_ranked_search_of_ties_and_empty_tables(spark, tmp_path):
    rows = [(i, "alpha beta") for i in range(200)] + [(1000 + i, "gamma") for i in range(300)]
    assert searched(spark, tmp_path / "a", rows, [(1, "beta")], 20) == ranked(rows, [(1, "beta")], 20)
    assert searched(spark, tmp_path / "b", [], [(1, "beta")], 20) == []
    assert searched(spark, tmp_path / "c", rows, [], 20) == []
    assert searched(spark, tmp_path / "d", [(1, None), (2, "..")], [(1, "beta")], 20) == []


def test_sums_of_slices_are_sums_of_numbers():
    from lattica.llm.ranked_search import _add, best, times

    rng = np.random.default_rng(5)
    slices = lambda v, bits: np.stack([np.packbits((v >> s) & 1, bitorder="little").view(np.uint64) for s in range(bits)])
    numbers = lambda s: sum((np.unpackbits(row.view(np.uint8), bitorder="little").astype(np.int64) << i for i, row in enumerate(s)), np.zeros(64 * s.shape[1], np.int64))
    a, b = (rng.integers(0, 1 << 20, 640) for _ in range(2))
    total = slices(a, 45)
    _add(total, slices(b, 20))
    assert (numbers(total) == a + b).all()
    factors = rng.integers(0, 9000, 10)
    assert (numbers(times(slices(b, 20), factors)) == b * np.repeat(factors, 64)).all()
    few = rng.integers(0, 30, 640)  # some twenty of each
    sure, left = best(slices(few, 5)[:, None, :], 100)
    chosen = np.flatnonzero(np.unpackbits(sure[0].view(np.uint8), bitorder="little"))
    tied = np.flatnonzero(np.unpackbits(left[0].view(np.uint8), bitorder="little"))
    assert len(chosen) <= 100 <= len(chosen) + len(tied) and len(set(few[tied])) == 1 and few[chosen].min() > few[tied[0]]


# Quality rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def base_counts(text):
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def normal(line):
    return " ".join(WORD.findall(re.sub("[0-9]", "0", line.translate(LOWER))))


def verdicts(rows, most, share):
    """For each row: counts, base_failed, removed words, kept, clean text."""
    texts = [(i, t or "", h) for i, t, h in rows]
    held, hosts = {}, {}
    for _, t, h in texts:
        hosts.setdefault(h, set()).add(t)
        for x in t.split("\n"):
            if WORD.search(x):
                held.setdefault((h, normal(x)), set()).add(t)
    gone = {key for key, some in held.items() if len(some) > most and len(some) > share * len(hosts[key[0]])}
    out = []
    for i, t, h in texts:
        n, *rest = base_counts(t)
        keep = [x for x in t.split("\n") if not WORD.search(x) or (h, normal(x)) not in gone]
        left = len(WORD.findall("\n".join(keep)))
        failed = n < 10 or 100 * rest[-1] > 20 * n
        out.append((i, n, *rest, failed, n - left, not failed and left >= 10 and left >= 0.5 * n, "\n".join(keep)))
    return sorted(out, key=str)


RULED = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept", "clean_text"]


@pytest.mark.parametrize("sizes", [{}, {"broadcast_lines": 0, "hot_part": 20}, {"broadcast_lines": 0}])
def test_quality_rules_equal_brute_force(spark, sizes):
    from lattica.llm.quality_rules import line_rules

    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(["ab", "cd", "Éf", "gh", "$5", "<i>", "日"]) + str(rng.randrange(300)) for _ in range(rng.randrange(1, 12)))
    shared = [line() for _ in range(12)]
    rows = []
    for i in range(150):
        body = [rng.choice(shared) if rng.random() < 0.4 else line() for _ in range(rng.randrange(1, 9))]
        rows.append((i, rng.choice(["\n", "\n\n", "\r\n"]).join(body), rng.choice(["a", "a", "b", None])))
    rows += [(200 + i, f"Page {i} of {i * 7}\n" + line() + "\n" + line(), "a") for i in range(30)]
    rows += [(300, None, "a"), (301, "", "a"), (302, " \n\x0b\n", None), (303, "x y " * 30_000, "b"), (304, "\n".join(shared), "a"), (304, "\n".join(shared), "a"), (None, line(), "b")]
    rows += [(400 + i, "the same text in many rows is one text of its host\nand so is no frequent line", "c") for i in range(40)]
    df = docs(spark, rows).repartition(5).withColumns({"lines": F.lit(1), "row": F.lit(2), "host": F.lit(3), "kept": F.lit("x"), "n_words": F.lit(0)})
    out = line_rules(spark, df, ["doc_id", "kept", "row", "lines"], most=4, share=0.05, clean=True, **sizes)
    assert set(out.columns) == {*RULED, "row", "lines", "removed_lines"}
    got = sorted((tuple(r) for r in out.select(*RULED).collect()), key=str)
    assert got == verdicts([(i, t, h) for i, t, h in rows], 4, 0.05)
    assert any(r[7] for r in got) and any(not r[8] and not r[6] for r in got)


def test_quality_rules_of_an_empty_table(spark):
    from lattica.llm.quality_rules import line_rules

    assert line_rules(spark, docs(spark, []), ["doc_id"]).count() == 0


def test_repeated_windows_do_not_cross_texts():
    from lattica.llm.quality_rules import repeated_words

    rng = random.Random(6)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(0, 40))] for _ in range(200)]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = repeated_words(np.array([w for t in texts for w in t]), owner, len(texts))
    assert got.tolist() == [base_counts(" ".join(map(str, t)))[4] for t in texts]


# Fill in the middle


def middle(i, text, seed=1, words=("<P>", "<S>", "<M>"), cuts=None):
    """n, form, prefix and middle lengths and output of a text, in units given by their starts."""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * j : 8 * j + 8], 16) for j in range(4))
    starts = list(range(len(text))) if cuts is None else cuts(text)
    n = len(starts)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(w in text for w in words) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    at = [*starts, len(text)]
    prefix, mid, suffix = text[: at[a]], text[at[a] : at[b]], text[at[b] :]
    p, s, m = words
    if h4 % 100 < 20:
        return n, "spm", a, b - a, s + suffix + p + prefix + m + mid
    return n, "psm", a, b - a, p + prefix + s + suffix + m + mid


def word_starts(text):
    return [m.start() for m in WORD.finditer(text)]


def line_starts(text):
    return [0, *(m.end() for m in re.finditer("\n", text) if m.end() < len(text))] if text else []


MIDDLE = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


@pytest.mark.parametrize("unit,cuts", [("char", None), ("word", word_starts), ("line", line_starts)])
@pytest.mark.parametrize("part_bytes", [1 << 20, 700])
def test_fill_in_middle_equals_brute_force(spark, unit, cuts, part_bytes):
    from lattica.llm.fill_in_middle import fill_in_middle, restored

    rng = random.Random(7)
    text = lambda n: "".join(rng.choice(["a", "b ", "é", "日", "😀", "\n", "<", "<P", "S>", "\x00", "  "]) for _ in range(n))
    rows = [(i, text(rng.choice((1, 2, 5, 80, 300)))) for i in range(150)] + [(200 + i, text(3000)) for i in range(6)]
    rows += [(300, None), (301, ""), (302, "a<S>b"), (303, "x" * 699 + "<M>" + "y" * 700), (304, "x" * 254 + "<P>"), (305, "<<P>>"), (306, "😀" * 500), (None, "null id " * 9), (7, "again " * 200), (7, "again " * 200), (307, " " * 2000)]
    df = docs(spark, rows).repartition(3).withColumns({"n": F.lit("x"), "row": F.lit(1), "h1": F.lit(2)})
    out = fill_in_middle(spark, df, ["doc_id", "row", "n"], unit=unit, part_bytes=part_bytes).withColumn("back", restored(F.col("output"), F.col("form")))
    got = out.collect()
    assert set(out.columns) == {*MIDDLE, "row", "back"}
    assert sorted((tuple(r[c] for c in MIDDLE) for r in got), key=str) == sorted(((i, *middle(i, t or "", cuts=cuts)) for i, t in rows), key=str)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_other_sentinels_and_empty_table(spark):
    from lattica.llm.fill_in_middle import fill_in_middle, restored

    words = ("aab", "aabc.", "\\Q|")
    rows = [(i, t) for i, t in enumerate(["aaab", "aaxb", "x\\Q|", "aabc", "plain words of a text"] * 8)]
    out = fill_in_middle(spark, docs(spark, rows), ["doc_id"], words=words, plain_from=100).collect()
    assert sorted((tuple(r[c] for c in MIDDLE)) for r in out if r["form"] == "plain") == sorted((i, len(t), "plain", None, None, t) for i, t in rows if any(w in t for w in words))
    assert fill_in_middle(spark, docs(spark, []), ["doc_id"]).count() == 0


def test_functions_of_chunks_compose():
    from lattica.llm.fill_in_middle import CHUNK, Scanned, compose, units

    rng = random.Random(8)
    texts = ["".join(rng.choice("ab é日😀\n") for _ in range(rng.choice((0, 1, 10, CHUNK, 2000)))).encode() for _ in range(60)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    for kind in ("char", "word", "line"):
        whole = Scanned(data, offsets, units(kind))
        for n, t in enumerate(texts):
            at = rng.randrange(len(t) + 1)
            parts = [Scanned(np.frombuffer(p, np.uint8), np.array([0, len(p)]), units(kind)) for p in (t[:at], t[at:])]
            end, count = compose(*((p.end, p.count) for p in parts))
            assert (end[:, 0] == whole.end[:, n]).all() and (count[:, 0] == whole.count[:, n]).all()
