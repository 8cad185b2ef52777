"""Packing, language, licences, encoding, quality: against libraries and brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(rng, n, letters="aeioustrn"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(n))


# Packing


def pack(spark, df, **kw):
    from lattica.llm.packing import pack_documents

    return [r.asDict() for r in pack_documents(spark, df, carry={"ids": F.col("ids")}, **kw).collect()]


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_ids_pieces_and_fill(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rng = random.Random(1)
    texts = [words(rng, rng.randint(0, 120)) for _ in range(150)] + [None, "", "same", "same", "x <|endoftext|> it's  ñandú 　 😀\n\n", words(rng, 400), "a" * 3000]
    rows = pack(spark, docs(spark, texts).withColumns({"item": F.lit("clash"), "length": F.lit(1), "ids": F.lit(2)}), capacity=128)
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        have = got.setdefault(r["doc_id"], [])
        assert r["start"] == len(have) and (r["piece"] == 0 or r["length"] == 128)
        have += np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(r["ids"]) == 4 * r["length"]
    for i, text in enumerate(texts):
        assert got[i] == tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    n = check_packing(rows, 128)
    assert n <= -(-sum(r["length"] for r in rows) // 128) + 5


@pytest.mark.parametrize("sizes", [[5] * 300, [128] * 3 + [127, 1], list(range(1, 128)) * 2, [65] * 20 + [63] * 20, [1] * 500])
def test_packing_lengths(spark, sizes):
    from lattica.llm.common import Workspace
    from lattica.llm.packing import best_fit

    items = spark.createDataFrame(list(enumerate(sizes)), "item long, length int")
    rows = [{"offset": r["offset"], "length": sizes[r["item"]], "sequence_id": r["sequence_id"], "item": r["item"]} for r in best_fit(Workspace(spark, "t"), items, 128).collect()]
    assert sorted(r["item"] for r in rows) == list(range(len(sizes)))
    assert check_packing(rows, 128) <= -(-sum(sizes) // 128) + 4


def test_packing_sweep_plan_matches_in_order():
    from lattica.llm.packing import _plan

    rows, found = _plan({("a", "G"): 3, ("b", "U"): 2, ("b", "G"): 1, ("c", "U"): 5})
    assert rows == [("b", 0, 2, "a", 2), ("c", 0, 1, "b", 0), ("c", 1, 2, "a", 1)] and found == {"a": 0, "b": 2, "c": 2}


def test_packing_ids_of_added_tokens(spark, tmp_path):
    """The query gives the ids of the library as it loads the file."""
    import zlib as z

    import public_tokenizers
    from tokenizers import Tokenizer

    from lattica.llm.packing import op1_best_fit_packing

    tokenizer, end = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), "<|endoftext|>"
    texts = [end, f"{end}a b", f"a {end} b", f"a b{end}", f"a{end}{end} {end}\n{end}", "<|endoftext|", f"x  {end}  it's", "plain", None]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op1_best_fit_packing(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert (got[i]["length"], got[i]["ids_crc32"]) == (len(ids), z.crc32(np.array(ids, "<u4").tobytes())), text
    assert 50256 in tokenizer.encode(texts[0], add_special_tokens=False).ids


def test_packing_is_as_tight_as_sequential_best_fit(spark):
    from lattica.llm.common import Workspace
    from lattica.llm.packing import best_fit

    rng = random.Random(11)
    for sizes in ([min(512, int(rng.expovariate(1 / 90)) + 1) for _ in range(3000)], [rng.randint(100, 400) for _ in range(2000)]):
        gaps = [0] * 513  # how many sequences have a gap of a size
        sequences = 0
        for size in sorted(sizes, reverse=True):
            gap = next((g for g in range(size, 513) if gaps[g]), None)
            if gap is None:
                sequences, gap = sequences + 1, 512
            else:
                gaps[gap] -= 1
            gaps[gap - size] += 1
        items = spark.createDataFrame(list(enumerate(sizes)), "item long, length int").repartition(4)
        rows = [{"offset": r["offset"], "length": sizes[r["item"]], "sequence_id": r["sequence_id"]} for r in best_fit(Workspace(spark, "t"), items, 512).collect()]
        assert check_packing(rows, 512) <= 1.03 * sequences + 2


def test_packing_empty_and_sequences(spark):
    from lattica.llm.packing import pack_documents, packed_sequences

    assert pack(spark, empty(spark)) == []
    out = packed_sequences(pack_documents(spark, docs(spark, ["a b", "c", None]), capacity=16)).collect()
    assert len(out) == 1 and len(out[0]["ids"]) == 4 * out[0]["length"] == 4 * 6


# Language


def test_language_held_out_and_edges(spark):
    from lattica.llm.language_id import identify, train

    rng = random.Random(2)
    kinds = {"xx": "abcdefgh", "yy": "ijklmnop", "zz": "qrstuvwxé"}
    rows = [(i, words(rng, rng.randint(3, 60), kinds[k]), k, "s", 0) for i, k in enumerate(list(kinds) * 60)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = train(df, F.col("doc_id") % 4 != 0, per_language=30)
    odd = spark.createDataFrame([(900, None, "xx", "s", 0), (901, "", None, "s", 0), (902, "123 !! 4", "xx", "s", 0), (903, "x" * 3_000_000, "xx", "s", 0), (None, "abc", "xx", "s", 0)], SCHEMA)
    out = {r["doc_id"]: r for r in identify(df.unionByName(odd).withColumns({"score": F.lit("clash"), "_text": F.lit(0)}), model).collect()}
    held = [r for r in rows if r[0] % 4 == 0]
    assert sum(out[r[0]]["lang_pred"] == r[2] for r in held) / len(held) > 0.97
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and out[903]["lang_pred"] in kinds and len(out) == len(rows) + 5
    assert all(0 <= r["score"] <= 1 for r in out.values()) and not any(out[r[0]]["rejected"] for r in held)
    assert sum(o == n for o, n in zip(model.owner[:-1], model.owner[1:])) > 0  # several centroids a language
    nothing = train(empty(spark), F.lit(True))
    assert identify(docs(spark, ["abc"]), nothing).first()["lang_pred"] == "und" and identify(empty(spark), model).count() == 0


def test_language_ngrams_cover_the_whole_text():
    from lattica.llm import language_id as L

    rng = random.Random(3)
    text = words(rng, 3000)
    whole, step = L.term_counts(text), L._CHUNK
    try:
        L._CHUNK = 1000
        parts = L.term_counts(text)
    finally:
        L._CHUNK = step
    assert (whole == parts).all()
    assert L.term_counts("ab" + "c" * 5000 + "tail").sum() > 3 * 5000


def test_language_of_many_languages_and_ids(spark):
    from lattica.llm.language_id import identify, train

    rng = random.Random(12)
    alphabets = {f"l{n:03d}": "".join(chr(0x4E00 + 6 * n + i) for i in range(6)) for n in range(300)}
    rows = [(7, words(rng, 20, letters), name, "s", 0) for name, letters in alphabets.items() for _ in range(3)]
    rows += [(None, words(rng, 20, letters), name, "s", 0) for name, letters in alphabets.items()] + [(7, "same text", "l000", "s", 0)] * 500
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    model = train(df, F.lit(True), total=900)
    assert len(model.languages) == 300
    asked = [(i, words(rng, 20, letters), name, "s", 0) for i, (name, letters) in enumerate(alphabets.items())]
    out = {r["doc_id"]: r["lang_pred"] for r in identify(spark.createDataFrame(asked, SCHEMA), model).collect()}
    assert sum(out[r[0]] == r[2] for r in asked) > 290
    assert len(train(df, F.lit(True), total=50).languages) == 50  # more languages than rows of the sample


def test_language_against_plain_cosines(spark):
    from lattica.llm import language_id as L

    rng = random.Random(13)
    kinds = {"xx": "abcdefgh", "yy": "efghijkl"}
    rows = [(i, words(rng, rng.randint(3, 60), kinds[k]), k, "s", 0) for i, k in enumerate(list(kinds) * 60)]
    model = L.train(spark.createDataFrame(rows, SCHEMA), F.lit(True))
    texts = [words(rng, rng.randint(2, 30), kinds[k]) for k in list(kinds) * 8] + ["Abc, de! 12 f", "x" * 300]
    for text, owner, score in zip(texts, *model.predict(texts)[:2]):
        plain = "".join(c if "a" <= c <= "z" or ord(c) >= 0xAA else " " for c in f" {text.lower()} ")
        plain = " " + " ".join(plain.split()) + " "
        tf = {}
        for n in L.ORDERS:
            for i in range(len(plain) - n + 1):
                at = int(L._buckets(np.array([ord(c) for c in plain[i : i + n]], np.uint64), n)[0])
                tf[at] = tf.get(at, 0) + 1
        x = {k: np.log1p(v) * model.idf[k] for k, v in tf.items()}
        norm = sum(v * v for v in x.values()) ** 0.5
        cosines = [sum(v * c[k] for k, v in x.items()) / norm for c in model.vectors]
        best = int(np.argmax(cosines))
        assert abs(cosines[best] - score) < 1e-4 and (model.owner[best] == owner or sorted(cosines)[-2] > cosines[best] - 1e-5)


def test_language_rejects_what_is_far(spark):
    """Texts of a language that was not learned go, those of one that was stay."""
    from lattica.llm.language_id import identify, train

    rng = random.Random(14)
    stems = {k: [words(rng, 1, "abcdefghijklmnopqrstuvwxyz") for _ in range(250)] for k in ("xx", "yy", "far")}
    text = lambda k: " ".join(rng.choice(stems[k]) for _ in range(rng.randint(5, 150)))
    rows = [(i, text(k), k, "s", 0) for i, k in enumerate(["xx", "yy"] * 200)]
    model = train(spark.createDataFrame(rows, SCHEMA), F.lit(True))
    out = identify(spark.createDataFrame([(i, text(k), k, "s", 0) for i, k in enumerate(["xx", "yy", "far", "far"] * 40)], SCHEMA), model, ["lang"]).groupBy("lang").agg(F.avg(F.col("rejected").cast("int")).alias("r")).collect()
    share = {r["lang"]: r["r"] for r in out}
    assert share["xx"] <= 0.02 and share["yy"] <= 0.02 and share["far"] >= 0.9


# Quality


def test_quality_risk_gradient_and_score():
    from lattica.llm import quality as Q

    gen = np.random.default_rng(5)
    p, u = gen.normal(0.7, 1, (40, 6)), gen.normal(0, 1, (60, 6))
    w, b, prior = gen.normal(0, 0.4, 6), 0.2, 0.45

    def plain(w, b):  # both risks, row by row
        loss = lambda x, label: -np.log((1 / (1 + np.exp(-(x @ w + b)))) if label else 1 - 1 / (1 + np.exp(-(x @ w + b))))
        mean = lambda rows, label: sum(loss(x, label) for x in rows) / len(rows)
        return prior * mean(p, 1), mean(u, 0) - prior * mean(p, 0)

    for n, (risk, dw, db) in enumerate((Q.risk_of_positives(p, prior, w, b), Q.risk_of_negatives(p, u, prior, w, b))):
        assert abs(risk - plain(w, b)[n]) < 1e-9
        for i in range(6):
            step = np.eye(6)[i] * 1e-5
            assert abs((plain(w + step, b)[n] - plain(w - step, b)[n]) / 2e-5 - dw[i]) < 1e-6
        assert abs((plain(w, b + 1e-5)[n] - plain(w, b - 1e-5)[n]) / 2e-5 - db) < 1e-6
    size = (1 << Q.SHAPE_BITS) + Q.STATS
    model = Q.Model(gen.normal(0, 1, size), gen.uniform(0.5, 2, size), gen.normal(0, 0.1, size + 3 * Q.STATS), 0.3, 0.5)
    row = gen.normal(0, 2, size)
    z = [max(-6, min(6, (x - m) / s)) for x, m, s in zip(row, model.mean, model.scale)]
    all_ = z + [max(x - 1, 0) for x in z[: Q.STATS]] + [max(-x - 1, 0) for x in z[: Q.STATS]] + [max(x - 3, 0) for x in z[: Q.STATS]]
    assert abs(model.score(row[None, :])[0] - 1 / (1 + np.exp(-(sum(x * k for x, k in zip(all_, model.weights)) + 0.3)))) < 1e-9


def test_quality_sample_is_bounded_by_rows(spark):
    from lattica.llm.quality import train

    rng = random.Random(15)
    one = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(one, words(rng, 40).capitalize() + ".", "en", "s", 0) for _ in range(300)] + [(one, "one text", "en", "s", 0)] * 400 + [(None, "no id", "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    import lattica.llm.quality as Q

    got = []
    fit, Q.fit = Q.fit, lambda p, u, *a, **k: got.append((len(p), len(u))) or fit(p, u, *a, **k)
    try:
        train(df, spark.createDataFrame([(one, 1, 0)], "doc_id long, quality int, toxic int"), keep=F.lit(True), positives=40, unlabelled=60)
    finally:
        Q.fit = fit
    assert 20 <= got[0][0] <= 40 and 20 <= got[0][1] <= 60


def test_quality_features_cover_the_whole_text():
    from lattica.llm import quality as Q

    text = words(random.Random(16), 800)
    whole, step = Q.features(text), Q._CHUNK
    try:
        Q._CHUNK = 101
        assert np.allclose(whole, Q.features(text))
    finally:
        Q._CHUNK = step


def test_quality_held_out_and_edges(spark):
    from lattica.llm.quality import estimate_prior, score_documents, train

    rng = random.Random(4)

    def bad():
        return rng.choice([lambda: " ".join([words(rng, 1)] * 60), lambda: words(rng, 60).upper().replace(" ", "!! "), lambda: words(rng, 50).replace(" ", "%%% ")])()

    rows = [(i, bad() if i % 5 == 0 else words(rng, rng.randint(20, 150)).capitalize() + ".", "en", "s", 0) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 500) if i % 3], "doc_id long, quality int, toxic int")
    model = train(df, labels)
    assert 0.6 < model.prior < 0.95
    odd = spark.createDataFrame([(900, None, "", "", 0), (901, "", "", "", 0), (902, "ab " * 300_000, "", "", 0), (903, "x" * 500_000, "", "", 0)], SCHEMA)
    out = {r["doc_id"]: r for r in score_documents(df.unionByName(odd).withColumn("predicted", F.lit("clash")), model).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(out[i]["predicted"] == int(i % 5 != 0) for i in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out.values()) and out[900]["score"] == out[901]["score"] and out[902]["predicted"] == 0
    gen = np.random.default_rng(0)
    p = gen.normal(2, 1, 3000)
    assert abs(estimate_prior(p, np.concatenate([gen.normal(2, 1, 2100), gen.normal(-3, 1, 900)])) - 0.7) < 0.08
    nothing = train(empty(spark), labels.limit(0))
    assert score_documents(docs(spark, ["a"]), nothing).first()["score"] == 1.0 and score_documents(empty(spark), model).count() == 0


# Licences


def test_licenses(spark):
    from lattica.llm.licenses import scan_licenses, train

    rng = random.Random(5)
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Licensed under the Apache License, Version 2.0.": "Apache", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Released under the MIT License.": "MIT",
        "Distributed under the BSD 3-Clause License": "BSD", "CC BY-SA 4.0": "CC-BY-SA", "He lost his driving license last year.": "unknown", "Copyright 2020 by nobody.": "unknown",
    }
    texts = [f"{words(rng, 30)}\n{line}\n{words(rng, 30)}" for line in lines]
    long = words(rng, 4000) + " Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction " + words(rng, 4000)
    df = docs(spark, [*texts, long, None, "", "nothing here", texts[0]]).withColumns({"family": F.lit("clash"), "words": F.lit(1)})
    out = [r.asDict() for r in scan_licenses(spark, df).collect()]
    first = {r["doc_id"]: r for r in out}
    for i, family in enumerate(lines.values()):
        assert first[i]["family"] == family and first[i]["paragraph"] == 1, (i, first[i])
    assert first[len(lines)]["family"] == "MIT" and first[len(lines) + 4]["family"] == "CC-BY-NC" and len(out) == len(lines) + 2
    model = train()
    for i, line in enumerate(lines):  # the scan and plain Python agree: the likeliest family against the unknown class
        p = model.probabilities(line)
        odds = (p[1:] / (p[1:] + p[0])).max()
        assert abs((odds if first[i]["family"] != "unknown" else 1 - odds) - first[i]["probability"]) < 1e-9
    assert scan_licenses(spark, empty(spark)).count() == 0


def test_licenses_of_one_long_line(spark):
    from lattica.llm.licenses import NOTICES, scan_licenses

    rng = random.Random(7)
    line = " ".join([words(rng, 300), NOTICES["MIT"][0], words(rng, 300), NOTICES["GPL"][0], words(rng, 300), "The license plate of the car was stolen.", words(rng, 300)])
    out = scan_licenses(spark, docs(spark, [line, words(rng, 200) + " The license plate of the car was stolen. " + words(rng, 200)])).collect()
    assert sorted((r["doc_id"], r["paragraph"], r["family"]) for r in out) == [(0, 0, "GPL"), (0, 0, "MIT"), (1, 0, "unknown")]


def test_licenses_that_break_over_lines(spark):
    from lattica.llm.licenses import NOTICES, scan_licenses

    rng = random.Random(8)
    notice = NOTICES["MIT"][0].split()
    wrapped = "\n".join(" ".join(notice[i : i + 4]) for i in range(0, len(notice), 4))
    cases = [
        ("Released under the MIT\nLicense.", 3, "MIT"), ("This code is available under the ISC\nlicense", 3, "ISC"), ("Licensed under the Eclipse Public\r\nLicense 2.0", 3, "EPL"), (wrapped, 3, "MIT"),
        ("Released under the MIT\n \nLicense.", 5, "unknown"), ("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", None, None),
    ]
    texts = [f"{words(rng, 30)}\n\n\n{case}\n\n{words(rng, 30)}" for case, _, _ in cases]
    got = {}
    for r in scan_licenses(spark, docs(spark, texts)).collect():
        got.setdefault(r["doc_id"], []).append((r["paragraph"], r["family"]))
    for i, (_, line, family) in enumerate(cases[:-1]):
        assert got[i] == [(line, family)], (i, got[i])
    assert sorted(got[len(cases) - 1]) == [(3, "MIT"), (4, "Apache")]


def test_licenses_cut_by_windows(spark):
    from lattica.llm.licenses import scan_licenses

    rng = random.Random(9)
    cases = [(f"{words(rng, n)}{gap}{name}{gap}{words(rng, 60)}", family) for n in range(68, 82) for gap in (" ", "\n") for name, family in (("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), ("under the GNU Lesser General Public License", "LGPL"))]
    cases += [(f"{words(rng, n)} under the GNU Lesser General Public License {words(rng, 60)}", "LGPL") for n in range(34, 42)]
    got = {}
    for r in scan_licenses(spark, docs(spark, [t for t, _ in cases])).collect():
        got.setdefault(r["doc_id"], []).append(r["family"])
    assert got == {i: [family] for i, (_, family) in enumerate(cases)}


def scanned_plainly(text):
    """Rows (paragraph, family, probability, template, similarity) of a text, in plain Python."""
    import math

    from lattica.llm import licenses as L

    model, anchors = L.train(), set(L.ANCHORS)
    known = [(family, t, whole, L.grams_of(L.words_of(t))) for family, t, whole in L.templates()]
    weights = dict(zip(model.vocabulary, model.weights))

    def shown(line, joined):
        words, best = L.words_of(line), {}
        for i in range(0, max(1, len(words) - (L.WINDOW - L.STEP)), L.STEP):
            window = words[i : i + L.WINDOW]
            last = i + L.WINDOW < len(words)
            window = ["" if w in anchors and ((i and j < L.EDGE) or (last and j >= L.WINDOW - L.EDGE)) else w for j, w in enumerate(window)]
            if not anchors & set(window) and (joined or i):
                continue
            grams = L.grams_of(window)
            z = model.bias + sum((weights[g] for g in grams if g in weights), np.zeros(len(model.classes)))
            odds = {c: 1 / (1 + math.exp(z[0] - v)) for c, v in zip(model.classes[1:], z[1:])}
            named, noticed = {}, {}
            for family, t, whole, own in known:
                common = len(set(own) & set(grams))
                alike = common / min(len(own), len(grams)) if grams else 0
                if odds[family] < L.LEAST_PROBABILITY:
                    continue
                if whole and common == len(own):
                    named[family] = max(named.get(family, (0.0, 0, "")), (1.0, common, t))
                elif not whole and alike >= L.CONFIRMED and common >= L.LEAST_COMMON:
                    noticed[family] = max(noticed.get(family, (0.0, 0, "")), (alike, common, t))
            top = max(((*a[:2], odds[f], f) for f, a in noticed.items()), default=(None,))[-1]
            sure = ({top: noticed[top]} if top else {}) | named
            found = {f: (odds[f], a[2], a[0]) for f, a in sure.items()}
            for f, r in (found or {"unknown": (1 - max(odds.values()), None, 0.0)}).items():
                if f not in best or (r[0] < best[f][0] if f == "unknown" else r[0] > best[f][0]):
                    best[f] = r
        return best

    anchor, blocks = re.compile(L._ANCHOR_PATTERN), [[]]
    for n, line in enumerate(text.split("\n")):
        if not line.strip(" ") or not line.strip(" \t\r\f") and n < text.count("\n"):
            blocks.append([])
        if line.strip(" "):
            blocks[-1].append((n, line))
    rows = []
    for block in blocks:
        alone = {n: shown(line, False) for n, line in block if anchor.search(line)}
        families = {f for found in alone.values() for f in found if f != "unknown"}
        whole = shown(" ".join(line for _, line in block), True) if len(block) > 1 else {}
        extra = {f: r for f, r in whole.items() if f != "unknown" and f not in families}
        rows += [(block[0][0], f, *r) for f, r in extra.items()]
        rows += [(n, f, *r) for n, found in alone.items() for f, r in found.items() if f != "unknown" or not families | set(extra)]
    return rows


def test_licenses_equal_plain_python(spark):
    from lattica.llm import licenses as L

    rng = random.Random(12)
    parts = [t for some in L.NOTICES.values() for t in some] + [rng.choice(L.FORMS).format(n) for some in L.NAMES.values() for n in some] + L.OTHERS + L.FOREIGN_NOTICES + L.FOREIGN

    def piece():
        body = rng.choice(parts).split()
        body = [w for w in body if rng.random() > 0.04] + words(rng, rng.choice((0, 5, 60))).split()
        return "".join(w + rng.choice([" ", " ", " ", " ", " ", "\n"]) for w in body).strip()

    texts = [rng.choice(["\n", "\n\n", "\n \t\n", " ", "\r\n"]).join(piece() for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    texts += [words(rng, 3990) + " " + " ".join(parts[:30]) + " " + words(rng, 4100) + " CC BY 4.0"]
    got = {}
    for r in scan_licenses_rows(spark, texts):
        got.setdefault(r["doc_id"], []).append((r["paragraph"], r["family"], round(r["probability"], 9), r["template"], round(r["similarity"], 9)))
    for i, text in enumerate(texts):
        want = [(n, f, round(p, 9), t, round(s, 9)) for n, f, p, t, s in scanned_plainly(text)]
        assert sorted(got.get(i, []), key=str) == sorted(want, key=str), (i, text)


def scan_licenses_rows(spark, texts):
    from lattica.llm.licenses import scan_licenses

    return scan_licenses(spark, docs(spark, texts).repartition(4)).collect()


def test_licenses_of_every_notice_and_of_several(spark):
    from lattica.llm.licenses import NOTICES

    cases = [(text, {family}) for family, some in NOTICES.items() for text in some]
    cases += [("Dual licensed under MIT and Apache-2.0.", {"MIT", "Apache"}), ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", {"MIT", "Apache"}), ("SPDX-License-Identifier: GPL-2.0 OR BSD-3-Clause", {"GPL", "BSD"})]
    foreign = [
        "Boost Software License - Version 1.0", "Distributed under the Boost Software License, Version 1.0.", "Released under the zlib License.", "Licensed under the Artistic License 2.0", "This work is licensed under the SIL Open Font License, Version 1.1.",
        "Licensed under the European Union Public Licence", "Published under the CeCILL Free Software License Agreement", "Mulan Permissive Software License, Version 2", "Distributed under the Eiffel Forum License", "Licensed under the PostgreSQL License.", "Intel Open Source License",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
    ]
    cases += [(text, {"unknown"}) for text in foreign]
    got = {i: set() for i in range(len(cases))}
    for r in scan_licenses_rows(spark, [t for t, _ in cases]):
        got[r["doc_id"]].add(r["family"])
    assert {t: got[i] for i, (t, _) in enumerate(cases) if got[i] != cases[i][1]} == {}


def test_licenses_of_a_text_of_many_blocks(spark):
    blocks = 100_000
    text = "\n\n".join("This is licensed under the MIT License." if n % 10 == 0 else f"block {n} of a long file" for n in range(blocks))
    out = scan_licenses_rows(spark, [text])
    assert sorted((r["paragraph"], r["family"]) for r in out) == [(2 * n, "MIT") for n in range(0, blocks, 10)]


# Encoding


def test_byte_bpe_against_tiktoken(spark):
    import public_tokenizers
    import tiktoken

    from lattica.llm.byte_bpe import borders, codec, decode_documents, default_ranks, encode_documents, scan_functions, _THEN

    own = codec(default_ranks())
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(6)
    alphabet = list("abstrevlmd'''    \n\t\r12٣é你ñ!?. 　\x85\x1c​😀ǅªⅫ²")
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 20))) for _ in range(4000)] + ["a" * 3000, "ab'sll" * 900, "é" * 1000 + "!" * 500, " " * 999, "it's we're I'll <|endoftext|>"]
    for text, ids in zip(texts, own.encode_many(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()
    assert borders("").tolist() == [0] and borders("it's a").tolist() == [0, 2, 4, 6]
    functions = np.array([rng.randrange(27) for _ in range(1000)], np.uint8)
    want, now = [], 0 + 3 * 1 + 9 * 2
    for f in functions:
        now = _THEN[now, f]
        want.append(now)
    assert scan_functions(functions).tolist() == want
    for piece in ("hello", "antidisestablishment", "zzzzzzzz", "Straße"):
        assert own.merge(piece.encode()) == np.frombuffer(own.merge_many([piece.encode()])[0], "<u4").tolist() == own._by_heap(piece.encode()) or piece.encode() in own.ranks
    df = docs(spark, [*texts[:50], None, "", "same", "same"]).withColumns({"ids": F.lit(1), "n_tokens": F.lit(2)})
    done = {r["doc_id"]: r for r in decode_documents(encode_documents(df)).collect()}
    assert bytes(done[50]["decoded"]) == b"" and done[51]["n_tokens"] == 0 and bytes(done[52]["ids"]) == bytes(done[53]["ids"])
    assert all(hashlib.sha256(bytes(done[i]["decoded"])).digest() == hashlib.sha256(texts[i].encode()).digest() for i in range(50))
    row = encode_documents(docs(spark, ["ab cd"]), offsets=True).first()
    assert np.frombuffer(bytes(row["offsets"]), "<u8").tolist() == own.offsets(bytes(row["ids"]))[:-1].tolist()
    assert encode_documents(empty(spark)).count() == 0


def test_byte_bpe_classes_of_every_codepoint():
    import unicodedata

    import public_tokenizers
    import tiktoken

    from lattica.llm.byte_bpe import LETTER, NUMBER, SPACE, _classes, codec, default_ranks

    own = codec(default_ranks())
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    kinds = _classes()
    python = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], 9) for c in range(0x110000)])
    newer = np.flatnonzero((kinds <= NUMBER) & (python != kinds)).tolist()  # of a later Unicode than Python's
    rng = random.Random(17)
    some = newer[:1500] + np.flatnonzero(kinds == SPACE).tolist() + [c for c in rng.sample(range(0x110000), 3000) if not 0xD800 <= c < 0xE000]
    texts = [f"{c}a{c}1{c}!{c} {c}{c}\n{c}'s" for c in map(chr, some)]
    for text, ids in zip(texts, own.encode_many(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text), repr(text)
    assert kinds[ord("a")] == LETTER and kinds[ord("5")] == NUMBER and kinds[0x2028] == SPACE
