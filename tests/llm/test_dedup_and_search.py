"""Exact and near duplicates, top-k, URL rules, archives: against brute force."""

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


def words(rng, n):
    return [rng.choice(["ab", "cd", "ef", "gh", "ij"]) + str(rng.randrange(400)) for _ in range(n)]


# Exact duplicates


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_duplicates(spark, digest_bytes):
    from lattica.llm.exact_dedup import exact_duplicates

    rng = random.Random(1)
    bodies = [" ".join(words(rng, 12)) for _ in range(40)]
    rows = [(i, rng.choice(bodies).replace(" ", rng.choice([" ", "  ", "\n", "\t "]))) for i in range(200)] + [(500 + i, bodies[0]) for i in range(80)]
    rows += [(900, None), (901, ""), (902, " \n\x0b"), (903, "\xa0"), (904, "\xa0 "), (None, bodies[1]), (905, "x" * 1_000_000), (906, "x" * 1_000_000)]
    df = docs(spark, rows).repartition(5).withColumns({"digest": F.lit(1), "run": F.lit(2)})
    out = exact_duplicates(spark, df, digest_bytes).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i is None, -len(t or ""), i or 0))
    want = {}
    for norm, members in groups.items():
        best = min(members)
        for none, _, i in members:
            want[None if none else i] = (None if best[0] else best[2], len(members), hashlib.sha256(norm.encode()).hexdigest())
    assert len(out) == len(rows)
    for r in out:
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == want[r["doc_id"]]
    assert sum(r["kept"] for r in out) == len(groups)


def test_exact_duplicates_of_repeated_rows_and_empty(spark):
    from lattica.llm.exact_dedup import exact_duplicates

    out = exact_duplicates(spark, docs(spark, [(1, "a"), (1, "a"), (1, "a"), (2, "b")]).repartition(3)).collect()
    assert sum(r["kept"] for r in out if r["doc_id"] == 1) == 1 and {r["group_size"] for r in out} == {3, 1}
    assert exact_duplicates(spark, docs(spark, [])).count() == 0


def test_runs_filters_and_probe(spark):
    from lattica.llm.exact_dedup import build_filter, flush_runs, may_contain, probe

    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    bloom = np.frombuffer(build_filter(keys[:1500], 18_000), np.uint8)
    assert may_contain(bloom, keys[:1500]).all() and may_contain(bloom, keys[1500:]).mean() < 0.02
    runs = flush_runs(docs(spark, [(i, f"text {i % 50}") for i in range(200)]).repartition(3)).cache()
    digests = [r["digest"] for r in runs.where("filter is not null").collect()]
    assert len(digests) == 3
    hits = {r["doc_id"]: r["keep_id"] for r in probe(spark, runs, docs(spark, [(1000, "text 7"), (1001, "te xt7"), (1002, "text 99")])).collect()}
    assert hits == {1000: 7, 1001: 7}


# Near duplicates


def shingles(text):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        u = len(sets[a] | sets[b])
        if sets[a] == sets[b] or u and len(sets[a] & sets[b]) / u >= 0.8:
            root[find(b)] = find(a)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {i: min(g) for g in groups.values() for i in g}


def test_near_duplicates_against_all_pairs(spark):
    from lattica.llm.near_dedup import near_duplicates

    rng = random.Random(2)
    rows, n = [], 0

    def add(w):
        nonlocal n
        rows.append((n, " ".join(w)))
        n += 1

    shared = words(rng, 60)
    for size, copies in ((120, 60), (40, 20), (300, 15), (12, 6), (5, 3), (3, 2)):
        base = words(rng, size)
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            add(w)
    for _ in range(30):
        add(words(rng, rng.randint(20, 80)) + shared)
    rows += [(900, None), (901, ""), (902, "!!! ?"), (903, "One, two; THREE four five six."), (904, "one two three four five six"), (905, "w " * 200_000)]
    df = docs(spark, rows).repartition(4).withColumns({"cls": F.lit(1), "key": F.lit(2)})
    out = {r["doc_id"]: r for r in near_duplicates(spark, df).collect()}
    want = brute_groups(rows)
    assert {i: r["group_id"] for i, r in out.items()} == want
    assert all(r["kept"] == (i == want[i]) for i, r in out.items())
    assert all(r["group_size"] == list(want.values()).count(want[i]) for i, r in out.items())


def test_near_duplicates_empty_and_repeated(spark):
    from lattica.llm.near_dedup import near_duplicates

    assert near_duplicates(spark, docs(spark, [])).count() == 0
    out = near_duplicates(spark, docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z")])).collect()
    assert sum(r["kept"] for r in out) == 2 and sorted(r["group_size"] for r in out) == [1, 2, 2]


@pytest.mark.parametrize("same_id", [True, False])
def test_near_duplicates_of_repeated_sets_in_mixed_buckets(spark, monkeypatch, same_id):
    """Rows that repeat, and copies that a full filter of ids lets through, in buckets
    whose hub is far from some of their members."""
    from lattica.llm import near_dedup

    monkeypatch.setattr(near_dedup, "_id_filter", lambda ids: b"\xff" * (near_dedup.FILTER_BITS // 8))
    rng = random.Random(5)
    rows = []
    for family in range(12):
        base = [f"f{family}w{i}" for i in range(124)]
        other = base[:98] + [f"f{family}v{i}" for i in range(26)]
        for words_, copies in ((base, 14), (other, 8)):
            for at in rng.sample(range(5, 93), copies):
                rows.append((len(rows), " ".join([*words_[:at], f"own{len(rows)}", *words_[at + 1 :]])))
    want = brute_groups(rows)
    assert len(set(want.values())) == 24
    repeated = [(i if same_id else i + 10_000 * k, t) for k in range(5) for i, t in rows]
    out = near_dedup.near_duplicates(spark, docs(spark, repeated).repartition(5), bands=3, rows=1).collect()
    assert len(out) == len(repeated) and all(r["group_id"] == want[r["doc_id"] % 10_000] for r in out)


def test_near_duplicates_of_one_large_bucket(spark, monkeypatch):
    """All texts share a bucket and most of their words, but are in many components: pairs
    are made of those that share a scarce shingle, not of all."""
    from lattica.llm import near_dedup

    rng = random.Random(6)
    shared, rows = [f"s{i}" for i in range(70)], []
    for family in range(300):
        own = [f"f{family}w{i}" for i in range(60)]
        rows.append((len(rows), " ".join(shared + own)))
        if family % 10 == 0:
            own[rng.randrange(60)] = "changed"
            rows.append((len(rows), " ".join(shared + own)))
    made = []
    verified = near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, sets: made.append(pairs.count()) or verified(pairs, sets))
    monkeypatch.setattr(near_dedup, "dart_signature", lambda e, w, size, seed=1: np.ones(size, np.uint64))
    df = docs(spark, rows)
    keys = near_dedup.sketches
    monkeypatch.setattr(near_dedup, "sketches", lambda *a, **k: keys(*a, **k).withColumn("bands", F.when(F.col("bands").isNotNull(), F.array(F.lit(1).cast("long")))))
    out = {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicates(spark, df, bands=1, rows=1).collect()}
    assert out == brute_groups(rows) and len(set(out.values())) == 300
    assert sum(made) < 3 * len(rows), made


def form_letters(rng, n, slots=9, values=12, copies=0.1):
    """Texts of 150 words, nine of which have one of twelve values each; of some texts a
    few values change, which is a near copy while these are three at most."""
    fixed, at = [f"fixed{i}" for i in range(150)], [8 + 16 * i for i in range(slots)]
    chosen = []
    for _ in range(n):
        if chosen and rng.random() < copies:
            new = list(rng.choice(chosen))
            for i in rng.sample(range(slots), rng.randrange(1, 6)):
                new[i] = rng.randrange(values)
        else:
            new = [rng.randrange(values) for _ in range(slots)]
        chosen.append(new)
    texts = []
    for values_ in chosen:
        words_ = list(fixed)
        for i, v in zip(at, values_):
            words_[i] = f"slot{i}value{v}"
        texts.append(" ".join(words_))
    return np.array(chosen), list(enumerate(texts))


def slot_groups(chosen):
    """The least text of each text's group: 146 shingles, of which a slot changes five."""
    root = list(range(len(chosen)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(1, len(chosen)):
        for j in np.flatnonzero((chosen[:i] != chosen[i]).sum(axis=1) <= 3):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return {i: find(i) for i in range(len(chosen))}


def test_near_duplicates_of_form_letters(spark, monkeypatch):
    """All letters share a bucket and two thirds of their shingles; pairs grow with the
    letters, not with their square."""
    from lattica.llm import near_dedup

    made, verified, keys = [], near_dedup._verified, near_dedup.sketches
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, sets: made.append(pairs.count()) or verified(pairs, sets))
    monkeypatch.setattr(near_dedup, "sketches", lambda *a, **k: keys(*a, **k).withColumn("bands", F.when(F.col("bands").isNotNull(), F.array(F.lit(1).cast("long")))))
    total = {}
    for n in (200, 1000, 4000):
        chosen, rows = form_letters(random.Random(n), n)
        want = slot_groups(chosen)
        if n == 200:
            assert want == brute_groups(rows)
        made.clear()
        out = {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicates(spark, docs(spark, rows), bands=1, rows=1).collect()}
        assert out == want
        total[n] = sum(made)
    assert total[4000] < total[1000] * 4**1.2 and total[4000] < 4000 * 4000 / 80, total


def test_similarity_of_long_sets():
    from lattica.llm.common import mix64
    from lattica.llm.near_dedup import _similarity

    a = np.sort(mix64(np.arange(1_000_000, dtype=np.uint64)))
    b = np.sort(mix64(np.arange(111_112, 1_111_112, dtype=np.uint64)))
    assert _similarity(a.tobytes(), None, a.tobytes(), None) == 1.0
    assert _similarity(a.tobytes(), None, b.tobytes(), None) == 888_888 / 1_111_112 < 0.8
    w = np.ones(len(a), "<u4").tobytes()
    assert _similarity(a.tobytes(), w, b.tobytes(), w) == 888_888 / 1_111_112


def test_dart_signature_estimates_weighted_jaccard():
    from lattica.llm.common import mix64
    from lattica.llm.near_dedup import dart_signature

    rng = np.random.default_rng(3)
    for n, weights in ((80, lambda k: np.ones(k)), (80, lambda k: rng.integers(1, 6, k).astype(float)), (1, lambda k: np.ones(k)), (5000, lambda k: np.ones(k))):
        elements = mix64(np.arange(n, dtype=np.uint64) + np.uint64(n))
        x, y = weights(n), weights(n)
        y[: n // 3] = x[: n // 3]
        mine, other = dart_signature(elements, x, 2000), dart_signature(elements, y, 2000)
        assert abs((mine == other).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.06
        assert (dart_signature(elements[::-1], x[::-1], 2000) == mine).all()
    part = dart_signature(elements[:4000], np.ones(4000), 2000)
    assert abs((part == dart_signature(elements, np.ones(5000), 2000)).mean() - 0.8) < 0.05


def test_components(spark):
    from lattica.llm.common import Workspace
    from lattica.llm.near_dedup import components

    edges = [(f"{a:03d}", f"{b:03d}") for a, b in [(i, i + 1) for i in range(30)] + [(100, 101), (100, 102), (7, 7)]]
    out = components(Workspace(spark, "t"), spark.createDataFrame(edges, "a string, b string"), "c")
    roots = {r["node"]: r["root"] for r in out.collect()}
    assert {roots[f"{i:03d}"] for i in range(31)} == {"000"} and roots["102"] == "100" and len(roots) == 34


# Top-k


def brute_top_k(vectors, k):
    codes = {i: tuple(x is not None and x > 0 for x in v) for i, v in vectors if v is not None and i is not None}
    return {q: sorted((sum(a != b for a, b in zip(codes[q], c)), i) for i, c in codes.items() if i != q)[:k] for q in codes}


@pytest.mark.parametrize("bits, n, hot", [(64, 300, 0), (20, 200, 120), (3, 40, 10), (70, 60, 5)])
def test_top_k(spark, bits, n, hot):
    from lattica.llm.topk import top_k

    rng = random.Random(bits)
    one = [rng.gauss(0, 1) for _ in range(bits)]
    vectors = [(i, list(one) if i < hot else [rng.gauss(0, 1) for _ in range(bits)]) for i in range(n)] + [(n, None), (n + 1, [None] * bits)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({"segment": F.lit(1), "id": F.lit("clash")})
    out = {}
    for r in top_k(spark, df, df.where("vec_id % 20 = 0"), 7).collect():
        out.setdefault(r["vec_id"], []).append((r["rank"], r["distance"], r["neighbour_id"]))
    want = brute_top_k(vectors, 7)
    assert set(out) == {q for q in want if q % 20 == 0}
    for q, found in out.items():
        assert [(d, i) for _, d, i in sorted(found)] == want[q] and [r for r, _, _ in sorted(found)] == list(range(1, len(found) + 1))


def test_top_k_small_and_empty(spark):
    from lattica.llm.topk import top_k

    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    three = spark.createDataFrame([(1, [1.0, -1.0]), (2, [1.0, 1.0]), (3, [1.0, -1.0])], "vec_id long, embedding array<float>")
    assert top_k(spark, none, none).count() == 0
    assert sorted((r["vec_id"], r["neighbour_id"], r["distance"]) for r in top_k(spark, three, three, 5).collect()) == [(1, 2, 1), (1, 3, 0), (2, 1, 1), (2, 3, 1), (3, 1, 0), (3, 2, 1)]


# URL rules


def test_url_rules(spark, tmp_path):
    from lattica.llm.url_filter import RULES, RuleArray, filter_urls, split_url, write_rules

    urls = ["http://WWW.Example.com/en/1", "https://a.example.com/en/x?y", "https://example.com/de/", "http://x.net/es/1#t", "http://net/fr/", "http://x.com", "http://com/", "ftp://notcom/", None, "", "no-scheme/com/", "http:///en/", "http://xexample.com/en/", "x://a.b://c/d", "http://é.com/\n/x", "http://Ä.NET/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("clash"), "rule": F.lit(1)})
    out = {r["page_id"]: r for r in filter_urls(spark, df, RULES).collect()}
    for i, url in enumerate(urls):
        host, path = split_url(url)
        fits = [(len(rule), rule, verdict) for verdict, rule in RULES for h, p in [(rule[: rule.find("/")], rule[rule.find("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[1:] if fits else (None, "allow")
        assert (out[i]["rule"], out[i]["verdict"]) == want and (out[i]["host"], out[i]["path"]) == (host, path), url
    assert split_url("http://A.b:80/p?q") == ("a.b:80", "/p") and split_url(None) == ("", "")
    write_rules(str(tmp_path / "r"), RULES, key=lambda s: len(s) % 3)  # all keys collide
    assert RuleArray(str(tmp_path / "r"), key=lambda s: len(s) % 3).match([("a.example.com", "/en/"), ("b.org", "/en/")]) == [("example.com/en/", True), (None, False)]
    write_rules(str(tmp_path / "e"), [])
    assert RuleArray(str(tmp_path / "e")).match([("a", "/")]) == [(None, False)]
    assert filter_urls(spark, df.limit(0), RULES).count() == 0
    junk = ".".join(["a"] * 200_000)  # suffixes of some rule's length alone are looked up
    assert RuleArray(str(tmp_path / "r"), key=lambda s: len(s) % 3).match([(junk + ".net", "/es/x"), (junk, "/")]) == [("net/es/", True), (None, False)]


# Archives


def test_archives_round_trip(spark, monkeypatch):
    from lattica.llm import warc

    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "PART_LINES", 10)
    html = [f"<p>{i % 9} ä</p>" for i in range(60)] + [None, "", "x" * 300_000, "a\r\n\r\nb", "same", "same"]
    pages = [(i, f"http://h{i % 5}.Example.com/p{i % 13}" if i % 11 else "http://hot.org/", h) for i, h in enumerate(html)] + [(200, None, "n"), (201, "weird\nurl ü", "w"), (None, "http://n.org/", "solo"), (65, "http://h0.Example.com/p0", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).withColumns({"key": F.lit(1), "record": F.lit(2)})
    out = warc.archive_pages(spark, df).collect()
    latest = {}
    for i, _, h in pages:
        latest[h or ""] = max(latest.get(h or "", -1), -1 if i is None else i)
    assert len(out) == len(pages)
    body = {i: (h or "").encode() for i, _, h in pages}
    for r in out:
        b = body[r["page_id"]]
        keep = latest[b.decode()]
        assert r["payload_bytes"] == len(b) and r["payload_digest"] == base64.b32encode(hashlib.sha1(b).digest()).decode()
        alone = r["page_id"] is None or r["page_id"] == keep
        assert (r["record_type"], r["refers_to"]) == (("response", None) if alone else ("revisit", keep))
    assert warc.archive_pages(spark, df.limit(0)).count() == 0
    none = warc.archive_pages(spark, df.where("html = 'same'"), least_bytes=5).collect()
    assert {r["record_type"] for r in none} == {"response"} and len(none) == 3


def test_look_up_by_index(spark):
    from lattica.llm import warc
    from lattica.llm.common import Workspace

    space = Workspace(spark, "t")
    pages = spark.createDataFrame([(i, f"http://s{i % 7}.org/{i % 3}", f"b{i}") for i in range(40)], "page_id long, url string, html string")
    index = warc.build_index(space, warc.write_archives(space, pages))
    asked = spark.createDataFrame([("http://S3.org/0",), ("http://none.org/",), ("zzz",)], "url string")
    found = warc.look_up(space, index, asked).collect()
    assert sorted(r["page_id"] for r in found) == [i for i in range(40) if i % 7 == 3 and i % 3 == 0]
    assert warc.url_key("https://www.Example.com/a?b") == "com,example,www)/a?b" and warc.url_key(None) == ""
