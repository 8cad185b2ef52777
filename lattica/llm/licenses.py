"""Licence scans by a trained paragraph classifier (operator 4).

A sparse logistic regression over word n-grams weighs the licence families of a
paragraph, and an unknown class, against each other; a temperature fitted on examples
left out of training calibrates its probabilities. A family counts only where it beats
the unknown class and a template confirms it: a customary name that stands there whole,
or enough of a notice's words. A window that names several licences shows them all.

Training is a small computation on the driver over the templates below. Scanning
uses DataFrame functions alone. Every feature holds an anchor word, so lines and blocks of
lines without one have no features: leaving them out first changes no answer.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

UNKNOWN = "unknown"
#: Words of a window that a longer paragraph is read in, and its step.
WINDOW, STEP = 80, 40
#: Words at a cut edge of a window whose anchors only the window beside it reads: the
#: cut may go through a name, and no name is longer.
EDGE = 8
#: Words of a long paragraph that one row holds before it is cut into windows, a multiple of STEP.
SLICE = 4000
#: Least calibrated probability of a family against the unknown class.
LEAST_PROBABILITY = 0.5
#: Share of the smaller side's n-grams that a notice must share with a paragraph, and
#: the least number of them.
CONFIRMED, LEAST_COMMON = 0.5, 10

#: Names of licences by family, as notices write them. The first list has
#: those that confirm a family where they stand whole.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "Expat License", "under the MIT", "under MIT", "license MIT", "identifier MIT", "or MIT", "and MIT", "MIT or", "MIT and", "MIT licensed"],
    "Apache": ["Apache License", "Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0", "Apache Software License", "Apache licensed"],
    "BSD": ["BSD License", "BSD licence", "BSD 3-Clause", "BSD 2-Clause", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause license", "New BSD License", "BSD licensed"],
    "GPL": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License version 2", "GNU GPL", "GPLv3", "GPLv2", "GPL-3.0", "GPL-2.0", "GPL-3.0-or-later license", "GPL license"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL", "LGPLv3", "LGPL-2.1 license"],
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL", "AGPLv3", "AGPL-3.0 license"],
    "MPL": ["Mozilla Public License", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL", "MPL-2.0 license"],
    "EPL": ["Eclipse Public License", "Eclipse Public License 2.0", "EPL-2.0 license", "EPL-2.0"],
    "ISC": ["ISC License", "ISC licence", "identifier ISC", "under ISC"],
    "CC-BY": ["Creative Commons Attribution License", "Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC BY 3.0", "CC-BY license"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA license"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial License", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC-BY-NC license"],
    "CC0": ["CC0 1.0 Universal", "CC0 license", "CC0 1.0", "Creative Commons Zero license", "CC0 public domain dedication"],
    "Unlicense": ["the Unlicense", "Unlicense license", "identifier Unlicense", "under Unlicense", "Unlicense"],
}

#: Names of licences of no family above, and words of their notices.
FOREIGN = [
    "Boost Software License", "Boost Software License - Version 1.0", "zlib License", "Artistic License 2.0", "PostgreSQL License", "Python Software Foundation License", "European Union Public License", "Microsoft Public License",
    "SIL Open Font License", "Academic Free License", "Open Software License 3.0", "Common Development and Distribution License", "Common Public License", "IBM Public License", "Q Public License", "Open Database License",
    "Ruby License", "OpenSSL License", "JSON License", "NCSA Open Source License", "Universal Permissive License", "Business Source License", "Elastic License 2.0", "Server Side Public License", "GNU Free Documentation License",
    "Sleepycat License", "Vim License", "W3C Software License", "Unicode License", "Zope Public License", "Oracle Binary Code License", "Sun Public License", "Reciprocal Public License", "Nokia Open Source License", "Lucent Public License",
    "freeware license", "shareware license", "end user license agreement", "commercial license", "enterprise license",
]
FOREIGN_NOTICES = [
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: the origin of this software must not be misrepresented",
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1. The license is available with a FAQ at https://scripts.sil.org/OFL",
    "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
    "By installing this software you accept the terms of this license agreement. You may not copy, modify or redistribute the software.",
]

#: How a notice names two licences.
PAIRS = ["Dual licensed under {} and {}.", "Licensed under either of {} or {} at your option.", "Licensed under the {} or the {}.", "SPDX-License-Identifier: {} OR {}", "This project is available under the {} and the {}."]

#: How notices mention a name.
FORMS = [
    "{}", "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.",
    "This software is distributed under the terms of the {}.", "License: {}", "The code is available under the {}.", "Published under the {} license.",
    "You may use this file under the {}, see the file LICENSE.", "SPDX-License-Identifier: {}", "All content is made available under the {} unless stated otherwise.",
]

#: Customary notices, as published with the licences.
NOTICES = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "Apache": ["Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "You should have received a copy of the GNU General Public License along with this program."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Lesser General Public License along with this library."],
    "AGPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Affero General Public License along with this program."],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License which is available at https://www.eclipse.org/legal/epl"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY": ["To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    "CC-BY-SA": ["To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"],
    "CC-BY-NC": ["To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0. http://creativecommons.org/publicdomain/zero/1.0/"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. For more information, please refer to http://unlicense.org/"],
}

#: Sentences with anchor words that are no licence.
OTHERS = [
    "He lost his driving license last year and had to apply for a new one.", "The license plate of the car was stolen.", "A fishing licence is required in this county.",
    "She asked for permission to leave the room.", "The warranty of the washing machine expired in May.", "Copyright law differs between countries.", "The seminar on copyright takes place on Monday.",
    "Redistribution of wealth was the topic of the debate.", "The Apache tribe lived in the southwest.", "An Apache helicopter landed near the base.", "The gnu grazes on the plains of Africa.",
    "Copyright 2020 by the author.", "All rights reserved. No permission is given.", "The solar eclipse was visible in the north.", "Mozilla published a new browser.", "The patent license was sold for a large sum.",
    "You need a license to sell alcohol here.", "License", "The software license costs ten euros a month.", "Please read the license agreement before you install the program.", "No license was found.", "The commons voted against the bill.",
    "Licensed under the terms of our own agreement.", "This work is licensed under a proprietary license.", "The attribution of the painting is uncertain.", "Please cc me on the mail.",
]

#: A feature is an n-gram with one of these words.
ANCHORS = [
    "license", "licence", "licensed", "licenced", "licenses", "licensing", "sublicense", "licensor", "copyright", "permission", "permissions", "warranty", "warranties",
    "redistribution", "redistributions", "redistribute", "unlicense", "unencumbered", "gnu", "gpl", "gplv2", "gplv3", "lgpl", "lgplv3", "agpl", "agplv3", "apache", "bsd", "mozilla", "mpl", "epl", "cc0", "creativecommons", "spdx",
    "cc", "attribution", "sharealike", "noncommercial",
]
_ANCHOR_PATTERN = r"(?i)(?<![a-z0-9])(?:" + "|".join(ANCHORS) + r")(?![a-z0-9])"
_ANCHOR_GRAM = "(^| )(" + "|".join(ANCHORS) + ")( |$)"
#: Between a numbered line and a blank one after it.
_BLANK_LINE = r"(?<=\n)(?=[0-9]+\x01[ \t\r\f]*\n)"


def words_of(text: str) -> list[str]:
    """Runs of a-z and 0-9 of the lower-cased text, as the scan cuts them."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def grams_of(words: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)))


def templates() -> list[tuple[str, str, bool]]:
    """(family, text, whole): every name, which must stand whole, and the notices that don't
    hold a name of their family; of the others the name is what tells them apart."""
    named = lambda family, notice: any(set(grams_of(words_of(n))) <= set(grams_of(words_of(notice))) for n in NAMES[family])
    out = [(family, text, False) for family, texts in NOTICES.items() for text in texts if not named(family, text)]
    return out + [(family, name, True) for family, names in NAMES.items() for name in names]


class Model:
    """weights: n-gram -> one weight for each class; classes[0] is the unknown one."""

    def __init__(self, classes: list[str], vocabulary: list[str], weights: np.ndarray, bias: np.ndarray):
        self.classes, self.vocabulary, self.weights, self.bias = classes, vocabulary, weights, bias

    def probabilities(self, text: str) -> np.ndarray:
        """By plain Python, for tests: what the scan gives for one window."""
        at = {g: i for i, g in enumerate(self.vocabulary)}
        z = self.bias + sum((self.weights[at[g]] for g in grams_of(words_of(text)) if g in at), np.zeros(len(self.classes)))
        e = np.exp(z - z.max())
        return e / e.sum()


def _examples(seed: int) -> tuple[list[list[str]], list[tuple[str, ...]]]:
    """Notices and names in every form, whole, with words around them and with words
    dropped, and two names at once; licences of no family, other sentences and made-up
    words for the unknown class."""
    rng = random.Random(seed)
    soup = ["".join(rng.choice("aeioustrnldm") for _ in range(rng.randint(1, 8))) for _ in range(400)] + "the of and to in is a for on with by as this that it be mit der die und de la le les el un".split()
    texts, tags = [], []

    def add(words: list[str], *tag: str, loss: float = 0.03) -> None:
        noise = lambda: [rng.choice(soup) for _ in range(rng.choice((0, 0, 2, 8, 20)))]
        texts.append(noise() + ([w for w in words if rng.random() > loss] or words) + noise()), tags.append(tag)

    named = {family: [n for n in names if len(words_of(n)) > 1 or n.lower() != "mit"] for family, names in NAMES.items()}
    for family, names in named.items():
        for name in names:
            for form in FORMS:
                add(words_of(form.format(name)), family)
                add(words_of(form.format(name)), family)
        for notice in NOTICES[family]:
            words = words_of(notice)
            for n in range(24):
                size = len(words) if n % 2 else rng.randint(-(-len(words) // 2), len(words))  # whole, or the greater part of it
                first = rng.randint(0, len(words) - size)
                add(words[first : first + size], family, loss=0.02 * (n % 3))
    families = list(named)
    for n in range(400):
        one, two = rng.sample(families, 2)
        add(words_of(PAIRS[n % len(PAIRS)].format(*(rng.choice([x for x in named[f] if not x.split()[0] in ("or", "and", "under", "identifier", "license")]) for f in (one, two)))), one, two)
    for name in FOREIGN:
        for form in FORMS:
            add(words_of(form.format(name)), UNKNOWN)
    for text in (*OTHERS, *FOREIGN_NOTICES):
        for _ in range(12):
            add(words_of(text), UNKNOWN, loss=0.05)
    for _ in range(250):
        add([rng.choice(soup) for _ in range(rng.randint(2, 30))] + [rng.choice(ANCHORS)] * rng.randint(0, 1) + [rng.choice(soup) for _ in range(5)], UNKNOWN)
    return texts, tags


@lru_cache(maxsize=1)
def train(l2: float = 2e-3, steps: int = 250) -> Model:
    """Multinomial logistic regression by Adam, then a temperature on fresh examples."""
    texts, tags = _examples(1)
    classes = [UNKNOWN, *NAMES]
    anchors = set(ANCHORS)
    rows = [[g for g in grams_of(t) if not anchors.isdisjoint(g.split())] for t in texts]
    seen: dict[str, int] = {}
    for row in rows:
        for g in row:
            seen[g] = seen.get(g, 0) + 1
    vocabulary = sorted(g for g, n in seen.items() if n >= 4)
    at = {g: i for i, g in enumerate(vocabulary)}

    def matrix(rows: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(rows), len(vocabulary)), np.float32)
        for n, row in enumerate(rows):
            x[n, [at[g] for g in row if g in at]] = 1
        return x

    def shares(tags: list[tuple[str, ...]]) -> np.ndarray:
        y = np.zeros((len(tags), len(classes)), np.float32)
        for n, some in enumerate(tags):
            y[n, [classes.index(t) for t in some]] = 1 / len(some)
        return y

    x, y = matrix(rows), shares(tags)
    share = np.sqrt(len(y) / (len(classes) * y.sum(axis=0)))[y.argmax(axis=1)][:, None].astype(np.float32)
    w, b = np.zeros((x.shape[1], len(classes)), np.float32), np.zeros(len(classes), np.float32)
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, b)]
    for t in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - y) * share / len(y)
        for value, gradient, (m, v) in zip((w, b), (x.T @ d + l2 * w / 10, d.sum(axis=0)), moments):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient * gradient - v)
            value -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    fresh, told = _examples(2)
    z = matrix([[g for g in grams_of(t) if g in at] for t in fresh]) @ w + b
    answer = shares(told)

    def loss(heat: float) -> float:
        s = z / heat
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - (answer * s).sum(axis=1)).mean())

    heat = min((0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0), key=loss)
    return Model(classes, vocabulary, w.astype(float) / heat, b.astype(float) / heat)


def _ngrams(words: Column) -> Column:
    """grams_of() as a column expression."""
    n = F.size(words)

    def runs(k: int) -> Column:
        spans = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(spans, lambda i: F.array_join(F.slice(words, i, k), " "))

    return F.array_distinct(F.concat(words, runs(2), runs(3)))


#: Between the number of a line and the line.
_MARK = "\x01"


def _lines(block: Column) -> Column:
    """Lines of a block as (paragraph, line), from numbered lines; blank ones are left out."""
    numbered = F.transform(F.split(block, "\n"), lambda x: F.struct(F.substring_index(x, _MARK, 1).try_cast("int").alias("paragraph"), x.substr(F.instr(x, _MARK) + 1, F.length(x)).alias("line")))
    return F.filter(numbered, lambda x: F.trim(x["line"]) != "")


def _windows(docs: DataFrame) -> DataFrame:
    """(item, doc_id, paragraph, joined, window, words): windows of the lines, and of the
    joined lines, of each block of `docs`, of which `item` is the number."""
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(F.col("text").rlike(_ANCHOR_PATTERN))
    # Each line carries its number, so a block needs nothing of those before it.
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(i.cast("string"), F.lit(_MARK), x)), "\n")
    blocks = texts.select("doc_id", F.explode(F.split(numbered, _BLANK_LINE)).alias("block")).where(F.col("block").rlike(_ANCHOR_PATTERN))
    cut = blocks.select(F.monotonically_increasing_id().alias("item"), "doc_id", _lines(F.col("block")).alias("lines"))
    whole = F.struct(F.col("lines")[0]["paragraph"].alias("paragraph"), F.lit(True).alias("joined"), F.array_join(F.col("lines")["line"], " ").alias("line"))
    single = F.transform(F.filter("lines", lambda x: x["line"].rlike(_ANCHOR_PATTERN)), lambda x: F.struct(x["paragraph"].alias("paragraph"), F.lit(False).alias("joined"), x["line"].alias("line")))
    units = F.concat(single, F.when(F.size("lines") > 1, F.array(whole)).otherwise(F.slice(single, 1, 0)))
    rows = cut.select("item", "doc_id", F.explode(units).alias("u")).select("item", "doc_id", "u.paragraph", "u.joined", F.filter(F.split(F.lower("u.line"), "[^a-z0-9]+"), lambda w: w != "").alias("words"))
    # Long paragraphs are cut in two steps, so that a row never carries all words for each window.
    last = F.greatest(F.lit(1), F.size("words") - (WINDOW - STEP))
    pieces = F.transform(F.sequence(F.lit(0), last - 1, F.lit(SLICE)), lambda b: F.struct(b.alias("base"), F.slice("words", b + 1, SLICE + WINDOW).alias("words")))
    rows = rows.select("item", "doc_id", "paragraph", "joined", F.size("words").alias("n"), last.alias("last"), F.explode(pieces).alias("p")).select("item", "doc_id", "paragraph", "joined", "n", "last", "p.base", "p.words")

    def window(at: Column) -> Column:
        i = F.col("base") + at
        cut = lambda j: ((i > 1) & (j < EDGE)) | ((i + (WINDOW - 1) < F.col("n")) & (j >= WINDOW - EDGE))
        return F.struct(i.alias("window"), F.transform(F.slice("words", at, WINDOW), lambda w, j: F.when(cut(j) & w.isin(ANCHORS), "").otherwise(w)).alias("words"))

    starts = F.sequence(F.lit(1), F.least(F.lit(SLICE), F.col("last") - F.col("base")), F.lit(STEP))
    # Windows without an anchor have no features; the first of a line stays, so that each line has one.
    kept = F.filter(F.transform(starts, window), lambda w: F.exists(w["words"], lambda x: x.isin(ANCHORS)) | (~F.col("joined") & (w["window"] == 1)))
    return rows.select("item", "doc_id", "paragraph", "joined", F.explode(kept).alias("w")).select("item", "doc_id", "paragraph", "joined", "w.window", "w.words")


def scan_licenses(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows for each line of `docs` (doc_id, text) with an anchor word: doc_id,
    paragraph (number of the line, from 0), family, probability, template,
    similarity. A paragraph of more than WINDOW words is read in windows; it gives a row
    for each family that a window shows, by its most certain window.

    A window shows a family whose probability against the unknown class is
    LEAST_PROBABILITY or more (`probability`), and that a template confirms (`template`,
    `similarity`): a name that stands there whole, or a notice with which it shares
    CONFIRMED of the smaller side's n-grams and LEAST_COMMON of them; of families that
    notices confirm the likest one, others only by name. A line that shows none gives `unknown`, with the
    probability that it is of none; of equal windows the first counts, of equal
    templates the last in order of text.

    Names and notices may break over lines: the lines between two blank ones are read
    joined as well. A family that they show and none of them shows alone gives a row
    with the number of the first of them. Lines give `unknown` only where nothing
    between those blank lines shows a family.

    Null text counts as empty, and such texts give no rows; repeated rows and ids
    are scanned each for itself; an empty table gives an empty result; other
    columns are ignored, whatever their names. Texts may be long: work and memory grow
    with a text, and a row that is shuffled holds one window.
    """
    model = train()
    names = [f"z{i}" for i in range(len(model.classes))]
    features = F.broadcast(spark.createDataFrame([(g, *map(float, w)) for g, w in zip(model.vocabulary, model.weights)], "gram string, " + ", ".join(f"{n} double" for n in names)))  # the vocabulary of the templates: of fixed size
    known: dict[str, list] = {}
    for family, text, whole in templates():
        known.setdefault(family, []).append((text, whole, grams_of(words_of(text))))
    patterns = F.broadcast(spark.createDataFrame(list(known.items()), "family string, known array<struct<text:string,whole:boolean,grams:array<string>>>"))  # of fixed size

    at = ["item", "paragraph", "joined", "window"]
    anchored = F.filter(_ngrams(F.col("words")), lambda g: g.rlike(_ANCHOR_GRAM))
    hits = _windows(docs).select(*at, "doc_id", "words", F.explode_outer(anchored).alias("gram")).join(features, "gram", "left")
    summed = hits.groupBy(*at).agg(F.first("doc_id").alias("doc_id"), F.first("words").alias("words"), *(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names))
    scores = {c: F.col(n) + float(b) for c, n, b in zip(model.classes, names, model.bias)}
    odds = F.array(*(F.struct(F.lit(c).alias("family"), (1 / (1 + F.exp(scores[UNKNOWN] - s))).alias("probability")) for c, s in scores.items() if c != UNKNOWN))
    told = summed.select(*at, "doc_id", _ngrams(F.col("words")).alias("grams"), odds.alias("odds"))
    likely = F.filter("odds", lambda o: o["probability"] >= LEAST_PROBABILITY)
    none = 1 - F.array_max(F.transform("odds", lambda o: o["probability"]))
    one = told.select(*at, "doc_id", "grams", none.alias("none"), F.explode_outer(likely).alias("o")).select(*at, "doc_id", "grams", "none", "o.family", "o.probability").join(patterns, "family", "left")
    common = lambda t: F.size(F.array_intersect(t["grams"], F.col("grams")))
    seen = F.transform("known", lambda t: F.struct(t["whole"].alias("whole"), (common(t) / F.least(F.size(t["grams"]), F.size("grams"))).alias("similarity"), common(t).alias("common"), F.size(t["grams"]).alias("size"), t["text"].alias("text")))
    sure = F.filter(seen, lambda t: F.when(t["whole"], t["common"] == t["size"]).otherwise((t["similarity"] >= CONFIRMED) & (t["common"] >= LEAST_COMMON)))
    alike = lambda whole: F.array_max(F.transform(F.filter("sure", lambda t: t["whole"] == F.lit(whole)), lambda t: F.struct(F.when(t["whole"], 1.0).otherwise(t["similarity"]).alias("similarity"), t["common"].alias("common"), t["text"].alias("text"))))
    one = one.withColumn("sure", sure).select(*at, "doc_id", "none", "family", "probability", alike(True).alias("name"), alike(False).alias("notice"))
    # Of the families that only a notice confirms the likest, of equally like ones the likeliest.
    one = one.withColumn("top", F.max(F.when(F.col("notice").isNotNull(), F.struct("notice.similarity", "notice.common", "probability", "family"))).over(Window.partitionBy(*at)))
    shown = F.col("name").isNotNull() | F.coalesce(F.col("notice").isNotNull() & (F.col("top.family") == F.col("family")), F.lit(False))
    one = one.withColumn("alike", F.coalesce("name", "notice"))
    read = one.select(
        *at, "doc_id", F.when(shown, F.col("family")).otherwise(UNKNOWN).alias("family"), F.when(shown, F.col("probability")).otherwise(F.col("none")).alias("probability"),
        F.when(shown, F.col("alike.text")).alias("template"), F.when(shown, F.col("alike.similarity")).otherwise(0.0).alias("similarity"),
    )
    # Of each family the most certain window; for the unknown class the one that is least sure of it.
    certain = F.struct(F.when(F.col("family") == UNKNOWN, -F.col("probability")).otherwise(F.col("probability")).alias("p"), (-F.col("window")).alias("at"))
    best = read.groupBy("item", "paragraph", "joined", "family").agg(F.max_by(F.struct("doc_id", "probability", "template", "similarity"), certain).alias("r"))
    # The joined lines count for families that no line shows alone; `unknown` where the block shows none.
    block, named = Window.partitionBy("item"), F.col("family") != UNKNOWN
    alone = best.withColumn("alone", F.collect_set(F.when(named & ~F.col("joined"), F.col("family"))).over(block)).withColumn("any", F.max(named).over(block))  # at most the families
    kept = alone.where(F.when(named, ~F.col("joined") | ~F.array_contains("alone", F.col("family"))).otherwise(~F.col("joined") & ~F.col("any")))
    return kept.select("r.doc_id", "paragraph", "family", "r.probability", "r.template", "r.similarity")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
