"""Licence scans: a trained paragraph classifier with an unknown class, confirmed against templates.

Training is small and happens on the driver: notices of each family, varied by a fixed rule, and paragraphs that are no
licence. Features are the distinct words and word pairs of a paragraph, hashed to 2^16 places; the model is a
multinomial logistic regression with an L1 penalty, so few places have weights, and its temperature is calibrated on
variants that it has not seen. The class `unknown` is trained like the others; features that no notice has carry no
weight, so ordinary prose falls to it.

Scanning uses DataFrame functions only and no shuffle: every paragraph of every text is hashed, looked up in literal
tables and scored; a family predicted with enough probability is confirmed if the paragraph holds enough of the pairs
of one of the family's notices. Each line is a paragraph; so that wrapped notices are found, a run of lines with words
is one too, under the number of its first line. A run is reported if it is confirmed and none of its lines confirms
its family. Comment marks are no words.

Nulls: a null text has no paragraphs. A paragraph without words isn't counted. A null id keeps its row, as do repeated
rows; an empty table gives an empty one. Columns other than the id and the text don't matter.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import numbers

BITS = 16
PROBABILITY = 0.6
CONFIRM = 0.6
UNKNOWN = "unknown"

# Notices by which works name their licence, by family.
NOTICES: dict[str, list[str]] = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "artistic": ["you may redistribute it and/or modify it under the terms of the Artistic License 2.0", "Released under the Artistic License.", "SPDX-License-Identifier: Artistic-2.0"],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "Use, modification and distribution are subject to the Boost Software License", "SPDX-License-Identifier: BSL-1.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.", "SPDX-License-Identifier: CC0-1.0"],
    "cddl": ["The contents of this file are subject to the terms of the Common Development and Distribution License", "Licensed under the CDDL, version 1.1.", "SPDX-License-Identifier: CDDL-1.1"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License.", "SPDX-License-Identifier: EPL-2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GNU GPL v2."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "SPDX-License-Identifier: MPL-2.0"],
    "odbl": ["This database is made available under the Open Database License", "Licensed under the Open Data Commons Open Database License (ODbL).", "SPDX-License-Identifier: ODbL-1.0"],
    "ofl": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.", "This license is available with a FAQ at https://openfontlicense.org", "SPDX-License-Identifier: OFL-1.1"],
    "psf": ["Licensed under the Python Software Foundation License Version 2.", "Licensed to PSF under a Contributor Agreement.", "SPDX-License-Identifier: PSF-2.0"],
    "reserved": ["All rights reserved.", "Copyright 2020 by the author. All rights reserved.", "No part of this publication may be reproduced without prior written permission of the publisher"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "For more information, please refer to https://unlicense.org", "SPDX-License-Identifier: Unlicense"],
    "wtfpl": ["Released under the WTFPL, version 2.", "Licensed under the terms of the WTFPL.", "SPDX-License-Identifier: WTFPL"],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Released under the zlib License.", "SPDX-License-Identifier: Zlib"],
}
# Paragraphs that share words with notices and are none.
OTHERS = [
    "The version of the work that the author released in the public library was modified.", "You may obtain a copy of the form at the office of the foundation.", "A licensed driver may use this car for any purpose.",
    "The general terms of the program are subject to change.", "All children have rights under the law.", "He was granted permission to use the material of the university.", "The copyright of the book was sold for a fee.",
    "The public was made to file into the open source of the river without restriction.", "Distributed forms of the foundation are free of charge.", "Please read the terms and conditions with the following notice.",
    "The license office is open to any person.", "Version 2.0 of the file was published by the international committee.", "It is free software, said the person with the documentation.", "The commercial value of the work is related to the extent of its use.",
    "the and of to a in is that for it as was with be by on at from this are or an", "no one may do this without the others", "under the table there is a work of art", "this work is by the author of the first part",
]
# Words that every text has; alone or in pairs with each other they are no features.
COMMON = set("the and of to a in is that for it as was with be by on at from this are or an no one may do without there you your if not can any all who has have been part first work other".split())
WORD = re.compile("[a-z0-9]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def slot(gram: str, bits: int = BITS) -> int:
    """The place of a feature: the engine's own 64-bit string hash, modulo 2^bits."""
    return xxhash.xxh64_intdigest(gram.encode(), 42) % (1 << bits)


def grams(tokens: list[str]) -> set[str]:
    return {*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:]))}


@dataclass
class Model:
    """Families with `unknown` last; weights by feature place; notices of each family as sets of places of pairs."""

    families: list[str]
    places: list[int]
    weights: list[list[float]]
    bias: list[float]
    temperature: float
    notices: list[tuple[int, list[int]]]
    words: list[int]


def variants(text: str, rng: random.Random, n: int) -> Iterable[list[str]]:
    """The words of the text, plain and with some dropped, cut or surrounded by others."""
    own = words(text)
    yield own
    filler = words(" ".join(OTHERS))
    for _ in range(n):
        out = [w for w in own if rng.random() > 0.08] or own
        if rng.random() < 0.5:
            out = [rng.choice(filler) for _ in range(rng.randint(1, 12))] + out
        if rng.random() < 0.5:
            out = out + [rng.choice(filler) for _ in range(rng.randint(1, 12))]
        yield out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache(1)
def train(bits: int = BITS, seed: int = 7, steps: int = 400, rate: float = 8.0, l1: float = 2e-4) -> Model:
    """Fit and calibrate the classifier on variants of NOTICES and OTHERS, by proximal gradient steps. Deterministic."""
    rng = random.Random(seed)
    families = [*sorted(NOTICES), UNKNOWN]
    vocabulary = sorted({slot(g, bits) for texts in NOTICES.values() for t in texts for g in grams(words(t)) if not COMMON.issuperset(g.split())})
    column = {p: i for i, p in enumerate(vocabulary)}

    def rows(n: int) -> tuple[np.ndarray, np.ndarray]:
        out = [(families.index(f), v) for f, texts in NOTICES.items() for t in texts for v in variants(t, rng, n)]
        out += [(len(families) - 1, v) for t in OTHERS for v in variants(t, rng, 3 * n)]
        filler = words(" ".join(OTHERS))
        out += [(len(families) - 1, [rng.choice(filler) for _ in range(rng.randint(0, rng.choice((10, 40, 150))))]) for _ in range(60 * n)]
        x = np.zeros((len(out), len(vocabulary)))
        for i, (_, v) in enumerate(out):
            x[i, [column[p] for p in {slot(g, bits) for g in grams(v)} if p in column]] = 1
        return x, np.array([y for y, _ in out])

    (x, y), (unseen, truth) = rows(10), rows(4)
    target = np.eye(len(families))[y]
    w, bias = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
    for step in range(steps):
        error = softmax(x @ w + bias) - target
        size = rate / (1 + 0.01 * step)
        w -= size * (x.T @ error) / len(x)
        w = np.sign(w) * np.maximum(0, np.abs(w) - size * l1)  # the L1 penalty
        bias -= 0.1 * size * error.mean(axis=0)
    z = unseen @ w + bias
    loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(truth)), truth], 1e-12)).sum()
    temperature = min((round(0.3 + 0.1 * i, 1) for i in range(38)), key=loss)
    used = [i for i in range(len(vocabulary)) if w[i].any()]
    notices = []
    for f, texts in NOTICES.items():
        for t in texts:
            own = words(t)
            notices.append((families.index(f), sorted({slot(f"{a} {b}", bits) for a, b in zip(own, own[1:])})))
    known = sorted({slot(v, bits) for texts in NOTICES.values() for t in texts for v in words(t)})
    return Model(families, [vocabulary[i] for i in used], np.round(w[used], 5).tolist(), np.round(bias, 5).tolist(), temperature, notices, known)


def place_of(gram: Column, bits: int) -> Column:
    return F.xxhash64(gram).bitwiseAND(F.lit((1 << bits) - 1))


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, probability: float = PROBABILITY, confirm: float = CONFIRM) -> DataFrame:
    """(doc_id, n_paragraphs, found array<struct<paragraph, family, probability, match, confirmed>>) for each row.

    `found` has the paragraphs for which a family other than `unknown` is most probable and probable enough.
    """
    model = model or train(bits)
    k = len(model.families)
    rank = dict(zip(model.places, range(1, len(model.places) + 1)))
    pairs = {p for _, own in model.notices for p in own}
    for p in sorted(pairs - rank.keys()):
        rank[p] = len(rank) + 1
    rows = model.weights + [[0.0] * k] * (len(rank) - len(model.weights))
    for p in model.words:  # known, so that their pairs are looked up, but without a weight
        rank.setdefault(p, len(rank) + 1)
    # a feature's number among those in use, or 0
    table = numbers([rank.get(p, 0) for p in range(1 << bits)])
    weights = F.split(F.lit(",".join(str(x / model.temperature) for row in rows for x in row)), ",").cast("array<double>")
    bias = F.split(F.lit(",".join(str(x / model.temperature) for x in model.bias)), ",").cast("array<double>")
    names = F.split(F.lit(",".join(model.families)), ",")

    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    paragraphs = F.filter(F.transform(F.split(text, "\n"), lambda p, i: F.struct(i.alias("paragraph"), p.alias("t"))), lambda p: p["t"].rlike("[a-z0-9]"))
    at = lambda gram: F.element_at(table, (place_of(gram, bits) + 1).cast("int"))

    def numbered(t: Column) -> Column:
        """Words with their numbers; the empty words at the ends have none."""
        return F.transform(F.split(t, "[^a-z0-9]+"), lambda w: F.struct(w.alias("w"), at(w).alias("n")))

    def features(w: Column) -> Column:
        # a pair can only be in use if both of its words are
        two = F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.when((a["n"] > 0) & (b["n"] > 0), at(F.concat_ws(" ", a["w"], b["w"]))).otherwise(F.lit(0).cast("long")))
        return F.array_distinct(F.concat(F.filter(w["n"], lambda x: (x > 0) & (x <= len(rows))), F.filter(two, lambda x: (x > 0) & (x <= len(rows)))))

    def score(x: Column) -> Column:
        """Logits of the classes: the weights of a feature follow one another."""
        return F.transform(F.sequence(F.lit(1), F.lit(k)), lambda c: F.aggregate(x, F.element_at(bias, c), lambda total, f: total + F.element_at(weights, ((f - 1) * k + c).cast("int"))))

    def match(x: Column, best: Column) -> Column:
        out = F.lit(0.0)
        by_family: dict[int, list[list[int]]] = {}
        for f, own in model.notices:
            by_family.setdefault(f, []).append([rank[p] for p in own])
        for f, lists in by_family.items():
            shares = [F.size(F.array_intersect(x, numbers(own))) / F.lit(float(len(own))) for own in lists]
            out = F.when(best == f, F.greatest(*shares) if len(shares) > 1 else shares[0]).otherwise(out)
        return out

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), paragraphs.alias("p"))
    docs = docs.select("doc_id", F.size("p").cast("long").alias("n_paragraphs"), F.transform("p", lambda p: F.struct(p["paragraph"].alias("paragraph"), numbered(p["t"]).alias("w"))).alias("p"))
    # runs of two lines or more whose numbers follow one another: their words, without the empty ones at the lines' ends
    after = lambda i: F.get("p", i)["paragraph"] - F.get("p", i - 1)["paragraph"] == 1
    index = F.when(F.size("p") > 0, F.sequence(F.lit(0), F.size("p") - 1)).otherwise(F.array().cast("array<int>"))
    docs = docs.withColumn("first", F.filter(index, lambda i: ~F.coalesce(after(i), F.lit(False)))).withColumn("last", F.filter(index, lambda i: ~F.coalesce(after(i + 1), F.lit(False))))
    runs = F.filter(F.zip_with("first", "last", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda r: r["b"] > r["a"])
    docs = docs.withColumn("runs", F.transform(runs, lambda r: F.struct(
        F.get("p", r["a"])["paragraph"].alias("paragraph"), F.get("p", r["b"])["paragraph"].alias("last"),
        F.filter(F.flatten(F.transform(F.slice("p", r["a"] + 1, r["b"] - r["a"] + 1), lambda p: p["w"])), lambda w: w["w"] != "").alias("w"),
    )))
    docs = docs.select("doc_id", "n_paragraphs", F.concat(F.transform("p", lambda p: F.struct(p["paragraph"].alias("paragraph"), p["paragraph"].alias("last"), p["w"].alias("w"))), F.col("runs")).alias("p"))
    docs = docs.withColumn("p", F.transform("p", lambda p: F.struct(p["paragraph"].alias("paragraph"), p["last"].alias("last"), features(p["w"]).alias("x"))))
    # a paragraph with the bias alone is `unknown`: only those with two features or more are scored
    docs = docs.withColumn("p", F.transform(F.filter("p", lambda p: F.size(p["x"]) > 1), lambda p: F.struct(p["paragraph"].alias("paragraph"), p["last"].alias("last"), p["x"].alias("x"), score(p["x"]).alias("z"))))
    docs = docs.withColumn("p", F.transform("p", lambda p: F.struct(p["paragraph"].alias("paragraph"), p["last"].alias("last"), p["x"].alias("x"), p["z"].alias("z"), (F.array_position(p["z"], F.array_max(p["z"])) - 1).cast("int").alias("best"))))
    docs = docs.withColumn("p", F.filter("p", lambda p: p["best"] < k - 1))
    odds = lambda z: 1 / F.aggregate(z, F.lit(0.0), lambda total, v: total + F.exp(v - F.array_max(z)))
    docs = docs.withColumn("p", F.filter(F.transform("p", lambda p: F.struct(p["paragraph"].alias("paragraph"), p["last"].alias("last"), p["best"].alias("best"), odds(p["z"]).alias("probability"), match(p["x"], p["best"]).alias("match"))), lambda p: p["probability"] >= probability))
    docs = docs.withColumn("p", F.transform("p", lambda p: F.struct(p["paragraph"].alias("paragraph"), F.get(names, p["best"]).alias("family"), p["probability"].alias("probability"), p["match"].alias("match"), (p["match"] >= confirm).alias("confirmed"), p["last"].alias("last"))))
    docs = docs.withColumn("lines", F.filter("p", lambda p: p["last"] == p["paragraph"]))
    told = lambda r: F.exists("lines", lambda p: p["confirmed"] & (p["family"] == r["family"]) & p["paragraph"].between(r["paragraph"], r["last"]))
    found = F.array_sort(F.concat("lines", F.filter("p", lambda p: (p["last"] > p["paragraph"]) & p["confirmed"] & ~told(p))))
    return docs.select("doc_id", "n_paragraphs", F.transform(found, lambda p: F.struct(*[p[c].alias(c) for c in ("paragraph", "family", "probability", "match", "confirmed")])).alias("found"))
