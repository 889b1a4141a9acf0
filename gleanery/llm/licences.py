"""Licence scan: a trained paragraph classifier, in DataFrame functions on the main path.

Paragraphs are lines, a hard-wrapped one's lines together (``WRAP``). A multinomial logistic regression over binary word 1- and 2-grams names a licence family or
none. It is trained on the driver from the family texts below (spans, dropped words, other years and versions) and
from a bounded sample of the corpus's own lines. What is licence-like but no family convincingly is ``unknown``: the
probabilities are tempered and their threshold set on licences outside the families. A family is confirmed when most
of a paragraph's n-grams are in the family's texts and one is in no other family's.

Every feature holds a word that hardly occurs outside licences, so only paragraphs with such a word are scored; the
others have no feature at all and are none by the bias. The table of features is bounded by ``MOST_FEATURES``.

Defined cases: null and empty texts hold no licence; each row is scanned for itself, rows with a null id and rows
that repeat too; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE, UNKNOWN = "none", "unknown"
MOST_FEATURES, MOST_LINES, LEAST_SIMILAR = 4_000, 2_000, 0.75
#: Wording of public licences, by family.
FAMILIES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license. See the LICENSE file. SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3. SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
    ),
    "LGPL": (
        "Released under the GNU Lesser General Public License, version 2.1 (LGPL). SPDX-License-Identifier: LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License. Use of this source code is governed by a BSD-style license. SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "MPL": (
        "Licensed under the Mozilla Public License, version 2.0 (MPL 2.0). SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "You are free to share and adapt the material under the Creative Commons Attribution ShareAlike license CC BY-SA 4.0, you must give appropriate credit.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC-SA 4.0. Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. You may not use the material for commercial purposes.",
    ),
    "Public domain": (
        "This is free and unencumbered software released into the public domain. The Unlicense. SPDX-License-Identifier: Unlicense",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication.",
    ),
    "Proprietary": (
        "Copyright (c) 2020 Example Inc. All rights reserved. Confidential and proprietary.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
    ),
}
#: Licences outside the families, to calibrate what is unknown.
OTHERS = (
    "Released under the Eclipse Public License, version 2.0.",
    "Licensed under the zlib license.",
    "This software is licensed under the Boost Software License, Version 1.0.",
    "Do what the fuck you want to public license, everyone is permitted to copy and distribute verbatim copies of this license document.",
    "Licensed under the European Union Public Licence.",
    "Licensed under the Artistic License 2.0.",
    "This font software is licensed under the SIL Open Font License, version 1.1.",
    "Licensed under the PostgreSQL License.",
)
#: A line break inside a paragraph: a small letter follows, or a long line before it ends in the middle of a sentence.
WRAP = r"\n(?:(?=[ \t#*/]*\p{Ll})|(?<=[^\n]{40}[\p{L}\p{N},)]\r?\n)(?=[^\n]*\S))"
PLAIN = "the a of and to in is it that for on was be with this are as by from or at an you not all have can will may his her they were one our out use if no so we which their time when there people into more other some than then these two way about after again also".split()


def words_of(text: str) -> list[str]:
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]


def grams_of(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@dataclass
class Model:
    """Weights by feature and class, biases, temperature, threshold and the features of each family's texts."""

    classes: list[str]
    features: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    templates: np.ndarray
    anchors: list[str]


def _examples(r: np.random.Generator, lines: list[str]) -> tuple[list[list[str]], list[str], list[list[str]]]:
    """Training paragraphs as words, their classes, and paragraphs of other licences."""
    texts, labels = [], []

    def vary(words: list[str]) -> list[str]:
        n = int(r.integers(min(5, len(words)), len(words) + 1)) if r.random() < 0.5 else len(words)
        a = int(r.integers(0, len(words) - n + 1))
        out = [w for w in words[a : a + n] if r.random() > 0.05]
        out = [str(int(r.integers(1, 2030))) if w.isdigit() and r.random() < 0.3 else w for w in out]
        extra = [str(x) for x in r.choice(PLAIN, int(r.integers(0, 6)))] if r.random() < 0.3 else []
        return out + extra if r.random() < 0.5 else extra + out

    for family, templates in FAMILIES.items():
        sentences = [s for t in templates for s in [t, *t.split(". ")] if len(words_of(s)) >= 4]
        for _ in range(60):
            texts.append(vary(words_of(str(r.choice(sentences)))))
            labels.append(family)
    everything = [w for ts in FAMILIES.values() for t in ts for w in words_of(t)]
    for _ in range(400):  # plain prose, now and then with a word of a licence
        texts.append([str(r.choice(PLAIN)) if r.random() < 0.95 else str(r.choice(everything)) for _ in range(int(r.integers(4, 60)))])
        labels.append(NONE)
    for line in lines:
        texts.append(words_of(line))
        labels.append(NONE)
    return texts, labels, [vary(words_of(t)) for t in OTHERS for _ in range(10)]


def train(lines: list[str], seed: int = 11, steps: int = 300) -> Model:
    """lines: at most MOST_LINES paragraphs of the corpus without licence words, as examples of none."""
    r = np.random.default_rng(seed)
    texts, labels, others = _examples(r, lines[:MOST_LINES])
    grams = [grams_of(t) for t in texts]
    classes = [*FAMILIES, NONE]
    own = np.array([classes.index(x) for x in labels])
    # words that plain text has, too, tell nothing by themselves
    plain_count: dict[str, int] = {}
    for g, label in zip(grams, labels, strict=True):
        if label == NONE:
            for w in g:
                plain_count[w] = plain_count.get(w, 0) + 1
    limit = max(1, (own == len(classes) - 1).sum() // 50)
    count: dict[str, int] = {}
    for g, label in zip(grams, labels, strict=True):
        if label != NONE:
            for w in g:
                count[w] = count.get(w, 0) + 1
    common = {w for w in [*PLAIN, *plain_count] if w in PLAIN or plain_count.get(w, 0) > limit}
    told = lambda w: any(x not in common and not x.isdigit() for x in w.split())
    features = sorted(sorted((w for w in count if told(w) and count[w] > 2), key=lambda w: (-count[w], w))[:MOST_FEATURES])
    at = {w: k for k, w in enumerate(features)}
    x = np.zeros((len(texts), len(features)), np.float32)
    for k, g in enumerate(grams):
        x[k, [at[w] for w in g if w in at]] = 1
    y = np.eye(len(classes), dtype=np.float32)[own]
    weight = 1.0 / np.bincount(own)[own] / len(classes)
    w, b = np.zeros((len(features), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    b[-1] = 2.0
    moments = [np.zeros_like(w), np.zeros_like(w)]
    for step in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ ((p - y) * weight[:, None]) + 1e-4 * w
        moments[0] += 0.1 * (g - moments[0])
        moments[1] += 0.01 * (g**2 - moments[1])
        w -= 0.05 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-7)
    # a paragraph without any feature is none: its bias stands over all
    b[:] = [*np.full(len(classes) - 1, -3.0), 0.0]
    held, held_labels, _ = _examples(np.random.default_rng(seed + 1), [])

    def scores(rows):
        z = np.zeros((len(rows), len(classes)))
        for k, t in enumerate(rows):
            z[k] = w[[at[g] for g in grams_of(t) if g in at]].sum(axis=0) + b
        return z

    known = np.array([k != NONE for k in held_labels])
    z, gold = scores(held)[known], np.array([classes.index(k) for k in held_labels])[known]
    zo = scores(others)

    def tempered(z, t):
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    temperature = min((1.0, 1.5, 2.0, 3.0, 4.0), key=lambda t: -np.log(tempered(z, t)[np.arange(len(z)), gold] + 1e-9).mean())
    right, wrong = np.sort(tempered(z, temperature)[:, :-1].max(axis=1)), np.sort(tempered(zo, temperature)[:, :-1].max(axis=1))
    cuts = np.linspace(0.3, 0.95, 66)
    least = float(max(cuts, key=lambda c: ((right >= c).mean() + 1.0 * (wrong < c).mean(), -c)))
    # the texts' other n-grams join the table without weights, to be compared
    rest = sorted({g for ts in FAMILIES.values() for t in ts for g in grams_of(words_of(t))} - set(features))
    w = np.concatenate([w, np.zeros((len(rest), len(classes)), np.float32)])
    features += rest
    at = {g: k for k, g in enumerate(features)}
    templates = np.zeros((len(features), len(classes) - 1), np.int64)
    for k, family in enumerate(FAMILIES):
        templates[[at[g] for t in FAMILIES[family] for g in grams_of(words_of(t))], k] = 1
    # beside these, the n-grams that only one family's texts have
    templates = np.concatenate([templates, templates * (templates.sum(axis=1, keepdims=True) == 1)], axis=1)
    anchors = sorted({x for f in features[: len(features) - len(rest)] for x in f.split() if x not in common and not x.isdigit()})
    return Model(classes, features, w.astype(float), b.astype(float), temperature, least, templates, anchors)


def paragraph_words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")


def paragraphs(text: Column) -> Column:
    return F.split(F.regexp_replace(text, WRAP, " "), "\n")


def sample_lines(docs: DataFrame, text_col: str = "text", most: int = MOST_LINES) -> list[str]:
    """A bounded sample of the corpus's different paragraphs without licence words, by a hash.

    Only those whose hash is small enough for about ``most`` or some more are ordered, so what tasks send to the driver
    does not grow with their number.
    """
    share = min(1.0, 2 * most / max(1, docs.count()))
    lines = docs.filter(F.col(text_col).isNotNull()).select(F.explode(paragraphs(F.col(text_col))).alias("line"))
    plain = lines.filter(~F.lower("line").rlike("licen|copyright|rights|permi|warrant") & (F.length("line") > 20) & (F.shiftrightunsigned(F.xxhash64("line"), 1) <= min(2**63 - 1, int(share * 2**63))))
    return [row["line"] for row in plain.distinct().orderBy(F.xxhash64("line"), "line").limit(most).collect()]


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each paragraph that holds a licence: id, paragraph, family, probability, similarity, confirmed."""
    spark = docs.sparkSession
    k = len(model.classes)
    table = spark.createDataFrame(
        [(f, [float(v) for v in w], [int(v) for v in t]) for f, w, t in zip(model.features, model.weights, model.templates, strict=True)],
        "gram string, w array<double>, t array<long>",
    )
    lines = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), F.posexplode(paragraphs(F.col(text_col))).alias("paragraph", "line"))
    # the model's words are a bounded list
    held = lines.select(id_col, "_row", "paragraph", F.explode(F.array(paragraph_words(F.col("line")))).alias("words")).filter(F.exists("words", lambda x: x.isin(model.anchors)))
    pairs = F.when(F.size("words") > 1, F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)))).otherwise(F.array().cast("array<string>"))
    grams = held.select(id_col, "_row", "paragraph", F.explode(F.array(F.array_distinct(F.concat("words", pairs)))).alias("all"))
    grams = grams.select(id_col, "_row", "paragraph", F.size("all").alias("n"), F.explode("all").alias("gram"))
    sums = [F.sum(F.col("w")[c]).alias(f"w{c}") for c in range(k)] + [F.sum(F.col("t")[c]).alias(f"t{c}") for c in range(2 * k - 2)]
    met = grams.join(F.broadcast(table), "gram").groupBy(id_col, "_row", "paragraph", "n").agg(*sums)
    logits = F.array(*[F.round((F.col(f"w{c}") + float(model.bias[c])) / model.temperature, 9) for c in range(k)])
    met = met.select(id_col, "paragraph", "n", F.array(*[F.col(f"t{c}") for c in range(2 * k - 2)]).alias("t"), logits.alias("z"))
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    met = met.withColumn("p", F.transform("z", lambda x: F.exp(x - top) / total))
    families = F.array(*[F.lit(c) for c in model.classes[:-1]])
    best = F.array_max(F.slice("p", 1, k - 1))
    met = met.withColumn("best", best).withColumn("at", F.array_position(F.slice("p", 1, k - 1), F.col("best")).cast("int"))
    similarity = F.element_at("t", F.col("at")) / F.col("n")
    out = met.filter(F.element_at("p", k) < 0.5).select(
        id_col,
        "paragraph",
        F.when(F.col("best") >= model.least, F.element_at(families, F.col("at"))).otherwise(UNKNOWN).alias("family"),
        F.round("best", 6).alias("probability"),
        F.round(similarity, 6).alias("similarity"),
        (F.element_at("t", F.col("at") + k - 1) > 0).alias("_own"),
    )
    confirmed = (F.col("family") != UNKNOWN) & (F.col("similarity") >= LEAST_SIMILAR) & F.col("_own")
    return out.withColumn("confirmed", confirmed).drop("_own")
