import pytest

from gleanery.llm import licences


@pytest.fixture(scope="module")
def model():
    return licences.train([f"some plain line of words number {k} and the rest of it" for k in range(300)])


def test_held_out_accuracy(model):
    import numpy as np

    at = {w: k for k, w in enumerate(model.features)}
    texts, labels, _ = licences._examples(np.random.default_rng(99), [])
    right = 0
    for words, label in zip(texts, labels, strict=True):
        z = model.weights[[at[g] for g in licences.grams_of(words) if g in at]].sum(axis=0) + model.bias
        right += model.classes[int(z.argmax())] == label
    assert right / len(texts) > 0.85


def test_scan(spark, model):
    rows = [
        (1, "Some prose.\nReleased under the MIT License.\nMore prose here"),
        (2, "prose\n\nThis work is licensed under the GNU General Public License, version 3."),
        (3, "a plain text of the version that is 2.0 with no licence"),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
        (6, None),
        (7, ""),
        (None, "Released under the MIT License."),
        (1, "Released under the MIT License."),
        (8, "Licensed under the Eclipse Public License, version 2.0."),
        (9, "the " * 20_000 + "\nReleased under the MIT License."),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, family string").repartition(3)
    found = sorted(((r.doc_id or 0, r.paragraph, r.family, r.confirmed) for r in licences.scan(docs, model).collect()))
    families = [(i, p, f) for i, p, f, _ in found]
    for expected in [(0, 0, "MIT"), (1, 0, "MIT"), (1, 1, "MIT"), (2, 2, "GPL"), (4, 0, "CC-BY-NC"), (5, 0, "Apache"), (5, 1, "MIT"), (9, 1, "MIT")]:
        assert expected in families
    assert not [x for x in found if x[0] in (3, 6, 7)]
    assert [f for i, _, f, c in found if i == 8 and (f == licences.UNKNOWN or not c)] or not [x for x in found if x[0] == 8]
    assert licences.scan(docs.limit(0), model).count() == 0


def test_no_feature_without_an_anchor(model):
    anchors = set(model.anchors)
    assert all(anchors & set(f.split()) for f, w in zip(model.features, model.weights, strict=True) if w.any())
    assert (model.weights != 0).any(axis=1).sum() <= licences.MOST_FEATURES
    assert model.bias.argmax() == len(model.classes) - 1


WRAPPED = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software"""


def test_wrapped_paragraphs_are_judged_whole(spark, model):
    docs = spark.createDataFrame([(1, f"A title\n\n{WRAPPED}\n\nReleased under the MIT License.\nAnd prose.", 0)], "doc_id long, text string, paragraph int")
    found = sorted((r.paragraph, r.family, r.confirmed) for r in licences.scan(docs, model).collect())
    assert found == [(2, "MIT", True), (4, "MIT", True)]


def plain_scan(model, text):
    """The classifier and the template comparison without Spark."""
    import re

    import numpy as np

    at = {w: k for k, w in enumerate(model.features)}
    out = []
    wrap = re.compile(r"\n(?=[ \t#*/]*[a-z])")  # the long lines here end with a full stop
    for number, line in enumerate(wrap.sub(" ", text).split("\n")):
        words = licences.words_of(line)
        grams = licences.grams_of(words)
        known = [at[g] for g in grams if g in at]
        if not known or not set(words) & set(model.anchors):
            continue
        z = (model.weights[known].sum(axis=0) + model.bias) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        if p[-1] >= 0.5:
            continue
        best = int(p[:-1].argmax())
        family = model.classes[best] if p[best] >= model.least else licences.UNKNOWN
        similar = model.templates[known, best].sum() / len(grams)
        own = model.templates[known, len(model.classes) - 1 + best].sum() > 0
        out.append((number, family, round(float(p[best]), 5), round(float(similar), 5), bool(family != licences.UNKNOWN and similar >= licences.LEAST_SIMILAR and own)))
    return out


def test_scan_matches_a_plain_classifier(spark, model):
    import random

    r = random.Random(6)
    sentences = [x + "." for ts in licences.FAMILIES.values() for t in ts for x in t.split(". ")] + list(licences.OTHERS) + ["Plain prose stands here and says nothing.", "the version of it is 2.0 and more.", ""]
    rows = [(k, "\n".join(r.choice(sentences).rstrip(".") + r.choice([".", ".", " and so on."]) for _ in range(r.randrange(0, 6)))) for k in range(60)]
    rows += [(3, rows[3][1]), (70, "MIT " * 3000 + "License.")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((x.doc_id, x.paragraph, x.family, round(x.probability, 5), round(x.similarity, 5), x.confirmed) for x in licences.scan(frame, model).collect())
    want = sorted((k, *x) for k, t in rows for x in plain_scan(model, t))
    assert [x[:3] + x[5:] for x in got] == [x[:3] + x[5:] for x in want]
    assert all(abs(a[3] - b[3]) < 1e-4 and abs(a[4] - b[4]) < 1e-4 for a, b in zip(got, want, strict=True))
