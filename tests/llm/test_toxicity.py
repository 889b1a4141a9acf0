import numpy as np

from gleanery.llm import toxicity as T


def corpus(seed, n):
    r = np.random.default_rng(seed)
    syllables = ["ka", "to", "mi", "re", "su", "lo", "ne", "vi"]
    word = lambda: "".join(r.choice(syllables, int(r.integers(1, 4))))
    texts, labels = [], []
    for i in range(n):
        words = [word() for _ in range(int(r.integers(3, 120)))]
        if i % 3 == 0:
            words[int(r.integers(0, len(words)))] = "Zgrx" + word() + "!"
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_held_out_accuracy_by_characters_alone():
    net = T.train(*corpus(1, 600), steps=500)
    texts, labels = corpus(2, 300)  # other words with the same stem
    predicted = T.Scorer(net).score(texts) >= 0.5
    assert (predicted == np.array(labels)).mean() > 0.95


def test_gradients_match_differences():
    net = T.Net(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    gates = r.standard_normal((5, 3, 6 * T.HIDDEN))
    mask = np.arange(5)[:, None] < np.array([5, 3, 1])
    loss = lambda: float((net.run(gates, mask) * np.array([1.0, -2.0, 0.5])).sum())
    _, saved = net.run(gates, mask, keep=True)
    g, dgates = net.backward(mask, saved, np.array([1.0, -2.0, 0.5]))
    for array, grad in [(gates, dgates), *[(net.p[k], g[k]) for k in ("att", "query", "out", "Uf", "Ub")]]:
        for _ in range(4):
            at = tuple(int(r.integers(0, s)) for s in array.shape)
            old = array[at]
            array[at] = old + 1e-5
            up = loss()
            array[at] = old - 1e-5
            down = loss()
            array[at] = old
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-2 * max(1.0, abs(grad[at]))


def test_windows_cover_every_word():
    for n in (0, 1, 32, 33, 52, 53, 500):
        starts = T.cut_windows(n)
        assert {i for s in starts for i in range(s, min(n, s + T.WINDOW))} == set(range(n))
        assert all(s + T.WINDOW <= n for s in starts) or n < T.WINDOW


def test_edge_rows(spark):
    texts, labels = corpus(4, 90)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (None, "x y"), (901, "")]
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in rows], "doc_id long, text string, score double")
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(None, 1), (900, None)], "doc_id long, toxic int")
    found = T.training_rows(docs, marks)
    import zlib

    assert len(found[0]) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(90))
    out = T.score_toxicity(docs, T.train(*found, steps=60)).collect()
    assert len(out) == 94 and all(0 <= r.score <= 1 for r in out)
    assert T.score_toxicity(docs.limit(0), None).count() == 0
    assert {r.score for r in T.score_toxicity(docs, None).collect()} == {0.0}


def unspaced(texts, glue=""):
    """Ideographs for letters, without white space."""
    return [glue.join(t.lower().replace("!", "").split()).translate({ord("a") + k: 0x4E00 + 7 * k for k in range(26)}) for t in texts]


def test_toxic_part_at_the_end_of_a_long_text_without_white_space():
    texts, labels = corpus(5, 600)
    net = T.train(texts + unspaced(texts) + unspaced(texts, " "), labels * 3, steps=500)
    clean = [t for t, y in zip(*corpus(6, 240), strict=True) if not y]
    clean = [" ".join(clean[k : k + 4]) for k in range(0, 160, 4)]
    toxic = [f"{t} Zgrx{t.split()[0]}" for t in clean]
    scorer = T.Scorer(net)
    for glue in ("", "_", ","):
        assert (scorer.score(unspaced(toxic, glue)) >= 0.5).mean() > 0.9, glue
        assert (scorer.score(unspaced(clean, glue)) < 0.5).mean() > 0.9, glue
    assert (scorer.score(["_".join(t.split()) for t in toxic]) >= 0.5).mean() > 0.9


def test_inputs_hold_all_characters_of_long_words():
    word = "".join(chr(0x4E00 + k) for k in range(1000))
    pieces = T.split_words(f"a {word} b")[1:-1]
    assert all(any(word[k : k + 5] in p for p in pieces) for k in range(996))
    assert all(len(p.encode()) <= 200 for p in pieces)
    assert T.split_words("x" * 200) == ["x" * 200] and len(T.split_words("x" * 201)) > 1


def test_scores_match_a_plain_network():
    """Every window by itself, step by step, without memo, batches or masks."""
    net = T.train(*corpus(7, 200), steps=60)
    p, h = net.p, T.HIDDEN

    def window(words):
        x = net.embed(*T.word_inputs(words))
        states = np.zeros((len(words), 2 * h))
        for way, order, at in (("f", range(len(words)), 0), ("b", range(len(words) - 1, -1, -1), h)):
            state = np.zeros(h)
            for k in order:
                g, u = x[k] @ p[f"W{way}"] + p[f"c{way}"], state @ p[f"U{way}"]
                z, r = 1 / (1 + np.exp(-(g[:h] + u[:h]))), 1 / (1 + np.exp(-(g[h : 2 * h] + u[h : 2 * h])))
                state = (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :]) + z * state
                states[k, at : at + h] = state
        a = np.exp(np.tanh(states @ p["att"]) @ p["query"])
        return float((a / a.sum()) @ states @ p["out"] + p["bias"][0])

    texts = [*corpus(8, 25)[0], "", None, "x", "ka " * 300]
    for text, score in zip(texts, T.Scorer(net).score(texts), strict=True):
        words = [w.strip(T.PUNCTUATION) for w in T.split_words(text)]
        logits = [window(words[s : s + T.WINDOW]) for s in T.cut_windows(len(words))] if words else [float(p["bias"][0])]
        assert abs(score - 1 / (1 + np.exp(-max(logits)))) < 1e-4


def test_a_passage_of_half_a_window_lies_whole_in_one():
    for n in (40, 100, 333):
        starts = T.cut_windows(n)
        for a in range(n - T.WINDOW // 2 + 1):
            assert any(s <= a and a + T.WINDOW // 2 <= s + T.WINDOW for s in starts)
