import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import common, jaccard
from gleanery.llm.common import Words


def brute(rows, k, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text in rows:
        words = [w.translate(lower) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    component = {i: i for i in sets}

    def find(x):
        while component[x] != x:
            x = component[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                one, two = sorted((find(ids[a]), find(ids[b])))
                component[two] = one
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed, n=260):
    r = np.random.default_rng(seed)
    word = lambda: f"w{int(r.zipf(1.3)) % 4000}"
    line = " ".join(word() for _ in range(14))
    base = [[word() for _ in range(int(r.integers(1, 120)))] for _ in range(30)]
    rows = []
    for i in range(n):
        words = list(base[int(r.integers(0, 30)) if i % 3 else 0])
        for _ in range(int(r.integers(0, 4))):
            words[int(r.integers(0, len(words)))] = word()
        rows.append((i * 7, ("\t" if i % 5 else "\n").join(words).upper() + (f" {line}" if i % 4 == 0 else "")))
    return rows + [(3, None), (5, ""), (8, " \n\t"), (10, "Ab"), (11, "aB "), (12, "É"), (13, "é"), (15, "a b"), (16, "A\x0bb"), (17, "a b c d"), (18, "a b c d e")]


@pytest.mark.parametrize(("seed", "k", "percent", "least"), [(1, 3, 90, 2), (2, 5, 80, 2), (3, 3, 90, 32)])
def test_matches_brute_force(spark, seed, k, percent, least):
    rows = corpus(seed)
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(6)
    got = jaccard.jaccard_components(frame, k=k, percent=percent, frequent_from=least).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, k, percent)


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_partners_share_a_signature(percent):
    r = np.random.default_rng(percent)
    universe = np.unique(r.integers(0, 1 << 63, 3000, dtype=np.uint64))
    frequent = np.unique(universe[::2] >> jaccard.FREQUENT_BITS)
    rank = r.permutation(len(frequent))
    for _ in range(400):
        n = int(r.integers(4, 160))
        x = np.sort(r.choice(universe[:: int(r.integers(1, 3))], n, replace=False))
        drop = int(r.integers(0, n * (100 - percent) // 100 + 1))
        y = np.sort(np.concatenate([r.permutation(x)[drop:], r.choice(universe, int(r.integers(0, 1 + n // 20)))]))
        y = np.unique(y)
        common = len(np.intersect1d(x, y))
        if 100 * common >= percent * (len(x) + len(y) - common) and not np.array_equal(x, y):
            (one, p_one), (two, p_two) = (jaccard.signatures(z, percent, frequent, rank) for z in (x, y))
            singles = len(np.intersect1d(one, two))
            n, p, m, q = (np.array([len(z)]) for z in (x, one, y, two))
            assert singles >= jaccard.least_shared(n, p, m, q, percent)[0]
            assert singles or len(np.intersect1d(p_one, p_two))
            for z, own in ((x, p_one), (y, p_two)):
                if not singles:
                    kept = len(z) - len(one if z is x else two)
                    assert kept >= jaccard.least_overlap(len(z), -(-percent * len(z) // 100), percent) and len(own)


def test_sketches_differ_no_more_than_their_sets():
    r = np.random.default_rng(8)
    for _ in range(60):
        x, y = (np.unique(r.integers(0, 1 << 63, int(r.integers(1, 60000 if r.random() < 0.1 else 300)), dtype=np.uint64) << np.uint64(1)) for _ in range(2))
        y = np.unique(np.concatenate([y, x[: len(x) // 2]]))
        a, b = (np.frombuffer(jaccard.sketch(z), np.uint8).astype(int) for z in (x, y))
        assert len(a) == jaccard.SKETCH and np.abs(a - b).sum() <= len(np.setxor1d(x, y))


def test_empty_and_null_ids(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (2, "A b c d")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_components(rows).collect())) == [(1, 2, 1), (2, 2, 1)]


def test_short_texts_are_one_shingle():
    one, blank = jaccard.shingle_sets(Words(lower=True), ["one two", " "], 3, np.zeros(4, np.int32))
    assert len(one) == 1
    assert len(blank) == 0


def test_words_hash_alike_wherever_they_stand():
    hashes, at = Words(lower=True).cut(["Ab c\nd  ", None, "", " x", "aB C", "\u00c9\x0b\u00e9", "c ab"])
    assert list(np.diff(at)) == [3, 0, 0, 1, 2, 2, 2]
    assert hashes[0] == hashes[4] == hashes[9] and hashes[1] == hashes[5] == hashes[8] and len(set(hashes.tolist())) == 6


def test_buckets_follow_the_size_of_the_table(spark, monkeypatch):
    """Groups of an exchange are as many as the table's size asks for, and none holds much more than its share."""
    r = np.random.default_rng(12)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 300, 40)) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate([*texts, *texts[:100]])), "doc_id long, text string").repartition(3)
    want = {tuple(x) for x in jaccard.jaccard_components(frame).collect()}
    sizes = []

    def watched(rows, buckets=None):
        if "tokens" in rows.columns or "sig" in rows.columns:
            blob = "tokens" if "tokens" in rows.columns else "sig"
            sizes.append((buckets, sorted(x.n for x in rows.groupBy("bucket").agg(F.sum(F.length(blob)).alias("n")).collect())))
        return common.exchange(rows, buckets)

    monkeypatch.setattr(jaccard, "bucket_count", lambda rows: 23)
    monkeypatch.setattr(jaccard, "exchange", watched)
    assert {tuple(x) for x in jaccard.jaccard_components(frame).collect()} == want
    assert len(sizes) == 3 and all(b == 23 for b, _ in sizes)
    assert all(not n or len(n) <= 23 and n[-1] <= 3 * (sum(n) / 23) for _, n in sizes)
