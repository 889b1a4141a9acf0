import re

import numpy as np
import pytest

from gleanery.llm.common import Words
from gleanery.llm.substrings import Windows, _Outbox, deduplicate_substrings


def brute(rows, width):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for i, text in rows]
    first = {}
    for i, own in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(own) - width + 1):
            key = tuple(own[k : k + width])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for i, own in words:
        gone = set()
        if i is not None:
            for k in range(len(own) - width + 1):
                if first[tuple(own[k : k + width])] < (i, k):
                    gone.update(range(k, k + width))
        out.append((i, len(own), len(gone), " ".join(w for k, w in enumerate(own) if k not in gone)))
    return sorted(out, key=str)


def corpus(seed):
    r = np.random.default_rng(seed)
    word = lambda: f"w{int(r.zipf(1.4)) % 500}"
    passages = [[word() for _ in range(int(r.integers(15, 70)))] for _ in range(12)]
    rows = []
    for i in range(160):
        words = []
        for _ in range(int(r.integers(0, 5))):
            words += [word() for _ in range(int(r.integers(0, 60)))]
            p = passages[int(r.integers(0, 12))]
            a = int(r.integers(0, 12))
            words += p[a:] if i % 2 else p
        if i % 7 == 0:
            words += ["run"] * int(r.integers(10, 60)) + ["a", "b"] * int(r.integers(5, 30))
        rows.append((int(i * 3), ("\n" if i % 4 else " \t").join(words)))
    return [*rows, *rows[:3], (1001, None), (1002, ""), (1003, " \n"), (None, rows[0][1]), (1004, rows[0][1]), (1005, "É " * 45), (1006, "É " * 19)]


@pytest.mark.parametrize(("seed", "width"), [(1, 20), (2, 20), (3, 12)])
def test_matches_brute_force(spark, seed, width):
    rows = corpus(seed)
    frame = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_words int").repartition(5)
    got = deduplicate_substrings(frame, width).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=str) == brute(rows, width)


def test_equal_windows_have_equal_witnesses():
    rows = [t for _, t in corpus(9)]
    w = Windows(Words(lower=False), rows, 20)
    seen = {}
    for window, witness, at in zip(w.hash(w.first).tolist(), w.witness.tolist(), w.first.tolist(), strict=True):
        told = (None, 0) if witness < 0 else (int(w.key[witness]), int(w.start[witness]) - at)
        assert seen.setdefault(window, told) == told
    assert (w.witness >= 0).mean() > 0.8


def test_empty(spark):
    assert deduplicate_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blobs_are_in_order_of_ids_and_places():
    """Ordered ids and places compress well when shuffled; keys do not in any order."""
    r = np.random.default_rng(1)
    box = _Outbox(3, 0)
    box.add(key=r.integers(0, 500, 2000).astype(np.uint64), id=r.integers(0, 40, 2000), place=r.integers(0, 300, 2000))
    rows = 0
    for blob in box.flush().to_pylist():
        ids, places = np.frombuffer(blob["id"], np.int64), np.frombuffer(blob["place"], np.int32)
        assert (np.lexsort((places, ids)) == np.arange(len(ids))).all()
        rows += len(ids)
    assert rows > 1900
