import numpy as np
import pytest

from gleanery.llm import neighbours


def brute(rows, k, every):
    good, seen = [], set()
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v) or len(v) != 8 or (i, tuple(v)) in seen:
            continue
        seen.add((i, tuple(v)))
        good.append((i, np.array(v, dtype=np.float32).astype(float)))
    out = {}
    for i, q in good:
        if i % every == 0:
            found = sorted((float(np.sqrt(((x - q) ** 2).sum())), j) for j, x in good if j != i)[:k]
            out[i] = found
    return out


def test_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 16)
    r = np.random.default_rng(0)
    points = r.normal(size=(900, 8))
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(points)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)]  # one very common vector
    rows += [(2000, None), (2010, [0.0] * 8), (2020, [1.0, None, *[0.0] * 6]), (2030, [float("nan")] * 8), (2040, [float("inf")] * 8), (None, rows[0][1]), (2050, [1.0]), rows[10], (2060, [])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, list int").repartition(4)
    got = {}
    for x in neighbours.nearest(frame, every=10).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    want = brute(rows, 10, 10)
    assert set(got) == set(want)
    hits = total = 0
    for q, found in want.items():
        assert found[0][0] >= 0 and len(got[q]) == 10 and got[q] == sorted(got[q])
        hits += len({j for _, j in found} & {j for _, j in got[q]})
        total += 10
    assert hits / total >= 0.9
    assert got[1000] == [(0.0, 5), *[(0.0, 1000 + i) for i in range(1, 10)]]


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (100, [3.0, 2.0])]])
def test_few_rows(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = neighbours.nearest(frame).collect()
    assert len(out) == sum(i % 100 == 0 for i, _ in rows) * max(0, len(rows) - 1)


def test_isolated_vectors_have_all_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 4)
    r = np.random.default_rng(4)
    near = r.normal(size=(600, 8))
    far = [r.normal(size=8) * 400 for _ in range(20)]  # each becomes a list of its own
    rows = [(1000 + i, [float(np.float32(x)) for x in v]) for i, v in enumerate(near)]
    rows += [(10 * i, [float(np.float32(x)) for x in v]) for i, v in enumerate(far)]
    rows += [(10 * i + j, rows[600 + i][1]) for i in range(15, 20) for j in (1, 2)]  # small groups of copies
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for x in neighbours.nearest(frame, every=10).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    want = brute(rows, 10, 10)
    assert set(got) == set(want) and all(len(x) == 10 and x == sorted(x) for x in got.values())
    assert all(got[10 * i][:2] == [(0.0, 10 * i + 1), (0.0, 10 * i + 2)] for i in range(15, 20))


def test_short_queries_search_all_lists_in_the_end(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 1)
    monkeypatch.setattr(neighbours, "WIDEN", 2, raising=False)
    rows = [(i, [float(3.0**i), 1.0]) for i in range(13)]  # nearly a list for each
    frame = spark.createDataFrame([(10 * i + j, v) for i, v in rows for j in range(4)], "vec_id long, embedding array<float>")
    out = neighbours.nearest(frame, every=10).groupBy("query_id").count().collect()
    assert {x.query_id: x["count"] for x in out} == {10 * i: 10 for i, _ in rows}


def test_groups_are_bounded_whatever_list_is_asked(spark, monkeypatch):
    """Many queries near one centroid are split, and still have their neighbours."""
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(neighbours, "PART_ROWS", 30)
    monkeypatch.setattr(neighbours, "LIST_ROWS", 100)
    r = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in 0.01 * r.normal(size=8) + 1]) for i in range(500)]
    sizes = []
    inner = type(spark.range(1)).groupBy

    def watched(self, *keys):
        if keys == ("list", "part", "block"):
            counts = inner(self, *keys).agg(neighbours.F.count_if("query").alias("q"), neighbours.F.count_if(~neighbours.F.col("query")).alias("v")).collect()
            sizes.extend((x.q, x.v) for x in counts)
        return inner(self, *keys)

    monkeypatch.setattr(type(spark.range(1)), "groupBy", watched)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for x in neighbours.nearest(frame, every=2).collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    want = brute(rows, 10, 2)
    assert {k: sorted(v) for k, v in got.items()} == want
    assert sizes and max(q for q, _ in sizes) < 60 and max(v for _, v in sizes) < 90
