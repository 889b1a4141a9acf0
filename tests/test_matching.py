"""Candidates, tries, containment: against plain Python, and how much they compare."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery.operators import groups, joins
from gleanery.operators.lexicon import WordTrie


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_band_candidates_are_few_and_once(spark):
    r = random.Random(5)
    n = 1500
    rows = [(i, signed(r.getrandbits(64)), signed(r.getrandbits(64))) for i in range(n)]
    met = groups.band_candidates(spark.createDataFrame(rows, "id long, h0 long, h1 long"), "id", ["h0", "h1"], 20)
    pairs = [(x.a, x.b) for x in met.select("a", "b").collect()]
    assert all(a < b for a, b in pairs)
    assert 0 < len(pairs) <= 4 * n * n * 133 / 2**18


def test_near_pairs_are_all_found(spark):
    r = random.Random(6)
    base = [r.getrandbits(128) for _ in range(60)]
    hashes = base + [h ^ sum(1 << b for b in r.sample(range(128), r.randrange(1, 24))) for h in base for _ in range(3)] + base[:5] * 4
    rows = [(i, signed(h >> 64), signed(h & (1 << 64) - 1)) for i, h in enumerate(hashes)]
    got = {(x.a, x.b): x.bits for x in groups.hamming_pairs(spark.createDataFrame(rows, "id long, h0 long, h1 long"), "id", ["h0", "h1"], 20).collect()}
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    reps = sorted(first.values())
    want = {(a, b): (hashes[a] ^ hashes[b]).bit_count() for a in reps for b in reps if a < b and (hashes[a] ^ hashes[b]).bit_count() <= 20}
    want |= {(first[h], i): 0 for i, h in enumerate(hashes) if first[h] != i}
    assert got == want


def test_lane_bits_cross_lanes(spark):
    r = random.Random(7)
    h = r.getrandbits(128)
    row = spark.createDataFrame([(signed(h >> 64), signed(h & (1 << 64) - 1))], "h0 long, h1 long")
    lanes = [F.col("h0"), F.col("h1")]
    for a, b in ((0, 18), (54, 73), (63, 65), (64, 127), (110, 128), (1, 64)):
        assert row.select(groups.lane_bits(lanes, a, b).alias("x")).first().x == h >> (128 - b) & (1 << b - a) - 1


def plain_hits(text, lexicon):
    out = {}
    for name, alias in lexicon:
        m = re.search(rf"(?<!\w){re.escape(alias)}(?!\w)", text, re.IGNORECASE)
        if m and m.start() < out.get(name, len(text) + 1):
            out[name] = m.start()
    return out


@pytest.mark.parametrize("few", [0, 2, 5, 16])
def test_trie_reads_like_a_regex_per_alias(few, monkeypatch):
    monkeypatch.setattr(WordTrie, "FEW", few)
    r = random.Random(8)
    lexicon = [("a", "in"), ("a", "in the"), ("b", "the end"), ("c", "in the end"), ("d", "end-in"), ("e", "+in"), ("f", "the ("), ("g", "++"), ("h", "ÉNA"), ("a", "a  b"), ("i", "x_y")]
    bits = ["in", "In", "the", "end", "-", "+", "++", " ", " ", " ", "(", "éna", "Éna", "a", "b", "  ", "x_y", "_", "ß", "İ", "7"]
    trie = WordTrie(lexicon)
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(0, 14)))
        assert trie.earliest(text) == plain_hits(text, lexicon), text


def test_lexicon_hits_by_trie_and_by_join(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "The end, in the END"), (2, None), (3, ""), (4, "inthe"), (1, "in")], "id long, text string")
    lexicon = spark.createDataFrame([("x", "the"), ("y", "in the end"), ("z", "in"), ("w", None), ("v", "")], "name string, alias string")
    want = {(1, "x", 1), (1, "y", 10), (1, "z", 1)}
    assert {tuple(x) for x in joins.lexicon_hits(texts, "id", "text", lexicon).collect()} == want
    monkeypatch.setattr(joins, "MOST_BROADCAST", 2)
    assert {tuple(x) for x in joins.lexicon_hits(texts, "id", "text", lexicon.dropna()).collect()} == want


def test_not_contained_against_all_pairs(spark):
    r = random.Random(9)
    word = lambda most: "".join(r.choice("abc_é") for _ in range(r.randrange(0, most)))
    texts = [word(40) for _ in range(60)] + [None, ""]
    needles = [(i, word(9)) for i in range(400)] + [(1000, None), (1001, ""), (1002, texts[0]), (1003, texts[0] + "a")]
    rows = spark.createDataFrame(needles, "id long, needle string")
    hay = spark.createDataFrame([(t, 1) for t in texts], "hay string, _needle int")
    got = joins.not_contained(rows, F.col("needle"), hay, "hay")
    assert got.columns == ["id", "needle"]
    assert {x.id for x in got.collect()} == {i for i, n in needles if n is None or not any(n in t for t in texts if t is not None)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert joins.not_contained(rows, F.col("needle"), hay.limit(0), "hay").count() == len(needles)


@pytest.mark.parametrize("head", [2, 64])
def test_not_contained_with_long_needles(spark, monkeypatch, head):
    monkeypatch.setattr(joins, "MOST_HEAD", head)
    r = random.Random(4)
    texts = ["".join(r.choice("ab😀") for _ in range(r.randrange(1, 200))) for _ in range(30)] + ["a" * 90]
    needles = [("a" * n, i) for i, n in enumerate((1, 7, 8, 89, 90, 91))]
    for i in range(200):
        t = r.choice(texts)
        at = r.randrange(len(t))
        needles.append((t[at : at + r.randrange(1, 190)] + r.choice(("", "", "a", "b")), 100 + i))
    got = joins.not_contained(spark.createDataFrame(needles, "needle string, id int"), F.col("needle"), spark.createDataFrame([(t,) for t in texts], "hay string"), "hay")
    assert {x.id for x in got.collect()} == {i for n, i in needles if not any(n in t for t in texts)}


def test_containment_takes_few_substrings(spark):
    """All needles and texts share what they are made of: 4,000,000 pairs of them hold a common part of three."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("01") for _ in range(24))
    wanted = spark.createDataFrame([(word(),) for _ in range(2000)], "_needle string").distinct()
    hay = spark.createDataFrame([(f"seen: {word()}, {word()}",) for _ in range(2000)], "_hay string")
    assert joins.substrings_met(wanted, hay).count() < 5000


def test_blocks_score_like_the_broadcast_way(spark, monkeypatch):
    import numpy as np

    from gleanery.operators import similarity

    r = np.random.default_rng(4)
    make = lambda n, at: [(at + i, [float(np.float32(x)) for x in r.normal(size=6)]) for i in range(n)]
    vectors, references = make(70, 0), make(95, 1000)
    references += [(2000 + i, references[3][1]) for i in range(60)] + [(3000, [0.0] * 6), (3001, None)]
    vectors += [(500, vectors[0][1]), (501, [0.0] * 6), (502, None)]
    a, b = (spark.createDataFrame(x, "id long, embedding array<float>") for x in (vectors, references))
    want = {x.id: x for x in similarity.scored_against(a, b, "id", "id", "embedding").collect()}
    monkeypatch.setattr(similarity, "MOST_NUMBERS", 60)
    monkeypatch.setattr(similarity, "BLOCK_NUMBERS", 120)
    out = similarity.scored_against(a, b, "id", "id", "embedding")
    got = {x.id: x for x in out.collect()}
    assert got.keys() == want.keys() and len(got) == 72
    for k, x in want.items():
        assert all(abs(x[c] - got[k][c]) < 1e-9 for c in ("sim_mean", "sim_median", "sim_max", "sim_top")) and x.nearest == got[k].nearest, k
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert similarity.scored_against(a, b.limit(0), "id", "id", "embedding").collect() == []


def test_products_come_in_bounded_slices(spark, monkeypatch):
    import numpy as np

    from gleanery.operators import similarity

    r = np.random.default_rng(5)
    a, b = r.normal(size=(25, 6)), r.normal(size=(40, 6))
    b[30:] = b[3]  # copies: the first of them is the nearest
    a[7] = b[3]
    monkeypatch.setattr(similarity, "PRODUCTS", 100)
    slices = list(similarity.products(a, b))
    assert max(x.size for _, x in slices) <= 100 and np.allclose(np.concatenate([x for _, x in slices]), a @ b.T)
    at, top = similarity.nearest_of(a, b, a @ b.T)
    assert at[7] == 3 and top[7] == sum(x * x for x in b[3].tolist()) and (at < 30).all()
    rows = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {x.id: x for x in similarity.scored_against(rows(a), rows(b), "id", "id", "v").collect()}
    for i, s in enumerate(a @ b.T):
        assert got[i].nearest == at[i] and abs(got[i].sim_median - np.median(s)) < 1e-9 and abs(got[i].sim_top - np.sort(s)[-3:].mean()) < 1e-9
    monkeypatch.setattr(similarity, "MOST_NUMBERS", 60)
    few = similarity.scored_against(rows(a), rows(b), "id", "id", "v", median=False).collect()
    assert all(x.nearest == got[x.id].nearest and abs(x.sim_top - got[x.id].sim_top) < 1e-9 and x.sim_median is None for x in few) and len(few) == 25


def test_no_sketch_for_each_key(spark, tmp_path):
    from gleanery.plans import relational

    rows = [("AN"[k % 2] if k % 7 else None, k // 3 if k % 11 else None) for k in range(900)]
    spark.createDataFrame(rows, "l_returnflag string, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    made = relational.sketch_error(spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys=\[[^\]]*l_orderkey[^\]]*\], functions=\[[^\]]*(sketch|approx)", plan)
    want = {f: len({k for g, k in rows if g == f and k is not None}) for f in ("A", "N", None)} | {"all": len({k for _, k in rows if k is not None})}
    assert {x.l_returnflag: x.orders for x in made.collect()} == want
