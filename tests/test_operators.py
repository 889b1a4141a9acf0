"""Semantics on hand-written rows: nulls, ties, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from gleanery.functions import geometry as G
from gleanery.functions import texts as T
from gleanery.operators import groups, history, joins, ladder, similarity


def one(spark, expr, **values):
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(expr.alias("r")).first()["r"]


def test_ladder_first_match_and_all_issues(spark):
    rows = spark.createDataFrame([(1, None, 10), (2, "a", 10), (3, "a", 500)], "id long, text string, w int")
    rules = (("no_text", "text IS NULL"), ("small", "w < 384"))
    assert [r.reason for r in ladder.reject_ladder(rows, rules).orderBy("id").collect()] == ["no_text", "small", None]
    issues = ladder.all_issues(rows, "id", (("no_text", "error", "text IS NULL"), ("small", "warning", "w < 384")))
    assert sorted(map(tuple, issues.collect())) == [(1, "error", "no_text"), (1, "warning", "small"), (2, "warning", "small")]
    assert ladder.all_issues(rows.limit(0), "id", (("x", "error", "w < 1"),)).count() == 0


def test_paired_is_null_safe_and_last_wins(spark):
    left = spark.createDataFrame([(None, 1, 0.5), ("a", None, 0.6), ("b", 2, 0.7)], "k string, seed int, x double")
    right = spark.createDataFrame([(None, 1, 1, 0.1), (None, 1, 2, 0.2), ("a", None, 1, 0.3), ("c", 2, 1, 0.4)], "k string, seed int, line int, x double")
    got = {(r.k, r.seed): r.base_x for r in joins.paired(left, right, ["k", "seed"], "line").collect()}
    assert got == {(None, 1): 0.2, ("a", None): 0.3}


def test_resume_keeps_rows_with_null_keys(spark):
    todo = spark.createDataFrame([("a", 1), ("a", None), ("b", 1)], "id string, seed int")
    done = spark.createDataFrame([("a", 1), ("a", None)], "id string, seed int")
    assert sorted(map(tuple, joins.resume(todo, done, ["id", "seed"]).collect()), key=str) == [("a", None), ("b", 1)]


def test_as_of_takes_the_latest_not_later(spark):
    left = spark.createDataFrame([(1, "u", 5), (2, "u", 1), (3, "v", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("u", 2, 20), ("u", 5, 50), ("u", 6, 60), ("u", 4, None)], "k string, t int, v int")
    assert {r.id: r.last for r in joins.as_of(left, right, "k", "t", "t", "v", "last").collect()} == {1: 50, 2: None, 3: None}


def test_levels_survive_cycles(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "r"), ("r", "b"), ("x", "y")], "parent string, child string")
    assert {r.node: r.level for r in joins.levels_from(edges, "r").collect()} == {"r": 0, "a": 1, "b": 1}


def test_merged_sets_and_survivors(spark):
    pairs = spark.createDataFrame([(1, 2, 2), (2, 3, 0), (7, 8, 1), (8, 9, 1)], "a long, b long, priority int")
    sets = {r.node: (r.set_id, r.priority) for r in groups.merged_sets(pairs).collect()}
    assert sets == {1: (1, 0), 2: (1, 0), 3: (1, 0), 7: (7, 1), 8: (7, 1), 9: (7, 1)}
    members = spark.createDataFrame([(1, 1, 10, True), (2, 1, 10, True), (3, 1, 99, False), (7, 7, 1, True)], "node long, set_id long, area int, live boolean")
    kept = {r.node: r.kept for r in groups.survivors(members, F.col("live"), [F.desc("area"), F.asc("node")]).collect()}
    assert kept == {1: True, 2: False}


def test_hamming_bands_lose_no_pair(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    rows = [(k, base[k % 30] ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 6)))) for k in range(120)]
    signed = [(k, v - (1 << 64) if v >> 63 else v) for k, v in rows]
    got = {(x.a, x.b): x.bits for x in groups.hamming_pairs(spark.createDataFrame(signed, "id long, h long"), "id", ["h"], 5).collect()}
    first = {}
    for k, v in rows:
        first.setdefault(v, k)  # pairs are of the smallest ids of hashes; copies hang on these
    want = {(a, b): bin(x ^ y).count("1") for x, a in first.items() for y, b in first.items() if a < b and bin(x ^ y).count("1") <= 5}
    assert got == want | {(first[v], k): 0 for k, v in rows if first[v] != k}


@pytest.mark.parametrize("most", [16, 34])
def test_hamming_of_wide_hashes(spark, most):
    r = random.Random(most)
    rows = [(k, r.getrandbits(64), r.getrandbits(64)) for k in range(40)]
    turned = lambda v, n: v ^ sum(1 << b for b in r.sample(range(64), n))
    rows += [(40 + k, turned(x, r.randrange(0, most // 2 + 3)), turned(y, r.randrange(0, most // 2 + 3))) for k, x, y in rows]
    signed = [(k, *[v - (1 << 64) if v >> 63 else v for v in lanes]) for k, *lanes in rows]
    got = {(x.a, x.b): x.bits for x in groups.hamming_pairs(spark.createDataFrame(signed, "id long, h0 long, h1 long"), "id", ["h0", "h1"], most).collect()}
    bits = lambda x, y: sum(bin(u ^ v).count("1") for u, v in zip(x, y, strict=True))
    want = {(a, b): bits(x, y) for a, *x in rows for b, *y in rows if a < b and bits(x, y) <= most}
    assert got == want and len(want) > 20


def test_loops_that_do_not_settle_are_errors(spark):
    chain = spark.createDataFrame([(k, k + 1, 0) for k in range(40)], "a long, b long, priority int")
    with pytest.raises(ValueError):
        groups.merged_sets(chain, most_rounds=1)
    edges = spark.createDataFrame([(k, k + 1) for k in range(6)], "parent long, child long")
    with pytest.raises(ValueError):
        joins.levels_from(edges, 0, most=3)
    assert joins.levels_from(edges, 0).count() == 7


def test_lexicon_of_several_words(spark):
    texts = spark.createDataFrame([(1, "The Sea King met a c.d. man and the sea. King"), (2, "seaking, the deep sea"), (3, "by the SEA KING's hall, Otto"), (4, None), (5, "ottoman")], "id long, t string")
    lexicon = spark.createDataFrame([("Neptune", "sea king"), ("water", "sea"), ("Otto", "Otto"), ("odd", "c.d"), ("sea", "deep sea")], "name string, alias string")
    hits = joins.lexicon_hits(texts, "id", "t", lexicon)
    assert {r.id: r.names for r in joins.names_in_order(hits, "id").collect()} == {1: "Neptune, water, odd", 2: "sea, water", 3: "Neptune, water, Otto"}
    ranked = spark.createDataFrame([("water", "by water", 2), ("Neptune", "in the palace of the sea", 1)], "name string, place string, priority int")
    assert {r.id: r.place for r in joins.first_by_priority(hits, "id", ranked, "place").collect()} == {1: "in the palace of the sea", 2: "by water", 3: "in the palace of the sea"}


def test_means_are_exact(spark):
    rows = spark.createDataFrame([(0.0001, -0.0002), (0.0002, -0.0001), (None, -0.0001)], "x double, y double")
    got = rows.select(similarity.exact_mean(F.col("x")).alias("x"), similarity.exact_mean(F.col("y")).alias("y"), similarity.exact_mean(F.col("x"), 3).alias("z")).first()
    assert (got.x, got.y, got.z) == (0.0002, -0.0001, 0.0)


def test_similarity_ways_agree(spark):
    r = random.Random(1)
    vectors = spark.createDataFrame([(k, [r.random() for _ in range(6)]) for k in range(40)], "id long, v array<double>")
    run, references = vectors.filter("id >= 10"), vectors.filter("id < 10")
    fast = {x.id: x for x in similarity.scored_against(run, references, "id", "id", "v").collect()}
    for x in similarity.scored_by_blocks(run, references, "id", "id", "v", 3).collect():
        assert x.nearest == fast[x.id].nearest and abs(x.sim_top - fast[x.id].sim_top) < 1e-9 and abs(x.sim_median - fast[x.id].sim_median) < 1e-9
    few = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0]), ("c", None)], "g string, v array<double>")
    assert {x.g: x.diversity for x in similarity.diversity(few, "g", "v", 2).collect()} == {"a": None, "b": 1.0, "c": None}


def test_rewind_equals_a_stack(spark):
    r = random.Random(7)
    rows, want = [], set()
    for log in range(20):
        stack = []
        for at in range(30):
            step = r.randrange(12)
            rows.append((log, at, step))
            stack = [x for x in stack if x[1] < step] + [(at, step)]
        want |= {(log, *x) for x in stack}
    got = history.rewound(spark.createDataFrame(rows, "log int, at int, step int"), "at", "step", ["log"])
    assert {(x.log, x.at, x.step) for x in got.collect()} == want


def test_history_means_batches_and_ids(spark):
    steps = spark.createDataFrame([(s, 0.2 if s <= 250 else 0.1) for s in range(1, 501)], "step int, loss double")
    means = {x.step: x.m for x in history.trailing_mean(steps, "step", "loss", 50, "m").collect()}
    assert abs(means[250] - 0.2) < 1e-9 and abs(means[500] - 0.1) < 1e-9
    rows = spark.createDataFrame([(k, k % 3) for k in range(20)], "id int, size int")
    assert history.fixed_batches(rows, "size", ["id"], 4, drop_last=True).groupBy("size", "batch").count().filter("count <> 4").count() == 0
    stems = spark.createDataFrame([("0000",), ("0003",), ("notes",)], "stem string")
    assert history.next_id(stems, "stem").first()[0] == 4 and history.next_id(stems.limit(0), "stem").first()[0] == 0
    final = spark.createDataFrame([("x", "c1", False, 5, True), ("x", "f", True, 1, True), ("y", "c2", False, 9, False), ("y", "c1", False, 3, True)], "k string, path string, final boolean, step int, ok boolean")
    assert dict(map(tuple, history.latest(final, ["k"], "path", "final", "step", "ok").collect())) == {"x": "f", "y": "c1"}


@pytest.mark.parametrize(
    ("raw", "want"),
    [("File:The_Great &amp; Small.jpg", "The Great & Small"), ('<b>Lady</b> in "red"', "Lady in red"), ("Caf&eacute; &#8211; Th&#xe9;&#0;&bogus; &amp;lt;", "Café – Thé\ufffd&bogus; &lt;"), ("SunSet", "Sun Set"), ("ab", None), (None, None), (" - , ", None), ("A &lt;b&gt; C", "A <b> C")],
)
def test_clean_title(spark, raw, want):
    noise = (r"(?i)^file:\s*", r"(?i)\.jpg$")
    assert one(spark, T.clean_title(F.col("t"), noise), t=raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("File:Acme Works, Lady lost in thoughts (1901).jpg", "Lady lost in thoughts"),
        ("File:A King as Envoy (cropped).jpg", "A King as Envoy"),
        ("File:Acme Works, Spring (oleographic print).jpg", "Spring"),
        ("Swan and Lady label QS:Len,Swan and Lady label QS:Lsi,x", "Swan and Lady"),
        ('<div class="fn">\n"A Lady looking back"</div>', "A Lady looking back"),
        ("Painting of 3 Sisters by Acme Works", "Sisters"),
        ("File:AshGrove.jpg", "Ash Grove"),
    ],
)
def test_title_noise(spark, raw, want):
    assert one(spark, T.clean_title(F.col("t"), T.title_noise(r"acme\s+works")), t=raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("St. Cecilia at the organ", "St"),
        ("Mr. T.S. Eliot reads. More follows", "Mr"),
        ("Saraswati is the goddess of art (and wisdom). She is more. And more", "Saraswati is the goddess of art (and wisdom)"),
        ("A Lady title QS:P1476,en", "A Lady"),
        ("A Lady Malayalam: \u0d05\u0d06, in red", "A Lady , in red"),
        ("one two three four five six seven eight nine ten eleven twelve thirteen", "one two three four five six seven eight nine ten eleven twelve"),
        ("kept  as it\nis.", "kept as it\nis"),
        (None, None),
    ],
)
def test_short_title(spark, raw, want):
    assert one(spark, T.short_title(F.col("t")), t=raw) == want


def test_counts_and_palettes(spark):
    counts = {w: one(spark, T.parse_count(F.col("t")), t=w) for w in ("none", "No", "zero", "eight", "nine", "many", "12", "")}
    assert counts == {"none": 0, "No": 0, "zero": 0, "eight": 8, "nine": None, "many": None, "12": 12, "": None}
    bands = [((100, 100, 101), "cool"), ((100, 101, 100), "green"), ((109, 100, 100), "warm"), ((107, 100, 100), "neutral"), ((100, 100, 100), "neutral")]
    for (r, g, b), want in bands:
        assert spark.range(1).select(T.palette_band(F.lit(r), F.lit(g), F.lit(b)).alias("r")).first()["r"] == want


def test_coerced_answers(spark):
    answer = '{"subject": "we see a lake by day", "pose": ["a", 2, true], "style": 3, "light": "", "old": false, "new": true, "none": null, "list": []}'
    got = one(spark, T.coerced(F.col("t"), F.lit("a lake")), t=answer)
    assert got == {"subject": "we see a lake by day", "pose": "a, 2, true", "style": "3", "new": "True"}
    assert one(spark, T.coerced(F.col("t"), F.lit("a hill")), t=answer) is None
    assert one(spark, T.coerced(F.col("t"), F.lit("a")), t="no json") is None


def test_texts(spark):
    assert one(spark, T.extract_year(F.col("t"), 1860, 1910), t="x (1890) (1700)") == 1890
    assert one(spark, T.extract_year(F.col("t"), 1860, 1910), t="x (1700) (1890)") is None
    assert one(spark, T.parse_count(F.col("t")), t=" Three ") == 3 and one(spark, T.parse_count(F.col("t")), t="12") == 12 and one(spark, T.parse_count(F.col("t")), t="lots") is None
    assert one(spark, T.redacted(F.col("t")), t="API_KEY: 123") == T.REDACTED and one(spark, T.redacted(F.col("t")), t="the token went missing") == "the token went missing"
    assert not one(spark, T.informative(F.col("t"), ("no",), ("phone",)), t="two phones here") and one(spark, T.informative(F.col("t"), ("no",), ("phone",)), t="phonetic")
    assert one(spark, T.token_count(F.col("t")), t="one, two é") == 4


@pytest.mark.parametrize("note", [None, "kept note"])
def test_trim_is_the_longest_prefix_that_fits(spark, note):
    r = random.Random(5)
    cost = lambda t: int(len([w for w in t.replace(",", " ").split() if w]) * 13 // 10) + t.count(",")
    for _ in range(12):
        parts = [" ".join("w" * r.randrange(1, 4) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 7))]
        budget = r.randrange(3, 25)
        best = None
        for k in range(1, len(parts) + 1):
            held = parts[:k] if note is None else parts[: min(2, k)] + [note] + parts[min(2, k) : k]
            if k == 1 or cost(", ".join(held)) <= budget:
                best = ", ".join(held)
        row = spark.createDataFrame([(parts, note)], "p array<string>, note string")
        assert row.select(T.trim_to_budget(F.col("p"), budget, note=None if note is None else F.col("note")).alias("r")).first()["r"] == best


def test_keypoints(spark):
    schema = "a array<array<struct<x:double,y:double>>>, b array<array<struct<x:double,y:double>>>"
    same, far = [(0.1, 0.1), (0.2, 0.2), None], [(0.9, 0.9), (0.2, 0.2), None]
    cases = [(([same], [same]), 1.0), (([same], []), 0.0), (([], [same]), None), ((None, [same]), None), (([same], [[(0.9, 0.9), (0.9, 0.9), None], far]), 0.5), (([[None, None, None]], [same]), 0.0)]
    for (a, b), want in cases:
        got = spark.createDataFrame([(a, b)], schema).select(G.best_keypoint_score(F.col("a"), F.col("b")).alias("r")).first()["r"]
        assert got == want


def test_buckets(spark):
    buckets = G.aspect_buckets(spark)
    rows = buckets.collect()
    assert all(r.w % 64 == 0 and r.h % 64 == 0 and abs(r.w * r.h - 512 * 512) <= 0.15 * 512 * 512 for r in rows)
    sizes = spark.createDataFrame([(1, 1000, 1420), (2, 1000, 1000)], "id int, w int, h int")
    assert {r.id: (r.bucket_w, r.bucket_h) for r in G.nearest_bucket(sizes, buckets, "id").collect()} == {1: (448, 640), 2: (512, 512)}
    w, h = G.photo_size(F.col("w"), F.col("h"))
    assert all(64 <= x <= 2000 and x % 8 == 0 for r in sizes.select(w.alias("w"), h.alias("h")).collect() for x in r)


def test_next_id_of_keys_of_seven_digits(spark, tmp_path):
    from gleanery.plans import layout

    keys = [*range(999_990, 1_000_005), 1_234_566]
    spark.createDataFrame([(k, f"part {k}") for k in keys], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert layout.next_id(spark, str(tmp_path)).first()[0] == 1_234_567
