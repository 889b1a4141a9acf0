"""Global orders, shuffled batches, numbered lines, manifests, rewinding logs, paged sources."""

import html
import json
import random

import pytest
from pyspark.sql import functions as F

from gleanery.functions import geometry as G
from gleanery.functions import texts as T
from gleanery.operators import history, manifests
from gleanery.sources import catalogues, paged
from gleanery.sources import readers as R
from gleanery.streaming import events as E
from gleanery.streaming import logs as L


def test_ordinals_are_a_bijection_in_order(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 5000).alias("k")).repartition(6)
    assert all(x.k == x.position for x in history.ordinals(rows, [F.col("k")]).collect())
    down = history.ordinals(rows, [F.desc("k")], "at").collect()
    assert all(x.at == 4999 - x.k for x in down)
    assert history.ordinals(rows.limit(0), [F.col("k")]).collect() == []


def test_shuffles_depend_on_seed_and_epoch_alone(spark):
    rows = spark.range(300).toDF("id")
    order = lambda parts, seed, epoch: {x.id: x.position for x in history.shuffled(rows.repartition(parts), "id", seed, epoch).collect()}
    one = order(1, 4, 0)
    assert one == order(5, 4, 0) != order(5, 4, 1) and sorted(one.values()) == list(range(300))


@pytest.mark.parametrize("drop_last", [False, True])
def test_shuffled_batches_never_mix_groups(spark, drop_last):
    rows = spark.createDataFrame([(k, None if k % 50 == 0 else k % 3 if k % 4 else 9) for k in range(700)], "id long, g long").repartition(4)
    made = history.shuffled_batches(rows, "g", "id", 8, 1, 0, drop_last).collect()
    places = {}
    for x in made:
        places.setdefault(x.place, []).append(x)
    assert sorted(places) == list(range(len(places))) and all(len({(x.g, x.batch) for x in batch}) == 1 for batch in places.values())
    assert len({x.id for x in made}) == len(made) and (drop_last or len(made) == 700)
    sizes = [len(b) for b in places.values()]
    assert max(sizes) == 8 and (not drop_last or min(sizes) == 8)
    assert [places[k][0].g for k in range(20)] != sorted((places[k][0].g for k in range(20)), key=str)


def test_lines_of_split_files_are_numbered(spark, tmp_path):
    r = random.Random(1)
    lines = {}
    for name in ("a", "b", "c"):
        lines[name] = ["x" * r.randrange(0, 300) + (f"é{k}" if k % 3 else "") for k in range(r.randrange(1, 400))]
        (tmp_path / name).write_bytes(("\r\n" if name == "b" else "\n").join(lines[name]).encode() + (b"\n" if name == "c" else b""))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = R.numbered_lines(spark, str(tmp_path))
        assert found.select("path", F.spark_partition_id().alias("p")).distinct().count() > 6
        got = {}
        for x in found.collect():
            got.setdefault(x.path.rsplit("/", 1)[1], {})[x.line_no] = x.line
        (tmp_path / "bad").mkdir()
        (tmp_path / "bad" / "d.jsonl").write_text("\n".join('{"image": "i%d"}' % k if k not in (77, 190) else "{" for k in range(250)))
        (tmp_path / "bad" / "e.jsonl").write_text("\n".join('{"image": "j%d"}' % k for k in range(250)))
        rows, issues = R.read_jsonl_strict(spark, str(tmp_path / "bad"), "image string", "image")
        assert sorted((x.line_no, x.image) for x in rows.collect()) == [(k + 1, f"j{k}") for k in range(250)]
        assert sorted(x.message for x in issues.collect()) == ["line 191", "line 78"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    for name, want in lines.items():
        while want and not want[-1]:  # what follows the last line end is no line
            want.pop()
        assert [got[name][k + 1] for k in range(len(want))] == want


def test_manifest_problems(spark):
    rows = [(1, "a", "zq, fine", 512, 640), (2, "b", "zq, fine", 512, 640), (3, "c", "no", 513, 640), (4, "d", "zq unknown", None, 640), (5, "e", None, 512, 8), (6, "f", "zq " + "word " * 80, 8, 8), (7, "g", None, 8, 8)]
    frame = spark.createDataFrame(rows, "k int, image string, text string, width int, height int")
    found = manifests.manifest_problems(frame, "zq", "k")
    assert sorted((x.image, x.severity[0], x.category) for x in found.collect()) == [("b", "w", "duplicate_caption"), ("c", "e", "bad_size"), ("c", "e", "missing_trigger"), ("d", "e", "placeholder_caption"), ("d", "e", "unreadable_image"), ("e", "e", "missing_trigger"), ("f", "e", "caption_too_long"), ("g", "e", "missing_trigger"), ("g", "w", "duplicate_caption")]
    assert sorted(x.image for x in manifests.accepted(frame, found).collect()) == ["a", "b"]
    assert manifests.manifest_problems(frame, "zq", "k", cost=None).filter("category = 'caption_too_long'").count() == 0


def test_references_decode_as_in_browsers(spark):
    texts = ["a &amp b", "&ampx;", "&notit; &notin;", "&#65 &#x41;x&#x41g", "&eacute&Eacute;", "&nosuch; &", "&#0; &#xD800; &#99999999999;", "&&lt;&lt", "&copy2020", "x&frac14y", "none"]
    got = [x.t for x in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.unescaped(F.col("t")).alias("t")).orderBy("k").collect()]
    assert got == [html.unescape(t) for t in texts]


def test_buckets_of_configurations_equal_those_of_one(spark):
    one = {tuple(x) for x in G.aspect_buckets(spark).collect()}
    configs = spark.createDataFrame([(1, 512, 64, 1.75), (2, 256, 64, 1.5)], "c int, base int, step int, most_ratio double")
    made = G.aspect_buckets_of(configs).collect()
    assert {(x.w, x.h) for x in made if x.c == 1} == one and any(x.c == 2 for x in made)


def test_log_rewinds_over_micro_batches(spark, tmp_path):
    r = random.Random(2)
    schema = "k long, at long, step long, ts timestamp"
    rows = [(r.randrange(4), at, r.randrange(30), at * 1000) for at in range(400)]
    for b in range(5):
        part = rows[b * 80 : b * 80 + 80]
        spark.createDataFrame([(k, at, s) for k, at, s, _ in part], "k long, at long, step long").withColumn("ts", F.timestamp_millis(F.col("at") * 1000)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes = E.drained(L.rewinding_changes(stream.withWatermark("ts", "1 hour"), "k", "at", "step"), str(tmp_path / "out"), str(tmp_path / "state"))
    told = changes.collect()
    assert any(not x.kept for x in told)
    want = {(k, at, s) for k, at, s, _ in rows if not any(k2 == k and a2 > at and s2 <= s for k2, a2, s2, _ in rows)}
    assert {tuple(x) for x in L.settled_log(changes, "k", "at", "step").collect()} == want
    batch = history.rewound(spark.createDataFrame([(k, at, s) for k, at, s, _ in rows], "k long, at long, step long"), "at", "step", ["k"])
    assert {tuple(x) for x in batch.collect()} == want


def test_idle_logs_close(spark, tmp_path):
    """A key that is idle for long begins a new log: what it had before is not taken back."""
    for at, rows in ((0, [(1, 10, 5), (2, 11, 5)]), (1, [(2, 100, 9)]), (2, [(2, 101, 8)]), (3, [(1, 200, 1), (2, 201, 1)])):
        frame = spark.createDataFrame(rows, "k long, at long, step long").withColumn("ts", F.timestamp_seconds(F.col("at")))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b{at}"))
    source = lambda: spark.readStream.schema("k long, at long, step long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    changes = L.rewinding_changes(source().withWatermark("ts", "0 seconds"), "k", "at", "step", time="ts", idle_ms=50_000)
    log = L.settled_log(E.drained(changes, str(tmp_path / "out"), str(tmp_path / "state")), "k", "at", "step")
    got = {tuple(x) for x in log.collect()}
    assert got == {(1, 10, 5), (1, 200, 1), (2, 201, 1)}  # the first one's log closed at 60, when 100 was seen


def page(folder, name, **reply):
    (folder / f"page={name}").mkdir(parents=True)
    (folder / f"page={name}" / "part-0.txt").write_text(json.dumps(reply))


def test_pages_are_followed_and_tried_again(spark, tmp_path):
    page(tmp_path, "a-0", items=[{"x": 1}, {"x": "é"}], **{"continue": "a-1"})
    page(tmp_path, "a-1", items=[], **{"continue": "a-2"})
    page(tmp_path, "a-2", items=[[3]])
    page(tmp_path, "b-0", items=[4])
    for k, status in enumerate((429, 503)):
        page(tmp_path, f"a-1.try{k}", status=status)
    got = {(x.start, x.page, x.place, json.dumps(json.loads(x.item))) for x in paged.read_pages(spark, f"file://{tmp_path}", tries="3").collect()}
    assert got == {("a-0", "a-0", 0, '{"x": 1}'), ("a-0", "a-0", 1, '{"x": "\\u00e9"}'), ("a-0", "a-2", 0, "[3]"), ("b-0", "b-0", 0, "4")}
    assert paged.read_pages(spark, f"file://{tmp_path}", starts="b").count() == 1
    with pytest.raises(Exception, match="status 503"):
        paged.read_pages(spark, f"file://{tmp_path}", tries="2").collect()


def test_waits_grow_and_faults_end():
    waits, replies = [], {("p", 0): {"status": 500}, ("p", 1): {"status": 429, "retry_after": "9"}, ("p", 2): {"items": [1]}, ("q", 0): {"status": 404}, ("r", 0): {"items": [], "continue": "r"}}
    ask = lambda name, k: replies[name, k]
    assert paged.fetched(ask, "p", 5, 2.0, waits.append)["items"] == [1] and waits == [2.0, 9.0]
    with pytest.raises(paged.PageError, match="404"):
        paged.fetched(ask, "q", 5, 2.0, waits.append)
    with pytest.raises(paged.PageError, match="do not end"):
        list(paged.chained(lambda name, k: replies["r", 0], "r", 1, 0.0, 10))


def test_chains_in_files_are_followed(spark, tmp_path):
    rows = [("a-0", "a-2", {"items": [[3]]}), ("a-0", "a-1.try1", {"status": 503}), ("a-0", "a-1", {"items": [], "continue": "a-2"}), ("a-0", "a-0", {"items": [{"x": "é\tb\n"}, 1], "continue": "a-1"}), ("a-0", "a-1.try0", {"status": 429}), ("b-0", "b-0", {})]
    made = spark.createDataFrame([(chain, name, json.dumps(reply, ensure_ascii=False)) for chain, name, reply in rows], "chain string, page string, value string")
    path = f"file://{tmp_path}/pages"
    paged.write_chains(made, path)
    page(tmp_path / "pages", "c-0", items=[5])
    got = {(x.start, x.page, x.place, x.item) for x in paged.read_pages(spark, path, tries="3").collect()}
    assert got == {("a-0", "a-0", 0, '{"x": "é\\tb\\n"}'), ("a-0", "a-0", 1, "1"), ("a-0", "a-2", 0, "[3]"), ("c-0", "c-0", 0, "5")}
    with pytest.raises(Exception, match="status 503"):
        paged.read_pages(spark, path, tries="2").collect()
    paged.write_chains(made.filter("page <> 'a-2'"), f"file://{tmp_path}/less")
    with pytest.raises(Exception, match="a-2: status 404"):
        paged.read_pages(spark, f"file://{tmp_path}/less").collect()


def test_suites_of_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"prompt": "x"}, {"prompt": "y", "id": "own", "width": 8, "more": 1}]))
    (tmp_path / "b.json").write_text(json.dumps([{"prompt": "z"}]))
    assert sorted((x.file[-6:], x.id, x.prompt, x.width) for x in R.read_suites(spark, str(tmp_path)).collect()) == [("a.json", "own", "y", 8), ("a.json", "prompt00", "x", None), ("b.json", "prompt00", "z", None)]
    for k, bad in enumerate(('[{"id": "n"}]', "{broken", "[]")):
        (tmp_path / f"bad{k}").mkdir()
        (tmp_path / f"bad{k}" / "c.json").write_text(bad)
        with pytest.raises(Exception, match="no prompt|no entries"):
            R.read_suites(spark, str(tmp_path / f"bad{k}")).collect()


def test_moved_manifest_finds_its_files(spark, tmp_path):
    for name in ("old/a.png", "new/a.png", "new/b.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    rows = spark.createDataFrame([(1, f"{tmp_path}/old/a.png", "z"), (2, f"{tmp_path}/old/b.png", "z"), (3, "c.png", None), (4, None, None)], "k int, image string, _name string")
    found = R.with_found_paths(rows, R.scan_files(spark, str(tmp_path)), "image", f"{tmp_path}/new")
    assert {x.k: x.image for x in found.collect()} == {1: f"{tmp_path}/old/a.png", 2: f"{tmp_path}/new/b.png", 3: "c.png", 4: None}


def test_catalogue_records(spark):
    item = lambda k, url, licence, title: json.dumps({"locations": [{"url": url, "license": {"id": licence}}, {"url": "other"}] if url != "none" else [], "source": {"id": f"w{k}", "title": title}})
    rows = [
        (0, item(0, "https://x/a1/info.json", "cc0", "A lake by Acme")),
        (1, item(1, "https://x/a2/info.json/", "cc0", "ACME: a hill")),
        (2, item(2, "https://x/a3/info.json", "in-copyright", "Acme")),
        (3, item(3, "https://x/a4/info.json", "cc0", "another maker")),
        (4, item(4, "none", "cc0", "Acme")),
        (5, item(5, "https://x/known/info.json", "cc0", "Acme")),
        (6, item(6, "https://x/small/info.json", "pdm", "Acme")),
        (7, item(7, "https://x/nosize/info.json", "pdm", "Acme")),
        (8, item(8, "https://x/a5/info.json", "pdm", "by acme")),
        (9, "{broken"),
        (10, None),
        (11, "{}"),
    ]
    frame = spark.createDataFrame(rows, "k int, item string").repartition(3)
    infos = spark.createDataFrame([(x, 900, 800) for x in ("a1", "a2", "a3", "a4", "a5", "known")] + [("small", 900, 100)], "image_id string, width int, height int")
    known = spark.createDataFrame([("there is x-known.jpg",), (None,)], "note string")
    made = lambda **more: [(x.image, x.image_id, x.licence) for x in catalogues.catalogue_records(frame, [F.col("k")], infos, known, "note", {"cc0": "C", "pdm": "P"}, "Acme", 9998, **more).orderBy(F.length("image"), "image").collect()]
    assert made(least_side=500) == [("9998.jpg", "a1", "C"), ("9999.jpg", "a2", "C"), ("10000.jpg", "a5", "P")]
    assert [x[1] for x in made()] == ["a1", "a2", "small", "nosize", "a5"] and made(least_side=500, most=1) == [("9998.jpg", "a1", "C")]


def test_catalogue_reads_its_items_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(item):
        seen.add(1)
        return item

    items = [json.dumps({"locations": [{"url": f"https://x/a{k}/info.json", "license": {"id": "cc0"}}], "source": {"id": f"w{k}", "title": "Acme"}}) for k in range(12)]
    frame = spark.createDataFrame(list(enumerate(items)), "k int, item string").withColumn("item", F.udf(read, "string").asNondeterministic()("item"))
    infos = spark.createDataFrame([("a1", 900, 800)], "image_id string, width int, height int")
    known = spark.createDataFrame([("x-a5.jpg",)], "note string")
    made = catalogues.catalogue_records(frame, [F.col("k")], infos, known, "note", {"cc0": "C"}, "acme")
    assert [x.work for x in made.orderBy("image").collect()] == [f"w{k}" for k in range(12) if k != 5] and seen.value == 12


def test_flat_files(spark, tmp_path):
    for name in ("b.png", "a.PNG", ".c.png", "d.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper" / "e.png").write_bytes(b"x")
    assert [(x.place, x.name) for x in R.flat_files(spark, str(tmp_path), [".png"]).orderBy("place").collect()] == [(0, "a.PNG"), (1, "b.png")]
