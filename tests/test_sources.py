import json

import pytest
from pyspark.sql import functions as F

from gleanery.sources import readers as R
from gleanery.sources import writers as W
from gleanery.streaming import events as E

SCHEMA = "image string, caption string"


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/x.JPG", "y.png", "z.txt", ".hidden.png"):
        (tmp_path / name).write_bytes(b"data")
    files = R.scan_files(spark, str(tmp_path), content=True)
    good, bad = R.split_by_suffix(files, [".jpg", ".png"])
    assert sorted(r.name for r in good.collect()) == ["x.JPG", "y.png"] and [r.category for r in bad.collect()] == ["unsupported_format"]
    assert good.select("sha256").distinct().count() == 1
    records = spark.createDataFrame([("y.png",), ("new.png",)], "name string")
    assert [r.name for r in R.missing_only(records, files, "name").collect()] == ["new.png"]


def test_strict_and_lax_json(spark, tmp_path):
    good, bad = tmp_path / "g.jsonl", tmp_path / "b.jsonl"
    good.write_text('{"image": "a", "caption": "x"}\n\n{"image": "b"}\n')
    bad.write_text('{"image": "a"}\n{not json\n{"caption": "c"}\n')
    rows, issues = R.read_jsonl_strict(spark, str(good), SCHEMA, "image")
    assert sorted(r.image for r in rows.collect()) == ["a", "b"] and issues.count() == 0
    rows, issues = R.read_jsonl_strict(spark, str(bad), SCHEMA, "image")
    assert rows.count() == 0 and sorted(r.message for r in issues.collect()) == ["line 2", "line 3"]
    assert R.read_jsonl_lax(spark, str(tmp_path / "none.jsonl"), SCHEMA).count() == 0
    assert R.read_manifest(spark, str(tmp_path / "none.jsonl"), SCHEMA, str(good)).count() == 2
    with pytest.raises(FileNotFoundError):
        R.read_manifest(spark, str(tmp_path / "none.jsonl"), SCHEMA)


def test_sidecars_suite_and_config(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"prompt": "x", "seed": 3}, indent=1))
    (tmp_path / "p2.json").write_text("{broken")
    sidecars = R.read_sidecars(spark, str(tmp_path), "prompt string, seed int")
    rows = spark.createDataFrame([("/d/p1.png",), ("/d/p2.png",), ("/d/p3.png",)], "path string")
    assert {r.path: r.seed for r in R.with_sidecars(rows, sidecars, "path").collect()} == {"/d/p1.png": 3, "/d/p2.png": None, "/d/p3.png": None}
    suite = R.read_suite(spark, [{"prompt": "a"}, {"prompt": "b", "id": "own", "width": 512}])
    assert sorted(r.id for r in suite.collect()) == ["own", "prompt00"]
    with pytest.raises(ValueError):
        R.read_suite(spark, [{"id": "x"}])
    (tmp_path / "c.json").write_text('{"k": 1}')
    assert R.load_config(str(tmp_path / "c.json")) == {"k": 1} == R.load_config({"k": 1})


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, None), ("a", 1, "z")], "image string, extra int, caption string")
    W.rewrite_jsonl(rows, str(tmp_path / "m"), "image", ["image", "caption"])
    W.rewrite_jsonl(rows, str(tmp_path / "m"), "image", ["image", "caption"])
    W.append_jsonl(rows, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 4
    W.write_report({"rows": rows, "counts": rows.agg(F.count("*").alias("n"))}, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 3
    W.write_tagged_csv({"run": rows, "baseline": rows.select("image")}, str(tmp_path / "c"))
    assert {r.set: r["count"] for r in spark.read.option("header", True).csv(str(tmp_path / "c")).groupBy("set").count().collect()} == {"run": 2, "baseline": 2}
    W.write_once(rows, str(tmp_path / "once"))
    W.write_once(rows.limit(0), str(tmp_path / "once"))
    assert spark.read.option("header", True).csv(str(tmp_path / "once")).count() == 2
    W.write_manifest(rows, spark.createDataFrame([("a",)], "image string"), "image", str(tmp_path / "t"), str(tmp_path / "h"))
    assert [r.image for r in spark.read.json(str(tmp_path / "h")).collect()] == ["a"]
    (tmp_path / "h.csv").write_text("step,loss,lr\n1,0.5,0.1\n2,,0.1\n")
    assert [(r.step, r.loss) for r in R.read_history(spark, str(tmp_path / "h.csv")).collect()] == [(1, 0.5), (2, None)]


def test_streams_drain_and_upsert(spark, tmp_path):
    place = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 2)], "id int, k string, v int").write.parquet(place)
    source = spark.readStream.schema("id int, k string, v int").parquet(place)
    merge = E.upsert_into(str(tmp_path / "out"), ["k"], "id")
    query = source.writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    spark.createDataFrame([(9, "a", 7)], "id int, k string, v int").write.mode("append").parquet(place)
    query = source.writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.k: (r.id, r.v) for r in spark.read.parquet(str(tmp_path / "out/1")).collect()} == {"a": (9, 7), "b": (3, 2)}
