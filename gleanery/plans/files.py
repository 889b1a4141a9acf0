"""Sources and sinks: each query writes a table in some format to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import pictures as P
from gleanery.operators.history import ordinals
from gleanery.session import shared_path, table
from gleanery.sources import catalogues as C
from gleanery.sources import paged
from gleanery.sources import readers as R
from gleanery.sources import writers as W

PART = "p_partkey long, p_name string"


def _lines(spark, sf):
    """Parts as JSON lines in four files; in the files of keys that 4 divides some lines are broken."""
    parts = table(spark, sf, "part")
    line = F.when(F.col("p_partkey") % 1000 == 4, "{broken").otherwise(F.to_json(F.struct("p_partkey", "p_name")))
    made = parts.select("p_partkey", line.alias("value"), (F.col("p_partkey") % 4).alias("grp"))
    path = shared_path(spark, "lines")
    made.repartitionByRange(4, "grp").sortWithinPartitions("grp", "p_partkey").select("value", "grp").write.partitionBy("grp").text(path)
    return path


def jsonl_strict(spark, sf):
    """Rows of the files without a bad line."""
    return R.read_jsonl_strict(spark, _lines(spark, sf), PART, "p_partkey")[0].select("p_partkey", "p_name", "line_no")


def jsonl_issues(spark, sf):
    return R.read_jsonl_strict(spark, _lines(spark, sf), PART, "p_partkey")[1].select("severity", "category", "message")


def jsonl_lax(spark, sf):
    """Rows of a file that is there and of one that is not."""
    path = shared_path(spark, "lax")
    table(spark, sf, "part").select("p_partkey", "p_name").write.json(path)
    return R.read_jsonl_lax(spark, path, PART).unionByName(R.read_jsonl_lax(spark, shared_path(spark, "nothing"), PART))


def manifest_scan(spark, sf):
    """Known fields of the file that stands in for a missing manifest."""
    path = shared_path(spark, "manifest")
    table(spark, sf, "part").withColumn("own", F.lit(1)).write.json(path)
    return R.read_manifest(spark, shared_path(spark, "nothing"), PART, path)


#: Pages of a chain: a longer listing is one of several chains, so that more tasks read a larger one.
CHAIN_PAGES = 400


def _chains(spark, rows, group, key, size, item, stem, tag, faulty=None):
    """The folder of a captured listing of each group's rows by key: items in pages of ``size``, these in chains named
    <stem><group>-<chain>. A page that is ``faulty`` by its number in the group, _p, fails at first."""
    path = shared_path(spark, tag)
    placed = ordinals(rows.withColumn("_g", group), [F.col("_g"), F.col(key)], "_at")
    firsts = F.broadcast(placed.groupBy("_g").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows")))
    listed = placed.join(firsts, "_g").withColumn("_n", F.col("_at") - F.col("_first")).withColumn("_p", F.floor(F.col("_n") / size))
    pages = listed.groupBy("_g", "_rows", "_p").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", item.alias("item")))), lambda x: x["item"]).alias("items"))
    within = F.col("_p") % CHAIN_PAGES
    chain = F.concat(F.lit(stem), F.col("_g").cast("string"), F.lit("-"), F.floor(F.col("_p") / CHAIN_PAGES).cast("string"), F.lit("-"))
    name = lambda p: F.concat(chain, p.cast("string"))
    more = (within + 1 < CHAIN_PAGES) & ((F.col("_p") + 1) * size < F.col("_rows"))
    replies = pages.select(name(F.lit(0)).alias("chain"), name(within).alias("page"), F.to_json(F.struct("items", F.when(more, name(within + 1)).alias("continue"))).alias("value"), "_p")
    if faulty:
        replies = replies.select("chain", F.inline(F.concat(F.array(F.struct("page", "value")), F.when(F.expr(faulty), F.array(F.struct(F.concat("page", F.lit(".try0")).alias("page"), F.lit('{"status": 503}').alias("value")))).otherwise(F.array()))))
    paged.write_chains(replies, path)
    return path


def _page_place(page):
    """The group and the number in it of a page of ``_chains``."""
    part = lambda k: F.regexp_extract(page, r"^[a-z]+(-?\d+)-(\d+)-(\d+)$", k).cast("long")
    return part(1).cast("int"), (part(2) * CHAIN_PAGES + part(3)).cast("int")


SHELF_ROWS = 50
LICENCES = {"cc0": "CC0 1.0", "pdm": "Public Domain Mark"}


def catalogue_scan(spark, sf):
    """Works of a catalogue of parts that chains of pages of four shelves list: those of open licences and one maker that
    are large enough and that no supplier's note names, numbered."""
    k = F.col("p_partkey")
    image = F.concat(F.lit("img"), F.lpad(k.cast("string"), 7, "0"))
    url = F.when(k % 11 > 0, F.concat(F.lit("https://pictures.example/iiif/"), image, F.lit("/info.json")))
    licence = F.element_at(F.array(F.lit("cc0"), F.lit("pdm"), F.lit("in-copyright")), (k % 3 + 1).cast("int"))
    item = F.struct(F.array(F.struct(url.alias("url"), F.struct(licence.alias("id")).alias("license"))).alias("locations"), F.struct(F.concat(F.lit("w"), k.cast("string")).alias("id"), F.when(k % 5 > 1, F.concat("p_name", F.lit(" by ACME"))).otherwise(F.col("p_name")).alias("title")).alias("source"))
    path = _chains(spark, table(spark, sf, "part"), k % 4, "p_partkey", SHELF_ROWS, item, "shelf", "catalogue")
    infos = table(spark, sf, "part").filter(k % 7 > 0).select(image.alias("image_id"), (F.col("p_size") * 40).alias("width"), (F.col("p_size") * 30 + 200).alias("height"))
    known = table(spark, sf, "supplier").select(F.concat(F.lit("seen: "), F.lit("img"), F.lpad((F.col("s_suppkey") * 2).cast("string"), 7, "0"), F.lit(", "), F.col("s_name")).alias("note"))
    shelf, number = _page_place("page")
    items = paged.read_pages(spark, path).select(shelf.alias("shelf"), number.alias("number"), "place", "item")
    return C.catalogue_records(items, [F.col("shelf"), F.col("number"), F.col("place")], infos, known, "note", LICENCES, "acme", first_index=3, least_side=400)


def flat_listing(spark, sf):
    """Pictures of one folder in order: what lies deeper, is hidden or begins with a line is none."""
    path = shared_path(spark, "flat")
    regions = table(spark, sf, "region").select("r_regionkey", "r_name")
    regions.repartitionByRange(5, "r_regionkey").write.option("maxRecordsPerFile", 1).json(path)
    regions.write.mode("append").partitionBy("r_regionkey").json(f"{path}/deeper")
    listed = R.flat_files(spark, path, [".json"])
    return listed.select("place", F.from_json(F.col("content").cast("string"), "r_name string").alias("x")).select("place", "x.r_name").groupBy((F.col("place") >= 0).alias("placed")).agg(F.count_distinct("place").alias("n"), F.max("place").alias("last"), F.count_distinct("r_name").alias("names"))


def moved_manifest(spark, sf):
    """Pictures of parts: some where the manifest says, some beside it, some nowhere."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("img"), k.cast("string"), F.lit(".png"))
    rows = table(spark, sf, "part").select(k, F.concat(F.lit("data/"), (k % 5).cast("string"), F.lit("/"), name).alias("image"))
    files = rows.filter("p_partkey % 3 = 0").select(F.col("image").alias("path")).unionByName(table(spark, sf, "part").filter("p_partkey % 4 = 1").select(F.concat(F.lit("file:/moved/"), name).alias("path")))
    return R.with_found_paths(rows, files, "image", "/moved/")


def sidecar_scan(spark, sf):
    """One object a file; the broken one has nulls."""
    path = shared_path(spark, "sidecars")
    text = F.when(F.col("n_nationkey") == 7, "{broken").otherwise(F.to_json(F.struct("n_nationkey", "n_name")))
    table(spark, sf, "nation").select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    found = R.scan_files(spark, path)
    files = R.split_by_suffix(found, [".txt"])[0]
    return R.with_sidecars(files.select("path"), R.read_sidecars(spark, path, "n_nationkey int, n_name string", "*.txt"), "path").select("n_nationkey", "n_name")


def file_scan(spark, sf):
    """Files of a folder tree by suffix, and what is of no allowed one."""
    path = shared_path(spark, "tree")
    regions = table(spark, sf, "region").select("r_regionkey", "r_name")
    regions.coalesce(1).write.partitionBy("r_regionkey").json(f"{path}/a")
    regions.coalesce(1).write.csv(f"{path}/b")
    good, bad = R.split_by_suffix(R.scan_files(spark, path).filter("NOT startswith(name, '_')"), [".json"])
    return good.select("suffix").unionByName(bad.select(F.col("message").alias("suffix"))).groupBy("suffix").agg(F.count("*").alias("n"))


def missing_only(spark, sf):
    """Parts whose file is not there yet."""
    path = shared_path(spark, "there")
    table(spark, sf, "region").select("r_name", (F.col("r_regionkey") * 3).alias("k")).coalesce(1).write.partitionBy("k").json(path)
    there = R.scan_files(spark, path).filter("suffix = '.json'").select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("long").alias("name"))
    return R.missing_only(table(spark, sf, "part").select("p_partkey"), there, "p_partkey")


def history_scan(spark, sf):
    path = shared_path(spark, "history")
    table(spark, sf, "events").select(F.col("event_id").cast("int").alias("step"), "value", F.when(F.col("event_id") % 7 > 0, F.lit(0.5)).alias("lr")).write.option("header", True).csv(path)
    return R.read_history(spark, path).groupBy("lr").agg(F.count("*").alias("n"), F.max("step").alias("last"))


def suite_scan(spark, sf):
    """Prompt suites of benchmark items, a file for each of three: ids default to places."""
    path = shared_path(spark, "suites")
    key = F.col("item_id")
    entry = F.struct(F.when(key % 4 == 0, F.concat(F.lit("own"), key.cast("string"))).alias("id"), F.md5("text").alias("prompt"), F.when(key % 5 > 0, 512).alias("width"), F.lit(640).alias("height"), F.when(key % 3 == 0, "blurry").alias("negative_prompt"))
    suites = table(spark, sf, "benchmark").groupBy((key % 3).alias("suite")).agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), entry.alias("e")))).alias("all"))
    suites.select("suite", F.to_json(F.transform("all", lambda x: x["e"])).alias("value")).repartition("suite").write.partitionBy("suite").text(path)
    found = R.read_suites(spark, path)
    return found.select(F.regexp_extract("file", r"suite=(\d+)/", 1).cast("long").alias("suite"), "id", "prompt", "width", "height", "negative_prompt")


PAGE_ROWS = 40


def paged_scan(spark, sf):
    """Customers of each nation in pages of forty, some of which fail at first, by a source that follows their marks."""
    item = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    path = _chains(spark, table(spark, sf, "customer"), F.col("c_nationkey"), "c_custkey", PAGE_ROWS, item, "nation", "pages", faulty="_p % 3 = 1")
    nation, page = _page_place("page")
    items = paged.read_pages(spark, path, starts="nation")
    return items.select(nation.alias("nation"), page.alias("page"), "place", F.from_json("item", "id long, name string").alias("x")).select("nation", "page", "place", "x.id", "x.name")


def sorted_rewrite(spark, sf):
    """The second rewrite replaces the first; the first file's rows are the least."""
    path = shared_path(spark, "rewrite")
    parts = table(spark, sf, "part").select("p_name", "p_size", "p_partkey", "p_brand")
    for rows in (parts, parts.filter("p_size > 5")):
        W.rewrite_jsonl(rows, path, "p_partkey", ["p_partkey", "p_name"])
    lines = spark.read.text(path)
    return lines.select(F.regexp_extract("value", r'^\{"p_partkey":(\d+),"p_name":"[^"]*","p_brand"', 1).cast("long").alias("p_partkey"))


def append_rows(spark, sf):
    path = shared_path(spark, "append")
    nations = table(spark, sf, "nation")
    for rows in (nations, nations.filter("n_regionkey = 1")):
        W.append_jsonl(rows, path)
    return R.read_jsonl_lax(spark, path, "n_nationkey int, n_name string, n_regionkey int").groupBy("n_nationkey").agg(F.count("*").alias("n"))


def report_parts(spark, sf):
    path = shared_path(spark, "report")
    parts = table(spark, sf, "part")
    W.write_report({"sizes": parts.groupBy("p_size").agg(F.count("*").alias("n")), "all": parts.agg(F.count("*").alias("n"))}, path)
    read = spark.read.text(path).select(F.from_json("value", "part string, row struct<p_size:int,n:long>").alias("x"))
    return read.select("x.part", "x.row.p_size", "x.row.n")


def tagged_csv(spark, sf):
    path = shared_path(spark, "tagged")
    run = table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).alias("s_name"))
    W.write_tagged_csv({"run": run, "baseline": run.select("s_suppkey")}, path)
    read = spark.read.option("header", True).schema("set string, s_suppkey long, s_name string").csv(path)
    return read.select("set", "s_suppkey", F.nullif("s_name", F.lit("")).alias("s_name"))


def written_once(spark, sf):
    """What was written first stays."""
    path = shared_path(spark, "once")
    regions = table(spark, sf, "region").select("r_regionkey", "r_name")
    for rows in (regions, regions.filter("r_regionkey = 0")):
        W.write_once(rows, path)
    return spark.read.option("header", True).schema("r_regionkey int, r_name string").csv(path)


def dual_sink(spark, sf):
    """Rows in and outside of the hold-out; what earlier runs left goes."""
    path = shared_path(spark, "dual")
    parts, held = table(spark, sf, "part").select("p_partkey", "p_name"), table(spark, sf, "benchmark").select((F.col("item_id") * 3).alias("p_partkey"))
    for rows in (parts, parts.filter("p_partkey % 2 = 0")):
        W.write_manifest(rows, held, "p_partkey", f"{path}/train", f"{path}/held")
    sides = [spark.read.schema(PART).json(f"{path}/{name}").withColumn("side", F.lit(name)) for name in ("train", "held")]
    return sides[0].unionByName(sides[1])


def hex_hashes(spark, sf):
    """Gradient hashes of 8 x 9 gray pictures as hex; a picture of another shape has none."""
    wide = F.when(F.col("p_partkey") % 5 > 0, 9).otherwise(8)
    cell = lambda r, c: ((F.col("p_partkey") * 7 + r * 31 + c * 17) * (c + r + 3) % 251).cast("double")
    gray = F.array(*[F.slice(F.array(*[cell(r, c) for c in range(9)]), 1, wide) for r in range(8)])
    return table(spark, sf, "part").select("p_partkey", P.hex_hash(gray, 8).alias("hash"))


QUERIES = {f.__name__: f for f in (jsonl_strict, jsonl_issues, jsonl_lax, manifest_scan, moved_manifest, catalogue_scan, flat_listing, sidecar_scan, file_scan, missing_only, history_scan, suite_scan, paged_scan, sorted_rewrite, append_rows, report_parts, tagged_csv, written_once, dual_sink, hex_hashes)}
_CELL = lambda r, c: f"((p_partkey * 7 + {r * 31 + c * 17}) * {c + r + 3} % 251)"
_NIBBLE = lambda r, c: "printf('%x', " + " + ".join(f"CASE WHEN {_CELL(r, c + k + 1)} > {_CELL(r, c + k)} THEN {8 >> k} ELSE 0 END" for k in range(4)) + ")"
ORACLE_SQL = {
    "jsonl_strict": "SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey)::INT AS line_no FROM part WHERE p_partkey % 4 NOT IN (SELECT p_partkey % 4 FROM part WHERE p_partkey % 1000 = 4)",
    "jsonl_issues": "SELECT 'error' AS severity, 'invalid_metadata' AS category, 'line ' || rn AS message FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey) AS rn FROM part) WHERE p_partkey % 1000 = 4",
    "jsonl_lax": "SELECT p_partkey, p_name FROM part",
    "manifest_scan": "SELECT p_partkey, p_name FROM part",
    "catalogue_scan": """WITH p AS (SELECT p_partkey AS k, 'img' || lpad(p_partkey::VARCHAR, 7, '0') AS image_id, p_name || ' by ACME' AS title, CASE p_partkey % 3 WHEN 0 THEN 'CC0 1.0' ELSE 'Public Domain Mark' END AS licence, p_size * 40 AS width, p_size * 30 + 200 AS height
        FROM part WHERE p_partkey % 11 > 0 AND p_partkey % 3 < 2 AND p_partkey % 5 > 1 AND p_partkey % 7 > 0 AND least(p_size * 40, p_size * 30 + 200) >= 400 AND p_partkey NOT IN (SELECT s_suppkey * 2 FROM supplier))
        SELECT CASE WHEN n > 9999 THEN n::VARCHAR ELSE lpad(n::VARCHAR, 4, '0') END || '.jpg' AS image, title, licence, 'w' || k AS work, image_id, 'https://pictures.example/iiif/' || image_id || '/info.json' AS url, width, height FROM (SELECT *, row_number() OVER (ORDER BY k % 4, k) + 2 AS n FROM p)""",
    "flat_listing": "SELECT TRUE AS placed, count(*) AS n, count(*) - 1 AS last, count(DISTINCT r_name) AS names FROM region",
    "moved_manifest": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 4 = 1 THEN '/moved/img' || p_partkey || '.png' ELSE 'data/' || p_partkey % 5 || '/img' || p_partkey || '.png' END AS image FROM part",
    "sidecar_scan": "SELECT nullif(n_nationkey, 7) AS n_nationkey, CASE WHEN n_nationkey <> 7 THEN n_name END AS n_name FROM nation",
    "file_scan": "SELECT '.json' AS suffix, count(*) AS n FROM region UNION ALL SELECT '.csv', 1",
    "missing_only": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT r_regionkey * 3 FROM region)",
    "history_scan": "SELECT CASE WHEN event_id % 7 > 0 THEN 0.5::DOUBLE END AS lr, count(*) AS n, max(event_id)::INT AS last FROM events GROUP BY 1",
    "suite_scan": "SELECT item_id % 3 AS suite, CASE WHEN item_id % 4 = 0 THEN 'own' || item_id ELSE printf('prompt%02d', row_number() OVER (PARTITION BY item_id % 3 ORDER BY item_id) - 1) END AS id, md5(text) AS prompt, CASE WHEN item_id % 5 > 0 THEN 512 END AS width, 640 AS height, CASE WHEN item_id % 3 = 0 THEN 'blurry' END AS negative_prompt FROM benchmark",
    "paged_scan": f"SELECT c_nationkey AS nation, (n // {PAGE_ROWS})::INT AS page, (n % {PAGE_ROWS})::INT AS place, c_custkey AS id, c_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n FROM customer)",
    "sorted_rewrite": "SELECT p_partkey FROM part WHERE p_size > 5",
    "append_rows": "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END::BIGINT AS n FROM nation",
    "report_parts": "SELECT 'sizes' AS part, p_size, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*) FROM part",
    "tagged_csv": "SELECT 'run' AS set, s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS s_name FROM supplier UNION ALL SELECT 'baseline', s_suppkey, NULL FROM supplier",
    "written_once": "SELECT r_regionkey, r_name FROM region",
    "dual_sink": "SELECT p_partkey, p_name, CASE WHEN p_partkey IN (SELECT item_id * 3 FROM benchmark) THEN 'held' ELSE 'train' END AS side FROM part WHERE p_partkey % 2 = 0",
    "hex_hashes": "SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN " + " || ".join(_NIBBLE(r, c) for r in range(8) for c in (0, 4)) + " END AS hash FROM part",
}
