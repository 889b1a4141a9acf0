"""Look-ups, resolution chains, hold-outs, resumes, lexicons and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import texts as T
from gleanery.operators import groups, joins
from gleanery.session import table

LEXICON = (("moron", "moron"), ("fool", "idiot"), ("fool", "clown"), ("waste", "trash"), ("waste", "scum"), ("the place", "the"), ("what is", "how much is"), ("what is", "of the"), ("end", "in the end"))
PLACES = (("onthe", "a narrow place", 1), ("the", "a place", 4), ("in", "an inner place", 3), ("in the", "a known inner place", 2))


def _lexicon(spark):
    return spark.createDataFrame(LEXICON, "name string, alias string")


def last_row_wins(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return joins.last_row_wins(events, ["user_id"], "event_id")


def missing_files(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


def caption_resolution(spark, sf):
    """First text of: metadata caption, side text, generated text (only of the trusted source)."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    turns = table(spark, sf, "conversations").filter("turn = 0").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("side"), "role")
    meta = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("caption"))
    made = bench.select(F.col("item_id").alias("doc_id"), F.col("text").alias("made"))
    joined = meta.join(turns, "doc_id", "left").join(made, "doc_id", "left")
    text = joins.first_text(F.col("caption"), F.when(F.col("role") == "user", F.col("side")), F.col("made"))
    return joined.select("doc_id", F.md5(text).alias("resolved"))


def holdout_split(spark, sf):
    docs, bench = table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "benchmark").select((F.col("item_id") * 3).alias("doc_id"))
    train, held = joins.split_by_keys(docs, bench, "doc_id")
    return train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("holdout"))).groupBy("part").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def unprepared_holdout(spark, sf):
    wanted = table(spark, sf, "benchmark").select((F.col("item_id") * 30).alias("doc_id"))
    return wanted.exceptAll(table(spark, sf, "documents").select("doc_id"))


def known_anti(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


def substring_anti(spark, sf):
    """Nations whose name is in no customer segment or region name."""
    nations = table(spark, sf, "nation").withColumn("needle", F.substring(F.lower("n_name"), 1, 3))
    hay = table(spark, sf, "region").select(F.lower("r_name").alias("hay"))
    return joins.not_contained(nations, F.col("needle"), hay, "hay").select("n_nationkey")


def lookup_failures(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return joins.lookup_counts(docs.select("doc_id"), labels, ["doc_id"], "labels")


def _runs(spark, sf):
    events = table(spark, sf, "events")
    scored = events.select(F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("p"), F.col("user_id").cast("string"))).alias("prompt_id"), (F.col("event_id") % 3).alias("seed"), "event_id", "value", F.col("event_id") % 2 == 0)
    scored = scored.toDF("prompt_id", "seed", "event_id", "value", "is_run")
    run = scored.filter("is_run").groupBy("prompt_id", "seed").agg(F.max("value").alias("value"))
    return run, scored.filter("NOT is_run").select("prompt_id", "seed", "event_id", "value")


def paired_ab_nullsafe(spark, sf):
    run, base = _runs(spark, sf)
    return joins.paired(run, base, ["prompt_id", "seed"], "event_id")


def grid_crossjoin(spark, sf):
    prompts = table(spark, sf, "region").select("r_regionkey")
    return prompts.crossJoin(spark.range(3).toDF("seed")).select("r_regionkey", "seed", F.format_string("prompt%02d", F.col("r_regionkey")).alias("prompt"))


def resume_anti(spark, sf):
    todo = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 4).alias("seed")).distinct()
    done = table(spark, sf, "lineitem").select((F.col("l_suppkey") * 3).alias("id"), F.when(F.col("l_linenumber") < 4, F.col("l_linenumber").cast("long")).alias("seed"))
    return joins.resume(todo, done, ["id", "seed"]).groupBy("seed").agg(F.count("*").alias("n"))


def lexicon_match(spark, sf):
    hits = joins.lexicon_hits(table(spark, sf, "documents"), "doc_id", "text", _lexicon(spark))
    return joins.names_in_order(hits, "doc_id")


def first_place(spark, sf):
    """The description of the first place, by priority, that a text names."""
    places = spark.createDataFrame(PLACES, "name string, place string, priority int")
    hits = joins.lexicon_hits(table(spark, sf, "benchmark"), "item_id", "text", places.select("name", F.col("name").alias("alias")))
    return joins.first_by_priority(hits, "item_id", places, "place")


def tagged_union(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    both = a.withColumn("set", F.lit("run")).unionByName(b.withColumn("set", F.lit("baseline")))
    return both.groupBy("set").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("total"))


def overlap_sets(spark, sf):
    lists = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.substring("o_orderpriority", 1, 1)).alias("seen"))
    return lists.select("o_custkey", F.arrays_overlap("seen", F.array(F.lit("1"), F.lit("2"))).alias("urgent"))


def ordered_distinct(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return turns.select("conv_id", F.array_join(F.array_distinct(F.transform("r", lambda x: x["role"])), ",").alias("roles"))


def bfs_levels(spark, sf):
    """Levels of the graph that leads a customer key to two others, where they exist."""
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("parent"))
    edges = base.select("parent", F.explode(F.array(F.col("parent") * 2, F.col("parent") * 3)).alias("child")).join(base.select(F.col("parent").alias("child")), "child", "left_semi")
    return joins.levels_from(edges, 1, settle=groups.settle)


QUERIES = {f.__name__: f for f in (last_row_wins, missing_files, caption_resolution, holdout_split, unprepared_holdout, known_anti, substring_anti, lookup_failures, paired_ab_nullsafe, grid_crossjoin, resume_anti, lexicon_match, first_place, tagged_union, overlap_sets, ordered_distinct, bfs_levels)}
_BEFORE = "'(?is)^((?:.*?[^\\p{L}\\p{N}_])??)' || alias || '(?:[^\\p{L}\\p{N}_]|$)'"
_LEX = ", ".join(f"('{n}', '{a}')" for n, a in LEXICON)
ORACLE_SQL = {
    "last_row_wins": "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, count(*) AS n_rows FROM events GROUP BY 1",
    "missing_files": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "caption_resolution": "SELECT d.doc_id, md5(coalesce(nullif(trim(CASE WHEN d.doc_id % 3 = 0 THEN d.text END, ' '), ''), nullif(trim(CASE WHEN c.role = 'user' THEN c.text END, ' '), ''), nullif(trim(b.text, ' '), ''))) AS resolved FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id AND c.turn = 0 LEFT JOIN benchmark b ON b.item_id = d.doc_id",
    "holdout_split": "SELECT CASE WHEN doc_id IN (SELECT item_id * 3 FROM benchmark) THEN 'holdout' ELSE 'train' END AS part, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1",
    "unprepared_holdout": "SELECT item_id * 30 AS doc_id FROM benchmark EXCEPT ALL SELECT doc_id FROM documents",
    "known_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "substring_anti": "SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE contains(lower(r_name), substr(lower(n_name), 1, 3)))",
    "lookup_failures": "SELECT count(l.doc_id) AS found, count(*) - count(l.doc_id) AS missed, 'labels' AS lookup FROM documents d LEFT JOIN labels l USING (doc_id)",
    "paired_ab_nullsafe": """WITH s AS (SELECT CASE WHEN user_id % 5 > 0 THEN 'p' || user_id END AS prompt_id, event_id % 3 AS seed, event_id, value FROM events),
        r AS (SELECT prompt_id, seed, max(value) AS value FROM s WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT prompt_id, seed, max_by(value, event_id) AS base_value FROM s WHERE event_id % 2 <> 0 GROUP BY 1, 2)
        SELECT r.*, base_value FROM r JOIN b ON r.prompt_id IS NOT DISTINCT FROM b.prompt_id AND r.seed IS NOT DISTINCT FROM b.seed""",
    "grid_crossjoin": "SELECT r_regionkey, seed, printf('prompt%02d', r_regionkey) AS prompt FROM region, range(3) t(seed)",
    "resume_anti": "SELECT seed, count(*) AS n FROM (SELECT DISTINCT o_custkey AS id, o_orderkey % 4 AS seed FROM orders) t WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey * 3 = t.id AND l_linenumber < 4 AND l_linenumber = t.seed) GROUP BY 1",
    "lexicon_match": f"""WITH h AS (SELECT doc_id, name, min(length(regexp_extract(text, {_BEFORE}, 1))) AS first_at FROM documents JOIN (VALUES {_LEX}) l(name, alias) ON regexp_matches(text, {_BEFORE}) GROUP BY 1, 2)
        SELECT doc_id, string_agg(name, ', ' ORDER BY first_at, name) AS names, count(*) AS n_names FROM h GROUP BY 1""",
    "first_place": f"SELECT item_id, min_by(description, priority) AS place FROM benchmark JOIN (VALUES {', '.join(str(p) for p in PLACES)}) l(alias, description, priority) ON regexp_matches(text, {_BEFORE}) GROUP BY 1",
    "tagged_union": "SELECT 'run' AS set, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer UNION ALL SELECT 'baseline', count(*), round(sum(s_acctbal), 2) FROM supplier",
    "overlap_sets": "SELECT o_custkey, bool_or(substr(o_orderpriority, 1, 1) IN ('1', '2')) AS urgent FROM orders GROUP BY 1",
    "ordered_distinct": "SELECT conv_id, string_agg(role, ',' ORDER BY f) AS roles FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2) GROUP BY 1",
    "bfs_levels": """WITH RECURSIVE e AS (SELECT c_custkey AS p, unnest([c_custkey * 2, c_custkey * 3]) AS c FROM customer), g(node, level) AS (SELECT 1::BIGINT, 0 UNION SELECT c, level + 1 FROM g JOIN e ON p = node WHERE c IN (SELECT c_custkey FROM customer))
        SELECT node, min(level) AS level FROM g GROUP BY 1""",
}
