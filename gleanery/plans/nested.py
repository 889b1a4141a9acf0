"""Nested values: keypoints, maps, JSON payloads, hashes of pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import geometry as G
from gleanery.functions import pictures as P
from gleanery.session import table

JOINTS = 6


def _persons(spark, sf):
    """Persons of the first turns of conversations: joints from the text's length, some unseen."""
    parts = table(spark, sf, "part")
    joint = lambda k, shift: F.when((F.col("p_partkey") + k) % 4 > 0, F.struct(((F.col("p_partkey") * (k + 3) + shift) % 40 / 100).alias("x"), ((F.col("p_size") * (k + 1)) % 30 / 100).alias("y")))
    person = lambda shift: F.array(*[joint(k, shift) for k in range(JOINTS)])
    generated = F.when(F.col("p_partkey") % 7 == 0, F.array().cast("array<array<struct<x:double,y:double>>>")).otherwise(F.array(person(3), person(9)))
    reference = F.when(F.col("p_partkey") % 11 > 0, F.array(person(0), person(5)))
    return parts.select("p_partkey", reference.alias("reference"), generated.alias("generated"))


def pck_score(spark, sf):
    return _persons(spark, sf).select("p_partkey", F.round(G.best_keypoint_score(F.col("reference"), F.col("generated")), 6).alias("score"))


def map_gate(spark, sf):
    """Questions about persons drop out of an answer map where nobody is counted."""
    events = table(spark, sf, "events")
    answers = F.create_map(F.lit("pose"), F.lit("sitting"), F.lit("place"), F.col("event_type"), F.lit("dress"), F.lit("blue"))
    count = F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 3)
    kept = F.map_filter(answers, lambda k, v: ~(k.isin("pose", "dress") & F.coalesce(count == 0, F.lit(False))))
    return events.select("event_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("questions"))


def json_props(spark, sf):
    events = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return events.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def payload_flatten(spark, sf):
    """Pages of captured answers: nested objects to rows, with defaults for what is missing."""
    page = F.to_json(F.struct(F.struct(F.map_from_entries(F.array(F.struct(F.col("r_regionkey").cast("string"), F.struct(F.col("r_name").alias("title"), F.when(F.col("r_regionkey") % 2 == 0, "cc").alias("license"))))).alias("pages")).alias("query")))
    answers = table(spark, sf, "region").select(page.alias("body"))
    read = answers.select(F.from_json("body", "struct<query:struct<pages:map<string,struct<title:string,license:string>>>>").alias("a"))
    rows = read.select(F.explode("a.query.pages").alias("id", "page"))
    return rows.select("id", F.col("page.title").alias("title"), F.coalesce("page.license", F.lit("unknown")).alias("license"))


def picture_hashes(spark, sf):
    """Gradient and average bits of 4 x 5 gray pictures made from part keys."""
    gray = F.array(*[F.array(*[(F.col("p_partkey") * (7 * r + 3 * c + 1) % 251).cast("double") for c in range(5)]) for r in range(4)])
    return table(spark, sf, "part").select("p_partkey", P.gradient_hash(gray).alias("gradient"), P.average_hash(gray).alias("average"))


QUERIES = {f.__name__: f for f in (pck_score, map_gate, json_props, payload_flatten, picture_hashes)}
_CELL = lambda r, c: f"(p_partkey * {7 * r + 3 * c + 1} % 251)"
_ALL = [_CELL(r, c) for r in range(4) for c in range(5)]
_MEAN = "((" + " + ".join(_ALL) + ") / 20)"
ORACLE_SQL = {
    "pck_score": f"""WITH p AS (SELECT * FROM part), j AS (SELECT p_partkey, k, s, CASE WHEN (p_partkey + k) % 4 > 0 THEN ((p_partkey * (k + 3) + s) % 40) / 100 END AS x, ((p_size * (k + 1)) % 30) / 100 AS y FROM p, range({JOINTS}) t(k), (VALUES (0), (5), (3), (9)) v(s)),
        h AS (SELECT a.p_partkey, a.s AS r, b.s AS g, count(*) FILTER (WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.1) / count(a.x) AS share FROM j a JOIN j b ON a.p_partkey = b.p_partkey AND a.k = b.k WHERE a.s IN (0, 5) AND b.s IN (3, 9) GROUP BY ALL),
        m AS (SELECT p_partkey, avg(best) AS score FROM (SELECT p_partkey, r, max(share) AS best FROM h GROUP BY ALL) GROUP BY 1)
        SELECT p.p_partkey, CASE WHEN p.p_partkey % 11 = 0 THEN NULL WHEN p.p_partkey % 7 = 0 THEN 0.0::DOUBLE ELSE round(score, 6) END AS score FROM p JOIN m USING (p_partkey)""",
    "map_gate": "SELECT event_id, CASE WHEN event_id % 5 > 0 AND event_id % 3 = 0 THEN 'place' ELSE 'dress,place,pose' END AS questions FROM events",
    "json_props": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS most FROM (SELECT event_type, json_extract_string(props, '$.k')::INT AS k FROM events) GROUP BY 1",
    "payload_flatten": "SELECT r_regionkey::VARCHAR AS id, r_name AS title, CASE WHEN r_regionkey % 2 = 0 THEN 'cc' ELSE 'unknown' END AS license FROM region",
    "picture_hashes": "SELECT p_partkey, " + " || ".join(f"CASE WHEN {_CELL(r, c)} > {_CELL(r, c - 1)} THEN '1' ELSE '0' END" for r in range(4) for c in range(1, 5)) + " AS gradient, " + " || ".join(f"CASE WHEN {x} > {_MEAN} THEN '1' ELSE '0' END" for x in _ALL) + " AS average FROM part",
}
