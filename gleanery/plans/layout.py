"""Buckets, batches, step histories, retention and allocation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.functions import geometry as G
from gleanery.operators import history as H
from gleanery.session import table


def aspect_buckets(spark, sf):
    """Buckets of a configuration for each region."""
    key = F.col("r_regionkey")
    configs = table(spark, sf, "region").select(key, (384 + key * 64).cast("int").alias("base"), F.when(key % 2 == 0, 64).otherwise(32).alias("step"), (1.5 + key * 0.25).alias("most_ratio"))
    return G.aspect_buckets_of(configs).select("r_regionkey", "w", "h")


def _sizes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 17 + 300).cast("long").alias("w"), (F.col("p_partkey") % 600 + 400).alias("h"))


def nearest_bucket(spark, sf):
    return G.nearest_bucket(_sizes(spark, sf), G.aspect_buckets(spark), "p_partkey").select("p_partkey", "bucket_w", "bucket_h")


def resize_geometry(spark, sf):
    sized = G.nearest_bucket(_sizes(spark, sf), G.aspect_buckets(spark), "p_partkey")
    made = G.cover_scale(F.col("w"), F.col("h"), F.col("bucket_w"), F.col("bucket_h"))
    return sized.select("p_partkey", *[c.alias(k) for k, c in made.items()])


def photo_sizing(spark, sf):
    w, h = G.photo_size(F.col("w"), F.col("h"))
    return _sizes(spark, sf).select("p_partkey", w.alias("w"), h.alias("h"))


def size_histogram(spark, sf):
    sized = G.nearest_bucket(_sizes(spark, sf), G.aspect_buckets(spark), "p_partkey")
    return sized.groupBy(F.concat("bucket_w", F.lit("x"), "bucket_h").alias("size")).agg(F.count("*").alias("n"))


def fixed_batches(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_size")
    return H.fixed_batches(rows, "p_size", [F.asc("p_partkey")], 7)


def fixed_batches_dropped(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_size")
    return H.fixed_batches(rows, "p_size", [F.asc("p_partkey")], 7, drop_last=True).groupBy("p_size").agg(F.count_distinct("batch").alias("batches"), F.count("*").alias("n"))


def seeded_shuffle(spark, sf):
    """A permutation of all parts, the same at every run."""
    return H.shuffled(table(spark, sf, "part").select("p_partkey"), "p_partkey", 42, 1).select("p_partkey", "position")


def shuffled_batches(spark, sf):
    """Batches of seven parts of one size, shuffled within sizes and among each other."""
    return H.shuffled_batches(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", "p_partkey", 7, 42, 1)


def shuffled_batches_dropped(spark, sf):
    """The same without batches that are not full, and how many rows each place has."""
    made = H.shuffled_batches(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", "p_partkey", 7, 42, 2, drop_last=True)
    return made.groupBy("place").agg(F.count("*").alias("n"), F.min("p_size").alias("p_size"), F.sum("p_partkey").alias("total"))


def _steps(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 997).alias("step"), "value")


def moving_avg_range(spark, sf):
    return H.trailing_exact_mean(_steps(spark, sf), "step", "value", 50, "mean", ["user_id"]).select("event_id", "mean")


def recent_rows_mean(spark, sf):
    return H.recent_rows_mean(_steps(spark, sf), "event_id", "value", 5, "mean", ["user_id"]).select("event_id", F.round("mean", 4).alias("mean"))


def rewind_log(spark, sf):
    return H.rewound(_steps(spark, sf), "event_id", "step", ["user_id"]).select("user_id", "event_id", "step")


def retain_last_n(spark, sf):
    return H.retained(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 2)


def latest_resolve(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("final"), (F.col("o_totalprice") > 50000).alias("usable"))
    return H.latest(rows, ["o_custkey"], "o_orderkey", "final", "o_orderkey", "usable")


def next_id(spark, sf):
    names = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.format_string("%06d", "p_partkey")).otherwise(F.col("p_name")).alias("stem"))
    return H.next_id(names, "stem")


def newest_n(spark, sf):
    rows = table(spark, sf, "orders").filter("o_orderpriority <> '1-URGENT'")
    return rows.orderBy(F.desc("o_orderdate"), F.asc("o_orderkey")).limit(12).select("o_orderkey", "o_custkey")


def limit_usable(spark, sf):
    """The first five rows that can be used."""
    return table(spark, sf, "documents").filter("lang = 'fr' AND n_chars > 300").orderBy("doc_id").limit(5).select("doc_id")


def sorted_accepted(spark, sf):
    docs = table(spark, sf, "documents").filter("lang = 'de'")
    return docs.select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("place"), "source")


def min_snr(spark, sf):
    snr = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 4.0).alias("snr"))
    return snr.select("p_partkey", F.round(G.min_snr_weight(F.col("snr")), 6).alias("plain"), F.round(G.min_snr_weight(F.col("snr"), velocity=True), 6).alias("velocity"))


def training_plan(spark, sf):
    rows = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return rows.select("lang", *[c.cast("long").alias(k) for k, c in G.training_arithmetic(F.col("n"), 2, 4, 1500).items()])


QUERIES = {f.__name__: f for f in (aspect_buckets, nearest_bucket, resize_geometry, photo_sizing, size_histogram, fixed_batches, fixed_batches_dropped, seeded_shuffle, shuffled_batches, shuffled_batches_dropped, moving_avg_range, recent_rows_mean, rewind_log, retain_last_n, latest_resolve, next_id, newest_n, limit_usable, sorted_accepted, min_snr, training_plan)}
_BUCKETS = "b AS (SELECT w AS bw, h AS bh FROM range(64, 961, 64) x(w), range(64, 961, 64) y(h) WHERE greatest(w, h) / least(w, h) <= 1.75 AND abs(w * h - 262144) <= 0.15 * 262144)"
_SIZES = "s AS (SELECT p_partkey, p_size::BIGINT * 17 + 300 AS w, p_partkey % 600 + 400 AS h FROM part)"
_NEAREST = f"{_SIZES}, {_BUCKETS}, n AS (SELECT p_partkey, w, h, min_by((bw, bh), (round(abs(ln(w / h) - ln(bw / bh)), 12), bw, bh)) AS k FROM s, b GROUP BY ALL), z AS (SELECT p_partkey, w, h, k[1]::INT AS bucket_w, k[2]::INT AS bucket_h FROM n)"
_dealt = lambda seed, full=False: f"""d AS (SELECT p_partkey, p_size, (row_number() OVER (PARTITION BY p_size ORDER BY md5(p_partkey || ':{seed}'), p_partkey) - 1) // 7 AS batch FROM part),
o AS (SELECT p_size, batch, row_number() OVER (ORDER BY md5(p_size || ':' || batch || ':{seed}'), p_size, batch) - 1 AS place FROM d GROUP BY 1, 2 HAVING {'count(*) = 7' if full else 'TRUE'})"""  # noqa: E731
_STEPS = "t AS (SELECT user_id, event_id, event_id % 997 AS step, value FROM events)"
ORACLE_SQL = {
    "aspect_buckets": """WITH c AS (SELECT r_regionkey, 384 + r_regionkey * 64 AS base, CASE WHEN r_regionkey % 2 = 0 THEN 64 ELSE 32 END AS step, 1.5::DOUBLE + r_regionkey * 0.25::DOUBLE AS ratio FROM region),
        s AS (SELECT *, unnest(range(1, 100))::INT * step AS w FROM c), t AS (SELECT *, unnest(range(1, 100))::INT * step AS h FROM s)
        SELECT r_regionkey, w::INT AS w, h::INT AS h FROM t WHERE greatest(w, h) / least(w, h) <= ratio AND abs(w * h - base * base) <= 0.15 * base * base AND w <= base * ratio + step AND h <= base * ratio + step""",
    "seeded_shuffle": "SELECT p_partkey, row_number() OVER (ORDER BY md5(p_partkey || ':43'), p_partkey) - 1 AS position FROM part",
    "shuffled_batches": f"WITH {_dealt(43)} SELECT p_partkey, p_size, batch, place FROM d JOIN o USING (p_size, batch)",
    "shuffled_batches_dropped": f"WITH {_dealt(44, full=True)} SELECT place, count(*) AS n, min(p_size) AS p_size, sum(p_partkey)::BIGINT AS total FROM d JOIN o USING (p_size, batch) GROUP BY 1",
    "nearest_bucket": f"WITH {_NEAREST} SELECT p_partkey, bucket_w, bucket_h FROM z",
    "resize_geometry": f"""WITH {_NEAREST}, c AS (SELECT *, greatest(round_even(w * greatest(bucket_w / w, bucket_h / h), 0)::BIGINT, bucket_w) AS scaled_w, greatest(round_even(h * greatest(bucket_w / w, bucket_h / h), 0)::BIGINT, bucket_h) AS scaled_h FROM z)
        SELECT p_partkey, scaled_w, scaled_h, floor((scaled_w - bucket_w) / 2)::BIGINT AS crop_left, floor((scaled_h - bucket_h) / 2)::BIGINT AS crop_top FROM c""",
    "photo_sizing": f"WITH {_SIZES}, a AS (SELECT p_partkey, greatest(0.5, least(2.0, w / h))::DOUBLE AS r FROM s) SELECT p_partkey, greatest(64, floor(sqrt(286720 * r) / 8) * 8)::INT AS w, greatest(64, floor(sqrt(286720 * r) / r / 8) * 8)::INT AS h FROM a",
    "size_histogram": f"WITH {_NEAREST} SELECT bucket_w || 'x' || bucket_h AS size, count(*) AS n FROM z GROUP BY 1",
    "fixed_batches": "SELECT p_partkey, p_size, ((row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1) // 7)::BIGINT AS batch FROM part",
    "fixed_batches_dropped": "SELECT p_size, (count(*) // 7)::BIGINT AS batches, (count(*) // 7 * 7)::BIGINT AS n FROM part GROUP BY 1 HAVING count(*) >= 7",
    "moving_avg_range": f"WITH {_STEPS}, s AS (SELECT event_id, sum(round(value * 100)::BIGINT) OVER w AS total, count(value) OVER w * 100 AS n FROM t WINDOW w AS (PARTITION BY user_id ORDER BY step RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)) SELECT event_id, floor((20000 * total + n)::DOUBLE / (2 * n)) / 10000 AS mean FROM s",
    "recent_rows_mean": f"WITH {_STEPS} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS mean FROM t",
    "rewind_log": f"WITH {_STEPS} SELECT user_id, event_id, step FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.user_id = t.user_id AND u.event_id > t.event_id AND u.step <= t.step)",
    "retain_last_n": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 2 AS kept FROM orders",
    "latest_resolve": "SELECT o_custkey, max_by(o_orderkey, (o_orderstatus = 'F', o_orderkey)) AS o_orderkey FROM orders WHERE o_totalprice > 50000 GROUP BY 1",
    "next_id": "SELECT coalesce(max(p_partkey), -1) + 1 AS next_id FROM part WHERE p_partkey % 3 = 0",
    "newest_n": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority <> '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 12",
    "limit_usable": "SELECT doc_id FROM documents WHERE lang = 'fr' AND n_chars > 300 ORDER BY doc_id LIMIT 5",
    "sorted_accepted": "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS place, source FROM documents WHERE lang = 'de'",
    "min_snr": "SELECT p_partkey, round(least(s, 5) / s, 6) AS plain, round(least(s, 5) / (s + 1), 6) AS velocity FROM (SELECT p_partkey, p_size / 4.0::DOUBLE AS s FROM part)",
    "training_plan": "SELECT lang, e AS steps_per_epoch, 8::BIGINT AS effective_batch, ceil(1500 / e)::BIGINT AS epochs FROM (SELECT lang, ceil(ceil(count(*) / 2) / 4)::BIGINT AS e FROM documents GROUP BY 1)",
}
