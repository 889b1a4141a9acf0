"""Similarities of vectors and paired comparison of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import similarity as S
from gleanery.session import table

WIDTH = 64


def _sides(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return vectors.filter("vec_id % 5 <> 0"), vectors.filter("vec_id % 5 = 0")


def _scored(spark, sf, median=False):
    run, references = _sides(spark, sf)
    return S.scored_against(run, references, "vec_id", "vec_id", "embedding", median=median)


def topk_mean_sim(spark, sf):
    return _scored(spark, sf).select("vec_id", F.round("sim_top", 4).alias("top3"))


def nearest_ref(spark, sf):
    return _scored(spark, sf).select("vec_id", "nearest", F.round("sim_max", 4).alias("similarity"))


def sim_mean_median(spark, sf):
    return _scored(spark, sf, median=True).select("vec_id", F.round("sim_mean", 4).alias("mean"), F.round("sim_median", 4).alias("median"), F.round("sim_max", 4).alias("max"))


def leak_flag(spark, sf):
    """Flagged where the rounded similarity to the nearest is over the bound, which null never is."""
    return _scored(spark, sf).select("vec_id", (F.coalesce(F.round("sim_max", 4), F.lit(0.0)) > 0.5).alias("leaks"))


def exclude_self_sim(spark, sf):
    """Mean similarity to all other vectors of the label: (v . sum - v . v) / (n - 1), without making pairs."""
    vectors = table(spark, sf, "embeddings")
    sums = vectors.groupBy("label").agg(F.count("*").alias("n"), *[F.sum(F.get("embedding", F.lit(i)).cast("double")).alias(f"s{i}") for i in range(WIDTH)])
    whole = sums.select("label", "n", F.array(*[f"s{i}" for i in range(WIDTH)]).alias("total"))
    joined = vectors.join(whole, "label")
    own = S.dot(F.col("embedding"), F.col("embedding"))
    value = (S.dot(F.col("embedding"), F.col("total")) - own) / (F.col("n") - 1)
    return joined.select("vec_id", F.round(F.when(F.col("n") > 1, value), 4).alias("similarity"))


def group_diversity(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("embedding", F.when(~((F.col("label") == 3) & (F.col("vec_id") < 40)), F.col("embedding")))
    return S.diversity(rows, "label", "embedding", WIDTH).select("label", "n", F.round("diversity", 4).alias("diversity"))


def _images(spark, sf):
    events = table(spark, sf, "events")
    prompt = F.coalesce(F.nullif(F.when(F.col("user_id") % 9 > 0, F.concat(F.lit("p"), (F.col("user_id") % 12).cast("string"))), F.lit("")), F.concat(F.lit("e"), (F.col("event_id") % 4).cast("string")))
    return events.select(prompt.alias("prompt_id"), (F.col("event_id") % 4).alias("seed"), "event_id", F.round("value", 4).alias("style"), F.when(F.col("event_id") % 6 > 0, F.round(F.col("value") / 3, 4)).alias("adherence"), (F.col("event_id") % 2 == 0).alias("is_run"))


def per_prompt_rollup(spark, sf):
    return _images(spark, sf).groupBy("prompt_id").agg(F.count("*").alias("n"), S.exact_mean(F.col("style")).alias("style"), S.exact_mean(F.col("adherence")).alias("adherence"), F.max("style").alias("best"))


def two_level_summary(spark, sf):
    """Means of values rounded per image, and the mean of means rounded per prompt."""
    images = _images(spark, sf)
    flat = images.agg(S.exact_mean(F.col("style")).alias("style"), S.exact_mean(F.col("adherence")).alias("adherence"), F.count("*").alias("n"))
    prompts = per_prompt_rollup(spark, sf).agg(S.exact_mean(F.col("style")).alias("style_by_prompt"))
    return flat.join(F.broadcast(prompts))


def paired_delta_stats(spark, sf):
    images = _images(spark, sf).groupBy("prompt_id", "seed", "is_run").agg(F.max_by("style", "event_id").alias("style"), F.max_by("adherence", "event_id").alias("adherence"))
    run = images.filter("is_run").drop("is_run")
    base = images.filter("NOT is_run").select("prompt_id", (F.col("seed") - 1).alias("seed"), F.col("style").alias("base_style"), F.col("adherence").alias("base_adherence"))
    return S.delta_stats(run.join(base, ["prompt_id", "seed"]), ["style", "adherence"])


def variant_means(spark, sf):
    rows = _images(spark, sf).withColumn("variant", F.concat(F.lit("v"), F.col("seed").cast("string")))
    return rows.groupBy("is_run").pivot("variant", ["v0", "v1", "v2", "v3"]).agg(S.exact_mean(F.col("adherence"), 3))


QUERIES = {f.__name__: f for f in (topk_mean_sim, nearest_ref, sim_mean_median, leak_flag, exclude_self_sim, group_diversity, per_prompt_rollup, two_level_summary, paired_delta_stats, variant_means)}
_SIMS = """WITH s AS (SELECT a.vec_id, b.vec_id AS ref, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 5 <> 0 AND b.vec_id % 5 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, ref) AS rn FROM s) """
_IMAGES = """images AS (SELECT coalesce(nullif(CASE WHEN user_id % 9 > 0 THEN 'p' || (user_id % 12) END, ''), 'e' || (event_id % 4)) AS prompt_id, event_id % 4 AS seed, event_id, round(value, 4) AS style,
CASE WHEN event_id % 6 > 0 THEN round(value / 3, 4) END AS adherence, event_id % 2 = 0 AS is_run FROM events)"""
_MEAN = lambda x, digits=4: f"floor((2 * sum(round({x} * 10000)::BIGINT) + {10 ** (4 - digits)} * count({x})) / (2.0::DOUBLE * {10 ** (4 - digits)} * count({x}))) / {10**digits}"
_ROLLUP = f"SELECT prompt_id, count(*) AS n, {_MEAN('style')} AS style, {_MEAN('adherence')} AS adherence, max(style) AS best FROM images GROUP BY 1"
ORACLE_SQL = {
    "topk_mean_sim": _SIMS + "SELECT vec_id, round(avg(s), 4) AS top3 FROM r WHERE rn <= 3 GROUP BY 1",
    "nearest_ref": _SIMS + "SELECT vec_id, ref AS nearest, round(s, 4) AS similarity FROM r WHERE rn = 1",
    "sim_mean_median": _SIMS + "SELECT vec_id, round(avg(s), 4) AS mean, round(median(s), 4) AS median, round(max(s), 4) AS max FROM r GROUP BY 1",
    "leak_flag": _SIMS + "SELECT vec_id, coalesce(round(s, 4), 0) > 0.5 AS leaks FROM r WHERE rn = 1",
    "exclude_self_sim": "SELECT a.vec_id, round(avg(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 4) AS similarity FROM embeddings a LEFT JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1",
    "group_diversity": """WITH v AS (SELECT vec_id, label, CASE WHEN NOT (label = 3 AND vec_id < 40) THEN embedding::DOUBLE[] END AS e FROM embeddings), n AS (SELECT label, count(*) AS n, count(e) AS held FROM v GROUP BY 1),
        p AS (SELECT a.label, round(avg(1 - list_dot_product(a.e, b.e)), 4) AS d FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1) SELECT label, n, CASE WHEN n > 1 AND n = held THEN d END AS diversity FROM n LEFT JOIN p USING (label)""",
    "per_prompt_rollup": f"WITH {_IMAGES} {_ROLLUP}",
    "two_level_summary": f"WITH {_IMAGES}, p AS ({_ROLLUP}) SELECT {_MEAN('style')} AS style, {_MEAN('adherence')} AS adherence, count(*) AS n, (SELECT {_MEAN('style')} FROM p) AS style_by_prompt FROM images",
    "paired_delta_stats": f"""WITH {_IMAGES}, g AS (SELECT prompt_id, seed, is_run, max_by(style, event_id) AS style, arg_max_null(adherence, event_id) AS adherence FROM images GROUP BY ALL),
        p AS (SELECT r.style, r.adherence, b.style AS base_style, b.adherence AS base_adherence FROM g r JOIN g b ON r.is_run AND NOT b.is_run AND r.prompt_id = b.prompt_id AND r.seed = b.seed - 1),
        s AS (SELECT 'style' AS metric, style AS x, base_style AS y FROM p UNION ALL SELECT 'adherence', adherence, base_adherence FROM p)
        SELECT metric, {_MEAN('x')} AS run_mean, {_MEAN('y')} AS base_mean, {_MEAN('(x - y)')} AS mean_delta, count(*) FILTER (WHERE x - y > 0) || '/' || count(x - y) || ' pairs' AS higher_in FROM s GROUP BY 1""",
    "variant_means": f"WITH {_IMAGES} SELECT is_run, " + ", ".join(f"{_MEAN(f'(CASE WHEN seed = {k} THEN adherence END)', 3)} AS v{k}" for k in range(4)) + " FROM images GROUP BY 1",
}
