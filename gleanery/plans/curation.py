"""Curation of a document corpus: reject ladder, exact copies, survivors, exclusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.operators import ladder
from gleanery.session import table

LANGS = ("en", "fr", "de")
MIN_CHARS = 40

RULES = (
    ("missing_text", "text IS NULL OR trim(text) = ''"),
    ("missing_source", "source IS NULL OR trim(source) = ''"),
    ("unsupported_language", f"lang NOT IN {LANGS}"),
    ("too_short", f"n_chars < {MIN_CHARS}"),
)

LADDER_SQL = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in RULES) + " END"


def _laddered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.reject_ladder(table(spark, sf_dir, "documents"), RULES, "reason")


def corpus_curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, verdict and kept copy of every document."""
    laddered = _laddered(spark, sf_dir)
    candidates = laddered.filter("reason IS NULL").withColumn("digest", F.sha2("text", 256))
    ranked = ladder.best_per_group(candidates, ["digest"], [F.desc("n_chars"), F.asc("doc_id")], "rank_in_copies")
    kept = F.min_by("doc_id", "rank_in_copies").over(Window.partitionBy("digest"))
    judged = ranked.select("doc_id", F.when(F.col("rank_in_copies") > 1, "duplicate").otherwise("accepted").alias("verdict"), kept.alias("kept_id"))
    rejected = laddered.filter("reason IS NOT NULL").select("doc_id", F.col("reason").alias("verdict"), F.lit(None).cast("long").alias("kept_id"))
    return judged.unionByName(rejected)


_CURATED = f"""
WITH laddered AS (SELECT *, {LADDER_SQL} AS reason FROM documents),
ranked AS (SELECT doc_id, row_number() OVER w AS rn, first_value(doc_id) OVER w AS kept_id
           FROM laddered WHERE reason IS NULL
           WINDOW w AS (PARTITION BY sha256(text) ORDER BY n_chars DESC, doc_id)),
curated AS (SELECT doc_id, CASE WHEN rn > 1 THEN 'duplicate' ELSE 'accepted' END AS verdict, kept_id FROM ranked
            UNION ALL SELECT doc_id, reason, NULL FROM laddered WHERE reason IS NOT NULL)
"""


def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.exclusion_counts(corpus_curation(spark, sf_dir).filter("verdict <> 'accepted'"), "verdict")


def exact_dup_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept row of every group of two or more equal texts."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "n_chars", F.sha2("text", 256).alias("digest"))
    groups = docs.groupBy("digest").agg(F.count("*").alias("copies"), F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id")).alias("kept_id"))
    return groups.filter("copies > 1")


QUERIES = {"corpus_curation": corpus_curation, "exclusion_counts": exclusion_counts, "exact_dup_survivors": exact_dup_survivors}
ORACLE_SQL = {
    "corpus_curation": _CURATED + "SELECT * FROM curated",
    "exclusion_counts": _CURATED + "SELECT split_part(verdict, ':', 1) AS category, count(*) AS n FROM curated WHERE verdict <> 'accepted' GROUP BY 1",
    "exact_dup_survivors": "SELECT sha256(text) AS digest, count(*) AS copies, min_by(doc_id, (-n_chars, doc_id)) AS kept_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
}
