"""Rules over documents, parts and conversations: issues, soft flags, stale entries, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import texts as T
from gleanery.operators import joins, ladder, manifests
from gleanery.session import table

#: (category, severity, test) over documents; understood alike by Spark and DuckDB.
ISSUES = (
    ("too_short", "error", "n_chars < 200"),
    ("too_long", "warning", "n_chars > 5000"),
    ("unsupported_language", "error", "lang IN ('es')"),
    ("odd_id", "warning", "doc_id % 7 = 3"),
)
LISTED = (1, 5, 9, 27, 5000000, 5000001)


def _issues(spark, sf):
    return ladder.all_issues(table(spark, sf, "documents"), "doc_id", ISSUES)


_ISSUES = " UNION ALL ".join(f"SELECT doc_id, '{severity}' AS severity, '{category}' AS category, {k} AS ord FROM documents WHERE {test}" for k, (category, severity, test) in enumerate(ISSUES))


def issue_counts(spark, sf):
    return _issues(spark, sf).groupBy("severity", "category").agg(F.count("*").alias("n"))


def severity_counts(spark, sf):
    return _issues(spark, sf).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_distinct("doc_id").alias("documents"))


def first_reason_wins(spark, sf):
    order = F.coalesce(*[F.when(F.col("category") == c, F.lit(k)) for k, (c, _, _) in enumerate(ISSUES)])
    return ladder.first_reason(_issues(spark, sf).withColumn("ord", order), "doc_id", "category", "ord")


def reject_ladder(spark, sf):
    """The first rule that a document meets, in the order of the rules."""
    judged = ladder.reject_ladder(table(spark, sf, "documents"), [(c, test) for c, _, test in ISSUES])
    return judged.select("doc_id", "reason")


def soft_flags(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.filter("n_chars > 5000").select("doc_id", F.lit("warning").alias("severity"), F.lit("large").alias("category"))


def stale_rules(spark, sf):
    """Listed ids that exist are excluded; listed ids that do not are stale."""
    listed = spark.createDataFrame([(x,) for x in LISTED], "doc_id long")
    known = table(spark, sf, "documents").select("doc_id")
    stale, live = joins.split_by_keys(listed, known, "doc_id")
    return live.withColumn("status", F.lit("excluded")).unionByName(stale.withColumn("status", F.lit("stale")))


def dup_text_flag(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    return joins.first_row_wins(docs, ["digest"], [F.asc("doc_id")], "doc_id", "first_id").filter("is_repeat").select("doc_id", "first_id")


def secret_mask(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(T.redacted(F.col("text"))).alias("shown"))


def provenance_check(spark, sf):
    """Documents without a source, and labels without a document."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    no_source = docs.filter("source IS NULL OR source = '' OR source = 'src3'").select("doc_id", F.lit("no_source").alias("issue"))
    no_label = docs.select("doc_id").join(labels, "doc_id", "left_anti").select("doc_id", F.lit("no_label").alias("issue"))
    no_document = labels.select(F.col("doc_id") + 100).toDF("doc_id").join(docs, "doc_id", "left_anti").select("doc_id", F.lit("no_document").alias("issue"))
    return no_source.unionByName(no_label).unionByName(no_document)


def missing_caption(spark, sf):
    """Accepted turns without text, only if any text exists at all."""
    turns = table(spark, sf, "conversations")
    some = turns.filter("text IS NOT NULL AND trim(text) <> ''").limit(1).select(F.lit(True).alias("_some"))
    bare = turns.filter("text IS NULL OR trim(text) = '' OR length(text) < 60").select("conv_id", "turn")
    return bare.join(F.broadcast(some)).drop("_some")


def manifest_check(spark, sf):
    """All problems of every manifest row."""
    rules = (("size", "error", "p_size % 8 <> 0"), ("prefix", "error", "NOT startswith(p_name, 'a')"), ("placeholder", "warning", "lower(p_type) LIKE '%promo%'"), ("budget", "error", "length(p_name) > 20"))
    return ladder.all_issues(table(spark, sf, "part"), "p_partkey", rules).groupBy("p_partkey").agg(F.count("*").alias("n_problems"), F.count_if(F.col("severity") == "error").alias("n_errors"))


def _manifest(spark, sf):
    """A manifest of parts: sizes off the grid, unreadable ones, captions of all kinds."""
    k = F.col("p_partkey")
    said = F.concat(F.when(k % 7 > 0, "zqstyle, ").otherwise(""), F.col("p_type"), F.when(k % 13 == 0, ", unknown").when(k % 17 == 0, ", no VLM").otherwise(""), F.repeat(F.concat(F.lit(", "), F.col("p_name")), (k % 40).cast("int")))
    return table(spark, sf, "part").select(k, F.concat(F.lit("img"), k.cast("string")).alias("image"), F.when(k % 19 > 0, said).alias("text"), F.when(k % 11 > 0, F.col("p_size") * 8 + F.when(k % 5 == 0, 1).otherwise(0)).alias("width"), (F.col("p_size") * 16).alias("height"))


def manifest_problems(spark, sf):
    """Every problem of every row of a prepared manifest."""
    return manifests.manifest_problems(_manifest(spark, sf), "zqstyle", "p_partkey")


def manifest_accepted(spark, sf):
    """Rows that have warnings at most."""
    rows = _manifest(spark, sf)
    return manifests.accepted(rows, manifests.manifest_problems(rows, "zqstyle", "p_partkey")).select("image")


def upscale_detector(spark, sf):
    """Declared size against the original's; an unknown original (0 or null) tells nothing."""
    parts = table(spark, sf, "part")
    w, sw = F.col("p_size").cast("long") * 40, F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey") % 900)
    shape = parts.select("p_partkey", w.alias("w"), (w + 100).alias("h"), sw.alias("source_w"), (sw + 50).alias("source_h"))
    upscaled = (F.coalesce("source_w", F.lit(0)) > 0) & (F.coalesce("source_h", F.lit(0)) > 0) & (F.col("source_w") * F.col("source_h") < F.col("w") * F.col("h"))
    rejected = F.least("source_w", "source_h") < 384
    return shape.filter(upscaled).select("p_partkey", F.when(rejected, "upscaled_low_resolution").otherwise("upscaled_copy").alias("finding"))


def ingest_filter(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.filter(F.col("lang").isin("en", "fr") & F.lower("source").contains("src1") & (F.least(F.coalesce("n_chars", F.lit(0)), F.lit(5000)) >= 300)).select("doc_id")


STOP_ANSWERS = ("no", "none", "nothing", "unknown", "yes")
ANACHRONISMS = ("scum", "loser", "trash")


def answer_filter(spark, sf):
    turns = table(spark, sf, "conversations")
    return turns.filter(T.informative(F.col("text"), STOP_ANSWERS, ANACHRONISMS)).select("conv_id", "turn")


def gated_fields(spark, sf):
    """A follow-up counts only behind its gate; counts of nobody drop what asks about persons."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.length("text"))).alias("first"), F.max(F.when(F.col("turn") == 1, F.length("text"))).alias("second"), F.max("turn").alias("last"))
    answers = turns.select("conv_id", F.when(F.col("first") > 200, "yes").otherwise("no").alias("has_detail"), F.col("second").alias("detail"), F.when(F.col("last") > 0, F.col("last") % 3).alias("count"))
    return answers.select("conv_id", F.when(F.col("has_detail") == "yes", F.col("detail")).alias("detail"), (~(F.coalesce("count", F.lit(1)) == 0)).alias("keeps_person"))


def size_guard(spark, sf):
    parts = table(spark, sf, "part")
    return parts.select("p_partkey", (F.pmod("p_size", F.lit(8)) == 0).alias("on_grid"), (F.floor(F.col("p_size") * 37 / 8) * 8).cast("long").alias("snapped"))


QUERIES = {f.__name__: f for f in (issue_counts, severity_counts, first_reason_wins, reject_ladder, soft_flags, stale_rules, dup_text_flag, secret_mask, provenance_check, missing_caption, manifest_check, manifest_problems, manifest_accepted, upscale_detector, ingest_filter, answer_filter, gated_fields, size_guard)}
_VALUES = ", ".join(f"({x})" for x in LISTED)
_MANIFEST = """m AS (SELECT p_partkey AS k, 'img' || p_partkey AS image, CASE WHEN p_partkey % 19 > 0 THEN CASE WHEN p_partkey % 7 > 0 THEN 'zqstyle, ' ELSE '' END || p_type || CASE WHEN p_partkey % 13 = 0 THEN ', unknown' WHEN p_partkey % 17 = 0 THEN ', no VLM' ELSE '' END || repeat(', ' || p_name, p_partkey % 40) ELSE '' END AS text,
CASE WHEN p_partkey % 11 > 0 THEN p_size * 8 + (p_partkey % 5 = 0)::INT END AS w, p_size * 16 AS h FROM part),
t AS (SELECT *, floor(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) * 1.3::DECIMAL(3, 1))::BIGINT + length(text) - length(replace(text, ',', '')) AS tokens FROM m),
i AS (SELECT image, 'error' AS severity, 'unreadable_image' AS category, 'image missing or unreadable' AS message FROM t WHERE w IS NULL
UNION ALL SELECT image, 'error', 'bad_size', w || 'x' || h || ' is not a multiple of 8' FROM t WHERE w % 8 <> 0 OR w IS NOT NULL AND h % 8 <> 0
UNION ALL SELECT image, 'error', 'missing_trigger', 'caption does not start with zqstyle' FROM t WHERE NOT starts_with(text, 'zqstyle')
UNION ALL SELECT image, 'error', 'placeholder_caption', 'caption contains placeholder text' FROM t WHERE contains(text, 'unknown') OR contains(text, 'no VLM')
UNION ALL SELECT image, 'error', 'caption_too_long', tokens || ' tokens of 75' FROM t WHERE tokens > 75
UNION ALL SELECT image, 'warning', 'duplicate_caption', 'same caption as ' || first FROM (SELECT image, k, first_value(image) OVER c AS first, row_number() OVER c AS n FROM t WINDOW c AS (PARTITION BY text ORDER BY k)) WHERE n > 1)"""
ORACLE_SQL = {
    "manifest_problems": f"WITH {_MANIFEST} SELECT * FROM i",
    "manifest_accepted": f"WITH {_MANIFEST} SELECT image FROM t WHERE image NOT IN (SELECT image FROM i WHERE severity = 'error')",
    "issue_counts": f"SELECT severity, category, count(*) AS n FROM ({_ISSUES}) GROUP BY 1, 2",
    "severity_counts": f"SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(DISTINCT doc_id) AS documents FROM ({_ISSUES})",
    "first_reason_wins": f"SELECT doc_id, min_by(category, ord) AS reason, count(*) AS n_issues FROM ({_ISSUES}) GROUP BY 1",
    "reject_ladder": "SELECT doc_id, CASE " + " ".join(f"WHEN {test} THEN '{c}'" for c, _, test in ISSUES) + " END AS reason FROM documents",
    "soft_flags": "SELECT doc_id, 'warning' AS severity, 'large' AS category FROM documents WHERE n_chars > 5000",
    "stale_rules": f"SELECT l.id AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'stale' ELSE 'excluded' END AS status FROM (VALUES {_VALUES}) l(id) LEFT JOIN documents d ON d.doc_id = l.id",
    "dup_text_flag": "SELECT doc_id, first_id FROM (SELECT doc_id, first_value(doc_id) OVER w AS first_id, row_number() OVER w AS rn FROM documents WINDOW w AS (PARTITION BY md5(text) ORDER BY doc_id)) WHERE rn > 1",
    "secret_mask": f"SELECT doc_id, md5(CASE WHEN regexp_matches(lower(text), '{T.SECRET_WORDS}') AND regexp_matches(text, '[=:]') THEN '{T.REDACTED}' ELSE text END) AS shown FROM documents",
    "provenance_check": "SELECT doc_id, 'no_source' AS issue FROM documents WHERE source IS NULL OR source = '' OR source = 'src3' UNION ALL SELECT doc_id, 'no_label' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id + 100, 'no_document' FROM labels WHERE doc_id + 100 NOT IN (SELECT doc_id FROM documents)",
    "missing_caption": "SELECT conv_id, turn FROM conversations WHERE (text IS NULL OR trim(text) = '' OR length(text) < 60) AND EXISTS (SELECT 1 FROM conversations WHERE text IS NOT NULL AND trim(text) <> '')",
    "manifest_check": "SELECT * FROM (SELECT p_partkey, (p_size % 8 <> 0)::BIGINT + (NOT starts_with(p_name, 'a'))::BIGINT + (lower(p_type) LIKE '%promo%')::BIGINT + (length(p_name) > 20)::BIGINT AS n_problems, (p_size % 8 <> 0)::BIGINT + (NOT starts_with(p_name, 'a'))::BIGINT + (length(p_name) > 20)::BIGINT AS n_errors FROM part) WHERE n_problems > 0",
    "upscale_detector": "SELECT p_partkey, CASE WHEN sw < 384 THEN 'upscaled_low_resolution' ELSE 'upscaled_copy' END AS finding FROM (SELECT p_partkey, p_size::BIGINT * 40 AS w, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 900 END AS sw FROM part) WHERE sw > 0 AND sw * (sw + 50) < w * (w + 100)",
    "ingest_filter": "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND contains(lower(source), 'src1') AND least(coalesce(n_chars, 0), 5000) >= 300",
    "answer_filter": "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND trim(text) <> '' AND lower(trim(text)) NOT IN ('" + "', '".join(STOP_ANSWERS) + "') AND NOT regexp_matches(lower(text), '" + T.word_pattern(ANACHRONISMS) + "')",
    "gated_fields": "SELECT conv_id, CASE WHEN max(CASE WHEN turn = 0 THEN length(text) END) > 200 THEN max(CASE WHEN turn = 1 THEN length(text) END) END AS detail, coalesce(CASE WHEN max(turn) > 0 THEN max(turn) % 3 END, 1) <> 0 AS keeps_person FROM conversations GROUP BY 1",
    "size_guard": "SELECT p_partkey, p_size % 8 = 0 AS on_grid, (floor(p_size * 37 / 8) * 8)::BIGINT AS snapped FROM part",
}
