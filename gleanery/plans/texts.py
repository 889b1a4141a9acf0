"""Text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import captions as C
from gleanery.functions import texts as T
from gleanery.session import table

WHO = r"acme\s+works"
NOISE = T.title_noise(WHO)
REWRITES = (("ing", "ed"), (r"\s+", " "), ("^(a|the) ", ""))
_TITLE = r"<title>([^<]*)</title>"


def title_clean(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", T.clean_title(F.regexp_extract("html", _TITLE, 1), NOISE).alias("title"))


def year_extract(spark, sf):
    parts = table(spark, sf, "part").withColumn("raw", F.concat("p_name", F.lit(" ("), F.lpad((F.col("p_partkey") % 400 + 1700).cast("string"), 4, "0"), F.lit(") (1899)")))
    return parts.select("p_partkey", T.extract_year(F.col("raw"), 1860, 1910).alias("year"))


def strip_trigger(spark, sf):
    docs = table(spark, sf, "documents").withColumn("t", F.concat(F.lit("zqstyle, "), F.col("text")))
    return docs.select("doc_id", F.md5(T.strip_tokens(F.col("t"), ["zqstyle", "zqart"])).alias("plain"), F.md5(T.with_trigger(F.col("text"), "the")).alias("prompted"))


def short_titles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.short_title(F.col("text")).alias("title"))


def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


def _parts(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("part"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "part"))).alias("r"))
    return listed.select("conv_id", F.transform("r", lambda x: x["part"]).alias("parts"))


def budget_trim(spark, sf):
    return _parts(spark, sf).select("conv_id", T.trim_to_budget(F.col("parts"), 40).alias("text"))


def budget_trim_noted(spark, sf):
    note = F.when(F.col("conv_id") % 2 == 0, F.lit("noted by hand"))
    return _parts(spark, sf).select("conv_id", T.trim_to_budget(F.col("parts"), 40, note=note).alias("text"))


#: A budget of characters: any cost that adds up may be given.
LETTERS = T.AdditiveCost((F.length,), lambda n: n)


def budget_trim_letters(spark, sf):
    return _parts(spark, sf).select("conv_id", T.trim_to_budget(F.col("parts"), 400, LETTERS, separator=" / ").alias("text"))


def assemble_caption(spark, sf):
    docs = table(spark, sf, "documents")
    fields = F.create_map(F.lit("subject"), F.col("text"), F.lit("light"), F.when(F.col("doc_id") % 2 == 0, "unknown").otherwise("soft light"), F.lit("place"), F.lit("soft light"), F.lit("mood"), F.lit(None).cast("string"))
    return docs.select("doc_id", T.assembled(fields, ["subject", "light", "place", "mood"]).alias("caption"), T.text_block({"Lang": F.col("lang"), "Source": F.nullif(F.col("source"), F.lit("src1"))}).alias("block"))


def _pick(column, *values):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (column % len(values) + 1).cast("int"))


def caption_fields(spark, sf):
    """Captions of answers made from part keys."""
    k = F.col("p_partkey")
    answers = F.create_map(F.lit("people_count"), _pick(k, "one", "2", "none", "nine"), F.lit("clothing"), _pick(k, "dress", "necklace", "blue", None, "red coat"), F.lit("clothing_color"), _pick(k, "red", "odd"), F.lit("pose"), _pick(k, "sitting", "no"), F.lit("action"), _pick(k, "standing", "reading", None), F.lit("jewelry"), _pick(k, "gold", "jewels"), F.lit("environment"), _pick(k, "garden", "in town", "sea", "phone booth"), F.lit("time"), _pick(k, "night", "day"), F.lit("objects"), F.lit(None).cast("string"), F.lit("expression"), _pick(k, "calm", "a sad expression", "unknown"))
    legacy = C.measured_or_legacy(F.when(k % 2 == 0, F.create_map(F.lit("lighting"), F.lit("dark"), F.lit("palette"), F.lit("warm"), F.lit("orientation"), F.lit("portrait"))), F.lit("soft, night scene"), F.lit(""), F.lit("group of two figures, square"))
    fields = C.caption_fields(answers, legacy, F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", *[c.alias(name) for name, c in fields.items() if name != "subject"])


def prompt_trim(spark, sf):
    """Two required parts; optional ones go from the tail."""
    required = F.array(F.lit("zqstyle"), F.col("part"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("part"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "part"))).alias("r"), F.min_by("part", "turn").alias("part"))
    return listed.select("conv_id", T.trim_optional(required, F.transform("r", lambda x: x["part"]), 45).alias("prompt"))


def parse_counts(spark, sf):
    words = F.array(*[F.lit(x) for x in ("one", "Two", " 3 ", "many", "12", "nine", "none", "No")])
    events = table(spark, sf, "events")
    return events.select("event_id", T.parse_count(F.element_at(words, (F.col("event_id") % 8 + 1).cast("int"))).alias("count"))


def rewrites(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.rewritten(F.col("text"), REWRITES)).alias("rewritten"))


def visual_bands(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 256).alias("r"), (F.col("p_partkey") * 7 % 256).alias("g"), (F.col("p_partkey") * 13 % 256).alias("b"), F.col("p_size").alias("w"), (F.col("p_partkey") % 50 + 1).alias("h"))
    mean = (F.col("r") + F.col("g") + F.col("b")) / 3
    return p.select("p_partkey", T.brightness_band(mean).alias("light"), T.palette_band(F.col("r"), F.col("g"), F.col("b")).alias("palette"), T.orientation(F.col("w"), F.col("h")).alias("shape"))


def negative_terms(spark, sf):
    bench = table(spark, sf, "benchmark").withColumn("n", F.lit("blurry, Text, watermark , low quality,,text"))
    return bench.select("item_id", T.without_terms(F.col("n"), ["text", "low quality"]).alias("negative"))


def caption_dropout(spark, sf):
    """A tenth of the texts, by a digest of their keys, lose what follows the first comma."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(T.dropped_caption(F.col("doc_id"), F.col("text"), 10, 7)).alias("text"))


def output_names(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.output_name(F.lower("o_orderstatus"), F.col("o_custkey")).alias("name"))


def json_coercion(spark, sf):
    """Values of JSON objects as texts, lists joined and falsy ones dropped; an answer that does not hold the scene as
    it is counts for nothing, and where nothing is left the local value stands in."""
    k = F.get_json_object("props", "$.k").cast("int")
    scene = F.concat(F.lit("a "), "event_type")
    subject = F.when(F.col("event_id") % 4 > 0, F.concat(scene, F.lit(" by day"))).otherwise("another scene")
    told = F.struct(subject.alias("subject"), F.array(F.col("event_type"), F.lit("old")).alias("pose"), (k % 3).alias("clothing"), (k % 2 == 0).alias("style"), F.when(k % 5 == 0, "").otherwise("soft").alias("lighting"))
    made = T.coerced(F.to_json(told), scene)
    chosen = lambda key: F.coalesce(F.try_element_at(made, F.lit(key)), F.lit("local")).alias(key)
    return table(spark, sf, "events").select("event_id", *[chosen(x) for x in ("pose", "clothing", "style", "lighting")])


QUERIES = {f.__name__: f for f in (title_clean, year_extract, strip_trigger, short_titles, token_estimate, budget_trim, budget_trim_noted, budget_trim_letters, assemble_caption, caption_fields, prompt_trim, parse_counts, rewrites, visual_bands, negative_terms, caption_dropout, output_names, json_coercion)}


def _title_sql(t: str) -> str:
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    names = ", ".join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in T.REFERENCES.items())
    got = lambda pattern, group=0: f"regexp_extract(p, '{pattern}', {group})"
    digits = got(T.NUMBERED, 1)
    number = f"CASE WHEN lower({digits}[1]) = 'x' THEN ('0x' || {digits}[2:])::INT ELSE {digits}::INT END"
    told = "map_extract_value(MAP {" + names.replace("{", "{{").replace("}", "}}") + "}, {})"
    told = told.replace("MAP {", "MAP {{").replace("}, {})", "}}, {})")
    said = f"""CASE WHEN {got(T.NUMBERED)} <> '' THEN chr({number}) || p[length({got(T.NUMBERED)}) + 1:] WHEN {told.format(got(T.NAMED, 1))} IS NOT NULL THEN {told.format(got(T.NAMED, 1))} || p[length({got(T.NAMED)}) + 1:]
        WHEN {got(T.BARE)} <> '' THEN {told.format(got(T.BARE, 1))} || p[length({got(T.BARE)}) + 1:] ELSE '&' || p END"""
    t = f"list_reduce(list_transform(string_split({t}, '&'), lambda p, k: CASE WHEN k = 1 THEN p ELSE {said} END), lambda a, b: a || b)"
    t = f"trim(replace(replace({t}, '_', ' '), chr(34), ''))"
    edge = lambda x: f"regexp_replace({x}, '^[{T.EDGES}]+|[{T.EDGES}]+\\z', '', 'g')"
    for pattern in [*NOISE, *NOISE]:
        pattern = pattern.replace("'", "''")
        t = edge(f"regexp_replace({t}, '{pattern}', ' ', 'g')")
    return edge(f"regexp_replace({t}, '\\s+', ' ', 'g')")


_LATIN = r"regexp_replace(regexp_replace(text, '\s*\b(title|label)\s+QS:.*\z', ''), '(\b[A-Z][a-z]+:\s*)?[\x{0900}-\x{0DFF}]+', '', 'g')"
_LATIN = rf"regexp_replace(regexp_replace(regexp_replace({_LATIN}, '\s{{2,}}', ' ', 'g'), '^[ ,:\-]+|[ ,:\-]+\z', '', 'g'), '^\s+|\s+\z', '', 'g')"
_TOK = "(floor(len(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+')) * 13 / 10) + len({t}) - len(replace({t}, ',', '')))::BIGINT"
_PARTS = "p AS (SELECT conv_id, list(text ORDER BY turn) AS parts FROM conversations GROUP BY 1)"
_PUT = "array_to_string(CASE WHEN note IS NULL THEN parts[1:k] ELSE list_concat(list_concat(parts[1:least(2, k)], [note]), parts[least(2, k) + 1:k]) END, ', ')"


def _trim_sql(note: str) -> str:
    return f"""WITH {_PARTS}, c AS (SELECT conv_id, k, {_PUT} AS t FROM (SELECT *, {note} AS note, unnest(range(1, len(parts) + 1)) AS k FROM p))
        SELECT conv_id, max_by(t, k) AS text FROM c WHERE k = 1 OR {_TOK.format(t="t")} <= 40 GROUP BY 1"""


ORACLE_SQL = {
    "caption_dropout": "SELECT doc_id, md5(CASE WHEN ('0x' || substr(md5(doc_id || ':7'), 1, 8))::UBIGINT % 100 < 10 THEN split_part(text, ',', 1) ELSE text END) AS text FROM documents",
    "budget_trim_letters": f"WITH {_PARTS}, c AS (SELECT conv_id, k, array_to_string(parts[1:k], ' / ') AS t FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM p)) SELECT conv_id, max_by(t, k) AS text FROM c WHERE k = 1 OR length(t) <= 400 GROUP BY 1",
    "title_clean": f"""SELECT page_id, CASE WHEN length(u) >= 3 THEN u END AS title FROM (SELECT page_id, CASE WHEN contains(t, ' ') THEN t ELSE regexp_replace(t, '([a-z])([A-Z])', '\\1 \\2', 'g') END AS u
        FROM (SELECT page_id, {_title_sql(f"regexp_extract(html, '{_TITLE}', 1)")} AS t FROM pages))""",
    "year_extract": "SELECT p_partkey, CASE WHEN y BETWEEN 1860 AND 1910 THEN y::INT END AS year FROM (SELECT p_partkey, p_partkey % 400 + 1700 AS y FROM part)",
    "strip_trigger": "SELECT doc_id, md5(regexp_replace(regexp_replace('zqstyle, ' || text, '(zqstyle|zqart),?\\s*', '', 'g'), '^[ ,]+|[ ,]+\\z', '', 'g')) AS plain, md5(CASE WHEN contains(text, 'the') THEN text ELSE 'the, ' || text END) AS prompted FROM documents",
    "short_titles": f"""SELECT doc_id, CASE WHEN len(held) > 12 THEN array_to_string(held[1:12], ' ') ELSE first END AS title FROM (SELECT doc_id, first, regexp_split_to_array(regexp_replace(first, '^\\s+|\\s+\\z', '', 'g'), '\\s+') AS held
        FROM (SELECT doc_id, regexp_replace(regexp_replace({_LATIN}, '([a-z)])\\.\\s[\\s\\S]*\\z', '\\1'), '\\.+\\z', '') AS first FROM documents))""",
    "token_estimate": f"SELECT doc_id, {_TOK.format(t='text')} AS n_tokens FROM documents",
    "budget_trim": _trim_sql("NULL::VARCHAR"),
    "budget_trim_noted": _trim_sql("CASE WHEN conv_id % 2 = 0 THEN 'noted by hand' END"),
    "assemble_caption": "SELECT doc_id, CASE WHEN trim(text, ' ') <> '' AND text <> 'unknown' THEN text || ', ' ELSE '' END || 'soft light' AS caption, 'Lang:' || chr(10) || lang || chr(10) || chr(10) || 'Source:' || chr(10) || coalesce(nullif(source, 'src1'), 'unknown') AS block FROM documents",
    "caption_fields": """WITH a AS (SELECT p_partkey, p_partkey AS k, p_partkey % 2 = 0 AS even FROM part)
        SELECT p_partkey, CASE k % 4 WHEN 0 THEN 'single-figure composition, ' WHEN 1 THEN 'group of two figures, ' ELSE '' END || CASE WHEN even THEN 'portrait' ELSE 'square' END AS composition,
        CASE WHEN even AND k % 3 = 1 THEN 'sitting, reading' WHEN even THEN 'sitting' WHEN k % 3 = 1 THEN 'reading' ELSE 'unknown' END AS pose,
        CASE k % 5 WHEN 0 THEN 'wearing ' || CASE WHEN even THEN 'red dress' ELSE 'dress' END WHEN 2 THEN 'wearing ' || CASE WHEN even THEN 'red blue clothing' ELSE 'blue clothing' END WHEN 4 THEN 'wearing red coat' ELSE 'unknown' END AS clothing,
        CASE WHEN even THEN 'gold jewelry' ELSE 'jewels' END AS jewelry, CASE k % 3 WHEN 0 THEN 'calm expression' WHEN 1 THEN 'a sad expression' ELSE 'unknown' END AS expression, 'unknown' AS objects,
        CASE k % 4 WHEN 0 THEN 'in a garden' WHEN 1 THEN 'in town' WHEN 2 THEN 'in sea' ELSE 'unknown' END AS environment, CASE WHEN even THEN 'dark, night scene' ELSE 'soft' END AS lighting, CASE WHEN even THEN 'warm' ELSE 'unknown' END AS visual_characteristics FROM a""",
    "prompt_trim": f"""WITH p AS (SELECT conv_id, min_by(text, turn) AS scene, list(text ORDER BY turn) AS parts FROM conversations GROUP BY 1),
        u AS (SELECT conv_id, scene, list_filter(parts, lambda x, i: list_position(parts, x) = i) AS parts FROM p),
        c AS (SELECT conv_id, k, array_to_string(list_concat(['zqstyle', scene], parts[1:k]), ', ') AS t FROM (SELECT *, unnest(range(0, len(parts) + 1)) AS k FROM u))
        SELECT conv_id, max_by(t, k) AS prompt FROM c WHERE k = 0 OR {_TOK.format(t="t")} <= 45 GROUP BY 1""",
    "parse_counts": "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 4 THEN 12 WHEN 6 THEN 0 WHEN 7 THEN 0 END AS count FROM events",
    "rewrites": "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, 'ing', 'ed', 'g'), '\\s+', ' ', 'g'), '^(a|the) ', '', 'g')) AS rewritten FROM documents",
    "visual_bands": """SELECT p_partkey, CASE WHEN m < 85 THEN 'dark' WHEN m > 170 THEN 'bright' ELSE 'balanced' END AS light, CASE WHEN r > g * 1.08 AND r > b * 1.08 THEN 'warm' WHEN b > r AND b > g THEN 'cool' WHEN g > r AND g > b THEN 'green' ELSE 'neutral' END AS palette,
        CASE WHEN q < 0.9 THEN 'portrait' WHEN q > 1.1 THEN 'landscape' ELSE 'square' END AS shape FROM (SELECT p_partkey, p_partkey % 256 AS r, p_partkey * 7 % 256 AS g, p_partkey * 13 % 256 AS b, (r + g + b) / 3 AS m, p_size / (p_partkey % 50 + 1) AS q FROM part)""",
    "negative_terms": "SELECT item_id, 'blurry, watermark' AS negative FROM benchmark",
    "output_names": "SELECT o_orderkey, lower(o_orderstatus) || '_seed' || o_custkey AS name FROM orders",
    "json_coercion": """SELECT event_id, CASE WHEN ok THEN event_type || ', old' ELSE 'local' END AS pose, CASE WHEN ok AND k % 3 > 0 THEN (k % 3)::VARCHAR ELSE 'local' END AS clothing,
        CASE WHEN ok AND k % 2 = 0 THEN 'True' ELSE 'local' END AS style, CASE WHEN ok AND (k IS NULL OR k % 5 <> 0) THEN 'soft' ELSE 'local' END AS lighting
        FROM (SELECT event_id, event_type, event_id % 4 > 0 AS ok, json_extract_string(props, '$.k')::INT AS k FROM events)""",
}
