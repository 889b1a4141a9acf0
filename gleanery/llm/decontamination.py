"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers (in digits or words), units after numbers and capitalised words become typed placeholders that keep their value;
a point in a number is part of its value, a comma only before three digits: others list numbers. Windows of
``WINDOW`` canonical tokens are hash-joined with those of the benchmark items. Texts are read in two ways: capitalised
words are names, wherever they stand, but for words that head sentences without being names (``HEADS``); or none is. A
window needs ``LEAST_WORDS`` tokens that are no placeholders, as names and numbers alone fit any list of them. What met
along one alignment of an item must fill the item's slots consistently: one value of the item, one value of the
document. A document is contaminated when consistent windows cover at least half of an item's windows, so an item with
other numbers and names is caught and a chance meeting of templates is not.

Every text is cut into tokens once. Up to ``MOST_BROADCAST`` windows of the benchmark are broadcast; of a larger one
the windows' hashes meet in a shuffled join, and only what met is taken back to its text.

Defined cases: null and empty texts are clean; a null item text has no windows; items shorter than a window are met
as a whole, by windows of their length; an item of fewer than ``LEAST_ITEM_WORDS`` tokens that are no placeholders (a
bare number, a lone word) says too little to be matched: ``unmatchable_items`` lists it; rows with a null id are clean;
repeated ids are judged together; an empty table gives no rows; other columns are not read, whatever their names, and
pass through ``clean_documents``; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import stash

WINDOW, MOST_BROADCAST = 8, 200_000
LEAST_COVER = 0.5
LEAST_WORDS, LEAST_ITEM_WORDS = 2, 4
NUMBER, NAME, UNIT, POINT, AFTER = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
NAMED, PLAIN = 0, 1  # ways of reading: capitalised words are names, or words
UNITS = "km|kg|cm|mm|mg|ml|m|g|l|lb|lbs|oz|mi|ft|s|min|h|hours|hour|minutes|days|weeks|years|euros|euro|dollars|dollar|percent|miles|meters|metres|grams|liters|litres"
#: Words that are capitalised as heads of sentences and questions.
HEADS = tuple(
    "a an the this that these those it its he she they we you i his her their our your my and or but if when while where what which who whose why how "
    "there here then so as at by for from in into of on to with after before during is are was were be do does did has have had can could will would "
    "should may must not no yes all any each every some many most one first find calculate determine compute solve suppose let given show write name".split()
)
ONES = "one two three four five six seven eight nine".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = tuple([*"zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion dozen".split(), *ONES, *TENS, *[t + o for t in TENS for o in ONES]])
_GROUP = (r"(\p{N}),(\p{N}{3})([^\p{N}]|$)", "$1$2$3")
_POINT = (r"(\p{N})\.(\p{N})", f"$1{POINT}$2")
#: (pattern, replacement with $1) in order; understood alike by java.util.regex and RE2. What shares a character with the match before is met by a second turn.
REWRITES = (
    _GROUP,
    _GROUP,
    _POINT,
    _POINT,
    (f"(?i)({'|'.join(TENS)})[- ]({'|'.join(ONES)})", "$1$2"),
    (rf"(\p{{N}}[\p{{N}}{POINT}]*)", f" {NUMBER}$1 "),
    (rf"({NUMBER}[\p{{N}}{POINT}]+) +({UNITS})([^\p{{L}}\p{{N}}]|$)", f"$1 {UNIT}$2$3"),
    (rf"(^|[^\p{{L}}\p{{N}}{NUMBER}-{AFTER}])(\p{{Lu}}\p{{L}}+)", f"$1{NAME}$2"),
)
BREAKS = rf"[^\p{{L}}\p{{N}}{NUMBER}-{POINT}]+"


def tokens(text: Column) -> Column:
    """Tokens of a text, with a mark before numbers, units and capitalised words."""
    text = F.coalesce(text, F.lit(""))
    for pattern, into in REWRITES:
        text = F.regexp_replace(text, pattern, into)
    found = F.array_remove(F.split(F.lower(text), BREAKS), "")
    plain = lambda x: F.when(x.startswith(NAME), unmarked(x)).otherwise(x)
    return F.transform(found, lambda x: F.when(plain(x).isin(*NUMBER_WORDS), F.concat(F.lit(NUMBER), plain(x))).otherwise(x))


def is_marked(token: Column) -> Column:
    return (token >= NUMBER) & (token < AFTER)


def unmarked(token: Column) -> Column:
    return F.substring(token, 2, 1 << 30)


def is_slot(token: Column, way: Column | int) -> Column:
    """Whether a token is a placeholder in a way of reading: numbers and units always, names in one."""
    name = (F.lit(way) if isinstance(way, int) else way) == NAMED
    return is_marked(token) & (~token.startswith(NAME) | (name & ~unmarked(token).isin(*HEADS)))


def token_hashes(found: Column, way: int) -> Column:
    """Hashes of tokens, of placeholders by their type."""
    word = lambda x: F.when(x.startswith(NAME), F.xxhash64(unmarked(x))).otherwise(F.xxhash64(F.substring(x, 1, 1)))
    if way == PLAIN:
        return F.transform(found, lambda x: F.when(is_marked(x), word(x)).otherwise(F.xxhash64(x)))
    return F.transform(found, lambda x: F.when(is_slot(x, NAMED), F.xxhash64(F.substring(x, 1, 1))).when(is_marked(x), word(x)).otherwise(F.xxhash64(x)))


def each_window(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """Of tables with t (tokens): the other columns, t, way, size, pos and the hash h of every window of these sizes.

    Each step is an explode of its own, so that lambdas run once a text; windows are made in generated code.
    """
    rest = [c for c in texts.columns if c != "t"]
    ways = [F.struct(F.lit(way).alias("way"), F.lit(size).alias("size"), F.col(f"c.c{way}").alias("c")) for way in (NAMED, PLAIN) for size in sizes]
    read = texts.select(*rest, "t", F.explode(F.array(F.struct(*[token_hashes(F.col("t"), way).alias(f"c{way}") for way in (NAMED, PLAIN)]))).alias("c"))
    read = read.select(*rest, "t", F.explode(F.array(*ways)).alias("x")).select(*rest, "t", "x.way", "x.size", "x.c")
    rows = read.select(*rest, "t", "way", "size", "c", F.posexplode("c").alias("pos", "_h")).filter(F.col("pos") + F.col("size") <= F.size("c"))
    h = F.lit(None).cast("long")
    for size in sizes:
        h = F.when(F.col("size") == size, F.xxhash64("way", "size", *[F.get("c", F.col("pos") + j) for j in range(size)])).otherwise(h)
    return rows.select(*rest, "t", "way", "size", "pos", h.alias("h"))


def slots(found: Column, at: Column, size: Column | int, way: Column | int) -> Column:
    return F.filter(F.slice(found, at + 1, size), lambda x: is_slot(x, way))


def read_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item, t (tokens), words (how many are no placeholders in any reading) of the items."""
    found = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.explode(F.array(tokens(F.col(text_col)))).alias("t"))
    return found.withColumn("words", F.size("t") - F.size(F.filter("t", lambda x: is_slot(x, PLAIN))))


def unmatchable_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Items that hold too few words to be matched, with their number."""
    return read_items(benchmark, item_col, text_col).filter(F.col("words") < LEAST_ITEM_WORDS).select(F.col("item").alias(item_col), "words")


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, way, size, at, h, item_slots, n (the item's windows that can meet): names read as such only in windows that hold one."""
    found = read_items(benchmark, item_col, text_col).filter(F.col("words") >= LEAST_ITEM_WORDS).select("item", "t")
    rows = each_window(found, list(range(LEAST_ITEM_WORDS, WINDOW + 1))).filter(F.col("size") == F.least(F.size("t"), F.lit(WINDOW)))
    rows = rows.select("item", "way", "size", F.col("pos").alias("at"), "h", slots(F.col("t"), F.col("pos"), F.col("size"), F.col("way")).alias("item_slots"))
    words = F.col("size") - F.size("item_slots")
    rows = rows.filter(words >= F.when(F.col("size") == WINDOW, LEAST_WORDS).otherwise(LEAST_ITEM_WORDS))
    rows = rows.filter((F.col("way") == PLAIN) | F.exists("item_slots", lambda x: x.startswith(NAME)))
    windows = stash(rows.distinct(), "benchmark-windows")
    return windows.join(windows.groupBy("item").agg(F.count_distinct("at").alias("n")), "item")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_cover: float = LEAST_COVER, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc, item, cover, reworded (some slot has another value): one row for each item that contaminates a document."""
    windows = benchmark_windows(benchmark, item_col, item_text_col)
    counts = {row["size"]: row["n"] for row in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most WINDOW rows
    windows = windows.drop("way", "size")
    made = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.explode(F.array(tokens(F.col(text_col)))).alias("t"))
    if sum(counts.values()) <= most_broadcast:
        met = each_window(made, sorted(counts) or [WINDOW]).join(F.broadcast(windows), "h")
    else:
        told = made.withColumn("text", F.xxhash64("t"))  # of repeated ids each text meets for itself
        met = each_window(told, sorted(counts)).drop("t").join(windows, "h").join(told.dropDuplicates(["doc", "text"]), ["doc", "text"])
    met = met.select("doc", "item", "n", "at", (F.col("pos") - F.col("at")).alias("along"), F.arrays_zip(F.col("item_slots").alias("x"), slots(F.col("t"), F.col("pos"), F.col("size"), F.col("way")).alias("y")).alias("filled"))
    aligned = met.groupBy("doc", "item", "along").agg(F.first("n").alias("n"), F.collect_set("at").alias("ats"), F.array_distinct(F.flatten(F.collect_set("filled"))).alias("filled"))
    consistent = F.size("filled") == F.size(F.array_distinct(F.transform("filled", lambda p: p["x"])))
    reworded = F.exists("filled", lambda p: p["x"] != p["y"])
    held = aligned.filter(consistent).groupBy("doc", "item").agg(F.first("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"), F.max(reworded).alias("reworded"))
    return held.filter(F.col("covered") >= least_cover * F.col("n")).select("doc", "item", (F.col("covered") / F.col("n")).alias("cover"), "reworded")


def judged_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, contaminated, n_items, items (sorted)."""
    found = contaminated(docs, benchmark, id_col, text_col).groupBy(F.col("doc").alias("_doc")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = docs.select(id_col).join(found, F.col(id_col) == F.col("_doc"), "left")
    items = F.coalesce("items", F.array().cast(found.schema["items"].dataType))
    return out.select(id_col, F.col("items").isNotNull().alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("items"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    found = contaminated(docs, benchmark, id_col, text_col).select(F.col("doc").alias("_doc")).distinct()
    return docs.join(found, F.col(id_col) == F.col("_doc"), "left_anti")


def _sql_tokens(text: str) -> str:
    text = f"coalesce({text}, '')"
    for pattern, into in REWRITES:
        text = f"regexp_replace({text}, '{pattern}', '{into.replace('$', chr(92))}', 'g')"
    plain = f"CASE WHEN x[1] = '{NAME}' THEN x[2:] ELSE x END"
    numbers = ", ".join(f"'{w}'" for w in NUMBER_WORDS)
    return f"list_transform(list_filter(string_split_regex(lower({text}), '{BREAKS}'), lambda x: x <> ''), lambda x: CASE WHEN ({plain}) IN ({numbers}) THEN '{NUMBER}' || ({plain}) ELSE x END)"


_SLOT = f"(x >= '{NUMBER}' AND x < '{AFTER}')"
_HEADS = ", ".join(f"'{w}'" for w in HEADS)
_READ = f"""SELECT *, {NAMED} AS way, list_transform(t, lambda x: CASE WHEN x[1] = '{NAME}' AND x[2:] IN ({_HEADS}) THEN x[2:] ELSE x END) AS w FROM {{0}}
            UNION ALL SELECT *, {PLAIN}, list_transform(t, lambda x: CASE WHEN x[1] = '{NAME}' THEN x[2:] ELSE x END) FROM {{0}}"""
_KEY = f"list_transform(win, lambda x: CASE WHEN {_SLOT} THEN x[1] ELSE x END) AS k"
#: DuckDB SQL of judged_documents, the items as one string.
SQL = f"""
WITH dt AS (SELECT doc_id AS doc, {_sql_tokens("text")} AS t FROM documents), dw AS ({_READ.format("dt")}),
bt AS (SELECT item_id AS item, {_sql_tokens("text")} AS t FROM benchmark), bw AS ({_READ.format("bt")}),
able AS (SELECT item FROM bw WHERE way = {PLAIN} AND len(w) - len(list_filter(w, lambda x: {_SLOT})) >= {LEAST_ITEM_WORDS}),
bp AS (SELECT item, way, size, p, w[p + 1 : p + size] AS win FROM (SELECT item, way, w, least(len(w), {WINDOW}) AS size, unnest(range(greatest(len(w) - {WINDOW}, 0) + 1)) AS p FROM bw JOIN able USING (item))),
bk AS (SELECT *, {_KEY}, list_filter(win, lambda x: {_SLOT}) AS s FROM bp),
bc AS (SELECT DISTINCT item, way, size, p, win, k FROM bk WHERE size - len(s) >= CASE WHEN size = {WINDOW} THEN {LEAST_WORDS} ELSE {LEAST_ITEM_WORDS} END AND (way = {PLAIN} OR len(list_filter(s, lambda x: x[1] = '{NAME}')) > 0)),
n AS (SELECT item, count(DISTINCT p) AS n FROM bc GROUP BY 1),
dp AS (SELECT doc, way, size, p, w[p + 1 : p + size] AS win FROM (SELECT doc, way, w, size, unnest(range(len(w) - size + 1)) AS p FROM dw, (SELECT DISTINCT size FROM bc) WHERE len(w) >= size)),
dk AS (SELECT *, {_KEY} FROM dp),
met AS (SELECT doc, item, bc.p AS start_at, dk.p - bc.p AS along, list_filter(list_zip(bc.win, dk.win), lambda z: z[1] >= '{NUMBER}' AND z[1] < '{AFTER}') AS filled FROM dk JOIN bc USING (k, way, size)),
aligned AS (SELECT doc, item, along, list(DISTINCT start_at) AS ats, list_distinct(flatten(list(filled))) AS filled FROM met GROUP BY ALL),
held AS (SELECT doc, item, len(list_distinct(flatten(list(ats)))) AS covered FROM aligned
         WHERE len(filled) = len(list_distinct(list_transform(filled, lambda z: z[1]))) GROUP BY doc, item),
found AS (SELECT doc, list(item ORDER BY item) AS items FROM held JOIN n USING (item) WHERE covered >= {LEAST_COVER} * n GROUP BY doc)
SELECT doc_id, items IS NOT NULL AS contaminated, coalesce(len(items), 0) AS n_items, array_to_string(coalesce(items, []), ',') AS items
FROM documents LEFT JOIN found ON doc_id = doc
"""
