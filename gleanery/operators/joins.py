"""Joins whose semantics go beyond an equality: last row wins, null-safe pairs, resume, containment, lexicons, graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.lexicon import WordTrie

#: A side of at most so many rows may be broadcast; beyond it Spark chooses.
MOST_BROADCAST = 100_000
#: Characters of a needle's head, a power of two.
MOST_HEAD = 64
NOT_WORD = r"[^\p{L}\p{N}_]"


def small(rows: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Marks a side for broadcasting if a count of it stays within the bound."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def last_row_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the last by ``order``, with ``n_rows`` that the key had."""
    held = F.struct(F.col(order), *[F.col(c) for c in rows.columns if c not in (*keys, order)])
    best = rows.groupBy(*keys).agg(F.max(held).alias("_r"), F.count("*").alias("n_rows"))
    return best.select(*keys, "_r.*", "n_rows")


def first_row_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], pick: str, to: str) -> DataFrame:
    """Every row with the pick of its key's first row and whether it is a repeat."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(to, F.first(pick).over(w)).withColumn("is_repeat", F.row_number().over(w) > 1)


def lookup_counts(left: DataFrame, right: DataFrame, keys: Sequence[str], mark: str) -> DataFrame:
    """How many rows of left found and missed their row of right."""
    joined = left.join(right.select(*keys, F.lit(True).alias("_hit")).distinct(), list(keys), "left")
    return joined.agg(F.count_if(F.col("_hit")).alias("found"), F.count_if(F.col("_hit").isNull()).alias("missed")).withColumn("lookup", F.lit(mark))


def first_text(*columns: Column) -> Column:
    """The first of the columns that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])


def split_by_keys(rows: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is not listed, and rows whose key is."""
    return rows.join(keys, on, "left_anti"), rows.join(keys, on, "left_semi")


def resume(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is still to do. A row with a null key can't have been done."""
    return todo.join(done.dropna(subset=list(keys)).select(*keys).distinct(), list(keys), "left_anti")


def contained_needles(needles: DataFrame, needle: str, texts: DataFrame, text_col: str) -> DataFrame:
    """The different needles that occur in some text, the empty one in any.

    A needle's head is its longest beginning of 1, 2, 4 .. ``MOST_HEAD`` characters. Where a text holds a head, its substrings
    of the lengths that needles of that head have are compared with whole needles. So the work grows with the texts and the needles,
    not with the pairs that share something.
    """
    hay = texts.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("_hay")).distinct()
    wanted = needles.filter(F.col(needle).isNotNull()).select(F.col(needle).alias("_needle")).distinct()
    met = substrings_met(wanted, hay).unionByName(hay.select(F.lit("").alias("_needle")).distinct())
    return wanted.join(met, "_needle", "left_semi").withColumnRenamed("_needle", needle)


def substrings_met(wanted: DataFrame, hay: DataFrame) -> DataFrame:
    """_needle: the different substrings of texts that begin like a needle of their length."""
    # an equal hash of another head gives a substring more, no wrong needle
    width = F.least(F.pow(F.lit(2), F.length(F.bin(F.length("_needle"))) - 1).cast("int"), F.lit(MOST_HEAD))
    headed = wanted.filter("_needle <> ''").select(width.alias("_width"), F.length("_needle").alias("_n"), "_needle")
    heads = headed.groupBy("_width", F.xxhash64(F.split(F.substr("_needle", F.lit(1), F.col("_width")), "")).alias("_key")).agg(F.sort_array(F.collect_set("_n")).alias("_lengths"))
    widths = sorted(x[0] for x in headed.select("_width").distinct().collect())  # powers of two up to MOST_HEAD
    hay = hay.withColumn("_t", F.xxhash64("_hay"))
    lettered = hay.select("_t", F.split("_hay", "").alias("_letters"))
    begins = lambda w: F.when(F.size("_letters") >= w, F.transform(F.sequence(F.lit(1), F.size("_letters") - (w - 1)), lambda i: F.struct(i.alias("_at"), F.lit(w).alias("_width"), F.xxhash64(F.slice("_letters", i, w)).alias("_key"))))
    none = F.array().cast("array<struct<_at:int,_width:int,_key:bigint>>")
    windows = lettered.select("_t", F.explode(F.concat(none, *[F.coalesce(begins(w), none) for w in widths])).alias("_w")).select("_t", "_w.*")
    met = windows.join(heads, ["_width", "_key"]).groupBy("_t", "_lengths").agg(F.collect_set("_at").alias("_places"))
    placed = met.join(hay, "_t").select("_hay", "_lengths", F.explode("_places").alias("_at")).select("_hay", "_at", F.explode("_lengths").alias("_n"))
    return placed.filter(F.col("_at") + F.col("_n") - 1 <= F.length("_hay")).select(F.substr("_hay", F.col("_at"), F.col("_n")).alias("_needle")).distinct()


def not_contained(rows: DataFrame, needle: Column, texts: DataFrame, text_col: str) -> DataFrame:
    """Rows whose needle occurs in none of the texts; a null needle occurs nowhere."""
    held = rows.withColumn("_needle", needle)
    return held.join(contained_needles(held, "_needle", texts, text_col), "_needle", "left_anti").drop("_needle")


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Inner join on null-safe keys; of several right rows of a key the last one counts. Right columns get ``base_``."""
    other = last_row_wins(right, keys, order).drop("n_rows", order)
    other = other.select(*[F.col(c).alias(f"base_{c}") for c in other.columns])
    test = [F.col(k).eqNullSafe(F.col(f"base_{k}")) for k in keys]
    condition = test[0]
    for t in test[1:]:
        condition = condition & t
    return left.join(other, condition).drop(*[f"base_{k}" for k in keys])


def lexicon_hits(texts: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """lexicon: name, alias. Per text and name the earliest place of any alias as whole words, whatever its case.

    A lexicon of at most ``MOST_BROADCAST`` aliases becomes a trie of words that reads each text once. For a larger one
    the words of texts and the first words of aliases meet in a join, and what meets is searched.
    """
    lexicon = lexicon.filter("alias <> ''").select("name", "alias")
    held = lexicon.limit(MOST_BROADCAST + 1).collect()
    if len(held) > MOST_BROADCAST:
        return _lexicon_join(texts, id_col, text_col, lexicon)
    trie = texts.sparkSession.sparkContext.broadcast(WordTrie(held))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, names, places = [], [], []
            for k, text in enumerate(batch.column("_text").to_pylist()):
                for name, at in trie.value.earliest(text or "").items():
                    rows.append(k)
                    names.append(name)
                    places.append(at + 1)
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(places, pa.int32())], names=["_id", "name", "first_at"])

    kind = texts.schema[id_col].dataType.simpleString()
    hits = texts.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, name string, first_at int")
    return hits.groupBy(F.col("_id").alias(id_col), "name").agg(F.min("first_at").alias("first_at"))


def _lexicon_join(texts: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    words = texts.select(id_col, F.col(text_col).alias("_text"), F.array_distinct(F.split(F.lower(text_col), f"{NOT_WORD}+")).alias("_words"))
    words = words.select(id_col, "_text", F.explode("_words").alias("word"))
    first = F.regexp_extract(F.lower("alias"), r"([\p{L}\p{N}_]+)", 1)
    named = lexicon.select("name", first.alias("word"), F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])\Q"), F.col("alias"), F.lit(r"\E(?![\p{L}\p{N}_])")).alias("_whole"))
    met = words.join(named, "word").withColumn("_at", F.regexp_instr("_text", F.col("_whole"))).filter("_at > 0")
    return met.groupBy(id_col, "name").agg(F.min("_at").cast("int").alias("first_at"))


def first_by_priority(hits: DataFrame, id_col: str, ranked: DataFrame, to: str) -> DataFrame:
    """ranked: name, priority and what it stands for. Of the names that a text holds, what the first by priority stands for."""
    return hits.join(small(ranked), "name").groupBy(id_col).agg(F.min_by(to, "priority").alias(to))


def names_in_order(hits: DataFrame, id_col: str) -> DataFrame:
    """Names by first appearance, as one string per text."""
    listed = F.array_sort(F.collect_list(F.struct("first_at", "name")))
    return hits.groupBy(id_col).agg(F.array_join(F.transform(listed, lambda x: x["name"]), ", ").alias("names"), F.count("*").alias("n_names"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, to: str) -> DataFrame:
    """The right value of the latest time at or before each left row's time: one sort, no inequality join.

    Of right rows of one key and time the largest value counts.
    """
    tagged = left.select(F.struct(*left.columns).alias("_l"), F.col(key), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    other = right.select(F.lit(None).cast(tagged.schema["_l"].dataType).alias("_l"), F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy("_t", "_side", F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    return tagged.unionByName(other).withColumn(to, F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").select("_l.*", to)


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: float) -> DataFrame:
    """Points within [start, end) of a span of the same key, met in buckets of a width, so that the join hashes."""
    cell = lambda c: F.floor(c / width)
    dealt = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end)))))
    joined = points.withColumn("_cell", cell(F.col(at))).join(dealt, [key, "_cell"])
    return joined.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")


def levels_from(edges: DataFrame, root, parent: str = "parent", child: str = "child", most: int = 50, settle=None) -> DataFrame:
    """Breadth-first levels of a graph: node, level. Each level's new nodes are those not met before. A graph of more
    levels than ``most`` is an error.

    settle: cuts the lineage of a level (a written table on a cluster); None leaves it to Spark.
    """
    settle = settle or (lambda x: x)
    seen = edges.sparkSession.createDataFrame([(root, 0)], f"node {edges.schema[child].dataType.simpleString()}, level int")
    front = seen
    for level in range(1, most + 1):
        step = edges.join(front.select(F.col("node").alias(parent)), parent, "left_semi").select(F.col(child).alias("node")).distinct()
        front = settle(step.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            return seen
        seen = settle(seen.unionByName(front))
    raise ValueError(f"the graph has more than {most} levels")
