"""Similarity of vectors and what is summed up from it.

Two ways: a matrix product in Arrow batches when the references stay within a checked size; otherwise both sides are
cut into blocks, every pair of blocks is one product, and what the products tell of a vector adds up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.groups import settle

BLOCK_NUMBERS = 500_000  # of all vectors of a block
BINS = 256  # of a vector's similarities, to find their median
MOST_NUMBERS = 4_000_000  # of all reference vectors that one task holds
PRODUCTS = 1_000_000  # similarities that a task holds at once


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def products(a: np.ndarray, b: np.ndarray):
    """Slices of the rows of a, with their dot products with all rows of b: at most ``PRODUCTS`` at once, or one row's."""
    step = max(1, PRODUCTS // max(1, len(b)))
    for at in range(0, len(a), step):
        own = slice(at, at + step)
        yield own, a[own] @ b.T


def nearest_of(a: np.ndarray, b: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a the first of the rows of b with the largest product, and this. A matrix product may give equal rows
    different last bits, so what is near the largest is summed up again, component by component."""
    at, top = sims.argmax(axis=1), sims.max(axis=1)
    slack = 1e-12 * np.sqrt((a**2).sum(axis=1)) * np.sqrt((b**2).sum(axis=1).max())
    row, col = np.nonzero(sims >= (top - slack)[:, None])
    exact = np.zeros(len(row))
    for i in range(a.shape[1]):
        exact += a[row, i] * b[col, i]
    order = np.lexsort((col, -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
    at[row[first]], top[row[first]] = col[first], exact[first]
    return at, top


def best_of(sims: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row (all, if fewer), the largest first."""
    return -np.sort(-np.partition(sims, -k, axis=1)[:, -k:] if sims.shape[1] > k else -sims, axis=1)


def scored_against(vectors: DataFrame, references: DataFrame, id_col: str, ref_col: str, vector_col: str, k: int = 3, median: bool = True) -> DataFrame:
    """Per vector: mean, median, max similarity to the references, mean of the k best, nearest reference (ties: smallest id).

    Null vectors take no part, on either side. Without references there are no rows. Without ``median`` that is null.
    """
    vectors, references = (rows.filter(F.col(vector_col).isNotNull()) for rows in (vectors, references))
    first = references.select(F.size(vector_col)).first()
    most = max(1, MOST_NUMBERS // max(1, first[0])) if first else 0
    held = sorted(references.select(ref_col, vector_col).limit(most + 1).collect(), key=lambda r: r[0])
    if len(held) > most or not held:
        return scored_by_blocks(vectors, references, id_col, ref_col, vector_col, k, median) if held else vectors.sparkSession.createDataFrame([], _score_schema(vectors, references, id_col, ref_col))
    names, matrix = [r[0] for r in held], np.array([r[1] for r in held], np.float64)
    told = vectors.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches):
        ids, m = told.value
        for pdf in batches:
            if not len(pdf):
                continue
            a = np.array(pdf[vector_col].tolist(), np.float64)
            for own, sims in products(a, m):
                at, top = nearest_of(a[own], m, sims)
                middle = np.median(sims, axis=1) if median else None
                yield pd.DataFrame({id_col: pdf[id_col].iloc[own], "sim_mean": sims.mean(axis=1), "sim_median": middle, "sim_max": top, "sim_top": best_of(sims, k).mean(axis=1), "nearest": [ids[j] for j in at]})

    # a small file is one split, but may be much work
    dealt = vectors.select(id_col, vector_col).repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)
    return dealt.mapInPandas(run, _score_schema(vectors, references, id_col, ref_col))


def _score_schema(vectors, references, id_col, ref_col) -> str:
    return f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, sim_mean double, sim_median double, sim_max double, sim_top double, nearest {references.schema[ref_col].dataType.simpleString()}"


def _blocked(rows: DataFrame, id_col: str, vector_col: str, block: str, rows_of_block: int) -> DataFrame:
    """A row for each block: its number and an array of id and vector, ordered by id. Ids are keys: blocks are their hashes."""
    blocks = max(1, -(-rows.count() // rows_of_block))
    dealt = rows.select(F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias(block), F.struct(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).alias("_x"))
    return settle(dealt.groupBy(block).agg(F.sort_array(F.collect_list("_x")).alias(f"{block}_rows")))


def _met_blocks(batches):
    """Of each pair of blocks: rows and matrix of the left side, those of the right one."""
    for pdf in batches:
        for left, right in zip(pdf["l_rows"], pdf["r_rows"], strict=True):
            yield left, np.array([x["v"] for x in left], np.float64), right, np.array([x["v"] for x in right], np.float64)


def scored_by_blocks(vectors: DataFrame, references: DataFrame, id_col: str, ref_col: str, vector_col: str, k: int = 3, median: bool = True) -> DataFrame:
    """As ``scored_against``, for any number of references.

    A first round of products gives for each vector and block of references count, sum, the k best, the nearest and a
    histogram of ``BINS`` bins between bounds that the norms give. Counts of bins tell in which of them the median's
    one or two values lie, and at which place; a second round gives the different values in these bins and how often
    each occurs. So means, best ones and the median are exact, and no task holds all similarities of a vector.
    """
    width = references.select(F.size(vector_col)).first()[0]
    size = max(1, BLOCK_NUMBERS // max(1, width))
    left, right = _blocked(vectors, id_col, vector_col, "l", size), _blocked(references, ref_col, vector_col, "r", size)
    every_block = F.explode(F.sequence(F.lit(0), F.lit(right.agg(F.max("r")).first()[0])))
    norm = float(references.agg(F.max(F.sqrt(dot(F.col(vector_col), F.col(vector_col))))).first()[0])
    met = left.withColumn("r", every_block).join(right, "r")
    kinds = vectors.schema[id_col].dataType.simpleString(), references.schema[ref_col].dataType.simpleString()

    def bins_of(a, sims):
        reach = np.maximum(np.sqrt((a**2).sum(axis=1)) * norm, 1e-300)
        return np.clip(((sims / reach[:, None] + 1) / 2 * BINS).astype(np.int64), 0, BINS - 1)

    def summed(batches):
        for left_rows, a, right_rows, b in _met_blocks(batches):
            for own, sims in products(a, b):
                # references come by id, so of equal ones the first is the smallest
                at, top = nearest_of(a[own], b, sims)
                counts = [np.bincount(row, minlength=BINS) for row in bins_of(a[own], sims)] if median else [np.zeros(0, np.int64)] * len(sims)
                yield pd.DataFrame({"id": [x["id"] for x in left_rows[own]], "n": sims.shape[1], "total": sims.sum(axis=1), "best": list(best_of(sims, k)), "top": top, "nearest": [right_rows[j]["id"] for j in at], "bins": [np.flatnonzero(c) for c in counts], "counts": [c[c > 0] for c in counts]})

    first = met.select("l_rows", "r_rows").mapInPandas(summed, f"id {kinds[0]}, n long, total double, best array<double>, top double, nearest {kinds[1]}, bins array<long>, counts array<long>")
    first = settle(first)
    means = first.groupBy("id").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("sim_mean"), F.max("top").alias("sim_max"), F.min(F.struct((-F.col("top")).alias("s"), "nearest")).alias("_m"))
    of_vector = Window.partitionBy("id").orderBy(F.desc("s"))
    tops = first.select("id", F.explode("best").alias("s")).withColumn("_r", F.row_number().over(of_vector)).filter(F.col("_r") <= k).groupBy("id").agg(F.avg("s").alias("sim_top"))

    if not median:
        out = means.join(tops, "id")
        return out.select(F.col("id").alias(id_col), "sim_mean", F.lit(None).cast("double").alias("sim_median"), "sim_max", "sim_top", F.col("_m.nearest").alias("nearest"))

    # the bins of places (n - 1) // 2 and n // 2, and how many values lie in bins before
    counted = first.select("id", F.explode(F.arrays_zip("bins", "counts")).alias("c")).groupBy("id", F.col("c.bins").alias("bin")).agg(F.sum("c.counts").alias("c"))
    before = F.sum("c").over(Window.partitionBy("id").orderBy("bin")) - F.col("c")
    placed = counted.withColumn("before", before).join(means.select("id", ((F.col("n") - 1) / 2).cast("long").alias("p0"), (F.col("n") / 2).cast("long").alias("p1")), "id")
    within = lambda p: (F.col(p) >= F.col("before")) & (F.col(p) < F.col("before") + F.col("c"))
    wanted = settle(placed.filter(within("p0") | within("p1")).select("id", "bin", "before", "p0", "p1"))
    asked = wanted.groupBy("id").agg(F.array_sort(F.collect_list("bin")).alias("bins"))  # two at most
    marked = left.select("l", F.explode("l_rows").alias("x")).select("l", "x.*").join(asked, "id").groupBy("l").agg(F.sort_array(F.collect_list(F.struct("id", "v", "bins"))).alias("l_rows"))
    met = marked.withColumn("r", every_block).join(right, "r")

    def values(batches):
        for left_rows, a, _, b in _met_blocks(batches):
            for own, sims in products(a, b):
                bins, asked = bins_of(a[own], sims), [x["bins"] for x in left_rows[own]]
                for place in range(2):
                    wanted_bin = np.array([x[place] if len(x) > place else -1 for x in asked])
                    row, col = np.nonzero(bins == wanted_bin[:, None])
                    found, counts = np.unique(np.stack([row, sims[row, col]]), axis=1, return_counts=True) if len(row) else (np.zeros((2, 0)), row)
                    rows = found[0].astype(np.int64)
                    if len(rows):
                        yield pd.DataFrame({"id": [left_rows[own][j]["id"] for j in rows], "bin": wanted_bin[rows], "s": found[1], "c": counts})

    told = met.select("l_rows", "r_rows").mapInPandas(values, f"id {kinds[0]}, bin long, s double, c long").groupBy("id", "bin", "s").agg(F.sum("c").alias("c")).join(wanted, ["id", "bin"])
    upto = F.sum("c").over(Window.partitionBy("id", "bin").orderBy("s")) + F.col("before")
    told = told.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("c"))
    at = lambda p: F.max(F.when((F.col(p) >= F.col("start")) & (F.col(p) < F.col("upto")), F.col("s")))
    medians = told.groupBy("id").agg(((at("p0") + at("p1")) / 2).alias("sim_median"))
    out = means.join(tops, "id").join(medians, "id")
    return out.select(F.col("id").alias(id_col), "sim_mean", "sim_median", "sim_max", "sim_top", F.col("_m.nearest").alias("nearest"))


def diversity(rows: DataFrame, group: str, vector_col: str, width: int) -> DataFrame:
    """Mean of 1 - similarity over all pairs of a group; null for fewer than two rows or a missing vector.

    The sum over all pairs is (|sum of vectors|^2 - sum of |vector|^2) / 2, so no pairs are made.
    """
    sums = [F.sum(F.get(vector_col, F.lit(i)).cast("double")).alias(f"_s{i}") for i in range(width)]
    own = F.sum(dot(F.col(vector_col), F.col(vector_col))).alias("_own")
    made = rows.groupBy(group).agg(F.count("*").alias("n"), F.count(vector_col).alias("_held"), own, *sums)
    whole = sum((F.col(f"_s{i}") * F.col(f"_s{i}") for i in range(1, width)), F.col("_s0") * F.col("_s0"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    value = 1 - (whole - F.col("_own")) / 2 / pairs
    return made.select(group, "n", F.when((F.col("n") > 1) & (F.col("n") == F.col("_held")), value).alias("diversity"))


def exact_mean(value: Column, digits: int = 4, held: int = 4) -> Column:
    """The mean of numbers of ``held`` decimals, rounded half up from whole numbers, so that sums have no order."""
    total, n = F.sum(F.round(value * 10**held).cast("long")), F.count(value)
    unit = 10 ** (held - digits)
    return F.when(n > 0, F.floor((2 * total + unit * n) / (2 * unit * n)) / 10**digits)


def delta_stats(pairs: DataFrame, metrics: list[str]) -> DataFrame:
    """For each metric of paired runs (x and base_x): means of both sides, mean difference, how many pairs rise.

    Metrics have four decimals at most.
    """
    stacked = pairs.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x"), F.col(f"base_{m}").alias("y")) for m in metrics])).alias("r")).select("r.*")
    d = F.col("x") - F.col("y")
    return stacked.groupBy("metric").agg(
        exact_mean(F.col("x")).alias("run_mean"),
        exact_mean(F.col("y")).alias("base_mean"),
        exact_mean(d).alias("mean_delta"),
        F.concat(F.count_if(d > 0).cast("string"), F.lit("/"), F.count(d).cast("string"), F.lit(" pairs")).alias("higher_in"),
    )
