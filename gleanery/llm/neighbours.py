"""Approximate nearest neighbours with balanced posting lists.

Centroids come from a balanced k-means on a bounded sample; an in-memory proximity graph finds the nearest centroids
of a vector. Every vector lies in its nearest list; one near a boundary lies in up to ``REPLICAS`` lists, those whose
centroid is not much farther than the nearest and not behind one taken already. A query searches its ``SURE_LISTS``
nearest lists and those whose centroid distance is within a ratio of its nearest; one that met too few candidates
searches again, ``WIDEN`` times as many lists each time and all of them in the end. Lists are split into parts of
bounded size by a hash of the vector, so a list of any size is searched by many tasks; the queries of a list that many
visit are split into blocks likewise, each of which meets every part. Of equal vectors only the
smallest ids can be results, so the others are not indexed; queries of equal vectors are searched once.

The sample for the centroids has at most ``SAMPLE`` vectors, the centroids are at most ``MOST_LISTS``: both bound
what is broadcast. Every vector is indexed. Distances are exact, in double precision, on the original vectors.

Defined cases: vectors that are null, empty, zero, of another length than the first one's, or hold null or
non-finite components take no part, nor do rows with a null id; rows that repeat an id and a vector count once; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import bound_batches, stash

SAMPLE, LIST_ROWS, MOST_LISTS = 20_000, 128, 8_192
REPLICAS, REPLICA_RATIO = 4, 1.25
LEAST_PROBES, PROBED_SHARE, RATIO = 64, 8, 1.8  # lists a query may search: an eighth of all, but 64 at least
SURE_LISTS, WIDEN = 8, 8
PART_ROWS = BLOCK_QUERIES = 2_000


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, fast but rounded."""
    return np.maximum(0, (a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1))


def balanced_centroids(sample: np.ndarray, lists: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """k-means whose assignment charges a list for its size, so that lists stay near the mean size."""
    r = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centres = distinct[r.choice(len(distinct), min(lists, len(distinct)), replace=False)].astype(np.float64)
    fee = np.zeros(len(centres))
    for _ in range(rounds):
        d = squared(sample, centres)
        own = (d + fee).argmin(axis=1)
        size = np.bincount(own, minlength=len(centres))
        fee += 0.1 * d.min(axis=1).mean() * (size / max(1.0, size.mean()) - 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        full = size > 0
        centres[full] = sums[full] / size[full][:, None]
        if not full.all():  # a list without vectors moves into the largest
            away = np.argsort(-size)[: int((~full).sum())]
            centres[~full] = centres[away] + r.normal(0, 1e-3, (len(away), centres.shape[1]))
    return centres


class Graph:
    """A proximity graph over the centroids, searched best first."""

    def __init__(self, centres: np.ndarray, degree: int = 24, seed: int = 3):
        self.centres = centres
        r = np.random.default_rng(seed)
        links = []
        for at in range(0, len(centres), 512):
            d = squared(centres[at : at + 512], centres)
            links.append(np.argsort(d, axis=1)[:, 1 : degree + 1])
        near = np.concatenate(links)
        far = r.integers(0, len(centres), (len(centres), 4))  # a few long links keep the graph in one piece
        back: list[list[int]] = [[] for _ in range(len(centres))]
        for k, row in enumerate(near):
            for other in row[:8]:
                back[int(other)].append(k)
        self.links = [np.unique(np.concatenate([near[k], far[k], np.array(back[k], np.int64)])) for k in range(len(centres))]
        self.entry = np.unique(r.integers(0, len(centres), 8))

    def search(self, vector: np.ndarray, count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found, nearest first, and their distances; width: candidates that stay open."""
        away = lambda rows: np.sqrt(((self.centres[rows] - vector) ** 2).sum(axis=1))
        seen = np.zeros(len(self.centres), bool)
        seen[self.entry] = True
        found = [(-d, int(k)) for d, k in zip(away(self.entry), self.entry, strict=True)]
        heapq.heapify(found)
        open_ = [(-d, k) for d, k in found]
        heapq.heapify(open_)
        while open_:
            d, k = heapq.heappop(open_)
            if len(found) >= width and d > -found[0][0]:
                break
            new = self.links[k][~seen[self.links[k]]]
            seen[new] = True
            for dist, other in zip(away(new).tolist(), new.tolist(), strict=True):
                if len(found) < width or dist < -found[0][0]:
                    heapq.heappush(open_, (dist, other))
                    heapq.heappush(found, (-dist, other))
                    if len(found) > width:
                        heapq.heappop(found)
        best = sorted((-d, k) for d, k in found)[:count]
        return np.array([k for _, k in best], np.int64), np.array([d for d, _ in best])

    def replicas(self, vector: np.ndarray) -> list[int]:
        """Lists that hold a vector: the nearest, and others as near that no taken centroid hides."""
        lists, d = self.search(vector, 16, 32)
        taken: list[int] = []
        for k, dist in zip(lists.tolist(), d.tolist(), strict=True):
            if dist > REPLICA_RATIO * d[0] + 1e-12:
                break
            if all(np.sqrt(((self.centres[k] - self.centres[j]) ** 2).sum()) > dist * 0.6 for j in taken):
                taken.append(k)
            if len(taken) == REPLICAS:
                break
        return taken

    def lists_of(self, query: np.ndarray) -> list[int]:
        probes = max(LEAST_PROBES, len(self.centres) // PROBED_SHARE)
        lists, d = self.search(query, probes, probes + 64)
        return lists[(np.arange(len(d)) < SURE_LISTS) | (d <= RATIO * d[0] + 1e-12)].tolist()

    def nearest_lists(self, query: np.ndarray, count: int) -> list[int]:
        """So many nearest lists by their distances, not by the graph, which may not reach all."""
        return np.argsort(((self.centres - query) ** 2).sum(axis=1), kind="stable")[:count].tolist()


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array of doubles) of the vectors that take part, once each."""
    v = F.col("v")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    out = rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    # -0.0 is 0.0
    return out.filter((F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)).select("id", F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))


def nearest(rows: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each query; queries: ids divisible by ``every``."""
    spark = rows.sparkSession
    bound_batches(spark)
    good = usable(rows, id_col, vector_col)
    first = good.orderBy("id").limit(1).collect()
    width = len(first[0]["v"]) if first else 0
    good = good.filter(F.size("v") == width).withColumn("h", F.xxhash64("v"))
    of_vector = Window.partitionBy("h", "v").orderBy("id")
    # a query's own id may be among the smallest of its vector, so one more stays; equal rows count once
    ranked = good.withColumn("r", F.dense_rank().over(of_vector)).filter(F.col("r") <= k + 1).dropDuplicates(["id", "h", "v"])
    kept = stash(ranked.select("id", "v", "h", "r"), "vectors")
    distinct = kept.filter("r = 1")
    total = distinct.count()
    # of about twice the sample's size, by the hash, the first: what tasks send to the driver has a bound
    some = distinct.filter(F.shiftrightunsigned("h", 1) <= min(2**63 - 1, int(2 * SAMPLE / max(1, total) * 2**63)))
    sample = np.array([row["v"] for row in some.orderBy("h", "id").limit(SAMPLE).select("v").collect()], np.float64).reshape(-1, max(width, 1))
    lists = int(min(MOST_LISTS, max(1, total // LIST_ROWS), max(1, len(sample) // 4)))
    graph = Graph(balanced_centroids(sample, lists)) if len(sample) else None
    told = spark.sparkContext.broadcast(graph)

    def assign(choose):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                at, found = [], []
                vectors = batch.column("v").to_pylist()
                memo: dict = {}
                for j, v in enumerate(vectors):
                    key = tuple(v)
                    if key not in memo:
                        memo[key] = choose(told.value, np.array(v))
                    at += [j] * len(memo[key])
                    found += memo[key]
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("h").take(at), batch.column("v").take(at), pa.array(found, pa.int32())], names=["id", "h", "v", "list"])

        return run

    shape = "id long, h long, v array<double>, list int"
    entries = kept.select("id", "h", "v").mapInArrow(assign(Graph.replicas), shape)
    entries = stash(entries, "posting-lists")
    # parts of a list: enough that each has a bounded number of rows
    sizes = entries.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    parts = np.ones(lists, np.int64)
    for row in sizes.collect():  # at most MOST_LISTS rows
        parts[row["list"]] = row["parts"]
    split = spark.createDataFrame([(k, int(n)) for k, n in enumerate(parts)], "list int, parts int")
    split = F.broadcast(split)
    indexed = entries.join(split, "list").select("list", F.pmod(F.hash("h", "id"), "parts").alias("part"), F.lit(False).alias("query"), "id", "h", "v")
    asked = good.filter(F.pmod("id", F.lit(every)) == 0)
    queries = stash(asked.select("id", "h", "v").distinct(), "vector-queries")
    once = queries.groupBy("h", "v").agg(F.min("id").alias("id")).select("id", "h", "v")

    def meetings(rows, choose):
        """Vectors and queries by list, part and block of queries: a part meets all blocks, a query all parts."""
        sought = stash(rows.mapInArrow(assign(choose), shape), "query-lists")
        blocks = F.broadcast(sought.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks")))  # at most MOST_LISTS rows
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asked = sought.join(split, "list").join(blocks, "list").select("list", each("parts").alias("part"), F.pmod(F.hash("id"), "blocks").alias("block"), F.lit(True).alias("query"), "id", "h", "v")
        return indexed.join(blocks, "list").select("list", "part", each("blocks").alias("block"), "query", "id", "h", "v").unionByName(asked)

    def search(key, pdf):
        import pandas as pd

        # parts and blocks hold bounded rows
        vectors = pdf[~pdf["query"]]
        asked = pdf[pdf["query"]]
        out = []
        if len(vectors) and len(asked):
            x, ids = np.array(vectors["v"].tolist()), vectors["id"].to_numpy()
            order = np.argsort(ids)
            x, ids = x[order], ids[order]
            for at in range(0, len(asked), 256):
                part = asked.iloc[at : at + 256]
                q = np.array(part["v"].tolist())
                rough = squared(q, x)
                for j, qid in enumerate(part["id"]):
                    m = min(len(ids), k + 1)
                    limit = np.partition(rough[j], m - 1)[m - 1]
                    near = np.flatnonzero(rough[j] <= limit + 1e-9 * (1 + limit))
                    d = np.sqrt(((x[near] - q[j]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[near], d))[: k + 1]
                    out.append(pd.DataFrame({"query": qid, "id": ids[near][best], "d": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "d": pd.Series(dtype="float64")})

    def found_by(rows, choose):
        met = meetings(rows, choose).groupBy("list", "part", "block").applyInPandas(search, "query long, id long, d double")
        # one vector may be met in several lists
        met = met.groupBy("query", "id").agg(F.min("d").alias("d"))
        nearest_first = Window.partitionBy("query").orderBy("d", "id")
        return stash(met.withColumn("r", F.row_number().over(nearest_first)).filter(F.col("r") <= k + 1).select("query", "id", "d"), "met-vectors")

    def short_of(rows, found):
        """Queries of rows that met fewer than k + 1 candidates, themselves among them."""
        enough = found.groupBy("query").count().filter(F.col("count") > k).select(F.col("query").alias("id"))
        return stash(rows.join(enough, "id", "left_anti").select("id", "h", "v"), "short-queries")

    best, count = found_by(once, Graph.lists_of), SURE_LISTS
    short = short_of(once, best) if lists > count else None
    while short is not None and not short.isEmpty():
        count = min(lists, count * WIDEN)
        again = found_by(short, lambda graph, v, n=count: graph.nearest_lists(v, n))
        best = best.join(short.select(F.col("id").alias("query")), "query", "left_anti").unionByName(again)
        short = short_of(short, again) if count < lists else None
    # every query of the same vector takes the same answers, but for itself
    same = queries.select(F.col("id").alias("query_id"), "h", "v").join(once.withColumnRenamed("id", "query"), ["h", "v"]).select("query_id", "query")
    answers = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("found"))  # at most k + 1 each
    full = same.join(answers, "query").select("query_id", F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k).alias("found"))
    out = full.select("query_id", F.posexplode("found").alias("r", "x"))
    return out.select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"))
