"""Exact Jaccard self-join of word-shingle sets by token-combination prefixes.

Tokens (shingles) are ordered rare first, by how often their words occur in all documents. A set's prefix is extended until any partner must share one signature
with it: single tokens of the rare class, pairs of tokens of one frequent class. Signatures meet in buckets; each
document is verified against the smallest document that it meets first, components are formed, and then every pair
that meets and that components do not join yet is verified. Two sets that lead with rare tokens alone must share
several of them (what their sizes demand); short buckets count these, pair by pair. Groups of similar texts so cost as many checks as they
have members, and no link is lost.

Which tokens are frequent (and their order) is a table of at most twice ``most_frequent`` tokens, the largest counts
of all documents' leading tokens and of those behind them where too few of the leading are rare; it steers cost
alone, never results.

Defined cases: null and empty texts have no shingles and link with nothing, nor do rows with a null id (their
component is null); equal sets always link; repeated ids count as one document; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import Words, bound_batches, bucket_count, by_bucket, exchange, mix, shuffle_partitions, signed, split_by_bucket, stash, text_slices
from gleanery.llm.components import connected_components

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Sets at least this large take many frequent classes, smaller ones few; those near the border take both.
LARGE, MANY_CLASSES = 64, 32
WORD_CLASSES = 1 << 18
FREQUENT_BITS = np.uint64(24)  # a token's class goes by its hash without these low bits
FLUSH = 250_000  # rows that a task holds before it sends them on
SKETCH = 128  # counters of a sketch
PAIR = np.uint64(1)  # the low bit of a signature of two tokens


def shingle_set(words: np.ndarray, k: int, weights: np.ndarray) -> np.ndarray:
    """Distinct hashes of the k-word shingles of a text's word hashes, the likely rarest first.

    weights: for each class of words (by the hash's low bits) the logarithm of its count.
    """
    n = min(k, len(words))
    if not n:
        return words
    weight = weights[words & np.uint64(len(weights) - 1)]
    found, total = words[: len(words) - n + 1].copy(), weight[: len(words) - n + 1].copy()
    for i in range(1, n):
        found = found * BASE + words[i : len(words) - n + 1 + i]
        total += weight[i : len(words) - n + 1 + i]
    found, first = np.unique(mix(found + np.uint64(n)), return_index=True)
    return found[np.argsort(total[first], kind="stable")]


def shingle_sets(cutter: Words, texts: list[str | None], k: int, weights: np.ndarray):
    hashes, at = cutter.cut(texts)
    return [shingle_set(hashes[a:b], k, weights) for a, b in zip(at[:-1], at[1:], strict=True)]


def word_weights(docs: DataFrame, classes: int = WORD_CLASSES, fan: int = 16) -> np.ndarray:
    """Of every class of words its count over all documents, as rounded multiples of a logarithm: a table of fixed size."""
    parts = 16

    def count(batches):
        import pyarrow as pa

        cutter, counts = Words(lower=True), np.zeros(classes, np.int64)
        for batch in batches:
            for (texts,) in text_slices(batch, ["text"]):
                words, _ = cutter.cut(texts)
                counts += np.bincount((words & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
        rows = [(p, counts[p * step : (p + 1) * step]) for p in range(parts) if counts.any()]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([c.tobytes() for _, c in rows], pa.binary())], names=["bucket", "counts"])

    def add(batches):
        import pyarrow as pa

        now, total = None, None
        for batch in batches:
            for p, c in zip(batch.column("bucket").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if p != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["bucket", "counts"])
                    now, total = p, np.zeros(classes // parts, np.int64)
                total = total + np.frombuffer(c, np.int64)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["bucket", "counts"])

    # in two steps, as every task sends a whole table
    step = classes // parts
    spread = docs.select("text").mapInArrow(count, "bucket int, counts binary").withColumn("bucket", F.col("bucket") * fan + F.pmod(F.spark_partition_id(), F.lit(fan)))
    first = exchange(spread).mapInArrow(add, "bucket int, counts binary").withColumn("bucket", F.floor(F.col("bucket") / fan).cast("int"))
    out = np.zeros(classes, np.int64)
    for row in exchange(first).mapInArrow(add, "bucket int, counts binary").collect():
        out[row["bucket"] * step : (row["bucket"] + 1) * step] = np.frombuffer(row["counts"], np.int64)
    return np.round(4 * np.log2(out + 1)).astype(np.int32)


def missing_at_most(n: int, percent: int) -> int:
    """Tokens of a set of n that a partner may lack: n less the least overlap."""
    return n - -(-percent * n // 100)


def few_classes(percent: int) -> int:
    """So many frequent classes of pairs that the smallest set that can have an unequal partner still has a signature."""
    least = max(1, math.ceil(percent / (100 - percent)))
    return max(1, -(-percent * least // 100) - 1)


def signatures(tokens: np.ndarray, percent: int, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set: single rare tokens, and pairs of frequent ones if the rare are too few.

    frequent: sorted keys of the frequent tokens; rank: their order by count.
    """
    n = len(tokens)
    if n < percent / (100 - percent):  # only equal sets reach the threshold
        return tokens[:0], tokens[:0]
    need = missing_at_most(n, percent) + 1
    often, at = is_frequent(tokens, frequent)
    rare = tokens[~often] & ~PAIR
    if len(rare) >= need:
        return rare[:need], tokens[:0]
    out = []
    for scheme, classes in ((1, few_classes(percent)), (2, MANY_CLASSES)):
        if scheme == 1 and n * percent > LARGE * 100 or scheme == 2 and n * 100 < LARGE * percent:
            continue
        common = tokens[often]
        common = common[np.lexsort((common, rank[at[often]]))]
        kind = (mix(common >> FREQUENT_BITS) % np.uint64(classes)).astype(np.int64)
        # cover grows by one with every frequent token that is not the first of its class
        _, first = np.unique(kind, return_index=True)
        grows = np.ones(len(common), np.int64)
        grows[first] = 0
        end = int(np.searchsorted(len(rare) + np.cumsum(grows), need)) + 1
        common, kind = common[:end], kind[:end]
        for c in np.unique(kind):
            own = common[kind == c]
            i, j = np.triu_indices(len(own), 1)
            out.append(mix((own[i] * BASE + own[j]) ^ np.uint64(scheme)) | PAIR)
    return rare, np.concatenate(out)


def _sets_and_counts(docs: DataFrame, k: int, percent: int, told, buckets: int) -> DataFrame:
    """Per document its set's size and 128-bit key; beside these, blobs of its leading tokens for counting."""

    def run(batches):
        import pyarrow as pa

        cutter, seen, held, size = Words(lower=True), set(), [], 0
        empty = lambda n, kind: pa.nulls(n, kind)
        names = ["id", "n", "k1", "k2", "bucket", "tokens", "sets"]

        def flush():
            batch = _count_blobs(held, buckets)
            m = batch.num_rows
            return pa.RecordBatch.from_arrays([*[empty(m, pa.int64()) for _ in range(4)], *batch.columns], names=names)

        for batch in batches:
            for texts, ids in text_slices(batch, ["text", "id"]):
                rows = []
                for tokens, doc in zip(shingle_sets(cutter, texts, k, told.value[0]), ids, strict=True):
                    key = xxhash.xxh3_128_intdigest(tokens.tobytes())
                    rows.append((doc, len(tokens), signed(key >> 64), signed(key & (1 << 64) - 1)))
                    if key not in seen:
                        if len(seen) < 500_000:
                            seen.add(key)
                        held.append((tokens[: leading(len(tokens), percent)], key))
                        size += len(held[-1][0])
                columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, empty(len(rows), pa.int32()), *[empty(len(rows), pa.binary())] * 2], names=names)
                if size >= 4 * FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return docs.mapInArrow(run, "id long, n long, k1 long, k2 long, bucket int, tokens binary, sets binary")


def _count_blobs(held: list[tuple[np.ndarray, int]], buckets: int):
    """A batch of blobs of tokens to count, each with a mark of its set, so that copies of a set count once."""
    tokens = np.concatenate([t for t, _ in held]) >> FREQUENT_BITS
    sets = np.repeat(np.array([key & 0xFFFFFFFF for _, key in held], np.uint32), [len(t) for t, _ in held])
    held.clear()
    return split_by_bucket((tokens % np.uint64(buckets)).astype(np.int64), {"tokens": tokens, "sets": sets})


def leading(n: int, percent: int) -> int:
    """So many of a set's first tokens are counted at once."""
    return 3 * (missing_at_most(n, percent) + 1)


def _counts_behind(docs: DataFrame, k: int, percent: int, told, buckets: int) -> DataFrame:
    """Blobs of the tokens behind the leading ones, of sets that have too few rare tokens among these."""

    def run(batches):
        cutter, seen, held, size = Words(lower=True), set(), [], 0
        for batch in batches:
            for (texts,) in text_slices(batch, ["text"]):
                weights, frequent = told.value
                for tokens in shingle_sets(cutter, texts, k, weights):
                    first = leading(len(tokens), percent)
                    rare = int((~is_frequent(tokens[:first], frequent)[0]).sum())
                    if rare > missing_at_most(len(tokens), percent):
                        continue
                    key = xxhash.xxh3_128_intdigest(tokens.tobytes())
                    if key not in seen:
                        if len(seen) < 500_000:
                            seen.add(key)
                        held.append((tokens[first:], key))
                        size += len(held[-1][0])
                if size >= 4 * FLUSH:
                    yield _count_blobs(held, buckets)
                    size = 0
        if size:
            yield _count_blobs(held, buckets)

    return docs.select("text").mapInArrow(run, "bucket int, tokens binary, sets binary")


def is_frequent(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are frequent, and their places among the frequent ones' keys."""
    keys = tokens >> FREQUENT_BITS
    at = np.searchsorted(frequent, keys)
    at[at == len(frequent)] = 0
    return (frequent[at] == keys if len(frequent) else np.zeros(len(tokens), bool)), at


def _frequent(blobs: DataFrame, least: int, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the frequent tokens, sorted, and their counts; at most ``most`` of them."""

    def run(batches):
        import pyarrow as pa

        for _, held in by_bucket(batches, {"tokens": np.uint64, "sets": np.uint32}):
            order = np.lexsort((held["sets"], held["tokens"]))
            tokens, sets = held["tokens"][order], held["sets"][order]
            found, counts = np.unique(tokens[np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (sets[1:] != sets[:-1])])], return_counts=True)
            keep = counts >= least
            yield pa.RecordBatch.from_arrays([pa.array(found[keep].astype(np.int64)), pa.array(counts[keep].astype(np.int64))], names=["token", "docs"])

    counted = stash(exchange(blobs, buckets).mapInArrow(run, "token long, docs long"), "frequent")
    sizes = counted.groupBy(F.floor(F.log2("docs") * 4).alias("q")).agg(F.count("*").alias("c"), F.min("docs").alias("from")).orderBy(F.desc("q")).collect()
    total, start = 0, None
    for row in sizes:  # a few dozen rows
        total += row["c"]
        if total > most:
            break
        start = row["from"]
    if start is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counted.filter(F.col("docs") >= start).toPandas().sort_values("token")
    return rows["token"].to_numpy().astype(np.uint64), rows["docs"].to_numpy()


def _merged(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of either, and their order by count."""
    tokens, back = np.unique(np.concatenate([one[0], two[0]]), return_inverse=True)
    docs = np.zeros(len(tokens), np.int64)
    np.add.at(docs, back, np.concatenate([one[1], two[1]]))
    rank = np.empty(len(docs), np.int64)
    rank[np.lexsort((tokens, docs))] = np.arange(len(docs))
    return tokens, rank


def least_overlap(n, m, percent: int):
    return -(-percent * (n + m) // (100 + percent))


def least_shared(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """How many single tokens two sets of n and m tokens, that lead with p and q single tokens, share at least.

    A set with fewer than it needs leads with all its rare tokens.
    """
    all_rare = (p <= missing_at_most(n, percent)) & (q <= missing_at_most(m, percent))
    behind = np.where(all_rare, np.minimum(n - p, m - q), np.maximum(n - p, m - q))
    return least_overlap(n, m, percent) - behind


def pairs_within(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of each run of elements: runs begin at start and have size elements."""
    left, right = [], []
    for m in np.unique(size):
        i, j = np.triu_indices(m, 1)
        own = start[size == m][:, None]
        left.append((own + i).ravel())
        right.append((own + j).ravel())
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _postings(docs: DataFrame, k: int, percent: int, weights, frequent, rank, buckets: int, short: int = 48) -> DataFrame:
    """What meets in signatures. Of buckets of frequent pairs, and of long ones: sig, head, id, n, p (its single
    tokens); the head is the document of the fewest rare tokens, so the likeliest origin of copies. Of pairs in short
    buckets of single tokens: head, id, n (what they must share), shared; sig is null."""
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast((weights, frequent, rank))

    def emit(batches):
        cutter, seen, held, size = Words(lower=True), set(), [], 0

        def flush():
            sig, doc, n, p, own = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return split_by_bucket((mix(sig) % np.uint64(buckets)).astype(np.int64), {"sig": sig, "id": doc, "n": n, "p": p, "set": own})

        for batch in batches:
            for texts, ids in text_slices(batch, ["text", "id"]):
                for tokens, doc in zip(shingle_sets(cutter, texts, k, told.value[0]), ids, strict=True):
                    key = xxhash.xxh3_128_intdigest(tokens.tobytes())
                    if key in seen:  # its first copy of this task stands for it
                        continue
                    if len(seen) < 500_000:
                        seen.add(key)
                    single, paired = signatures(tokens, percent, *told.value[1:])
                    m = len(single) + len(paired)
                    if m:
                        held.append((np.concatenate([single, paired]), np.full(m, doc, np.int64), np.full(m, len(tokens), np.int32), np.full(m, len(single), np.int32), np.full(m, key & (1 << 64) - 1, np.uint64)))
                        size += m
                        if size >= FLUSH:
                            yield flush()
                            size = 0
        if size:
            yield flush()

    def meet(batches):
        import pyarrow as pa

        names = ["sig", "head", "id", "n", "p", "shared"]

        def rows(*columns):
            for a in range(0, len(columns[1]), FLUSH):
                yield pa.RecordBatch.from_arrays([pa.nulls(min(FLUSH, len(columns[1]) - a), pa.int64()) if c is None else pa.array(c[a : a + FLUSH].astype(np.int64)) for c in columns], names=names)

        for _, held in by_bucket(batches, {"sig": np.uint64, "id": np.int64, "n": np.int32, "p": np.int32, "set": np.uint64}):
            # of copies of one set, from several tasks, the smallest document stands for all
            order = np.lexsort((held["id"], held["set"], held["sig"]))
            sig, own = held["sig"][order], held["set"][order]
            once = order[np.concatenate([[True], (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])])]
            held = {c: x[once] for c, x in held.items()}
            order = np.lexsort((held["id"], held["p"], held["sig"]))
            sig, doc, n, p = (held[c][order].astype(np.int64 if c != "sig" else np.uint64) for c in ("sig", "id", "n", "p"))
            start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            size = np.diff(np.concatenate([start, [len(sig)]]))
            single = (sig[start] & PAIR) == 0
            counted = single & (size > 1) & (size <= short)
            i, j = pairs_within(start[counted], size[counted])
            fits = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (doc[i] != doc[j])
            i, j = i[fits], j[fits]
            order = np.lexsort((doc[j], doc[i]))
            i, j = i[order], j[order]
            if len(i):
                first = np.flatnonzero(np.concatenate([[True], (doc[i][1:] != doc[i][:-1]) | (doc[j][1:] != doc[j][:-1])]))
                times = np.diff(np.concatenate([first, [len(i)]]))
                i, j = i[first], j[first]
                yield from rows(None, doc[i], doc[j], np.maximum(1, least_shared(n[i], p[i], n[j], p[j], percent)), None, times)
            keep = np.repeat((size > 1) & ~counted, size)
            # without a shared single token, a set of too many rare tokens links with no set of at least its size
            keep &= np.repeat(single, size) | (n - p >= least_overlap(n, -(-percent * n // 100), percent))
            group = np.repeat(np.arange(len(start)), size)
            at = np.flatnonzero(keep)
            group = group[at]
            if len(at):
                new = np.concatenate([[True], group[1:] != group[:-1]])
                run = np.cumsum(new) - 1
                several = (np.bincount(run) > 1)[run]
                head = doc[at[np.flatnonzero(new)[run]]]
                yield from rows(sig[at[several]], head[several], doc[at[several]], n[at[several]], p[at[several]], None)

    blobs = docs.mapInArrow(emit, "bucket int, sig binary, id binary, n binary, p binary, set binary")
    return exchange(blobs, buckets).mapInArrow(meet, "sig long, head long, id long, n long, p long, shared long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("left")), "a")
    both = first.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def sketch(tokens: np.ndarray) -> bytes:
    """Counts of a set's tokens by hash, capped at a byte. Two sketches never differ by more than their sets do."""
    return np.minimum(np.bincount((tokens >> np.uint64(57)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def _across(members: DataFrame, sketches: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """Pairs of one bucket in different components, of sizes, single tokens and sketches that allow the threshold.

    members: sig, id, n, p, component. Buckets of one component are left out before anything is dealt; a bucket of more
    than ``block`` members is cut into blocks, and each two of these meet in a task of their own.
    """
    several = members.groupBy("sig").agg(F.count("*").alias("_m"), F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low < _high")
    several = several.select("sig", F.ceil(F.col("_m") / block).cast("int").alias("_blocks"))
    held = members.join(several, "sig").join(sketches, "id").withColumn("own", F.pmod(F.xxhash64("id"), "_blocks").cast("int"))
    held = held.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    held = held.withColumn("one", F.least("own", "_other")).withColumn("two", F.greatest("own", "_other"))

    def run(batches):
        import pyarrow as pa

        def changes(sig, one, two):
            return np.concatenate([[True], (sig[1:] != sig[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])])

        def pairs(sig, one, two, own, doc, n, p, component, sketches):
            start = np.flatnonzero(changes(sig, one, two))
            for a, b in zip(start, [*start[1:], len(sig)], strict=True):
                if (component[a:b] == component[a]).all():
                    continue
                d, m, r, c, o = doc[a:b], n[a:b], p[a:b], component[a:b], own[a:b]
                paired, cross = bool(sig[a] & 1), one[a] != two[a]
                for i in range(len(d) - 1):  # in order of single tokens, so the first of a pair is its head
                    x, y = slice(i, i + 1), slice(i + 1, None)
                    fits = (c[y] != c[x]) & (100 * np.minimum(m[x], m[y]) >= percent * np.maximum(m[x], m[y])) & (d[y] != d[x])
                    if cross:
                        fits &= o[y] != o[x]
                    if paired:
                        fits &= least_shared(m[x], r[x], m[y], r[y], percent) <= 0
                    at = np.flatnonzero(fits) + i + 1
                    if len(at):
                        apart = np.abs(sketches[a + at].astype(np.int16) - sketches[a + i]).sum(axis=1)
                        at = at[(100 + percent) * apart <= (100 - percent) * (m[i] + m[at])]
                    if len(at):
                        yield np.full(len(at), d[i]), d[at]

        held, size = [], 0
        make = lambda x: pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["a", "b"])
        names = ("sig", "one", "two", "own", "id", "n", "p", "component")
        rest = [*[np.zeros(0, np.int64)] * len(names), np.zeros((0, SKETCH), np.uint8)]
        for batch in _with_end(batches):
            if batch is None:
                now, rest = rest, None
            else:
                new = [np.asarray(batch.column(c)) for c in names]
                new.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH))
                now = [np.concatenate([r, x]) for r, x in zip(rest, new, strict=True)]
                cut = int(np.flatnonzero(changes(*now[:3]))[-1]) if len(now[0]) else 0  # the last blocks may go on
                rest, now = [x[cut:] for x in now], [x[:cut] for x in now]
            if len(now[0]):
                for pair in pairs(*now):
                    held.append(pair)
                    size += len(pair[0])
                    if size >= FLUSH:
                        yield make([np.concatenate(x) for x in zip(*held, strict=True)])
                        held, size = [], 0
        if size:
            yield make([np.concatenate(x) for x in zip(*held, strict=True)])

    dealt = held.repartition(shuffle_partitions(members.sparkSession), "sig", "one", "two").sortWithinPartitions("sig", "one", "two", "p", "id")
    return dealt.select("sig", "one", "two", "own", "id", "n", "p", "component", "sketch").mapInArrow(run, "a long, b long")


def _with_end(batches):
    yield from batches
    yield None


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", frequent_from: int = 32, most_frequent: int = 1 << 20) -> DataFrame:
    """Per document: id, n_shingles, component (smallest id that links reach).

    Two documents link when 100 * intersection >= percent * union of their sets of k-word shingles.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be 80 to 100: below, small sets have no pair of frequent tokens")
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = rows.filter("id IS NOT NULL")
    weights, buckets = word_weights(named), bucket_count(named)
    told = docs.sparkSession.sparkContext.broadcast((weights,))
    first = stash(_sets_and_counts(named, k, percent, told, buckets), "sets")
    sizes = first.filter("bucket IS NULL").select("id", "n", "k1", "k2")
    ahead = _frequent(first.filter("bucket IS NOT NULL").select("bucket", "tokens", "sets"), frequent_from, most_frequent, buckets)
    behind = _counts_behind(named, k, percent, docs.sparkSession.sparkContext.broadcast((weights, ahead[0])), buckets)
    frequent, rank = _merged(ahead, _frequent(behind, frequent_from, most_frequent, buckets))
    members = stash(_postings(named, k, percent, weights, frequent, rank, buckets), "postings")

    counted = members.filter("sig IS NULL").groupBy(F.col("head").alias("a"), F.col("id").alias("b")).agg(F.sum("shared").alias("shared"), F.max("n").alias("least"))
    near = stash(counted.filter("shared >= least").select("a", "b", "shared"), "near")
    members = members.filter("sig IS NOT NULL").select("sig", "head", "id", "n", "p")

    def token_sets(batches):
        import pyarrow as pa

        cutter = Words(lower=True)
        for batch in batches:
            for texts, ids in text_slices(batch, ["text", "id"]):
                sets = shingle_sets(cutter, texts, k, told.value[0])
                columns = [pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([sketch(x) for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names=["id", "tokens", "sketch"])

    met = members.select("id").union(near.select("a")).union(near.select("b")).distinct()
    sets = stash(named.join(met, "id", "left_semi").select("text", "id").mapInArrow(token_sets, "id long, tokens binary, sketch binary"), "met-sets")
    # a document is held first against the head that it meets in most ways
    heads = members.filter("id <> head").groupBy(F.col("head").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("c")).unionByName(near.select("a", "b", F.col("shared").alias("c")))
    stars = stash(heads.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b"), "stars")
    links = stash(_verified(stars, sets, percent), "links")
    linked = stash(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "linked")
    placed = members.join(linked.withColumnRenamed("node", "id"), "id", "left").select("sig", "id", "n", "p", F.coalesce("component", "id").alias("component"))
    placed = stash(placed, "placed")
    apart = near.select("a", "b")
    for end in ("a", "b"):
        apart = apart.join(linked.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    apart = apart.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    rest = _across(placed, sets.select("id", "sketch").dropDuplicates(["id"]), percent).union(apart).distinct().join(stars, ["a", "b"], "left_anti")
    more = _verified(rest, sets, percent)
    # documents with equal sets link to the smallest of them
    # written first, so that the join deals out both sides itself and can split a set of many copies
    copies = stash(sizes.filter("n > 0").groupBy("n", "k1", "k2").agg(F.min("id").alias("rep")), "copies")
    named_sets = sizes.join(copies, ["n", "k1", "k2"], "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("rep"))
    named_sets = stash(named_sets, "representatives")
    edges = links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v"))
    to_rep = named_sets.filter("id <> rep")
    for end in ("u", "v"):
        edges = edges.join(to_rep.select(F.col("id").alias(end), F.col("rep")), end, "left").withColumn(end, F.coalesce("rep", end)).drop("rep")
    found = connected_components(edges).withColumnRenamed("node", "rep")
    out = named_sets.join(found, "rep", "left").select("id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumnRenamed("id", id_col)


#: DuckDB SQL for the documents table, three-word shingles and nine tenths.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p + 1 : p + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 2, 1))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT a, a FROM both_ways UNION SELECT doc_id, b FROM reach JOIN both_ways ON other = a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM (SELECT DISTINCT doc_id FROM w) LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""
