"""Exact substring deduplication by recompression.

Texts are sequences of word hashes. Rounds name maximal runs of one symbol and then pairs of neighbours (a symbol of
a left class followed by one of a right class); names are hashes of what they stand for and classes are hashes of
names, so all tasks of a round give equal substrings equal names without a table of names. Rounds go on until a text is
one symbol or nothing pairs; symbols of all rounds then meet across the corpus in two Spark rounds:

* The symbols of high rounds, as long as a window or longer, meet by 128 bits made of their words' hashes. Every window inside of
  one that starts earlier elsewhere repeats, and needs no look of its own: a long repeat costs a few symbols.
* A symbol of a low round knows the span of words that decided it. Equal windows have equal symbols wherever that span
  lies inside, so every window takes, of the symbols decided inside it, one of the highest round, of the smallest hash,
  as its witness. Only windows whose witness occurs elsewhere can repeat; those that no long symbol settled are compared
  by 128 bits made of their words' hashes in the second round. The words themselves are known by 64 bits each.

Each window that starts earlier elsewhere has its words removed. A key that a task meets often goes to its bucket once;
what is known to repeat already is spread over all buckets.

Defined cases: null and empty texts have no words; texts shorter than a window stay whole; rows with a null id stay
whole and are not compared; rows of one id are one document (what is removed from one is removed from the other at
the same places, so equal rows stay equal); an empty table gives no rows; other columns pass through, whatever
their names (those that the operator adds replace equal names).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import Words, bound_batches, bucket_count, by_bucket, exchange, mix, split_by_bucket, stash, text_slices

#: Rounds whose symbols keep the span that decides them (further ones outgrow it), and the most rounds in all.
LOW_ROUNDS, ROUNDS = 4, 48
BASE = np.uint64(0xD6E8FEB86659FD93)
SECOND = np.uint64(0xA24BAED4963EE407)  # the base of the second 64 bits of a hash of words
FLUSH = 1_000_000


def _neighbour(values: np.ndarray, same: np.ndarray, back: bool, outside: np.ndarray) -> np.ndarray:
    """Each element's neighbour's value; ``outside`` where the text ends. same[i]: i and i + 1 are of one text."""
    out = outside.copy()
    if back:
        out[1:][same] = values[:-1][same]
    else:
        out[:-1][same] = values[1:][same]
    return out


def recompress(words: np.ndarray, at: np.ndarray, rounds: int = ROUNDS, low_rounds: int = LOW_ROUNDS):
    """After every round the symbols of all texts: round, name, first word, end and, in the first ``low_rounds``, the
    span of words that decides the symbol."""
    n = len(words)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    name, start, end = words, np.arange(n), np.arange(1, n + 1)
    low, high = start, end
    idle = 0
    for number in range(rounds):
        if len(name) < 2 or idle == 8:
            return
        known, before = number < low_rounds, len(name)
        same = text[1:] == text[:-1]
        joins = same & (name[1:] == name[:-1])
        if known or joins.any():
            first = np.flatnonzero(np.concatenate([[True], ~joins]))
            last = np.concatenate([first[1:] - 1, [len(name) - 1]])
            size = last - first + 1
            if known:  # that a run ends must be known
                low, high = _neighbour(low, same, True, at[text] - 1)[first], _neighbour(high, same, False, at[text + 1] + 1)[last]
            name = np.where(size > 1, mix(name[first] + size.astype(np.uint64) * BASE), name[first])
            start, end, text = start[first], end[last], text[first]
            same = text[1:] == text[:-1]
        left = (mix(name + np.uint64(number + 1)) & np.uint64(1)).astype(bool)
        joins = same & left[:-1] & ~left[1:]
        first = np.flatnonzero(np.concatenate([[True], ~joins]))
        last = np.concatenate([first[1:] - 1, [len(name) - 1]])
        pair = last > first
        if known:  # a pair decides itself; a single one of a left class depends on what follows, else on what precedes
            back, ahead = _neighbour(low, same, True, at[text] - 1), _neighbour(high, same, False, at[text + 1] + 1)
            low, high = np.where(pair | left[first], low[first], back[first]), np.where(pair | ~left[first], high[last], ahead[last])
        name = np.where(pair, mix(name[first] * BASE + name[last]), name[first])
        start, end, text = start[first], end[last], text[first]
        idle = idle + 1 if len(name) == before else 0
        yield number, name, start, end, low if known else None, high if known else None


class Windows:
    """Windows of a slice of texts, their witnesses and hashes, and the long symbols."""

    def __init__(self, cutter: Words, texts: list[str | None], width: int, long: bool = True):
        self.width = width
        words, self.at = cutter.cut(texts)
        n = len(words)
        cutter._powers(n + 1)
        up, down = cutter.up, cutter.down
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * up[:n], out=sums[1:])
        more = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(words + SECOND) * up[:n], out=more[1:])
        fits = np.ones(n, bool)
        for a, b in zip(self.at[:-1], self.at[1:], strict=True):
            fits[max(a, b - width + 1) : b] = False
        self.first = np.flatnonzero(fits)  # first words of all windows
        #: 128 bits of the words from i to j, in two arrays
        self.hashes = lambda i, j: (mix((sums[j] - sums[i]) * down[i]), mix((more[j] - more[i]) * down[i] + (j - i).astype(np.uint64)))
        self.hash = lambda i: self.hashes(i, i + width)[0]
        levels, longer, codes = [], [], np.zeros(0, np.int64)
        for number, name, start, end, low, high in recompress(words, self.at, ROUNDS if long else LOW_ROUNDS):
            if number < LOW_ROUNDS:
                text = np.searchsorted(self.at, start, "right") - 1
                inside = (low >= self.at[text]) & (high <= self.at[text + 1]) & (high - low <= width)
                own, a, b = start[inside], low[inside], high[inside]
                # a symbol's key: its name and all words that decide it
                levels.append((own, a, b, mix(mix((sums[b] - sums[a]) * down[a] + (own - a).astype(np.uint64)) + name[inside])))
            big = end - start >= 2 * width
            start, end = start[big], end[big]
            code = start * (n + 1) + end
            fresh = np.isin(code, codes, invert=True)  # long symbols that this round made
            codes = code
            longer.append((start[fresh], end[fresh]))
        empty = np.zeros(0, np.int64)
        self.long_start, self.long_end = (np.concatenate([empty, *[x[k] for x in longer]]) for k in (0, 1))
        self.start, self.key = np.concatenate([empty, *[x[0] for x in levels]]), np.concatenate([np.zeros(0, np.uint64), *[x[3] for x in levels]])
        self.witness = np.full(len(self.first), -1)  # by window; -1: none is decided inside it
        begin = len(self.start)
        for _, low, high, key in reversed(levels):
            begin -= len(key)
            open_ = np.flatnonzero(self.witness < 0)
            starts_before = np.concatenate([[0], np.cumsum(np.bincount(low, minlength=n + 1))])
            closed = np.cumsum(np.bincount(high, minlength=n + 1))
            a, b = starts_before[self.first[open_]], closed[self.first[open_] + width]
            best, least = np.full(len(a), -1), np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
            live = np.flatnonzero(a < b)
            step = 0
            while len(live):
                k = a[live] + step
                better = key[k] < least[live]
                least[live[better]] = key[k[better]]
                best[live[better]] = k[better]
                step += 1
                live = live[a[live] + step < b[live]]
            self.witness[open_[best >= 0]] = begin + best[best >= 0]

    def text_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, word, "right") - 1


#: Kinds of places that are taken home to their document: of witnesses that repeat, and of windows that do.
SEEN, SURE = 0, 1
HOME = "bucket int, id binary, place binary, size binary, what binary"


def _home(ids: np.ndarray, places: np.ndarray, sizes: np.ndarray, what: int, buckets: int):
    """A batch of blobs that takes (id, places from one on) to the bucket of the id."""
    bucket = (mix(ids.astype(np.uint64) + BASE) % np.uint64(buckets)).astype(np.int64)
    return split_by_bucket(bucket, {"id": ids, "place": places.astype(np.int32), "size": sizes.astype(np.int32), "what": np.full(len(ids), what, np.uint8)})


def joined_runs(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> dict[int, bytes]:
    """By id the union of its runs of places, as pairs (first, size) of int32."""
    if not len(ids):
        return {}
    order = np.lexsort((first, ids))
    ids, first, size = ids[order], first[order].astype(np.int64), size[order].astype(np.int64)
    new = np.concatenate([[True], ids[1:] != ids[:-1]])
    apart = (np.cumsum(new) - 1) * (1 << 33)  # ids do not touch each other
    reach = np.maximum.accumulate(apart + first + size)
    opens = np.concatenate([[True], (apart + first)[1:] > reach[:-1]])
    at = np.flatnonzero(opens)
    ends = reach[np.concatenate([at[1:] - 1, [len(ids) - 1]])] - apart[at]
    pairs = np.stack([first[at], ends - first[at]], axis=1).astype(np.int32)
    own = ids[at]
    cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return {int(own[a]): pairs[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(own)], strict=True)}


def _by_id(rows: DataFrame, buckets: int) -> DataFrame:
    """Of _home's blobs: id, seen, sure; the runs of places of each id by kind, null if there are none."""

    def run(batches):
        import pyarrow as pa

        for _, x in by_bucket(batches, {"id": np.int64, "place": np.int32, "size": np.int32, "what": np.uint8}):
            kinds = [joined_runs(x["id"][own], x["place"][own], x["size"][own]) for own in (x["what"] == SEEN, x["what"] == SURE)]
            ids = sorted(kinds[0].keys() | kinds[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array([k.get(i) for i in ids], pa.binary()) for k in kinds]], names=["id", "seen", "sure"])

    return exchange(rows, buckets).mapInArrow(run, "id long, seen binary, sure binary")


def places_of(runs: bytes | None) -> np.ndarray:
    pairs = np.frombuffer(runs or b"", np.int32).reshape(-1, 2).astype(np.int64)
    ends = np.cumsum(pairs[:, 1])
    return np.repeat(pairs[:, 0] - (ends - pairs[:, 1]), pairs[:, 1]) + np.arange(ends[-1] if len(ends) else 0)


class _Outbox:
    """Collects columns (key, id, place first) and gives batches of blobs: one of equal keys goes to the key's bucket, the
    others, known to repeat, to buckets that spread them. Buckets are numbered 2 * bucket + side."""

    COLUMNS = {"key": np.uint64, "key2": np.uint64, "id": np.int64, "place": np.int32, "size": np.int32, "kind": np.uint8}

    def __init__(self, buckets: int, side: int):
        self.buckets, self.side, self.held, self.size = np.uint64(buckets), side, [], 0

    def add(self, **columns) -> None:
        self.held.append(columns)
        self.size += len(columns["key"])

    def flush(self):
        x = {c: np.concatenate([held[c] for held in self.held]) for c in self.held[0]}
        self.held, self.size = [], 0
        wide = [x["key2"]] if "key2" in x else []
        order = np.lexsort((x["place"], x["id"], *wide, x["key"]))
        x = {c: v[order] for c, v in x.items()}
        equal = x["key"][1:] == x["key"][:-1]
        if wide:
            equal &= x["key2"][1:] == x["key2"][:-1]
        twice = equal & (x["id"][1:] == x["id"][:-1]) & (x["place"][1:] == x["place"][:-1])  # equal rows
        if twice.any():
            keep = np.concatenate([[True], ~twice])
            x = {c: v[keep] for c, v in x.items()}
            equal = x["key"][1:] == x["key"][:-1]
            if wide:
                equal &= x["key2"][1:] == x["key2"][:-1]
        again = np.concatenate([[False], equal])
        many = again.copy()
        many[:-1] |= again[1:]
        spread = mix(x["id"].astype(np.uint64) * BASE + x["place"].astype(np.uint64))
        bucket = (np.where(again, spread, mix(x["key"])) % self.buckets).astype(np.int64)
        x["kind"] = many.astype(np.uint8) + again  # 0: alone here, 1: first of several here, 2: a later one
        # keys are random, but ids and places in order take few bytes when shuffled
        order = np.lexsort((x["place"], x["id"], bucket))
        x, bucket, none = {c: v[order] for c, v in x.items()}, bucket[order], np.zeros(0)
        return split_by_bucket(2 * bucket + self.side, {c: x[c].astype(kind) if c in x else none for c, kind in self.COLUMNS.items()})


BLOB = "bucket int, " + ", ".join(f"{c} binary" for c in _Outbox.COLUMNS)


def later_elsewhere(x: dict[str, np.ndarray]) -> np.ndarray:
    """Which rows of a bucket start later than another of the same key (of equal rows none does)."""
    sure = x["kind"] == 2
    rest = np.flatnonzero(~sure)
    order = rest[np.lexsort((x["place"][rest], x["id"][rest], x["key2"][rest], x["key"][rest]))]
    key, key2, ids, places = (x[c][order] for c in ("key", "key2", "id", "place"))
    again = np.concatenate([[False], (key[1:] == key[:-1]) & (key2[1:] == key2[:-1])]) if len(key) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(~again, np.arange(len(key)), 0)) if len(key) else order
    again &= (ids != ids[start]) | (places != places[start])
    out = sure
    out[order[again]] = True
    return out


def _repeats(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """id, seen, sure: first words of the witnesses that occur more than once; windows inside of long symbols that start earlier elsewhere."""

    def emit(batches):
        cutter, low, high = Words(lower=False), _Outbox(buckets, 0), _Outbox(buckets, 1)
        for batch in batches:
            for texts, ids in text_slices(batch, ["text", "id"]):
                ids = np.array(ids, np.int64)
                w = Windows(cutter, texts, width)
                used = np.unique(w.witness[w.witness >= 0])
                text = w.text_of(w.start[used])
                low.add(key=w.key[used], id=ids[text], place=w.start[used] - w.at[text])
                text = w.text_of(w.long_start)
                key, key2 = w.hashes(w.long_start, w.long_end)
                high.add(key=key, key2=key2, id=ids[text], place=w.long_start - w.at[text], size=w.long_end - w.long_start)
                yield from (box.flush() for box in (low, high) if box.size >= FLUSH)
        yield from (box.flush() for box in (low, high) if box.size)

    def repeated(batches):
        for bucket, x in by_bucket(batches, _Outbox.COLUMNS):
            if bucket % 2:
                keep = later_elsewhere(x)
                yield _home(x["id"][keep], x["place"][keep], x["size"][keep] - width + 1, SURE, buckets)
            else:
                _, back, counts = np.unique(x["key"], return_inverse=True, return_counts=True)
                keep = (counts[back] > 1) | (x["kind"] > 0)
                yield _home(x["id"][keep], x["place"][keep], np.ones(int(keep.sum())), SEEN, buckets)

    return _by_id(exchange(docs.mapInArrow(emit, BLOB), buckets).mapInArrow(repeated, HOME), buckets)


def _later_windows(met: DataFrame, width: int, buckets: int) -> DataFrame:
    """met: id, text, seen, sure. id, sure: runs of the windows, of those that are not sure yet, whose words start earlier elsewhere."""

    def emit(batches):
        cutter, out = Words(lower=False), _Outbox(buckets, 0)
        for batch in batches:
            for texts, ids, seen, sure in text_slices(batch, ["text", "id", "seen", "sure"]):
                texts = [None if i is None else t for t, i in zip(texts, ids, strict=True)]
                ids = np.array([i or 0 for i in ids], np.int64)
                w = Windows(cutter, texts, width, long=False)
                hit, settled = (np.zeros(int(w.at[-1]) + 1, bool) for _ in range(2))
                for marks, runs in ((hit, seen), (settled, sure)):
                    for k, own in enumerate(runs):
                        if own:
                            places = places_of(own) + w.at[k]
                            marks[places[places < w.at[k + 1]]] = True
                # a window without a witness is always compared
                open_ = ~settled[w.first]
                told = w.witness >= 0
                open_[told] &= hit[w.start[w.witness[told]]]
                first = w.first[open_]
                text = w.text_of(first)
                if len(first):
                    key, key2 = w.hashes(first, first + width)
                    out.add(key=key, key2=key2, id=ids[text], place=first - w.at[text])
                if out.size >= FLUSH:
                    yield out.flush()
        if out.size:
            yield out.flush()

    def later(batches):
        for _, x in by_bucket(batches, _Outbox.COLUMNS):
            keep = later_elsewhere(x)
            yield _home(x["id"][keep], x["place"][keep], np.ones(int(keep.sum())), SURE, buckets)

    return _by_id(exchange(met.mapInArrow(emit, BLOB), buckets).mapInArrow(later, HOME), buckets)


def deduplicate_substrings(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with ``text_col`` as the words that stay, joined by blanks, and n_words and n_removed."""
    bound_batches(docs.sparkSession)
    named = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    plain = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    # all joins deal the same rows out by the same key, so that Spark deals them once
    base, key = docs.select(*plain), F.col(id_col).cast("long")
    buckets = bucket_count(named)
    repeats = stash(_repeats(named, width, buckets), "repeats").select(F.col("id").alias("_id"), F.col("seen").alias("_seen"), F.col("sure").alias("_sure"))
    met = base.join(repeats, key == F.col("_id"), "left").select(F.col(text_col).alias("text"), key.alias("id"), F.col("_seen").alias("seen"), F.col("_sure").alias("sure"))
    later = _later_windows(met, width, buckets).select("id", "sure")
    # a document's runs of both rounds; at most two rows each
    both = repeats.filter("_sure IS NOT NULL").select(F.col("_id").alias("id"), F.col("_sure").alias("sure")).unionByName(later)
    gone = both.groupBy(F.col("id").alias("_id")).agg(F.collect_list("sure").alias("_gone"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*plain).schema) + ", n_words long, n_removed long"
    text_at = plain.index(text_col)

    def rebuild(batches):
        from itertools import compress

        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                texts, n, removed = [], [], []
                for text, runs in zip(rows.column(text_col).to_pylist(), rows.column("_gone").to_pylist(), strict=True):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    n.append(len(words))
                    if runs:
                        change = np.zeros(len(words) + width + 1, np.int64)
                        pairs = np.frombuffer(b"".join(runs), np.int32).reshape(-1, 2).astype(np.int64)
                        pairs = pairs[pairs[:, 0] + width <= len(words)]  # another row of the id may be longer
                        np.add.at(change, pairs[:, 0], 1)
                        np.add.at(change, np.minimum(pairs.sum(axis=1) - 1 + width, len(words)), -1)
                        words = list(compress(words, (np.cumsum(change)[: len(words)] == 0).tolist()))
                    removed.append(n[-1] - len(words))
                    texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                columns = [rows.column(c) for c in plain]
                columns[text_at] = pa.array(texts, columns[text_at].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=[*plain, "n_words", "n_removed"])

    out = base.join(gone, key == F.col("_id"), "left").drop("_id")
    return out.mapInArrow(rebuild, schema)


#: DuckDB SQL for the documents table and windows of 20 words.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, p, array_to_string(ws[p + 1 : p + 20], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS p FROM w WHERE len(ws) >= 20)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS rn FROM g) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, p + o AS p FROM later, range(20) t(o)),
flat AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM flat ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
