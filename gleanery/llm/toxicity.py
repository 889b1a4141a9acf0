"""Toxicity: a bidirectional gated recurrent network with attention pooling, over characters and words, in numpy.

Every word enters as a hashed word embedding beside the mean of its hashed character n-gram embeddings. A word of
more than ``WORD_BYTES`` bytes (text without white space) is cut at its punctuation as well, and what is still longer
into overlapping pieces that hold all its characters: each an input of its own. Windows of
``WINDOW`` words at every ``STRIDE``-th word, the last ending with the text, run through a GRU in both directions; attention pools
the states to one logit. A text's score is the largest of its windows' probabilities. Training picks, for each
labelled text, the window that scores highest so far, as only some windows of a toxic text hold what makes it so.

Training rows are bounded by ``most_rows`` and ``most_chars`` of each label (a documented sample, by a hash of the id);
ids come first, so that no table of texts is shuffled. Everything else reads whole texts in one map. A passage of up to
WINDOW - STRIDE words lies whole in some window, a longer one in parts of at least that size.

Defined cases: null and empty texts have the score of an empty window; rows with a null id are scored and never
learned from; of rows that repeat an id the least text is learned from; repeated rows are scored alike; without labelled rows of both kinds every score is 0; an empty table
gives no rows; other columns are not read unless they are asked to pass through.
"""

from __future__ import annotations

import re
import string
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import bound_batches, text_slices

WINDOW, STRIDE, LEARNED_STRIDE = 32, 10, 20  # fewer windows are learned from than scored
WORD_BYTES, PIECE, PIECE_STEP = 200, 48, 40  # a piece's characters have at most 192 bytes; the overlap holds any n-gram
WORDS, GRAMS, WIDTH, HIDDEN, ATTEND = 1 << 12, 1 << 13, 8, 8, 8
NGRAMS = (3, 4, 5)
PUNCTUATION = string.punctuation + "¡¿«»…“”„‘’"
JOINTS = re.compile(f"[{re.escape(PUNCTUATION)}、。，．！？；：・「」『』（）]+")


def is_long(word: str) -> bool:
    return len(word) > WORD_BYTES // 4 and len(word.encode("utf-8", "surrogatepass")) > WORD_BYTES


def word_pieces(word: str) -> list[str]:
    """Inputs of a long word: the words that punctuation joins in it, long ones as overlapping pieces."""
    out = []
    for w in JOINTS.split(word):
        out += [w[k : k + PIECE] for k in range(0, len(w) - PIECE + PIECE_STEP, PIECE_STEP)] if is_long(w) else [w] if w else []
    return out or [""]


def split_words(text: str | None) -> list[str]:
    words = (text or "").lower().split()
    if max(map(len, words), default=0) <= WORD_BYTES // 4:
        return words
    return [x for w in words for x in (word_pieces(w) if is_long(w) else (w,))]


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of normalised words: their word class, the flat classes of their n-grams and where each word's begin."""
    kinds = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) & (WORDS - 1) for w in words), np.int64, len(words))
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">\0\0\0" for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(raw)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat)) - 3  # bytes up to the closing one
    rolled, found, own = np.zeros(len(flat), np.uint32), [], []
    for n in range(1, max(NGRAMS) + 1):
        rolled[: len(flat) - n + 1] = rolled[: len(flat) - n + 1] * np.uint32(0x01000193) + flat[n - 1 :] + np.uint32(1)
        if n in NGRAMS:
            at = np.flatnonzero(left >= n)
            h = rolled[at]
            found.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19)).astype(np.int64))
            own.append(owner[at])
    found, own = np.concatenate(found), np.concatenate(own)
    order = np.argsort(own, kind="stable")
    counts = np.bincount(own, minlength=len(words))
    return kinds, found[order], np.concatenate([[0], np.cumsum(counts)])


class Net:
    """The network; parameters are float32 arrays in ``p``."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) * (0.3 if s[0] > 100 else 1 / np.sqrt(s[0]))).astype(np.float32)
        d, h = 2 * WIDTH, HIDDEN
        self.p = {"word": init(WORDS, WIDTH), "gram": init(GRAMS, WIDTH), "att": init(2 * h, ATTEND), "query": init(ATTEND), "out": init(2 * h), "bias": np.full(1, -1.0, np.float32)}
        for way in "fb":
            self.p |= {f"W{way}": init(d, 3 * h), f"U{way}": init(h, 3 * h), f"c{way}": np.zeros(3 * h, np.float32)}

    def embed(self, kinds, grams, starts):
        counts = np.maximum(1, np.diff(starts))
        sums = np.zeros((len(kinds), WIDTH), np.float32)
        full = np.flatnonzero(np.diff(starts) > 0)
        if len(full):
            sums[full] = np.add.reduceat(self.p["gram"][grams], starts[full], axis=0)
        # common character strings cancel out in a mean, so it counts by the root
        return np.concatenate([self.p["word"][kinds], sums / np.sqrt(counts)[:, None].astype(np.float32)], axis=1)

    def project(self, x):
        """Input parts of all gates: forward and backward side by side."""
        return np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], axis=1)

    def run(self, gates, mask=None, keep=False):
        """gates: time, row, 6 * HIDDEN. Logits; with keep, also what backward() needs."""
        t, b, h = gates.shape[0], gates.shape[1], HIDDEN
        states = np.zeros((t, b, 2 * h), np.float32)
        trace = {}
        for way, order, at in (("f", range(t), 0), ("b", range(t - 1, -1, -1), 1)):
            u, state = self.p[f"U{way}"], np.zeros((b, h), np.float32)
            for k in order:
                g, hu = gates[k, :, 3 * h * at : 3 * h * (at + 1)], state @ u
                zr = sigmoid(g[:, : 2 * h] + hu[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                n = np.tanh(g[:, 2 * h :] + r * hu[:, 2 * h :])
                new = n + z * (state - n)
                if mask is not None:
                    new = np.where(mask[k][:, None], new, state)
                if keep:
                    trace[way, k] = (state, z, r, n, hu[:, 2 * h :])
                state = new
                states[k, :, h * at : h * (at + 1)] = state
        seen = np.tanh(states @ self.p["att"])
        a = seen @ self.p["query"]
        if mask is not None:
            a = np.where(mask, a, -1e9)
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * states).sum(axis=0)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (states, seen, a, pooled, trace)) if keep else logit

    def backward(self, mask, saved, dlogit):
        """Gradients of the parameters above the inputs, and of the gates."""
        states, seen, a, pooled, trace = saved
        t, b, h = states.shape[0], states.shape[1], HIDDEN
        g = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * self.p["out"]
        da = (states * dpool).sum(axis=2)
        da = a * (da - (a * da).sum(axis=0))
        dseen = da[:, :, None] * self.p["query"] * (1 - seen**2)
        g["query"] = (seen * da[:, :, None]).sum(axis=(0, 1))
        g["att"] = np.tensordot(states, dseen, ((0, 1), (0, 1)))
        dstates = a[:, :, None] * dpool + dseen @ self.p["att"].T
        dgates = np.zeros((t, b, 6 * h), np.float32)
        for way, order, at in (("f", range(t - 1, -1, -1), 0), ("b", range(t), 1)):
            u, carry, du = self.p[f"U{way}"], np.zeros((b, h), np.float32), np.zeros_like(self.p[f"U{way}"])
            for k in order:
                state, z, r, n, hun = trace[way, k]
                d = carry + dstates[k, :, h * at : h * (at + 1)]
                m = mask[k][:, None]
                own = d * m
                dn = own * (1 - z) * (1 - n**2)
                dz = own * (state - n) * z * (1 - z)
                dr = dn * hun * r * (1 - r)
                dhu = np.concatenate([dz, dr, dn * r], axis=1)
                dgates[k, :, 3 * h * at : 3 * h * (at + 1)] = np.concatenate([dz, dr, dn], axis=1)
                du += state.T @ dhu
                carry = dhu @ u.T + own * z + d * (1 - m)
            g[f"U{way}"] = du
        return g, dgates


def cut_windows(n: int, stride: int = STRIDE) -> list[int]:
    """Starts of the windows of a text of n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, stride), n - WINDOW]


def vocabulary_inputs(words: list[str], step: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_inputs of many words, in narrow types."""
    parts = [word_inputs(words[k : k + step]) for k in range(0, len(words), step)]
    ends = np.cumsum([p[2][-1] for p in parts])
    starts = np.concatenate([np.zeros(1, np.int64), *[p[2][1:] + before for p, before in zip(parts, [0, *ends[:-1]], strict=True)]])
    return np.concatenate([p[0] for p in parts]).astype(np.int32), np.concatenate([p[1] for p in parts]).astype(np.int16), starts


def vocabulary_gates(net: Net, kinds: np.ndarray, grams: np.ndarray, starts: np.ndarray, step: int = 20_000) -> np.ndarray:
    out = np.empty((len(kinds), 6 * HIDDEN), np.float32)
    for k in range(0, len(kinds), step):
        own = starts[k : k + step + 1]
        out[k : k + step] = net.project(net.embed(kinds[k : k + step], grams[own[0] : own[-1]], own - own[0]))
    return out


def best_windows(net: Net, gates: np.ndarray, ids: list[np.ndarray], windows: list[list[int]], step: int = 128) -> list[int]:
    """Of every text the start of the window that scores highest."""
    out: list[int] = []
    for k in range(0, len(ids), step):
        part, starts = ids[k : k + step], windows[k : k + step]
        flat = np.concatenate(part)
        base = np.cumsum([0, *map(len, part)])
        first = np.concatenate([base[j] + np.array(w) for j, w in enumerate(starts)])
        room = np.concatenate([np.full(len(w), min(WINDOW, len(part[j]))) for j, w in enumerate(starts)])
        logits = np.concatenate([_masked(net, gates, flat, first[m : m + 2048], room[m : m + 2048]) for m in range(0, len(first), 2048)])
        ends = np.cumsum([len(w) for w in starts])
        out += [w[int(logits[e - len(w) : e].argmax())] for w, e in zip(starts, ends, strict=True)]
    return out


def _masked(net: Net, gates: np.ndarray, flat: np.ndarray, first: np.ndarray, room: np.ndarray) -> np.ndarray:
    at = np.arange(WINDOW)[:, None]
    return net.run(gates[flat[first + np.minimum(at, room - 1)]], None if (room == WINDOW).all() else at < room)


class Scorer:
    """Scores texts with a trained net, by a bounded memo of words' gate inputs."""

    def __init__(self, net: Net, most: int = 250_000):
        self.net, self.most = net, most
        self._clear()

    def _clear(self):
        self.raw, self.plain = {}, {}
        self.gates = np.zeros((1024, 6 * HIDDEN), np.float32)

    def _learn(self, new: list[str]) -> None:
        plain = [w.strip(PUNCTUATION) for w in new]
        fresh = list({w for w in plain}.difference(self.plain))
        if fresh:
            at = len(self.plain)
            for k, w in enumerate(fresh):
                self.plain[w] = at + k
            while at + len(fresh) > len(self.gates):
                self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
            for k in range(0, len(fresh), 20_000):
                part = fresh[k : k + 20_000]
                self.gates[at + k : at + k + len(part)] = self.net.project(self.net.embed(*word_inputs(part)))
        for w, p in zip(new, plain, strict=True):
            self.raw[w] = self.plain[p]

    def window_logits(self, texts: list[str | None]) -> list[np.ndarray]:
        """The logits of every window of every text."""
        split = [split_words(t) for t in texts]
        if len(self.raw) > self.most:
            self._clear()
        new = list(set().union(*split).difference(self.raw))
        if new:
            self._learn(new)
        get = self.raw.__getitem__
        starts = [cut_windows(len(w)) for w in split]
        flat = np.fromiter((i for w in split for i in map(get, w)), np.int64, sum(map(len, split)))
        base = np.concatenate([[0], np.cumsum([len(w) for w in split])])
        first = np.array([base[k] + s for k, each in enumerate(starts) for s in each], dtype=np.int64)
        room = np.array([min(WINDOW, len(split[k])) for k, each in enumerate(starts) for _ in each], dtype=np.int64)
        logits = np.full(len(first), self.net.p["bias"][0], np.float32)
        full = np.flatnonzero(room == WINDOW)
        for k in range(0, len(full), 2048):
            at = full[k : k + 2048]
            logits[at] = self.net.run(self.gates[flat[first[at] + np.arange(WINDOW)[:, None]]])
        short = np.flatnonzero((room < WINDOW) & (room > 0))
        for k in range(0, len(short), 2048):
            at = short[k : k + 2048]
            mask = np.arange(WINDOW)[:, None] < room[at]
            logits[at] = self.net.run(self.gates[flat[first[at] + np.minimum(np.arange(WINDOW)[:, None], room[at] - 1)]], mask)
        return np.split(logits, np.cumsum([len(s) for s in starts])[:-1]) if texts else []

    def score(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(np.array([x.max() for x in self.window_logits(texts)], dtype=np.float64))


def train(texts: list[str | None], labels: list[int], seed: int = 7, steps: int = 700, batch: int = 96, rate: float = 0.01) -> Net | None:
    """A net trained on labelled texts; None unless both labels occur."""
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    r, net = np.random.default_rng(seed), Net(seed)
    # texts become numbers one by one: the driver holds each different word once
    vocab: dict[str, int] = {}
    ids = []
    for text in texts:
        words = [w.strip(PUNCTUATION) for w in split_words(text)] or [""]
        ids.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int32, len(words)))
    kinds, grams, starts = vocabulary_inputs(list(vocab))
    del vocab
    windows = [cut_windows(len(x), LEARNED_STRIDE) for x in ids]
    pos, neg = np.flatnonzero(y > 0.5), np.flatnonzero(y < 0.5)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    best: list[int] | None = None
    for step in range(1, steps + 1):
        if step > steps // 7 and step % max(1, steps // 7) == 1:  # look for the windows that count
            gates = vocabulary_gates(net, kinds, grams, starts)
            best = best_windows(net, gates, ids, windows)
            del gates
        rows = np.concatenate([r.choice(pos, batch // 2), r.choice(neg, batch - batch // 2)])
        at = [best[k] if best and (y[k] > 0.5 or r.random() < 0.5) else int(r.choice(windows[k])) for k in rows]
        room = np.array([min(WINDOW, len(ids[k])) for k in rows])
        mask = np.arange(WINDOW)[:, None] < room
        words = np.stack([np.concatenate([w := ids[k][s : s + WINDOW], np.full(WINDOW - len(w), w[-1])]) for k, s in zip(rows, at, strict=True)], axis=1)
        used, back = np.unique(words, return_inverse=True)
        sizes = starts[used + 1] - starts[used]
        own = np.concatenate([[0], np.cumsum(sizes)])
        part = grams[np.repeat(starts[used] - own[:-1], sizes) + np.arange(own[-1])]
        x = net.embed(kinds[used], part, own)
        gates = net.project(x)[back.reshape(words.shape)]
        logit, saved = net.run(gates, mask, keep=True)
        g, dgates = net.backward(mask, saved, (sigmoid(logit) - y[rows]).astype(np.float32) / len(rows))
        sums = np.zeros((len(used), 6 * HIDDEN), np.float32)
        np.add.at(sums, back.ravel(), dgates.reshape(-1, 6 * HIDDEN))
        h3 = 3 * HIDDEN
        g |= {"Wf": x.T @ sums[:, :h3], "Wb": x.T @ sums[:, h3:], "cf": sums[:, :h3].sum(axis=0), "cb": sums[:, h3:].sum(axis=0)}
        dx = sums[:, :h3] @ net.p["Wf"].T + sums[:, h3:] @ net.p["Wb"].T
        g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
        np.add.at(g["word"], kinds[used], dx[:, :WIDTH])
        np.add.at(g["gram"], part, np.repeat(dx[:, WIDTH:] / np.sqrt(np.maximum(1, sizes))[:, None].astype(np.float32), sizes, axis=0))
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        now = rate * (1 - 0.9 * step / steps)
        for k, v in g.items():
            v = v * min(1.0, 5.0 / (norm + 1e-9)) + (1e-5 * net.p[k] if k in ("word", "gram") else 0)
            m, s = moment[k]
            m += 0.1 * (v - m)
            s += 0.01 * (v**2 - s)
            net.p[k] -= (now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int = 2000, most_chars: int = 20_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list, list]:
    """Texts and labels to learn from: of each label at most most_rows ids with crc32(id) mod 5 not 0, by a hash of the id,
    as many of these as hold most_chars characters together (one at least)."""
    key = F.col(id_col).cast("string")
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (F.crc32(key) % 5 != 0)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    chosen = [usable.filter(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(most_rows) for y in (0, 1)]
    ids = {row[0]: row[1] for row in chosen[0].unionByName(chosen[1]).collect()}  # at most 2 * most_rows
    chosen = docs.filter(F.col(id_col).isin(list(ids))).groupBy(id_col).agg(F.min(text_col).alias("t"))
    sizes = {row[0]: row[1] or 0 for row in chosen.select(id_col, F.length("t")).collect()} if ids else {}
    held = dict.fromkeys((0, 1), 0)
    for k in list(ids):  # in order of the hash
        before, held[ids[k]] = held[ids[k]], held[ids[k]] + sizes.get(k, 0)
        if before and held[ids[k]] > most_chars:
            del ids[k]
    rows = chosen.filter(F.col(id_col).isin(list(ids))).collect() if ids else []
    rows.sort(key=lambda x: x[0])
    return [row[1] for row in rows], [ids[row[0]] for row in rows]


def score_toxicity(docs: DataFrame, net: Net | None, text_col: str = "text", to: str = "score", keep_text: bool = True) -> DataFrame:
    """The table with a score of every whole text, 0 to 1; without the text column if keep_text is false."""
    spark = docs.sparkSession
    bound_batches(spark)
    plain = [c for c in docs.columns if c != to and (keep_text or c != text_col)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*plain).schema) + f", `{to}` double"
    told = spark.sparkContext.broadcast(net)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(told.value) if told.value is not None else None
        for batch in batches:
            scores: list[float] = []
            for (texts,) in text_slices(batch, [text_col], 2_000_000):
                scores += list(scorer.score(texts)) if scorer else [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in plain], pa.array(scores, pa.float64())], names=[*plain, to])

    return docs.select(*dict.fromkeys([*plain, text_col])).mapInArrow(run, schema)
