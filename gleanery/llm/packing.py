"""Vector bin packing of training examples into sequences.

Every example demands a vector: tokens, one segment, loss-bearing tokens. A sequence offers a vector of limits.
Of the examples that fit, the one with the largest dot product of demand and remaining room goes in next
(both as shares of the limits). What no example fits is filled by cutting one.

Packing runs inside map tasks, over groups of a bounded number of examples and tokens in input order, so nothing is
shuffled and no task holds more than one group. Only full sequences leave a group; what is left of it goes on to the
next one. At a task's end, and where more is left than ``MOST_LEFT`` examples (tiny ones alone reach the segments before
the tokens), sequences end at a power of two, so they need no padding. ``fill_report`` tells how full sequences are.

Defined cases: a null or empty text is its end id alone; repeated ids and rows are packed each for itself; an
empty table gives no rows; columns of the input other than the id and the text are not read.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import Words, bound_batches, text_slices

MOST_LEFT, GROUP_TOKENS = 2_048, 1_000_000
PIECES = "{id} {id_type}, start long, length long, loss long, ids binary, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


class Merges:
    """Byte-pair merges of many words at once, for words of Latin letters under word_bpe_49k's rules.

    In each step every word makes its merge of the lowest rank, the leftmost of equal ones, as the tokenizer does.
    """

    PLAIN = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
    NEVER = np.int32(1 << 30)

    def __init__(self, model: dict):
        vocab = model["vocab"]
        # the printable stand-ins of bytes that byte-level vocabularies use
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand_in, extra = {b: chr(b) for b in shown}, 0
        for b in range(256):
            if b not in stand_in:
                stand_in[b] = chr(256 + extra)
                extra += 1
        self.inner = np.array([vocab[stand_in[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[stand_in[b] + "</w>"] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in pairs], np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left << 20 | right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        # most look-ups end at an empty slot of this table
        self.slot = np.zeros(1 << 20, bool)
        self.slot[self._slot(keys)] = True

    @staticmethod
    def _slot(keys):
        return (keys * 0x9E3779B1 >> 11) & ((1 << 20) - 1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.full(left.shape, self.NEVER)
        key = left.astype(np.int64) << 20 | right
        at = np.flatnonzero((right >= 0) & (left >= 0) & self.slot[self._slot(key)])
        key = key.ravel()[at]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[found] == key
        out.ravel()[at[hit]] = self.order[found[hit]]
        return out

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the words, and in it their numbers of ids and all ids."""
        raw = [w.lower().encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        counts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        order = np.argsort(sizes, kind="stable")
        for at in range(0, len(order), 8_000):
            part = order[at : at + 8_000]
            size, width = sizes[part], int(sizes[part[-1]])
            flat = np.frombuffer(b"".join([raw[k] for k in part.tolist()]), np.uint8)
            ids = np.full((len(part), width + 1), -1, np.int32)
            row = np.repeat(np.arange(len(part)), size)
            ids[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = self.inner[flat]
            ids[np.arange(len(part)), size - 1] = self.final[flat[np.cumsum(size) - 1]]
            rank = np.concatenate([self.ranks(ids[:, :-1], ids[:, 1:]), np.full((len(part), 1), self.NEVER)], axis=1)
            live, columns = np.arange(len(part)), np.arange(width + 1)
            done = ids.copy()
            while True:
                j = rank.argmin(axis=1)
                each = np.arange(len(live))
                best = rank[each, j]
                go = best < self.NEVER
                if not go.all():
                    done[live[~go]] = ids[~go]
                    live, ids, rank, j, best = live[go], ids[go], rank[go], j[go], best[go]
                    each = np.arange(len(live))
                if not len(live):
                    break
                ids[each, j] = self.made[best]
                take = np.minimum(columns + (columns > j[:, None]), width)
                ids, rank = np.take_along_axis(ids, take, axis=1), np.take_along_axis(rank, take, axis=1)
                ids[:, width], rank[:, width] = -1, self.NEVER
                rank[each, j] = self.ranks(ids[each, j], ids[each, np.minimum(j + 1, width)])
                back = np.flatnonzero(j)
                rank[back, j[back] - 1] = self.ranks(ids[back, j[back] - 1], ids[back, j[back]])
            counts.append((done >= 0).sum(axis=1))
            found.append(done[done >= 0])
        return order, np.concatenate(counts), np.concatenate(found)


class Ids:
    """Token ids of a text as little-endian uint32 bytes, by a memo of the ids of its parts.

    Right for tokenizers that never join characters across ASCII white space, lower-case, and part letters from
    punctuation, as word_bpe_49k does: a text's ids are those of its parts in order. Parts are known by 64-bit hashes.
    Whether a tokenizer does is tried on ``PROBES``; one that does not encodes whole texts.
    """

    #: Texts whose parts other tokenizers do not keep apart.
    PROBES = ("It's a long-winded TEST, isn't it? 3.5 km (or 1,234.56)!", "Été à Århus: ßtraße naïve Ærø… «ça» l'été", "tab\tnew\nline  two   blanks ", " leading and trailing ", "unbelievable internationalization antidisestablishmentarianism", "x=1;y_z+=a->b['k'] // http://a.b/c?d=e&f#g", "日本語のテキスト и русский текст", "CamelCase ALLCAPS mixed123 abc4def", "")

    def __init__(self, path: str, most: int = 2_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.cutter = Words(lower=True, part_letters=True)
        model = json.loads(self.tokenizer.to_str())["model"]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        try:
            self.merges = Merges(model) if model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" else None
        except KeyError:  # another alphabet of bytes
            self.merges = None
        self.by_parts = True
        self._clear()
        probes = list(self.PROBES)
        self.by_parts = self.of(probes) == self._whole(probes)
        self._clear()

    def _whole(self, texts: list[str | None]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]

    def _clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.begin, self.size, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, "<u4"), 0

    def _learn(self, hashes: list[int], parts: list[str]) -> list[int]:
        """Takes up the ids of parts; the row of each."""
        plain = [k for k, x in enumerate(parts) if self.merges and Merges.PLAIN(x)]
        other = sorted(set(range(len(parts))).difference(plain))
        order, counts, flat = self.merges.encode([parts[k] for k in plain]) if plain else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        rest = [found.ids for found in self.encode([parts[k] for k in other], add_special_tokens=False)]
        places = [*np.array(plain, np.int64)[order].tolist(), *other]
        sizes = np.concatenate([counts, np.fromiter(map(len, rest), np.int64, len(rest))])
        row, end = len(self.rows), self.used + int(sizes.sum())
        while row + len(parts) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : end] = np.concatenate([flat, np.array([i for ids in rest for i in ids], np.int64)])
        self.begin[row : row + len(parts)] = self.used + np.cumsum(sizes) - sizes
        self.size[row : row + len(parts)] = sizes
        self.used = end
        out = [0] * len(parts)
        for k, place in enumerate(places, row):
            out[place] = k
        self.rows.update(zip(hashes, out, strict=True))
        return out

    def of(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_parts:
            return self._whole(texts)
        hashes, at, joined, starts, ends = self.cutter.spans(texts)
        if len(self.rows) > self.most:
            self._clear()
        found, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        known = found.tolist()
        held = list(map(self.rows.get, known))
        if None in held:
            new = [k for k, row in enumerate(held) if row is None]
            places = first[new]
            parts = [joined[a:b].decode("utf-8", "replace") for a, b in zip(starts[places].tolist(), ends[places].tolist(), strict=True)]
            for k, row in zip(new, self._learn([known[k] for k in new], parts), strict=True):
                held[k] = row
        rows = np.array(held, np.int64)[back]
        sizes = self.size[rows]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.flat[np.repeat(self.begin[rows] - upto[:-1], sizes) + np.arange(upto[-1])]
        cuts = upto[at].tolist()
        out = [flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for k, text in enumerate(texts):  # special tokens reach over parts
            if text and "<" in text and any(x in text for x in self.special):
                out[k] = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return out


class Loss:
    """Loss-bearing tokens in any span of an example: all of them, or those of a 0/1 mask."""

    def __init__(self, mask: np.ndarray | None = None):
        self.sums = None if mask is None else np.concatenate([[0], np.cumsum(mask)])

    def of(self, start: int, end: int) -> int:
        return end - start if self.sums is None else int(self.sums[end] - self.sums[start])

    def longest(self, start: int, end: int, room: int) -> int:
        """The largest end of a piece from start with at most ``room`` loss-bearing tokens."""
        if self.sums is None:
            return min(end, start + room)
        return min(end, int(np.searchsorted(self.sums, self.sums[start] + room, "right")) - 1)


def pack_group(lengths: list[int], losses: list[Loss], limits: Limits, starts: list[int] | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences, as lists of (example, start, end), of all that is left of examples from their starts on."""
    return pack_some(lengths, losses, limits, starts or [0] * len(lengths), True)[0]


def pack_some(lengths: list[int], losses: list[Loss], limits: Limits, starts: list[int], final: bool) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
    """As pack_group(); unless final, full sequences alone, and where the rest of each example starts."""
    sequences: list[list[tuple[int, int, int]]] = []
    start = list(starts)
    for k, n in enumerate(lengths):  # what fills a sequence alone
        while n - start[k] >= limits.tokens and losses[k].of(start[k], start[k] + limits.tokens) <= limits.loss:
            sequences.append([(k, start[k], start[k] + limits.tokens)])
            start[k] += limits.tokens
    owner = np.array([k for k, n in enumerate(lengths) if n > start[k]], dtype=np.int64)
    begin = np.array([start[k] for k in owner], dtype=np.int64)
    end = np.array([lengths[k] for k in owner], dtype=np.int64)
    scale = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
    need = np.array([[e - b, 1, losses[k].of(b, e)] for k, b, e in zip(owner, begin, end, strict=True)], dtype=float).reshape(-1, 3) / scale
    alive = np.ones(len(owner), dtype=bool)

    def take(j: int, upto: int, bin_: list) -> None:
        bin_.append((int(owner[j]), int(begin[j]), int(upto)))
        begin[j] = upto
        alive[j] = begin[j] < end[j]
        need[j] = np.array([end[j] - begin[j], 1, losses[owner[j]].of(int(begin[j]), int(end[j]))]) / scale

    def give_back(piece: tuple[int, int, int], keep: int, bin_: list) -> None:
        """Cuts a piece at the end of a sequence to ``keep`` tokens; the rest waits again."""
        k, b, e = piece
        j = int(np.flatnonzero(owner == k)[0])
        begin[j] = b + keep
        alive[j] = True
        need[j] = np.array([end[j] - begin[j], 1, losses[k].of(int(begin[j]), int(end[j]))]) / scale
        if keep:
            bin_.append((k, b, b + keep))

    while alive.any():
        room, bin_ = np.ones(3), []
        while True:
            tokens = round(room[0] * limits.tokens)
            if not tokens or round(room[1] * limits.segments) < 1:
                break
            score = need @ room
            score[~((need <= room + 1e-9).all(axis=1) & alive)] = -1.0
            j = int(score.argmax())
            if score[j] >= 0:
                upto = int(end[j])
            else:
                score = np.where(alive, need @ room, -1.0)
                j = int(score.argmax())
                if not alive[j]:
                    break
                spare = round(room[2] * limits.loss)
                upto = losses[owner[j]].longest(int(begin[j]), min(int(end[j]), int(begin[j]) + tokens), spare)
                if upto <= begin[j]:
                    break
            room = room - np.array([upto - begin[j], 1, 0]) / scale
            room[2] -= losses[owner[j]].of(int(begin[j]), upto) / limits.loss
            take(j, upto, bin_)
        total = sum(e - b for _, b, e in bin_)
        if total < limits.tokens and not final:
            for k, b, _ in bin_:  # pieces of one example lie in order
                at = int(np.flatnonzero(owner == k)[0])
                begin[at] = min(begin[at], b)
            break
        if total < limits.tokens and total & (total - 1):  # end at a power of two
            keep = 1 << (total.bit_length() - 1)
            held, bin_, at = bin_, [], 0
            for piece in held:
                size = piece[2] - piece[1]
                if at + size <= keep:
                    bin_.append(piece)
                else:
                    give_back(piece, max(0, keep - at), bin_)
                at += size
        sequences.append(bin_)
    for k, b in zip(owner.tolist(), begin.tolist(), strict=True):
        start[k] = b
    return sequences, start


def fill_report(pieces: DataFrame, tokens: int = 2048) -> DataFrame:
    """One row: sequences, tokens, padding (to ``tokens``, none at a power of two), the share of tokens that is no padding, and of full sequences."""
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.bit_count("n") == 1
    padding = F.when(power, 0).otherwise(tokens - F.col("n"))
    return sizes.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(padding).alias("padding"), (F.sum("n") / F.sum(F.col("n") + padding)).alias("fill"), F.avg((F.col("n") == tokens).cast("int")).alias("full"))


def pack_examples(
    rows: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None, end_id: int | None = 1, group: int = 512, loss_pattern: str | None = None
) -> DataFrame:
    """Pieces of all texts: id, start, length, loss, ids, doc_tokens, sequence_id, offset.

    loss_pattern: a regular expression; only chunks of a text after a match of it and before the next blank line
    bear loss (for instruction data, such as ``assistant:``). None: every token does.
    """
    bound_batches(rows.sparkSession)
    limits = limits or Limits()
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        import os
        import re

        import pyarrow as pa

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        ids = Ids(tokenizer_path)
        waiting: list[tuple] = []  # key, part, ids, loss, where its rest starts
        new = size = number = 0
        names = [id_col, "start", "length", "loss", "ids", "doc_tokens", "sequence_id", "offset"]
        types = None

        def losses_of(text: str | None, found: bytes) -> Loss:
            if loss_pattern is None:
                return Loss()
            spans = [m.end() for m in re.finditer(loss_pattern, text or "")]
            mask = np.zeros(len(found) // 4, dtype=np.int64)
            for b in spans:
                e = (text or "").find("\n\n", b)
                e = len(text or "") if e < 0 else e
                before, inside = (len(x) // 4 for x in ids.of([(text or "")[:b], (text or "")[b:e]]))
                mask[before : before + inside] = 1
            return Loss(mask)

        def flush(final):
            nonlocal number, waiting, new, size
            out: list[list] = [[] for _ in names]
            lengths = [len(x[2]) // 4 for x in waiting]
            sequences, starts = pack_some(lengths, [x[3] for x in waiting], limits, [x[4] for x in waiting], final or len(waiting) - new > MOST_LEFT)
            for pieces in sequences:
                offset = 0
                for k, b, e in pieces:
                    key, part, found, loss, _ = waiting[k]
                    for column, value in zip(out, (key, b, e - b, loss.of(b, e), found[4 * b : 4 * e], lengths[k], (part << 33) | number, offset), strict=True):
                        column.append(value)
                    offset += e - b
                number += bool(pieces)
            waiting = [(*x[:4], b) for x, b, n in zip(waiting, starts, lengths, strict=True) if b < n]
            new = size = 0
            return pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(out, types, strict=True)], names=names)

        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for batch in batches:
            types = [batch.schema.field(id_col).type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for texts, keys, parts in text_slices(batch, [text_col, id_col, "_part"], 3_000_000):
                for text, key, part, found in zip(texts, keys, parts, ids.of(texts), strict=True):
                    found += tail
                    if found:
                        waiting.append((key, part, found, losses_of(text, found), 0))
                        new += 1
                        size += len(found) // 4
                    if new >= group or size >= GROUP_TOKENS:
                        yield flush(False)
        if waiting:
            yield flush(True)

    part: Column = F.spark_partition_id().cast("long").alias("_part")
    return rows.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col), part).mapInArrow(run, PIECES.format(id=f"`{id_col}`", id_type=kind))
