from collections import defaultdict

import numpy as np
import pytest

from gleanery.llm.packing import Ids, Limits, Loss, fill_report, pack_examples, pack_group, pack_some

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("word_bpe_49k.json"))


def whole(lengths, sequences, limits):
    seen = defaultdict(list)
    for pieces in sequences:
        assert sum(e - b for _, b, e in pieces) <= limits.tokens
        assert len(pieces) <= limits.segments
        for k, b, e in pieces:
            assert b < e
            seen[k].append((b, e))
    for k, n in enumerate(lengths):
        at = 0
        for b, e in sorted(seen[k]):
            assert b == at
            at = e
        assert at == n


@pytest.mark.parametrize("seed", range(6))
def test_every_token_lies_in_one_piece_and_limits_hold(seed):
    r = np.random.default_rng(seed)
    lengths = [int(x) for x in r.integers(1, 5000 if seed % 2 else 40, 300)]
    masks = [Loss((r.random(n) < 0.4).astype(int)) for n in lengths]
    limits = Limits(2048, 16, 700)
    sequences = pack_group(lengths, masks, limits)
    whole(lengths, sequences, limits)
    for pieces in sequences:
        assert sum(masks[k].of(b, e) for k, b, e in pieces) <= 700
    plain = pack_group(lengths, [Loss() for _ in lengths], Limits())
    whole(lengths, plain, Limits())
    totals = [sum(e - b for _, b, e in pieces) for pieces in plain]
    assert all(t & (t - 1) == 0 for t in totals)  # no padding at all


def test_texts_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    texts = [(1, "Hello the\nworld's  é É <|endoftext|> a\tb\x0b c d e"), (2, None), (2, ""), (3, "word " * 6000), (4, "x"), (4, "x")]
    rows = spark.createDataFrame([(i, t, "q") for i, t in texts], "doc_id long, text string, length string")
    out = pack_examples(rows, PATH).toPandas()
    expected = sorted((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in texts)
    assert out.length.sum() == sum(len(x) for _, x in expected)
    whole3 = b"".join(out[out.doc_id == 3].sort_values("start").ids)
    assert tuple(np.frombuffer(whole3, "<u4")) == dict(expected)[3]
    assert tuple(np.frombuffer(b"".join(out[out.doc_id == 1].sort_values("start").ids), "<u4")) == dict(expected)[1]
    for _, pieces in out.groupby("sequence_id"):
        pieces = pieces.sort_values("offset")
        assert list(pieces.offset) == [0, *np.cumsum(pieces.length)[:-1]]


def test_parts_have_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    from gleanery.llm.packing import Ids

    odd = ["a.b c'd.'s É.é x×y «z» “q”. 3.5,7 don't; <|endoftext|>. (.a) ΑΣ. ΑΣ", "Å.Ǆ ǅ! é́.x a…. İ.i", "l'été, c'est: re've 've! 's.", "", " .\u00a0. ", "e\u0301.b a\u0301, \u0301.", "<|startoftext|>x"]
    expected = [np.asarray(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(PATH).encode_batch(odd, add_special_tokens=False)]
    assert Ids(PATH).of(odd) == expected


def test_empty_table_and_loss_pattern(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_examples(empty, PATH).count() == 0
    turns = spark.createDataFrame([(1, "user: tell me\n\nassistant: a long answer\n\nuser: no")], "doc_id long, text string")
    row = pack_examples(turns, PATH, loss_pattern="assistant:").agg({"loss": "sum", "length": "sum"}).first()
    assert row["sum(loss)"] == 3 and row["sum(length)"] > 8


def test_leftovers_go_on_to_the_next_group(spark):
    r = np.random.default_rng(4)
    lengths = [int(x) for x in r.integers(1, 900, 200)]
    sequences, starts = pack_some(lengths, [Loss() for _ in lengths], Limits(), [0] * len(lengths), False)
    assert all(sum(e - b for _, b, e in pieces) == 2048 for pieces in sequences)
    left = sum(n - b for n, b in zip(lengths, starts, strict=True))
    assert left < 2048 and left + 2048 * len(sequences) == sum(lengths)
    rows = [(k, "ka to mi " * int(r.integers(1, 300))) for k in range(900)] + [(1000 + k, "mi") for k in range(900)]
    pieces = pack_examples(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH, group=64).cache()
    told = fill_report(pieces).first()
    # a task ends in powers of two: at most 11 for its tokens, and one for each 128 of the tiny texts at its end
    assert told.padding == 0 and told.sequences - round(told.full * told.sequences) <= 11 + 900 // 128
    whole_docs = pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(whole_docs) == 1800 and all(x["sum(length)"] == x["max(doc_tokens)"] for x in whole_docs)


def test_tiny_texts_alone_are_packed_too(spark):
    rows = spark.range(6000).selectExpr("id AS doc_id", "'mi' AS text").coalesce(1)
    pieces = pack_examples(rows, PATH, group=512)
    told = fill_report(pieces).first()
    assert told.padding == 0 and pieces.count() == 6000


def test_a_tokenizer_that_joins_parts_encodes_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = {c: k for k, c in enumerate(sorted({chr(x) for x in range(32, 127)} | {"a b", "</w>", "\n", "\t"}))}
    other = Tokenizer(models.BPE(vocab=vocab, merges=[("a", " "), ("a ", "b")] if "a " in vocab else [], unk_token=" "))
    other.pre_tokenizer = pre_tokenizers.Split("x", "isolated")
    other.save(str(tmp_path / "other.json"))
    ids = Ids(str(tmp_path / "other.json"))
    texts = ["It's a b, a b!", "UPPER lower", "", None]
    assert not ids.by_parts
    assert ids.of(texts) == [np.asarray(other.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert Ids(PATH).by_parts and Ids(PATH).merges is not None
