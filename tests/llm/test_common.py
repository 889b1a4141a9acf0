import numpy as np

from gleanery.llm import jaccard, packing, substrings
from gleanery.llm.common import Words
from gleanery.llm.queries import tokenizer_path


def alternating(n, other=False):
    """Letters by the parity of the ones of their places, of which all polynomials modulo 2^64 agree with the complement's."""
    return "".join("ab"[(k.bit_count() + other) % 2] for k in range(n))


ONE, OTHER = alternating(4096), alternating(4096, True)


def test_long_words_differ():
    for lower in (True, False):
        h, at = Words(lower).cut([ONE, OTHER, ONE + " " + OTHER, ONE.upper()])
        assert h[0] != h[1] and h[0] == h[2] and h[1] == h[3] and (h[0] == h[4]) == lower
    words = [("x" * n) + c for n in range(60, 70) for c in "abé"]
    assert len(set(Words(False).cut([" ".join(words)])[0].tolist())) == len(words)


def test_ids_of_long_words_are_the_tokenizers():
    ids = packing.Ids(tokenizer_path())
    texts = [ONE, OTHER, f"{OTHER} x {ONE}"]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    for got, text in zip(ids.of(texts), texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_windows_and_shingles_of_long_words_are_told_apart(spark):
    rest = [f"w{k}" for k in range(19)]
    rows = [(0, " ".join([ONE, *rest])), (1, " ".join([OTHER, *rest])), (2, " ".join([ONE, *rest]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.doc_id: x.n_removed for x in substrings.deduplicate_substrings(frame).collect()}
    assert kept == {0: 0, 1: 0, 2: 20}
    short = spark.createDataFrame([(k, " ".join([w, "a", "b"])) for k, w in enumerate((ONE, OTHER, ONE))], "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in jaccard.jaccard_components(short, k=3, percent=90).collect()} == {0: 0, 1: 1, 2: 0}
