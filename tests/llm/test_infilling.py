import hashlib

import pytest

from gleanery.llm import infilling


def plain_version(i, text):
    text = text or ""
    n = len(text)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if i is None:
        return n, "plain", None, None, text
    digest = sha(f"1:{i}")
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h4 % 100 < 20 else "psm", a, b - a, out


def test_against_plain_python(spark):
    pieces = ["", "a", "é😀\n\x00", "<P", "S>", "<", "P>", "x\r\ny ", "é", "ß ", "<M", ">"]
    texts = [None, "", "<S>", "a<M>b", "日" * 64, "y" * 63, "z" * 65, "long é " * 40_000]
    texts += ["".join(pieces[(k * 7 + j * (k + 3)) % len(pieces)] for j in range(k % 90)) for k in range(400)]
    rows = [(k, t, "spam", k) for k, t in enumerate(texts)]
    rows += [(None, "no id", "x", 1), rows[30], rows[30]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, form string, n long").repartition(3)
    out = infilling.fill_in_middle(frame, most_bytes=3_000)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"]
    got = sorted(map(tuple, out.collect()), key=str)
    want = []
    for i, t, *_ in rows:
        made = plain_version(i, t)
        want.append((i, *made, *(hashlib.sha256(x.encode()).hexdigest() for x in (made[-1], t or ""))))
    assert got == sorted(want, key=str)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}


def test_other_markers_and_empty_table(spark):
    kind = infilling.Infilling(("[A]", "[B]", "[C]"), plain=0, spm=100, seed="s'")
    rows = [(str(k), "don't <P> " * (k + 1)) for k in range(9)]
    out = infilling.fill_in_middle(spark.createDataFrame(rows, "id string, body string"), kind, "id", "body").collect()
    assert {x.form for x in out} == {"spm"} and all(x.output.startswith("[B]") and x.restored_sha256 == hashlib.sha256(dict(rows)[x.id].encode()).hexdigest() for x in out)
    assert infilling.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError, match="markers"):
        infilling.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), infilling.Infilling(("<a", "<a>", "b")))
