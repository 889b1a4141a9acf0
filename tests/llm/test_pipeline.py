"""The pipeline's stages against plain Python on a small corpus."""

import re

import numpy as np
import pytest

import corpus_pipeline
from gleanery.llm import toxicity
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_lines import brute as brute_lines

pytest.importorskip("public_tokenizers")


def words(r, n):
    return " ".join("".join(r.choice(list("abcdefghijk"), int(r.integers(2, 7)))) for _ in range(n))


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    r = np.random.default_rng(4)
    top = tmp_path_factory.mktemp("sf")
    items = [(k, words(r, 24).capitalize() + ".") for k in range(4)]
    common = words(r, 12)
    rows, labels = [], []
    for k in range(240):
        text = words(r, int(r.integers(5, 90)))
        if k % 4 == 0:
            text += " zgrx" + words(r, 1) + " zgrxo"
        labels.append((k, 1, int(k % 4 == 0)))
        if k % 3 == 1:
            text += "\n" + common
        rows.append((k, text, "en", "src0", len(text)))
    rows += [(1000 + k, rows[k][1], "en", "src1", 5) for k in range(1, 30, 2)]
    rows += [(2000 + k, f"{words(r, 20)} {items[k][1]} {words(r, 20)}", "en", None, 5) for k in range(4)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "x", 0), (3002, words(r, 4000), "fr", "x", 9), rows[7]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages(spark, place, tmp_path):
    docs = spark.read.parquet(f"{place}/documents.parquet")
    columns, items = docs.columns, [r.text for r in spark.read.parquet(f"{place}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    held = docs
    for name, stage in corpus_pipeline.STAGES:
        before = held.collect()
        stage(spark, held, place).write.parquet(f"{tmp_path}/{name}")
        held = spark.read.parquet(f"{tmp_path}/{name}")
        after = held.collect()
        if name != "packing":
            assert held.columns == columns
        if name == "toxicity":
            net = toxicity.train(*toxicity.training_rows(docs, spark.read.parquet(f"{place}/labels.parquet")))
            score = toxicity.Scorer(net).score([r.text for r in before])
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, s in zip(before, score, strict=True) if s < 0.5)
            assert not [r for r in after if "zgrx" in (r.text or "")] and len(after) > 180
        if name == "line_dedup":
            import hashlib

            assert sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in after) == sorted((i, h) for i, _, _, h in brute_lines([(r.doc_id, r.text) for r in before]))
            assert all(r.n_chars == len(r.text) for r in after)
        if name == "ngram_jaccard":
            parts = brute_components([(r.doc_id, r.text) for r in before], 5, 80)
            assert sorted(r.doc_id for r in after) == sorted(i for i, _, c in parts if i == c)
        if name == "decontamination":
            plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
            leaks = {r.doc_id for r in before if any(plain(x) in plain(r.text) for x in items)}
            assert len(leaks) == 4 and {r.doc_id for r in before} - {r.doc_id for r in after} == leaks
        if name == "packing":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            assert sum(r.length for r in after) == sum({r.doc_id: r.doc_tokens for r in after}.values())


def test_run_and_empty(spark, place, tmp_path):
    assert corpus_pipeline.run(spark, place).count() > 100
    spark.read.parquet(f"{place}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{place}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_ids_and_clashing_columns(spark, place):
    texts = ["one text of its own with words enough to make some shingles", "another text under the same id that has other words", "a third text which nothing else in here is like at all"]
    rows = [(1, texts[0], "x", 1, 7.5), (1, texts[1], "x", 2, 7.5), (1, texts[1], "x", 2, 7.5), (2, texts[2], "y", 3, None), (3, texts[2], "y", 4, 1.0), (None, texts[2], None, 5, 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, n_lines int, score double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, place)
        assert out.columns == docs.columns
        got = sorted((tuple(r) for r in out.collect()), key=str)
        gone = [rows[2], rows[4]] if name == "ngram_jaccard" else []
        want = sorted(rows, key=str)
        for r in gone:
            want.remove(r)
        assert got == want, name
    assert {r.doc_id for r in corpus_pipeline.pack(spark, docs, place).collect()} == {1, 2, 3, None}


@pytest.mark.parametrize("keep_pipeline", [False, True])
def test_the_rest_stands_without_these_folders(tmp_path, keep_pipeline):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[2]
    shutil.copytree(top / "gleanery", tmp_path / "gleanery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    if keep_pipeline:
        shutil.copy(top / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q) and not [k for k in q if k.startswith('op') and '_' in k and k[2].isdigit()]"
    run = f"import sys; sys.path[:] = [p for p in sys.path if p != {str(top)!r}]; {code}"
    subprocess.run([sys.executable, "-c", run], cwd=tmp_path, check=True)
