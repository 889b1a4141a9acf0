import hashlib
import re
from collections import defaultdict

import pytest

from gleanery.llm.lines import LineRuns, deduplicate_lines

LONG = "  The Same line that many documents of the corpus hold, É \t"


def brute(rows, least=40, docs=5):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(lower)
    held = defaultdict(set)
    for i, text in rows:
        if i is not None:
            for k in {key(x) for x in (text or "").split("\n")}:
                held[k].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(key(x)) >= least and len(held[key(x)]) >= docs and i is not None and i != max(held[key(x)]) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((i, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 4])
def test_matches_brute_force(spark, batches):
    rows = [(i, f"{LONG.upper() if i % 2 else LONG}\nown line number {i} which is long enough to count here\n{LONG}\n\nshort") for i in range(12)]
    rows += [(20, None), (21, ""), (None, LONG), (22, "x" * 39), (23, "é" * 45), *[(30 + k, "é" * 45 + "\r") for k in range(5)], (4, rows[4][1])]
    four = "a line that four documents hold, one of them in two rows"  # one too few
    rows += [(i, four) for i in (50, 51, 52, 53, 53)] + [(i, f"{four}, and a fifth document") for i in (50, 51, 52, 53, 54)]
    frame = spark.createDataFrame([(i, t, "z", 7) for i, t in rows], "doc_id long, text string, k1 string, n_lines int").repartition(5)
    got = deduplicate_lines(frame, batches=batches).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got), key=str) == brute(rows)
    assert got[0].k1 == "z"


def test_runs_decide_who_keeps_a_line(spark):
    runs = LineRuns(spark, fanout=3)
    batch = lambda ids: spark.createDataFrame([(1, 1, i) for i in ids] + [(2, ids[0], ids[0])], "k1 long, k2 long, id long")
    for ids in ([9, 8], [7], [5, 4, 4], [3]):
        held = runs.judged(batch(ids))
        plan = held._jdf.queryExecution().executedPlan().toString()
        # only the batch is dealt out: the runs are merged where they lie
        assert plan.count("SortMergeJoin") == sum(map(len, runs.levels)) and plan.count("Exchange hash") == 2
        assert {(r.k1, r.k2): (r.n_docs, r.last_doc) for r in held.collect()} == {(1, 1): (len(set(ids)), 9 if ids[0] == 9 else None), (2, ids[0]): (1, ids[0])}
        runs.ingest(batch(ids))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert {(r.k1, r.k2): (r.n_docs, r.last_doc) for r in runs.totals().collect()} == {(1, 1): (6, 9), **{(2, i): (1, i) for i in (9, 7, 5, 3)}}
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_very_long_texts(spark):
    line = "the line that all the long texts have in common, at many places"
    rows = [(i, "\n".join(f"{line}\n{i} {k} is the number of a line of its own, as long as need be" for k in range(4000))) for i in range(6)]
    rows += [(i, line + "x" * 400_000) for i in (10, 11, 12, 13, 14)]
    got = deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got), key=str) == brute(rows)


def test_empty(spark):
    assert deduplicate_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_failed_job_leaves_no_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "x" * 50) for k in range(9)], "doc_id long, text string")
    before = {t.name for t in spark.catalog.listTables()}

    def fail(self):
        raise RuntimeError("lost")

    monkeypatch.setattr(LineRuns, "totals", fail)
    with pytest.raises(RuntimeError, match="lost"):
        deduplicate_lines(docs)
    assert {t.name for t in spark.catalog.listTables()} == before
