"""Fill-in-middle transformation of documents: DuckDB runs over Arrow batches inside mapInArrow.

A text of n code points is cut in two places drawn from a hash of its id, and written with three markers either as
prefix, suffix, middle (psm) or as suffix, prefix, middle (spm); a share of the texts stays as it is (plain). Each
batch is registered with a DuckDB connection of the task: ``regexp_extract_all`` cuts the texts into runs of ``RUN``
code points, ``list_slice`` and ``array_to_string`` build the pieces (a run that is cut falls into single code points),
``sha256`` draws and digests. Arrow goes in and Arrow comes out; no row becomes a Python object. Nothing is shuffled.

Memory: a batch is worked on in slices of about ``MOST_BYTES`` of text, one text at least; lists hold a sixty-fourth
of the code points, so a long text costs a few times its own size.

Defined cases: a null text counts as empty; an empty text, and one that holds a marker, is plain; a null id has no
draws, so its text is plain; rows that repeat are each transformed, alike; an empty table gives no rows; columns other
than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from gleanery.llm.common import bound_batches

RUN = 64
MOST_BYTES = 2_000_000


@dataclass(frozen=True)
class Infilling:
    """How texts are drawn and marked. plain, spm: hundredths of all texts, and of those that are not plain."""

    markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    plain: int = 10
    spm: int = 20
    seed: str = "1:"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


MACROS = f"""
CREATE MACRO points(run) AS regexp_extract_all(coalesce(run, ''), '(?s).');
CREATE MACRO part_of(run, a, b) AS array_to_string(list_slice(points(run), a + 1, b), '');
CREATE MACRO units(runs, a, b) AS CASE WHEN a // {RUN} = b // {RUN} THEN part_of(runs[a // {RUN} + 1], a % {RUN}, b % {RUN})
    ELSE part_of(runs[a // {RUN} + 1], a % {RUN}, {RUN}) || array_to_string(list_slice(runs, a // {RUN} + 2, b // {RUN}), '') || part_of(runs[b // {RUN} + 1], 0, b % {RUN}) END;
CREATE MACRO draw(digest, k) AS ('0x' || substr(digest, 8 * k - 7, 8))::UBIGINT;
"""


def statement(kind: Infilling) -> str:
    """The query over a registered batch (id, text) that makes and restores the transformed texts."""
    p, s, m = map(_quoted, kind.markers)
    after = f"{len(kind.markers[0]) + 1}, 4000000000"
    return f"""
WITH hashed AS (SELECT id, coalesce(text, '') AS text, sha256({_quoted(kind.seed)} || id::VARCHAR) AS digest FROM batch),
cut AS (SELECT *, length(text)::BIGINT AS n, regexp_extract_all(text, '(?s).{{1,{RUN}}}') AS runs,
    CASE WHEN text = '' OR digest IS NULL OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR draw(digest, 3) % 100 >= {100 - kind.plain} THEN 'plain'
    WHEN draw(digest, 4) % 100 < {kind.spm} THEN 'spm' ELSE 'psm' END AS form FROM hashed),
drawn AS (SELECT *, least(draw(digest, 1) % (n + 1), draw(digest, 2) % (n + 1))::BIGINT AS a, greatest(draw(digest, 1) % (n + 1), draw(digest, 2) % (n + 1))::BIGINT AS b FROM cut),
pieces AS (SELECT id, n, form, text, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    CASE WHEN form <> 'plain' THEN units(runs, 0, a) END AS prefix, CASE WHEN form <> 'plain' THEN units(runs, a, b) END AS middle, CASE WHEN form <> 'plain' THEN units(runs, b, n) END AS suffix FROM drawn),
made AS (SELECT id, n, form, prefix_chars, middle_chars,
    CASE form WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle WHEN 'spm' THEN {s} || suffix || {p} || prefix || {m} || middle ELSE text END AS output FROM pieces),
split AS (SELECT *, CASE form WHEN 'psm' THEN string_split(output, {s}) WHEN 'spm' THEN string_split(output, {p}) END AS outer_parts FROM made),
halves AS (SELECT *, string_split(outer_parts[2], {m}) AS inner_parts FROM split)
SELECT id, n, form, prefix_chars, middle_chars, output, sha256(output) AS output_sha256,
    sha256(CASE form WHEN 'psm' THEN array_to_string([substring(outer_parts[1], {after}), inner_parts[2], inner_parts[1]], '')
    WHEN 'spm' THEN array_to_string([inner_parts[1], inner_parts[2], substring(outer_parts[1], {after})], '') ELSE output END) AS restored_sha256
FROM halves"""


def slices(batch, column: str, most_bytes: int):
    """Slices of an Arrow batch whose texts have about so many bytes together, one row at least."""
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield batch.slice(start, end - start)
        start = end


def fill_in_middle(docs: DataFrame, kind: Infilling | None = None, id_col: str = "doc_id", text_col: str = "text", keep_output: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """id, n (code points), form, prefix_chars, middle_chars (null if plain), output (if kept), output_sha256 and
    restored_sha256 (digest of the text that output and form give back) of every row."""
    kind = kind or Infilling()
    if len(set(kind.markers)) < 3 or len({len(x) for x in kind.markers}) > 1 or any(y.startswith(x[k:]) for x in kind.markers for y in kind.markers for k in range(1, len(x))):
        raise ValueError("markers must be three different strings of one length, none of which begins as another ends")
    bound_batches(docs.sparkSession)
    names = ["id", "n", "form", "prefix_chars", "middle_chars", *["output"] * keep_output, "output_sha256", "restored_sha256"]
    query = f"SELECT {', '.join(names)} FROM ({statement(kind)})"

    def run(batches):
        import duckdb
        import pyarrow as pa

        with duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": True}) as con:
            con.execute(MACROS)
            for batch in batches:
                for part in slices(batch, "text", most_bytes):
                    con.register("batch", pa.Table.from_batches([part]))
                    made = con.execute(query).to_arrow_table()
                    con.unregister("batch")
                    yield from made.to_batches()

    kinds = {"id": docs.schema[id_col].dataType.simpleString(), "n": "long", "prefix_chars": "long", "middle_chars": "long"}
    shape = ", ".join(f"{x} {kinds.get(x, 'string')}" for x in names)
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, shape).withColumnRenamed("id", id_col)


SQL = """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents),
d AS (SELECT doc_id, t, n, ('0x' || x[1:8])::UBIGINT % (n + 1) AS c1, ('0x' || x[9:16])::UBIGINT % (n + 1) AS c2, ('0x' || x[17:24])::UBIGINT % 100 AS c3, ('0x' || x[25:32])::UBIGINT % 100 AS c4 FROM h),
f AS (SELECT *, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR c3 >= 90 THEN 'plain' WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form, least(c1, c2)::BIGINT AS a, greatest(c1, c2)::BIGINT AS b FROM d),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', left(t, a), '<S>', substr(t, b + 1), '<M>', substr(t, a + 1, b - a)) ELSE concat('<S>', substr(t, b + 1), '<P>', left(t, a), '<M>', substr(t, a + 1, b - a)) END AS output FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""
