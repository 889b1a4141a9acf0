"""Corpus-wide line deduplication over levelled sorted runs of line hashes.

Documents come in batches, those of the largest ids first. A run is a table of line keys (128-bit hashes), bucketed and
sorted by key: how many documents of its batches hold the key and, in the run that met the key first, the largest id of
these. Each batch is dealt to the same buckets and merge-anti-joins the runs, which are not moved: a key that no run
holds is fresh, and as later batches have smaller ids only, its document is the one that keeps the line; of other keys
the batch adds its count alone. Both form the batch's own run at level 0. When a level holds ``fanout`` runs they are
merged, bucket by bucket, into one run of the next level. The merged runs decide which lines go.

Defined cases: null and empty texts are one empty line, which is kept; a row with a null id keeps its lines and
is not counted; rows of one id count as one document; an empty table gives an empty result; other columns pass
through, whatever their names (those that the operator adds replace equal names).
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import SPACE, bound_batches, new_path, remove, shuffle_partitions, stash, text_slices

KEY = ["k1", "k2"]


def line_keys(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """The key of a line: stripped, A-Z lower-cased, hashed; None if it is too short to count."""
    import struct

    import xxhash

    line = line.strip(SPACE)
    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return struct.unpack("<qq", xxhash.xxh3_128_digest(line.lower()))


@contextmanager
def _sorted_buckets(spark: SparkSession):
    """Buckets of one file each are read as sorted, so that merges need no sort."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Levelled sorted runs: bucketed tables with their files in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = shuffle_partitions(spark)
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, f"line-run-{level}")
        with _sorted_buckets(self.spark):
            rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").option("path", self.paths[name]).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self.paths.pop(name))

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One run of several, by merge joins: each has a key once, and one at most its last_doc."""
        rows = runs[0]
        for run in runs[1:]:
            other = run.select(*KEY, F.col("n_docs").alias("more"), F.col("last_doc").alias("doc"))
            total = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))
            rows = rows.join(other.hint("merge"), KEY, "full").select(*KEY, total.alias("n_docs"), F.coalesce("last_doc", "doc").alias("last_doc"))
        return rows

    def judged(self, keys: DataFrame) -> DataFrame:
        """The run of a batch of (k1, k2, id), all ids smaller than those of batches before: last_doc of fresh keys alone."""
        own = keys.distinct().groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("id").alias("last_doc"))
        fresh = F.lit(True)
        for k, run in enumerate(self.tables()):
            held = run.filter("last_doc IS NOT NULL").select(*KEY, F.lit(True).alias(f"held{k}"))
            own = own.join(held.hint("merge"), KEY, "left")
            fresh = fresh & F.col(f"held{k}").isNull()
        return own.select(*KEY, "n_docs", F.when(fresh, F.col("last_doc")).alias("last_doc"))

    def ingest(self, keys: DataFrame) -> None:
        self._write(self.judged(keys), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self._merged([self.spark.table(name) for name in old]), level + 1)
            self._drop(*old)
            level += 1

    def totals(self) -> DataFrame:
        return self._merged(self.tables())

    def close(self) -> None:
        self._drop(*list(self.paths))


def deal_batches(docs: DataFrame, batches: int) -> list[int]:
    """Ids that part the documents into about equal batches, largest first: a batch holds those above its id and not above the one before."""
    cuts = docs.approxQuantile("id", [k / batches for k in range(1, batches)], 0.02) if batches > 1 else []
    return sorted({int(x) for x in cuts}, reverse=True)


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """The documents with ``text_col`` rebuilt from the lines that stay, and n_lines and n_dropped.

    A key of at least min_chars code points in at least min_docs documents keeps its lines in the document with
    the largest id only.
    """
    spark = docs.sparkSession
    bound_batches(spark)

    def keys(parts):
        import pyarrow as pa

        for part in parts:
            for texts, ids in text_slices(part, ["text", "id"]):
                out: list[list] = [[], [], []]
                for text, doc in zip(texts, ids, strict=True):
                    found = {line_keys(line, min_chars) for line in text.encode("utf-8", "surrogatepass").split(b"\n") if len(line) >= min_chars} - {None}
                    out[0] += [k for k, _ in found]
                    out[1] += [k for _, k in found]
                    out[2] += [doc] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=[*KEY, "id"])

    slim = docs.filter(F.col(id_col).isNotNull()).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("id"))
    cuts = deal_batches(slim.select("id"), batches)
    batch = F.lit(len(cuts))
    for k, cut in reversed(list(enumerate(cuts))):
        batch = F.when(F.col("id") > cut, k).otherwise(batch)
    path = new_path(spark, "line-keys")
    slim.mapInArrow(keys, "k1 long, k2 long, id long").withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    held = spark.read.schema("k1 long, k2 long, id long, batch int").parquet(path)
    runs = LineRuns(spark, fanout)
    try:
        for k in range(len(cuts) + 1):
            runs.ingest(held.filter(F.col("batch") == k).select(*KEY, "id"))
        # written first, so that the join deals out both sides itself and can split a key that many documents hold
        heavy = stash(runs.totals().filter(F.col("n_docs") >= min_docs).select(*KEY, "last_doc"), "heavy-lines")
    finally:  # a job that fails leaves no tables in the catalogue
        runs.close()
    lost = held.drop("batch").join(heavy, KEY).filter("id <> last_doc").groupBy(F.col("id").alias("_id")).agg(F.collect_set(F.struct(*KEY)).alias("_lost"))
    plain = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*plain).schema) + ", n_lines long, n_dropped long"
    text_at = plain.index(text_col)

    def rebuild(parts):
        import pyarrow as pa

        for part in parts:
            for at in range(0, part.num_rows, 512):
                rows = part.slice(at, 512)
                texts, n, dropped = [], [], []
                for text, lost_keys in zip(rows.column(text_col).to_pylist(), rows.column("_lost").to_pylist(), strict=True):
                    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                    stay = lines
                    if lost_keys:
                        gone = {(x["k1"], x["k2"]) for x in lost_keys}
                        stay = [line for line in lines if len(line) < min_chars or line_keys(line, min_chars) not in gone]
                    texts.append(text or "" if stay is lines else b"\n".join(stay).decode("utf-8", "surrogatepass"))
                    n.append(len(lines))
                    dropped.append(len(lines) - len(stay))
                columns = [rows.column(c) for c in plain]
                columns[text_at] = pa.array(texts, columns[text_at].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=[*plain, "n_lines", "n_dropped"])

    joined = docs.select(*plain).join(lost, F.col(id_col).cast("long") == F.col("_id"), "left").drop("_id")
    return joined.mapInArrow(rebuild, schema)


#: DuckDB SQL for the documents table under the defaults above.
SQL = r"""
WITH lines AS (SELECT doc_id, u.pos, u.line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
                      LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS pos) u),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
heavy AS (SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT keyed.*, heavy.k IS NOT NULL AND doc_id <> last_doc AS gone FROM keyed LEFT JOIN heavy USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
