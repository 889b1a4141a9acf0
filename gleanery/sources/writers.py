"""Sinks: sorted rewrites, appends, reports, tagged unions, write-once sheets, two-part manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rewrite_jsonl(rows: DataFrame, path: str, key: str, first: Sequence[str]) -> None:
    """Replaces a folder of line-delimited JSON: sorted by key, known fields first, then the others by name."""
    rest = sorted(c for c in rows.columns if c not in first)
    rows.select(*[c for c in first if c in rows.columns], *rest).orderBy(key).write.mode("overwrite").json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    """One JSON object per part and row, with the part's name."""
    out = None
    for name, rows in parts.items():
        line = rows.select(F.to_json(F.struct(F.lit(name).alias("part"), F.struct(*rows.columns).alias("row"))).alias("value"))
        out = line if out is None else out.unionByName(line)
    if out is not None:
        out.write.mode("overwrite").text(path)


def write_tagged_csv(sets: dict[str, DataFrame], path: str) -> None:
    """The union of sets with their name as ``set``; nulls are empty."""
    out = None
    for name, rows in sets.items():
        tagged = rows.withColumn("set", F.lit(name)).select("set", *rows.columns)
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is not None:
        out.write.mode("overwrite").option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Writes only where nothing is yet, so that what a reviewer filled in stays."""
    rows.write.mode("ignore").option("header", "true").csv(path)


def write_manifest(rows: DataFrame, holdout: DataFrame, key: str, path: str, reference_path: str) -> None:
    """Rows outside the hold-out to one folder, those in it to another; what was there before goes."""
    rows.join(holdout.select(key), key, "left_anti").write.mode("overwrite").json(path)
    rows.join(holdout.select(key), key, "left_semi").write.mode("overwrite").json(reference_path)
