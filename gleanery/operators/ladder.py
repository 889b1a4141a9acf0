"""Rules over rows: first match wins, soft flags, audited reasons, counts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reject_ladder(rows: DataFrame, rules: Iterable[tuple[str, str]], to: str = "reason") -> DataFrame:
    """Name of the first rule that a row meets, in the given order; null where it meets none."""
    return rows.withColumn(to, F.coalesce(*[F.when(F.expr(test), F.lit(name)) for name, test in rules]))


def all_issues(rows: DataFrame, key: str, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """One row for every rule (category, severity, test) that a row meets."""
    found = F.array(*[F.when(F.expr(test), F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"))) for category, severity, test in rules])
    return rows.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue")).select(key, "issue.severity", "issue.category")


def first_reason(issues: DataFrame, key: str, reason: str, order: str) -> DataFrame:
    """The reason logged first for each key, and how many there were."""
    return issues.groupBy(key).agg(F.min_by(reason, order).alias("reason"), F.count("*").alias("n_issues"))


def best_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], to: str) -> DataFrame:
    """Adds each row's rank within its group."""
    return rows.withColumn(to, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def exclusion_counts(excluded: DataFrame, reason: str) -> DataFrame:
    """Counts by the part of a reason before its colon."""
    return excluded.groupBy(F.substring_index(reason, ":", 1).alias("category")).agg(F.count("*").alias("n"))
