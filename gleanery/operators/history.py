"""Ordered rows: step histories, retention, batches, allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.groups import settle


def trailing_mean(rows: DataFrame, step: str, value: str, width: int, to: str, by: list[str] | None = None) -> DataFrame:
    """Mean over the steps s - width + 1 to s that exist."""
    w = Window.partitionBy(*(by or [])).orderBy(step).rangeBetween(-(width - 1), 0)
    return rows.withColumn(to, F.avg(value).over(w))


def trailing_exact_mean(rows: DataFrame, step: str, value: str, width: int, to: str, by: list[str] | None = None, held: int = 2, digits: int = 4) -> DataFrame:
    """As trailing_mean, of values of ``held`` decimals, rounded half up to ``digits`` from sums of whole numbers, which do
    not depend on an order."""
    w = Window.partitionBy(*(by or [])).orderBy(step).rangeBetween(-(width - 1), 0)
    total, n = F.sum(F.round(F.col(value) * 10**held).cast("long")).over(w), F.count(value).over(w) * 10**held
    return rows.withColumn(to, F.when(n > 0, F.floor((2 * total * 10**digits + n) / (2 * n)) / 10**digits))


def recent_rows_mean(rows: DataFrame, order: str, value: str, n: int, to: str, by: list[str] | None = None) -> DataFrame:
    """Mean over a row and the n - 1 before it."""
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(-(n - 1), 0)
    return rows.withColumn(to, F.avg(value).over(w))


def rewound(rows: DataFrame, order: str, step: str, by: list[str]) -> DataFrame:
    """A log in which a row of step k takes back all earlier rows of steps from k on."""
    later = Window.partitionBy(*by).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("_least", F.min(step).over(later)).filter(F.col("_least").isNull() | (F.col("_least") > F.col(step))).drop("_least")


def retained(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """Whether each row is of its group's last n."""
    return rows.withColumn("kept", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order))) <= n)


def latest(rows: DataFrame, by: list[str], value: str, is_final: str, step: str, usable: str) -> DataFrame:
    """The final one, else the one of the largest step, among the usable."""
    return rows.filter(F.col(usable)).groupBy(*by).agg(F.max_by(value, F.struct(is_final, step)).alias(value))


def fixed_batches(rows: DataFrame, group: str, order: list, size: int, drop_last: bool = False) -> DataFrame:
    """Deals a group's rows into batches of a size; batches never mix groups."""
    w = Window.partitionBy(group).orderBy(*order)
    out = rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    if drop_last:
        out = out.withColumn("_n", F.count("*").over(Window.partitionBy(group, "batch"))).filter(F.col("_n") == size).drop("_n")
    return out


def ordinals(rows: DataFrame, order: list, to: str = "position") -> DataFrame:
    """The place of every row in a global order, from 0: ranges are dealt to tasks and sorted there, each counts its own
    rows, and what the ranges before hold is added. The order should tell all rows apart."""
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the place within a task
    dealt = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_task": F.spark_partition_id(), "_place": own}))
    counts = dealt.groupBy("_task").agg(F.count("*").alias("_n"))  # a row for each task
    before = counts.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before"))
    return dealt.join(F.broadcast(before), "_task").withColumn(to, F.col("_before") + F.col("_place")).drop("_task", "_place", "_before")


def order_key(keys: list[str], seed: int, epoch: int) -> Column:
    """A digest of keys, seed and epoch to shuffle by."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed + epoch))))


def shuffled(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """A permutation that a key, the seed and the epoch determine: ``position`` from 0, by ``order_key``."""
    return ordinals(rows.withColumn("order_key", order_key([key], seed, epoch)), [F.col("order_key"), F.col(key)])


def shuffled_batches(rows: DataFrame, group: str, key: str, size: int, seed: int, epoch: int, drop_last: bool = False) -> DataFrame:
    """Batches that never mix groups, shuffled within a group and among each other: ``batch`` of the group, ``place`` of
    the batch among all, both from 0. A group may be of any size: its order is a part of a global one."""
    placed = ordinals(rows.withColumn("_key", order_key([key], seed, epoch)), [F.col(group), F.col("_key"), F.col(key)], "_at").drop("_key")
    firsts = placed.groupBy(F.col(group).alias("_g")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    dealt = placed.join(firsts, F.col(group).eqNullSafe(F.col("_g"))).withColumn("batch", F.floor((F.col("_at") - F.col("_first")) / size).cast("long"))
    if drop_last:
        dealt = dealt.filter((F.col("batch") + 1) * size <= F.col("_n"))
    batches = firsts.select(F.col("_g"), F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("_n") - 1) / size).cast("long"))).alias("_b"), "_n")
    batches = batches.filter((F.col("_b") + 1) * size <= F.col("_n")) if drop_last else batches
    order = ordinals(batches.drop("_n").withColumn("_key", order_key(["_g", "_b"], seed, epoch)), [F.col("_key"), F.col("_g"), F.col("_b")], "place").drop("_key")
    dealt = dealt.drop("_at", "_first", "_n", "_g")
    return dealt.join(order, F.col(group).eqNullSafe(F.col("_g")) & (F.col("batch") == F.col("_b"))).drop("_g", "_b")


def next_id(names: DataFrame, stem: str) -> DataFrame:
    """One more than the largest stem of digits alone; 0 if there is none."""
    return names.agg((F.coalesce(F.max(F.when(F.col(stem).rlike(r"^\d{1,18}$"), F.col(stem).cast("long"))), F.lit(-1)) + 1).alias("next_id"))
