"""Windowed event-time operators that run alike on batches and on streams.

Times without a zone are taken as UTC. On a stream, a watermark bounds the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, time: str, late: str | None = None) -> DataFrame:
    """The event time as a TIMESTAMP, which watermarks need; ``late`` sets the watermark of a stream."""
    out = events.withColumn(time, F.col(time).cast("timestamp"))
    return out.withWatermark(time, late) if events.isStreaming and late else out


def windowed(events: DataFrame, time: str, width: str, slide: str | None, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates per tumbling or sliding window and keys."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    made = events.groupBy(span.alias("w"), *keys).agg(*aggregates)
    return made.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *[c for c in made.columns if c != "w"])


def sessions(events: DataFrame, time: str, gap: str, key: str) -> DataFrame:
    """Sessions of a key: start, events; a gap ends one."""
    made = events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return made.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def once(events: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are new, within the watermark on a stream."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def enriched(events: DataFrame, dimension: DataFrame, on: str) -> DataFrame:
    """Stream-static left join."""
    return events.join(dimension, on, "left")


def upsert_into(path: str, keys: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps the row of the largest version per key in a Parquet table that alternates between two folders."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch
        if number:
            new = spark.read.parquet(f"{path}/{(number - 1) % 2}").unionByName(batch)
        held = F.struct(F.col(version), *[F.col(c) for c in batch.columns if c not in (*keys, version)])
        best = new.groupBy(*keys).agg(F.max(held).alias("_r")).select(*keys, "_r.*").select(*batch.columns)
        best.write.mode("overwrite").parquet(f"{path}/{number % 2}")

    return merge


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and reads its result."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
