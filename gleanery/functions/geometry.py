"""Sizes, buckets, keypoints and training arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def aspect_buckets(spark: SparkSession, base: int = 512, step: int = 64, most_ratio: float = 1.75, tolerance: float = 0.15) -> DataFrame:
    """w, h: multiples of step with an area near base squared and a bounded ratio, in both orientations."""
    low, high = step, int(base * most_ratio) // step * step + step
    side = F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step)))
    tall = spark.range(1).select(side.alias("w")).select("w", side.alias("h")).filter("h >= w")
    area = F.col("w") * F.col("h")
    fits = tall.filter((F.col("h") / F.col("w") <= most_ratio) & (F.abs(area - base * base) <= tolerance * base * base))
    return fits.unionByName(fits.select(F.col("h").alias("w"), F.col("w").alias("h"))).distinct()


def aspect_buckets_of(configs: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """configs: base, step, most_ratio and own columns. These with w, h of each configuration's buckets."""
    span = F.sequence(F.col("step"), (F.floor(F.col("base") * F.col("most_ratio") / F.col("step")) * F.col("step") + F.col("step")).cast("int"), F.col("step"))
    dealt = configs.withColumn("w", F.explode(span)).withColumn("h", F.explode(span))
    area = F.col("base") * F.col("base")
    ratio = F.greatest("w", "h") / F.least("w", "h")
    return dealt.filter((ratio <= F.col("most_ratio")) & (F.abs(F.col("w") * F.col("h") - area) <= tolerance * area))


def nearest_bucket(sizes: DataFrame, buckets: DataFrame, id_col: str, w: str = "w", h: str = "h") -> DataFrame:
    """Adds the bucket of the nearest log-ratio; of equal ones the first in order. The buckets are one small array."""
    table = buckets.agg(F.array_sort(F.collect_list(F.struct("w", "h"))).alias("_b"))
    distance = lambda b: F.round(F.abs(F.log(F.col(w) / F.col(h)) - F.log(b["w"] / b["h"])), 12)
    ranked = F.array_min(F.transform("_b", lambda b: F.struct(distance(b).alias("d"), b["w"].alias("w"), b["h"].alias("h"))))
    return sizes.join(F.broadcast(table)).withColumn("_n", ranked).select(*[c for c in sizes.columns], F.col("_n.w").alias("bucket_w"), F.col("_n.h").alias("bucket_h"))


def cover_scale(w: Column, h: Column, bucket_w: Column, bucket_h: Column) -> dict[str, Column]:
    """Scaled size that covers a bucket, rounded half to even, and the offsets of a centred crop."""
    scale = F.greatest(bucket_w / w, bucket_h / h)
    new_w, new_h = (F.greatest(F.bround(x * scale, 0).cast("long"), b.cast("long")) for x, b in ((w, bucket_w), (h, bucket_h)))
    half = lambda x, b: F.floor((x - b) / 2).cast("long")
    return {"scaled_w": new_w, "scaled_h": new_h, "crop_left": half(new_w, bucket_w), "crop_top": half(new_h, bucket_h)}


def photo_size(w: Column, h: Column, area: int = 448 * 640, step: int = 8, least: int = 64) -> tuple[Column, Column]:
    """A size of the given area and the picture's aspect, clamped to one half and two, on a grid."""
    aspect = F.greatest(F.lit(0.5), F.least(F.lit(2.0), w / h))
    width = F.sqrt(area * aspect)
    snap = lambda x: F.greatest(F.lit(least), (F.floor(x / step) * step).cast("int"))
    return snap(width), snap(width / aspect)


def min_snr_weight(snr: Column, gamma: float = 5.0, velocity: bool = False) -> Column:
    weight = F.least(snr, F.lit(gamma)) / snr
    return weight * snr / (snr + 1) if velocity else weight


def training_arithmetic(rows: Column, batch: int, accumulate: int, steps: int) -> dict[str, Column]:
    per_epoch = F.ceil(F.ceil(rows / batch) / accumulate)
    return {"steps_per_epoch": per_epoch, "effective_batch": F.lit(batch * accumulate).cast("long"), "epochs": F.ceil(F.lit(steps) / per_epoch)}


def keypoint_hits(reference: Column, generated: Column, threshold: float) -> Column:
    """Share of a person's visible joints that the other person has within the threshold; 0 if none is visible."""
    near = lambda a, b: a.isNotNull() & b.isNotNull() & (F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])) <= threshold)
    hits = F.size(F.filter(F.zip_with(reference, generated, near), lambda x: x))
    seen = F.size(F.filter(reference, lambda x: x.isNotNull()))
    return F.when(seen > 0, hits / seen).otherwise(0.0)


def best_keypoint_score(reference: Column, generated: Column, threshold: float = 0.1) -> Column:
    """Mean over reference persons of the best generated person; null without reference, 0 without generated persons."""
    best = F.transform(reference, lambda p: F.array_max(F.transform(generated, lambda q: keypoint_hits(p, q, threshold))))
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(reference)
    return F.when(reference.isNull() | (F.size(reference) == 0), F.lit(None).cast("double")).when(generated.isNull() | (F.size(generated) == 0), 0.0).otherwise(mean)
