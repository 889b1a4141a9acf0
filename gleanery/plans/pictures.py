"""Pictures of many shapes made from part keys: resampled hashes and margins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import pictures as P
from gleanery.operators.groups import settle
from gleanery.session import table


def _shaped(spark, sf):
    """p_partkey, h, w; dealt over the shuffle partitions, as a small file of keys is one split, but many pictures."""
    parts = table(spark, sf, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select("p_partkey", (F.col("p_partkey") % 13 + 5).cast("int").alias("h"), (F.col("p_partkey") % 17 + 6).cast("int").alias("w"))


def _picture(cell):
    """Rows of cells, whose brightness is a function of row and column."""
    line = lambda r: F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda c: cell(r, c).cast("double"))
    return F.transform(F.sequence(F.lit(0), F.col("h") - 1), line)


def resized_hashes(spark, sf):
    """Gradient hashes of 16 x 17 cells and average hashes of 8 x 8 of pictures of 221 shapes."""
    gray = _picture(lambda r, c: (F.col("p_partkey") * 7 + r * 31 + c * 17) * (c + r + 3) % 251)
    return settle(_shaped(spark, sf).select("p_partkey", gray.alias("gray"))).select("p_partkey", P.difference_digest(F.col("gray")).alias("gradient"), P.average_digest(F.col("gray")).alias("average"))


def _channel(k: int):
    """A channel of pictures with flat margins of up to four rows and three columns around a varied middle."""
    p = F.col("p_partkey")
    inside = lambda r, c: (r >= p % 5) & (r < F.col("h") - p % 3) & (c >= p % 4) & (c < F.col("w") - p % 2)
    return _picture(lambda r, c: F.when(inside(r, c), (p * 7 + r * 31 + c * 17 + k * 5) * (c + r + 3) % 251).otherwise((p % 2) * 200 + (r + c) % 3 + k))


def border_boxes(spark, sf):
    """What lies inside the margins, and how many pixels are left of the first channel."""
    made = settle(_shaped(spark, sf).select("p_partkey", *[_channel(k).alias(f"g{k}") for k in range(3)]))
    boxed = settle(made.select("p_partkey", "g0", P.border([F.col(f"g{k}") for k in range(3)]).alias("box")))
    left = P.cropped(F.col("g0"), F.col("box"))
    edges = [F.col(f"box.{side}").alias(f"{side}_edge") for side in ("top", "bottom", "left", "right")]
    return boxed.select("p_partkey", *edges, F.size(F.flatten(left)).alias("n_left"), F.aggregate(F.flatten(left), F.lit(0.0), lambda s, x: s + x).alias("total"))


QUERIES = {f.__name__: f for f in (resized_hashes, border_boxes)}
_SHAPED = "s AS (SELECT p_partkey AS p, (p_partkey % 13 + 5)::BIGINT AS h, (p_partkey % 17 + 6)::BIGINT AS w FROM part)"
_AREA = lambda rows, cols, name: f"""{name} AS (SELECT p, i, j, sum(v * cr * cc) AS v FROM (SELECT p, i, j, (p * 7 + r * 31 + c * 17) * (c + r + 3) % 251 AS v,
least((i + 1) * h, (r + 1) * {rows}) - greatest(i * h, r * {rows}) AS cr, least((j + 1) * w, (c + 1) * {cols}) - greatest(j * w, c * {cols}) AS cc
FROM s, range(17) a(r), range(22) b(c), range({rows}) k(i), range({cols}) l(j) WHERE r < h AND c < w AND (i + 1) * h > r * {rows} AND i * h < (r + 1) * {rows} AND (j + 1) * w > c * {cols} AND j * w < (c + 1) * {cols}) GROUP BY 1, 2, 3)"""  # noqa: E731
ORACLE_SQL = {
    "resized_hashes": f"""WITH {_SHAPED}, {_AREA(16, 17, "d")}, {_AREA(8, 8, "a")},
        g AS (SELECT p, i, j, v > lag(v) OVER (PARTITION BY p, i ORDER BY j) AS bit FROM d), gl AS (SELECT p, i, printf('%04x', sum(CASE WHEN bit THEN 1 << (16 - j) ELSE 0 END)::BIGINT) AS line FROM g WHERE j > 0 GROUP BY 1, 2),
        al AS (SELECT p, i, printf('%02x', sum(CASE WHEN bit THEN 1 << (7 - j) ELSE 0 END)::BIGINT) AS line FROM (SELECT p, i, j, v * 64 > sum(v) OVER (PARTITION BY p) AS bit FROM a) GROUP BY 1, 2)
        SELECT g.p AS p_partkey, g.gradient, a.average FROM (SELECT p, string_agg(line, '' ORDER BY i) AS gradient FROM gl GROUP BY 1) g JOIN (SELECT p, string_agg(line, '' ORDER BY i) AS average FROM al GROUP BY 1) a USING (p)""",
    "border_boxes": f"""WITH {_SHAPED}, x AS (SELECT p, h, w, k, r, c, CASE WHEN r >= p % 5 AND r < h - p % 3 AND c >= p % 4 AND c < w - p % 2 THEN (p * 7 + r * 31 + c * 17 + k * 5) * (c + r + 3) % 251 ELSE p % 2 * 200 + (r + c) % 3 + k END AS v
        FROM s, range(3) t(k), range(17) a(r), range(22) b(c) WHERE r < h AND c < w),
        m AS (SELECT p, k, (list_sort(list(v))[2] + list_sort(list(v))[3]) / 2 AS corner FROM x WHERE r IN (0, h - 1) AND c IN (0, w - 1) GROUP BY 1, 2),
        rows AS (SELECT p, h, w, r, bool_and(flat) AS flat FROM (SELECT p, h, w, k, r, count(*) * sum(v * v) - sum(v) * sum(v) < 144 * count(*) * count(*) AND abs(sum(v) - any_value(corner) * count(*)) < 24 * count(*) AS flat FROM x JOIN m USING (p, k) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4),
        cols AS (SELECT p, h, w, c, bool_and(flat) AS flat FROM (SELECT p, h, w, k, c, count(*) * sum(v * v) - sum(v) * sum(v) < 144 * count(*) * count(*) AND abs(sum(v) - any_value(corner) * count(*)) < 24 * count(*) AS flat FROM x JOIN m USING (p, k) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4),
        tb AS (SELECT p, any_value(h) AS h, least(floor(any_value(h) * 0.15), coalesce(min(r) FILTER (NOT flat), any_value(h)))::INT AS top, greatest(any_value(h) - floor(any_value(h) * 0.15), coalesce(max(r) FILTER (NOT flat) + 1, 0))::INT AS bottom FROM rows GROUP BY 1),
        lr AS (SELECT p, least(floor(any_value(w) * 0.15), coalesce(min(c) FILTER (NOT flat), any_value(w)))::INT AS "left", greatest(any_value(w) - floor(any_value(w) * 0.15), coalesce(max(c) FILTER (NOT flat) + 1, 0))::INT AS "right" FROM cols GROUP BY 1)
        SELECT p AS p_partkey, top AS top_edge, bottom AS bottom_edge, "left" AS left_edge, "right" AS right_edge, count(*)::INT AS n_left, sum(v)::DOUBLE AS total FROM x JOIN tb USING (p) JOIN lr USING (p) WHERE k = 0 AND r >= top AND r < bottom AND c >= "left" AND c < "right" GROUP BY ALL""",
}
