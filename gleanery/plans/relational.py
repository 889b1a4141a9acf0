"""General relational queries over the star schema and the events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.operators import joins
from gleanery.session import table

def _net():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))



def pricing_summary(spark, sf):
    items = table(spark, sf, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02'")
    return items.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(_net()), 2).alias("sum_disc"), F.round(F.sum(_net() * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n"))


def shipping_priority(spark, sf):
    customers = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    items = table(spark, sf, "lineitem").select("l_orderkey", _net().alias("net"))
    joined = items.join(orders.join(customers, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("l_orderkey", "o_orderpriority").agg(F.round(F.sum("net"), 1).alias("revenue"))


def local_supplier_volume(spark, sf):
    nations = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return joined.groupBy("n_name", "r_name").agg(F.round(F.sum(_net()), 2).alias("revenue"))


def forecast_revenue(spark, sf):
    items = table(spark, sf, "lineitem").filter("l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24")
    return items.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


def semi_anti_full(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    semi = customers.join(orders, "c_custkey", "left_semi").agg(F.count("*").alias("n")).withColumn("kind", F.lit("semi"))
    anti = customers.join(orders, "c_custkey", "left_anti").agg(F.count("*").alias("n")).withColumn("kind", F.lit("anti"))
    suppliers = table(spark, sf, "supplier").select((F.col("s_suppkey") * 20).alias("c_custkey"), "s_nationkey")
    full = customers.join(suppliers, "c_custkey", "full").agg(F.count("*").alias("n")).withColumn("kind", F.lit("full"))
    return semi.unionByName(anti).unionByName(full)


def as_of_join(spark, sf):
    """For each purchase-like event the value of the user's latest other event."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value", "event_type")
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.filter("event_type <> 'purchase'").select("user_id", "ts", F.round("value", 6).alias("value"))
    return joins.as_of(left, right, "user_id", "ts", "ts", "value", "latest").select("event_id", "latest")


def interval_join(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") % 5000).cast("double").alias("at"))
    spans = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", (F.col("o_orderkey") * 1.5).cast("double").alias("start")).withColumn("end", F.col("start") + 400)
    return joins.interval_join(events, spans, "user_id", "at", "start", "end", 250.0).select("event_id", "o_orderkey")


def cube_rollup(spark, sf):
    orders = table(spark, sf, "orders")
    cube = orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("long").alias("level"))
    return cube


def grouping_sets(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("_customer_sets")
    return spark.sql("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM _customer_sets GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")


def window_ranks(spark, sf):
    w = Window.partitionBy("o_orderpriority").orderBy("o_totalprice", "o_orderkey")
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"), F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("percent"), F.round(F.cume_dist().over(w), 6).alias("cume"), F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey", 2).over(w).alias("after"), F.nth_value("o_orderkey", 3).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("third"))


def set_operations(spark, sf):
    a, b = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("k"))
    parts = {"intersect": a.intersect(b), "intersect_all": a.intersectAll(b), "except": a.subtract(b), "except_all": a.exceptAll(b), "union": a.union(b).distinct()}
    out = None
    for name, rows in parts.items():
        row = rows.agg(F.count("*").alias("n"), F.sum("k").alias("total")).withColumn("op", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def distinct_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey", "l_suppkey").alias("pairs"))


def approximate_distinct(spark, sf):
    """A sketch's estimate has no exact SQL; rows are checked alone."""
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey").alias("orders"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("parts"))


def sketch_error(spark, sf):
    """Exact counts, and whether the estimates of two sketches and of their union lie within three of their standard errors."""
    near = lambda estimate, exact, error: F.abs(estimate - exact) <= 3 * error * exact + 1
    # what occurs again changes no sketch, and beside a distinct count there would be sketches for each key
    keys = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey").distinct()
    counted = [F.count("l_orderkey").alias("orders"), F.approx_count_distinct("l_orderkey", 0.03).alias("a")]
    flags = keys.groupBy("l_returnflag").agg(*counted, F.hll_sketch_agg("l_orderkey", F.lit(12)).alias("s"))
    made = flags.select("l_returnflag", "orders", "a", F.hll_sketch_estimate("s").alias("h"))
    parts = flags.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("h"))
    whole = keys.select("l_orderkey").distinct().agg(*counted).join(F.broadcast(parts)).select(F.lit("all").alias("l_returnflag"), "orders", "a", "h")
    return made.unionByName(whole).select("l_returnflag", "orders", near(F.col("a"), F.col("orders"), 0.03).alias("near"), near(F.col("h"), F.col("orders"), 0.02).alias("near_hll"))


def percentiles(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.round(F.percentile("o_totalprice", 0.5), 4).alias("median"), F.round(F.percentile("o_totalprice", 0.9), 4).alias("p90"), F.round(F.stddev("o_totalprice"), 2).alias("deviation"))


def discrete_percentile(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("_orders_percentile")
    return spark.sql("SELECT o_orderstatus, percentile_disc(0.25) WITHIN GROUP (ORDER BY o_totalprice) AS q FROM _orders_percentile GROUP BY o_orderstatus")


def listed(spark, sf):
    table(spark, sf, "nation").createOrReplaceTempView("_nation_listed")
    return spark.sql("SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS nations FROM _nation_listed GROUP BY n_regionkey")


def value_histogram(spark, sf):
    return table(spark, sf, "part").groupBy(F.floor(F.col("p_retailprice") / 100).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def date_parts(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.groupBy(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.count("*").alias("n"), F.max(F.datediff(F.lit("2000-01-01"), "o_orderdate")).alias("oldest"))


def decimal_sums(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.sum(F.col("c_acctbal").cast("decimal(12,2)")).cast("string").alias("total"))


def event_funnel(spark, sf):
    events = table(spark, sf, "events")
    return events.groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.count("event_id")).na.fill(0)


QUERIES = {f.__name__: f for f in (pricing_summary, shipping_priority, local_supplier_volume, forecast_revenue, semi_anti_full, as_of_join, interval_join, cube_rollup, grouping_sets, window_ranks, set_operations, distinct_counts, approximate_distinct, sketch_error, percentiles, discrete_percentile, listed, value_histogram, date_parts, decimal_sums, event_funnel)}
_N = "l_extendedprice * (1 - l_discount)"
ORACLE_SQL = {
    "sketch_error": "SELECT coalesce(l_returnflag, 'all') AS l_returnflag, count(DISTINCT l_orderkey) AS orders, TRUE AS near, TRUE AS near_hll FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())",
    "pricing_summary": f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum({_N}), 2) AS sum_disc, round(sum({_N} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "shipping_priority": f"SELECT l_orderkey, o_orderpriority, round(sum({_N}), 1) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2",
    "local_supplier_volume": f"SELECT n_name, r_name, round(sum({_N}), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "forecast_revenue": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24",
    "semi_anti_full": "WITH o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 100000) SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (FROM o) UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (FROM o) UNION ALL SELECT 'full', count(*) FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 20",
    "as_of_join": "WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(round(value, 6)) AS value FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2) SELECT event_id, value AS latest FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts",
    "interval_join": "SELECT event_id, o_orderkey FROM events JOIN orders ON user_id = o_custkey AND event_id % 5000 >= o_orderkey * 1.5 AND event_id % 5000 < o_orderkey * 1.5 + 400",
    "cube_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "window_ranks": "SELECT o_orderkey, rank() OVER w::INT AS rank, dense_rank() OVER w::INT AS dense, ntile(4) OVER w::INT AS quarter, round(percent_rank() OVER w, 6) AS percent, round(cume_dist() OVER w, 6) AS cume, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after, nth_value(o_orderkey, 3) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)",
    "set_operations": "WITH a AS (SELECT o_custkey AS k FROM orders), b AS (SELECT c_custkey * 2 AS k FROM customer) " + " UNION ALL ".join(f"SELECT '{n}' AS op, count(*) AS n, sum(k)::BIGINT AS total FROM (FROM a {sql} FROM b)" for n, sql in (("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL"), ("union", "UNION"))),
    "distinct_counts": "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem GROUP BY 1",
    "percentiles": "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(stddev(o_totalprice), 2) AS deviation FROM orders GROUP BY 1",
    "discrete_percentile": "SELECT o_orderstatus, quantile_disc(o_totalprice, 0.25) AS q FROM orders GROUP BY 1",
    "listed": "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nation GROUP BY 1",
    "value_histogram": "SELECT floor(p_retailprice / 100)::BIGINT AS bin, count(*) AS n FROM part GROUP BY 1",
    "date_parts": "SELECT year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter, count(*) AS n, max(date_diff('day', o_orderdate::DATE, DATE '2000-01-01'))::INT AS oldest FROM orders GROUP BY 1, 2",
    "decimal_sums": "SELECT c_mktsegment, sum(c_acctbal::DECIMAL(12,2))::VARCHAR AS total FROM customer GROUP BY 1",
    "event_funnel": "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1",
}
