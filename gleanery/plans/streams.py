"""Event-time windows over events, as batches and as a drained stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.session import shared_path, table
from gleanery.streaming import events as E
from gleanery.streaming import logs as L


def tumbling_window(spark, sf):
    return E.windowed(E.timed(table(spark, sf, "events"), "ts"), "ts", "1 hour", None, ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sliding_window(spark, sf):
    return E.windowed(E.timed(table(spark, sf, "events"), "ts"), "ts", "2 hours", "1 hour", [], F.count("*").alias("n"))


def session_window(spark, sf):
    return E.sessions(E.timed(table(spark, sf, "events"), "ts"), "ts", "30 minutes", "user_id")


def first_of_kind(spark, sf):
    """One row per user and kind, then the users' names by a static join."""
    events = E.once(E.timed(table(spark, sf, "events"), "ts"), ["user_id", "event_type"]).select("user_id", "event_type")
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return E.enriched(events, names, "user_id")


def streamed_tumbling(spark, sf):
    """The tumbling windows that a stream over the table's file has closed when it ends."""
    made = E.windowed(E.timed(_stream(spark, sf), "ts", "10 minutes"), "ts", "1 hour", None, ["event_type"], F.count("*").alias("n"))
    return _drained(spark, made)


def streamed_sliding(spark, sf):
    """The sliding windows that a stream has closed when it ends."""
    return _drained(spark, E.windowed(E.timed(_stream(spark, sf), "ts", "10 minutes"), "ts", "2 hours", "1 hour", [], F.count("*").alias("n")))


def streamed_session(spark, sf):
    """The sessions that a stream has closed when it ends."""
    return _drained(spark, E.sessions(E.timed(_stream(spark, sf), "ts", "10 minutes"), "ts", "30 minutes", "user_id"))


def streamed_rewind(spark, sf):
    """A log of each user that rewinds as its rows arrive: what the changes add up to."""
    steps = _stream(spark, sf).select("user_id", "event_id", (F.col("event_id") % 997).alias("step"))
    return L.settled_log(_drained(spark, L.rewinding_changes(steps, "user_id", "event_id", "step")), "user_id", "event_id", "step")


def _stream(spark, sf):
    return spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")


def _drained(spark, made):
    place = shared_path(spark, "stream")
    return E.drained(made, f"{place}/out", f"{place}/state")


def streamed_once(spark, sf):
    """Users and kinds, each once on a stream whose watermark reaches over all events."""
    return _drained(spark, E.once(E.timed(_stream(spark, sf), "ts", "36500 days"), ["user_id", "event_type"]).select("user_id", "event_type"))


def streamed_join(spark, sf):
    """A stream with the names of its users."""
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return _drained(spark, E.enriched(_stream(spark, sf).select("event_id", "user_id"), names, "user_id"))


def streamed_upsert(spark, sf):
    """The latest event of each user, kept by batches of a stream."""
    place = shared_path(spark, "upsert")
    stream = _stream(spark, sf).select("user_id", "event_id", "event_type")
    query = stream.writeStream.foreachBatch(E.upsert_into(f"{place}/out", ["user_id"], "event_id")).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out/{(query.lastProgress['batchId'] if query.lastProgress else 0) % 2}")


QUERIES = {f.__name__: f for f in (tumbling_window, sliding_window, session_window, first_of_kind, streamed_tumbling, streamed_sliding, streamed_session, streamed_rewind, streamed_once, streamed_join, streamed_upsert)}
_SESSIONS = """g AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, TRUE)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)"""
ORACLE_SQL = {
    "streamed_sliding": "SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS start, count(*) AS n FROM events, range(2) t(k) GROUP BY 1 HAVING time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
    "streamed_session": f"WITH {_SESSIONS} SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
    "streamed_rewind": "WITH t AS (SELECT user_id, event_id, event_id % 997 AS step FROM events) SELECT user_id, event_id, step FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.user_id = t.user_id AND u.event_id > t.event_id AND u.step <= t.step)",
    "streamed_once": "SELECT DISTINCT user_id, event_type FROM events",
    "streamed_join": "SELECT event_id, user_id, c_name FROM events LEFT JOIN customer ON user_id = c_custkey",
    "streamed_upsert": "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "tumbling_window": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sliding_window": "SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS start, count(*) AS n FROM events, range(2) t(k) GROUP BY 1",
    "session_window": """WITH g AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, TRUE)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
        SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
    "first_of_kind": "SELECT DISTINCT user_id, event_type, c_name FROM events LEFT JOIN customer ON user_id = c_custkey",
    "streamed_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
}
