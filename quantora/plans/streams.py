"""Streaming queries, run over what the event table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantora.streaming import events as ev


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts and sums by event type from the stream, all windows."""
    g = ev.event_stream(spark, f"{d}/events.parquet").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    rows = ev.run_to_end(g.select(F.col("window.start").alias("start"), "event_type", "n", "total"), "complete")
    return rows.select("start", "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """User sessions (gap of 30 minutes) from the stream, counted per user."""
    g = ev.event_stream(spark, f"{d}/events.parquet").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    rows = ev.run_to_end(g.select("user_id", F.col("session_window.start").alias("start"), "n"), "complete")
    return rows.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


ORACLES = {
    "stream_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sessions": """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events)
        SELECT user_id, CAST(sum(f) AS BIGINT) AS n_sessions, CAST(count(*) AS BIGINT) AS n_events FROM s GROUP BY user_id""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
