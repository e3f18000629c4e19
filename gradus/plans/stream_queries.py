"""Queries of the streaming extension, run to the end over the events table, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.columns import r6
from gradus.session import shared_folder
from gradus.streaming import reviews


def _run(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    return reviews.run_to_end(stream, mode, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}")


def q_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    w = _run(spark, reviews.windowed_counts(reviews.event_stream(spark, d)), "complete")
    return w.select(F.unix_timestamp("start").alias("start_s"), "event_type", "n", r6(F.col("total")).alias("total"))


def q_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a learner without a pause longer than half an hour."""
    s = _run(spark, reviews.sessions(reviews.event_stream(spark, d)), "complete")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("finish").alias("finish_us"), "n")


def q_stream_memory(spark: SparkSession, d: str) -> DataFrame:
    m = _run(spark, reviews.memory_state(reviews.event_stream(spark, d)), "update")
    last = m.groupBy("user_id", "event_type").agg(F.max(F.struct("n_reviews", "stability")).alias("m"))
    return last.select("user_id", "event_type", F.col("m.n_reviews").cast("bigint").alias("n_reviews"), r6(F.log("m.stability")).alias("log_stability"))


def _sql() -> dict[str, str]:
    from gradus.plans.learning_queries import SQL

    return {
        "q_stream_windows": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*) AS n, floor(sum(value)::DOUBLE * 1e6 + 0.5) / 1e6 AS total FROM events GROUP BY ALL",
        "q_stream_sessions": """WITH g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL))
            SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS finish_us, count(*) AS n FROM g GROUP BY user_id, k""",
        "q_stream_memory": SQL["q_fsrs_fold"],
    }


QUERIES = {f.__name__: f for f in (q_stream_windows, q_stream_sessions, q_stream_memory)}
SQL = _sql()
