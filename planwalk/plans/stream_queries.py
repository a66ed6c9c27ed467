"""Streaming queries over the events table; each equals its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwalk.plans.views import oracle
from planwalk.registry import register
from planwalk.streaming import sessions


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = {"view": "START", "click": "PAUSE", "signup": "RESUME", "error": "CANCEL"}
    action = F.lit("COMPLETE")
    for event, name in kind.items():
        action = F.when(F.col("event_type") == event, name).otherwise(action)
    return sessions.event_stream(spark, sf_dir).select(F.col("user_id").alias("session_id"), "event_id", "ts", action.alias("action"))


@register(oracle("SELECT session_id, event_id, call_no FROM f_calls"))
def stream_walk_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls numbered per session by a keyed stream."""
    return sessions.walk(_calls(spark, sf_dir).drop("action"))


@register(
    oracle(
        """WITH run AS (SELECT session_id, event_id, call_no, CASE WHEN action = 'START' THEN 'ACTIVE' ELSE 'CREATED' END AS state, action = 'START' AS accepted FROM f_calls WHERE call_no = 1
  UNION ALL SELECT c.session_id, c.event_id, c.call_no, CASE WHEN action = 'START' AND r.state = 'CREATED' THEN 'ACTIVE' WHEN action = 'PAUSE' AND r.state = 'ACTIVE' THEN 'PAUSED' WHEN action = 'RESUME' AND r.state = 'PAUSED' THEN 'ACTIVE'
      WHEN action = 'CANCEL' AND r.state IN ('ACTIVE', 'PAUSED') THEN 'CANCELLED' WHEN action = 'COMPLETE' AND r.state = 'ACTIVE' THEN 'COMPLETED' ELSE r.state END,
    (action = 'START' AND r.state = 'CREATED') OR (action = 'PAUSE' AND r.state = 'ACTIVE') OR (action = 'RESUME' AND r.state = 'PAUSED') OR (action = 'CANCEL' AND r.state IN ('ACTIVE', 'PAUSED')) OR (action = 'COMPLETE' AND r.state = 'ACTIVE')
  FROM run r JOIN f_calls c ON c.session_id = r.session_id AND c.call_no = r.call_no + 1)
SELECT session_id, event_id, state, accepted FROM run"""
    )
)
def stream_session_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every action's state by a keyed stream."""
    return sessions.lifecycle(_calls(spark, sf_dir))


@register(oracle("SELECT date_trunc('hour', ts) AS start, event_type AS source, count(*) AS n FROM events GROUP BY 1, 2"))
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings per source and hour by a windowed stream."""
    found = sessions.drained_updates(sessions.window_counts(sessions.event_stream(spark, sf_dir)), "windows", ["start", "source"])
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))
