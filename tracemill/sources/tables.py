"""Recorded events and dialogue turns as the shapes that the operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.storage import table


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, event_type, value, t, k): one recorded stream a user, ordered by (t, event_id)."""
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros().alias("t"), k)


#: The same as a common table expression for DuckDB.
EVENTS_SQL = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t, json_extract_string(props, '$.k')::INT AS k FROM events)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, text): one dialogue a conversation, ordered by turn."""
    return table(spark, sf_dir, "conversations")
