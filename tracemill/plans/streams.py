"""Streaming queries run to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.plans.registry import query
from tracemill.sources.tables import EVENTS_SQL
from tracemill.storage import shared_dir
from tracemill.streaming import jobs

HOUR = 3_600_000_000
ALONG = "PARTITION BY user_id ORDER BY t, event_id"


@query("stream_log_appends", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_log_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01/13/21: idempotent appends."""
    return jobs.to_end(jobs.log_appends(jobs.event_stream(spark, sf_dir)).select("event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "stream_sessions",
    f"""WITH {EVENTS_SQL}, m AS (SELECT *, CASE WHEN t - lag(t) OVER ({ALONG}) <= {6 * HOUR} THEN 0 ELSE 1 END AS new FROM e),
    i AS (SELECT *, sum(new) OVER ({ALONG}) AS g FROM m), s AS (SELECT user_id, g, count(*) AS n FROM i GROUP BY ALL)
    SELECT user_id, count(*) AS sessions, max(n) AS longest FROM s GROUP BY 1""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-15: session windows."""
    s = jobs.to_end(jobs.typing_sessions(jobs.event_stream(spark, sf_dir), "user_id", "6 hours"), "complete")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query(
    "stream_rate_limit",
    f"""WITH RECURSIVE {EVENTS_SQL}, a AS (SELECT user_id, t, row_number() OVER ({ALONG}) AS n FROM e WHERE event_type = 'click'),
    w AS (SELECT user_id, n, t, t AS start_t, 1 AS used FROM a WHERE n = 1
      UNION ALL SELECT a.user_id, a.n, a.t, CASE WHEN a.t - w.start_t >= {48 * HOUR} THEN a.t ELSE w.start_t END, CASE WHEN a.t - w.start_t >= {48 * HOUR} THEN 1 ELSE w.used + 1 END FROM w JOIN a ON a.user_id = w.user_id AND a.n = w.n + 1)
    SELECT user_id, count(*) AS attempts, count(*) FILTER (WHERE used > 3) AS refused FROM w GROUP BY user_id""",
)
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-08: the stateful form of the fixed-window limit."""
    attempts = jobs.event_stream(spark, sf_dir).where("event_type = 'click'").select("user_id", F.unix_micros("ts").alias("t"))
    out = jobs.to_end(jobs.limited(attempts, "user_id", 3, 48 * HOUR))
    return out.groupBy("user_id").agg(F.count("*").alias("attempts"), F.count_if("refused").alias("refused"))


@query("stream_routes", "SELECT CASE WHEN event_type = 'view' THEN 'live' ELSE 'saved' END AS route, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL")
def stream_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03: views go to a live feed only, other events to the history."""
    at = f"{shared_dir(spark)}/routes/{uuid.uuid4().hex}"
    jobs.routed(jobs.table_stream(spark, sf_dir, "events"), F.col("event_type") == "view", f"{at}/saved", f"{at}/live", f"{at}/log")
    sides = [spark.read.parquet(f"{at}/{side}").withColumn("route", F.lit(side)) for side in ("saved", "live")]
    return sides[0].unionByName(sides[1]).groupBy("route", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
