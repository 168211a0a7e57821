"""Queries over recorded event streams. One user's events are one recorded workflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.functions import scalars as S
from tracemill.operators import intervals, keyed, sequences, statistics
from tracemill.plans.registry import query
from tracemill.sources.tables import EVENTS_SQL, events
from tracemill.storage import table

HOUR = 3_600_000_000
ALONG = "PARTITION BY user_id ORDER BY t, event_id"


def along(*more: str):
    return W.partitionBy("user_id", *more).orderBy("t", "event_id")


@query(
    "session_stats",
    f"""WITH {EVENTS_SQL}, m AS (SELECT *, CASE WHEN t - lag(t) OVER ({ALONG}) <= {6 * HOUR} THEN 0 ELSE 1 END AS new FROM e),
    i AS (SELECT *, sum(new) OVER ({ALONG}) AS island FROM m)
    SELECT user_id, count(DISTINCT island) AS sessions, count(*) AS events, max(n) AS longest FROM
      (SELECT *, count(*) OVER (PARTITION BY user_id, island) AS n FROM i) GROUP BY user_id""",
)
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-02, SEQ-03, AGG-01: runs of a user's events at most six hours apart."""
    e = sequences.islands(events(spark, sf_dir), ["user_id"], "t", "event_id", F.lit(True), 6 * HOUR)
    each = e.groupBy("user_id", "_island").agg(F.count("*").alias("n"))
    return each.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


@query(
    "scl_event_time",
    f"""WITH {EVENTS_SQL} SELECT event_id, (t - min(t) OVER (PARTITION BY user_id)) AS since_first,
    (t - min(t) OVER (PARTITION BY user_id)) // 1000 AS ms FROM e""",
)
def scl_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-02/03: time since the stream's first event."""
    since = F.col("t") - F.min("t").over(W.partitionBy("user_id"))
    return events(spark, sf_dir).select("event_id", since.alias("since_first"), F.floor(since / 1000).alias("ms"))


@query(
    "scl_running_screen",
    f"""WITH {EVENTS_SQL} SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN 800 + k * 16 END IGNORE NULLS)
    OVER ({ALONG} ROWS UNBOUNDED PRECEDING), 1920) AS width FROM e""",
)
def scl_running_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-04, STR-22: latest configured width, carried forward, with a default."""
    config = F.when(F.col("event_type") == "signup", 800 + F.col("k") * 16)
    w = along().rowsBetween(W.unboundedPreceding, 0)
    return events(spark, sf_dir).select("event_id", F.coalesce(F.last(config, ignorenulls=True).over(w), F.lit(1920)).alias("width"))


@query(
    "scl_grid",
    "SELECT event_id, round_even(least(1.0, greatest(0.0, value / 400.0)) * 999, 0)::INT AS grid, "
    "(sign(value - 100) * greatest(1.0, round_even(abs(value - 100), 0)))::INT AS delta FROM events",
)
def scl_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-01/05/06/08: share of an extent on the grid, whole signed steps."""
    v = S.finite(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", S.to_grid(S.unit(v, 400.0)).alias("grid"), S.whole_delta(v - 100).alias("delta"))


@query(
    "scl_modifiers",
    f"""WITH {EVENTS_SQL} SELECT event_id, concat_ws('+', CASE WHEN k & 2 <> 0 THEN 'ctrl' END, CASE WHEN k & 1 <> 0 THEN 'shift' END,
    CASE WHEN k & 4 <> 0 THEN 'alt' END, CASE WHEN k & 8 <> 0 THEN 'meta' END) AS names, (k & 15) AS mask FROM e""",
)
def scl_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-12: bit mask to names and back."""
    names = S.modifier_names(F.col("k"))
    return events(spark, sf_dir).select("event_id", F.array_join(names, "+").alias("names"), S.modifier_mask(names).alias("mask"))


@query(
    "scl_image_tokens",
    """WITH s AS (SELECT o_orderkey, (64 + o_custkey * 7 % 4000)::DOUBLE AS w, (64 + o_orderkey * 13 % 3000)::DOUBLE AS h FROM orders),
    n AS (SELECT *, greatest(32.0, round_even(h / 32.0, 0) * 32) AS hb, greatest(32.0, round_even(w / 32.0, 0) * 32) AS wb,
      sqrt(h * w / 1048576.0) AS dn, sqrt(65536.0 / (h * w)) AS up FROM s)
    SELECT o_orderkey, (CASE WHEN hb * wb > 1048576 THEN greatest(32.0, floor(h / dn / 32.0) * 32) WHEN hb * wb < 65536 THEN ceil(h * up / 32.0) * 32 ELSE hb END / 32.0 *
      (CASE WHEN hb * wb > 1048576 THEN greatest(32.0, floor(w / dn / 32.0) * 32) WHEN hb * wb < 65536 THEN ceil(w * up / 32.0) * 32 ELSE wb END / 32.0))::BIGINT AS tokens FROM n""",
)
def scl_image_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-17: tokens of resized images."""
    w, h = 64 + F.col("o_custkey") * 7 % 4000, 64 + F.col("o_orderkey") * 13 % 3000
    return table(spark, sf_dir, "orders").select("o_orderkey", S.image_tokens(w, h).alias("tokens"))


SPANS_SQL = f"""s AS (SELECT user_id, event_id AS span_id, t AS start_t, coalesce(lead(t) OVER ({ALONG}), (SELECT max(t) + 1 FROM e a WHERE a.user_id = x.user_id)) AS end_t
    FROM e x WHERE event_type = 'error')"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each error to the next of its stream, the last to the stream's end, that included."""
    ended = events(spark, sf_dir).withColumn("end", F.max("t").over(W.partitionBy("user_id")) + 1)
    return intervals.until_next(ended.where("event_type = 'error'"), ["user_id"], "t", "event_id", end="end")


@query(
    "join_actions_in_spans",
    f"""WITH {EVENTS_SQL}, {SPANS_SQL} SELECT s.span_id, count(*) AS actions, min(e.t - s.start_t) AS first_after, sum(e.k) AS k
    FROM s JOIN e ON e.user_id = s.user_id AND e.t >= s.start_t AND e.t < s.end_t AND e.event_type <> 'error' GROUP BY s.span_id""",
)
def join_actions_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-01, SEQ-21: actions of each half-open span."""
    e = events(spark, sf_dir).where("event_type <> 'error'").select("user_id", "event_id", "t", "k")
    j = intervals.interval_join(e, spans(spark, sf_dir), ["user_id"], "t", "start_t", "end_t", 24 * HOUR)
    return j.groupBy("span_id").agg(F.count("*").alias("actions"), F.min(F.col("t") - F.col("start_t")).alias("first_after"), F.sum("k").alias("k"))


@query(
    "join_last_frame",
    f"""WITH {EVENTS_SQL}, v AS (SELECT user_id, t, event_id AS frame FROM e WHERE event_type = 'view'),
    c AS (SELECT * FROM e WHERE event_type = 'click'),
    j AS (SELECT c.event_id, c.t, c.user_id, max_by(v.frame, (v.t, v.frame)) AS frame, max(v.t) AS frame_t FROM c LEFT JOIN v ON v.user_id = c.user_id AND v.t <= c.t - 10000 GROUP BY ALL)
    SELECT event_id, frame AS last_frame, t - frame_t AS age, coalesce(t - frame_t <= {4 * HOUR}, false) AS fresh FROM j""",
)
def join_last_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-02/03, FLT-11: each action's latest frame at least 10 ms older, and whether it is fresh."""
    e = events(spark, sf_dir)
    frames = e.where("event_type = 'view'").withColumn("frame", F.col("event_id")).withColumn("frame_t", F.col("t"))
    j = intervals.last_before(e.where("event_type = 'click'"), frames, ["user_id"], "t", "event_id", ["frame", "frame_t"], lag=10_000)
    age = F.col("t") - F.col("last_frame_t")
    return j.select("event_id", "last_frame", age.alias("age"), F.coalesce(age <= 4 * HOUR, F.lit(False)).alias("fresh"))


MASKS_SQL = f"m AS (SELECT user_id, event_id, t AS start_t, t + {2 * HOUR} AS end_t FROM e WHERE event_type = 'purchase' AND k % 4 = 0)"


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'purchase' and k % 4 = 0").select("user_id", F.col("t").alias("start_t"), (F.col("t") + 2 * HOUR).alias("end_t"))


@query(
    "join_span_masked",
    f"WITH {EVENTS_SQL}, {SPANS_SQL}, {MASKS_SQL} SELECT span_id, user_id FROM s WHERE EXISTS (SELECT 1 FROM m WHERE m.user_id = s.user_id AND m.start_t < s.end_t AND m.end_t > s.start_t)",
)
def join_span_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-04: spans that overlap a privacy interval."""
    return intervals.overlaps(spans(spark, sf_dir), _masks(spark, sf_dir), ["user_id"], "start_t", "end_t", 24 * HOUR).select("span_id", "user_id")


@query(
    "join_span_unmasked",
    f"WITH {EVENTS_SQL}, {SPANS_SQL}, {MASKS_SQL} SELECT span_id, user_id FROM s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = s.user_id AND m.start_t < s.end_t AND m.end_t > s.start_t)",
)
def join_span_unmasked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-04, FLT-06: spans clear of privacy intervals."""
    return intervals.overlaps(spans(spark, sf_dir), _masks(spark, sf_dir), ["user_id"], "start_t", "end_t", 24 * HOUR, anti=True).select("span_id", "user_id")


@query(
    "geo_interval_union",
    f"""WITH {EVENTS_SQL}, {MASKS_SQL}, n AS (SELECT *, CASE WHEN start_t <= max(end_t) OVER (PARTITION BY user_id ORDER BY start_t, end_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {HOUR} THEN 0 ELSE 1 END AS new FROM m),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start_t, end_t ROWS UNBOUNDED PRECEDING) AS g FROM n)
    SELECT user_id, min(start_t) AS start_t, max(end_t) AS end_t, count(*) AS n FROM i GROUP BY user_id, g""",
)
def geo_interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-12: unions of intervals that nearly touch."""
    return intervals.merged(_masks(spark, sf_dir), ["user_id"], "start_t", "end_t", HOUR)


@query(
    "flt_reject_reasons",
    f"""WITH {EVENTS_SQL}, {SPANS_SQL}, r AS (SELECT CASE WHEN end_t - start_t < {HOUR} THEN 'too_short' WHEN user_id % 7 = 0 THEN 'off_target' WHEN end_t - start_t > {96 * HOUR} THEN 'idle' END AS reason FROM s)
    SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1""",
)
def flt_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05/06/08/10: the first failing gate counts."""
    long = F.col("end_t") - F.col("start_t")
    reason = F.when(long < HOUR, "too_short").when(F.col("user_id") % 7 == 0, "off_target").when(long > 96 * HOUR, "idle").otherwise("kept")
    return spans(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    "flt_quality_flags",
    f"""WITH {EVENTS_SQL}, q AS (SELECT *, list_filter([CASE WHEN value < 20 THEN 'low' END, CASE WHEN k % 2 = 0 THEN 'even' END, CASE WHEN event_type = 'error' THEN 'error' END], lambda x: x IS NOT NULL) AS flags,
      4 * (value >= 20)::INT + 2 * (k % 2 = 1)::INT + 4 * (event_type <> 'error')::INT AS score FROM e)
    SELECT flag, count(*) AS n, sum(score) AS score FROM (SELECT unnest(flags) AS flag, score FROM q WHERE score < 9) GROUP BY flag""",
)
def flt_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07: weighted score; a row below the least score counts under every flag."""
    low, even, error = F.col("value") < 20, F.col("k") % 2 == 0, F.col("event_type") == "error"
    flags = F.filter(F.array(F.when(low, F.lit("low")), F.when(even, F.lit("even")), F.when(error, F.lit("error"))), lambda x: x.isNotNull())
    score = F.when(low, 0).otherwise(4) + F.when(even, 0).otherwise(2) + F.when(error, 0).otherwise(4)
    q = events(spark, sf_dir).select(flags.alias("flags"), score.alias("score")).where("score < 9")
    return q.select(F.explode("flags").alias("flag"), "score").groupBy("flag").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


@query(
    "flt_mask_state",
    f"""WITH {EVENTS_SQL}, m AS (SELECT *, last_value(CASE event_type WHEN 'signup' THEN true WHEN 'purchase' THEN false END IGNORE NULLS) OVER ({ALONG} ROWS UNBOUNDED PRECEDING) AS masked FROM e)
    SELECT event_type, count(*) AS n FROM m WHERE event_type IN ('click', 'view') AND NOT coalesce(masked, false) GROUP BY 1""",
)
def flt_mask_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01/02, STR-14: events outside of an open mask; a mask without end stays open."""
    edge = F.when(F.col("event_type") == "signup", True).when(F.col("event_type") == "purchase", False)
    masked = F.last(edge, ignorenulls=True).over(along().rowsBetween(W.unboundedPreceding, 0))
    m = events(spark, sf_dir).withColumn("masked", masked).where(F.col("event_type").isin("click", "view") & ~F.coalesce("masked", F.lit(False)))
    return m.groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "seq_typing_groups",
    f"""WITH {EVENTS_SQL}, m AS (SELECT *, event_type IN ('click', 'view') AS typ FROM e),
    n AS (SELECT *, typ AND NOT coalesce(lag(typ) OVER ({ALONG}) AND t - lag(t) OVER ({ALONG}) <= {12 * HOUR}, false) AS new FROM m),
    i AS (SELECT *, sum(new::INT) OVER ({ALONG}) AS g FROM n)
    SELECT user_id, min(t) AS first_t, max(t) AS end_t, count(*) AS n, string_agg(left(event_type, 1), '' ORDER BY t, event_id) AS text FROM i WHERE typ GROUP BY user_id, g HAVING count(*) >= 2""",
)
def seq_typing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-03/04, STR-15: runs of typing that no other action interrupts, texts joined."""
    i = sequences.islands(events(spark, sf_dir), ["user_id"], "t", "event_id", F.col("event_type").isin("click", "view"), 12 * HOUR).where("_island is not null")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "event_id", F.left("event_type", F.lit(1)).alias("c")))), lambda x: x["c"]), "")
    g = i.groupBy("user_id", "_island").agg(F.min("t").alias("first_t"), F.max("t").alias("end_t"), F.count("*").alias("n"), text.alias("text"))
    return g.where("n >= 2").drop("_island")


@query(
    "seq_running_bounds",
    f"""WITH {EVENTS_SQL} SELECT event_id, greatest(coalesce(max(t + k * 1000000) OVER ({ALONG} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0),
    coalesce(max(CASE WHEN event_type = 'error' THEN t END) OVER ({ALONG} ROWS UNBOUNDED PRECEDING), 0)) AS lower_t FROM e""",
)
def seq_running_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-06: latest earlier end or barrier."""
    end = F.max(F.col("t") + F.col("k") * 1_000_000).over(along().rowsBetween(W.unboundedPreceding, -1))
    barrier = F.max(F.when(F.col("event_type") == "error", F.col("t"))).over(along().rowsBetween(W.unboundedPreceding, 0))
    return events(spark, sf_dir).select("event_id", F.greatest(F.coalesce(end, F.lit(0)), F.coalesce(barrier, F.lit(0))).alias("lower_t"))


@query(
    "seq_chunk_prefix",
    f"""WITH {EVENTS_SQL}, a AS (SELECT user_id, list(t ORDER BY t, event_id) AS ts FROM e GROUP BY user_id),
    b AS (SELECT *, list_min(list_filter(range(1, len(ts)), lambda i: ts[i + 1] - ts[i] > {8 * HOUR})) AS stop FROM a)
    SELECT user_id, least(6, coalesce(stop, len(ts)))::INT AS taken FROM b""",
)
def seq_chunk_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-08: longest prefix of few, near actions."""
    first = sequences.near_prefix(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "t", 6, 8 * HOUR)
    return first.groupBy("user_id").agg(F.count("*").cast("int").alias("taken"))


@query(
    "seq_episodes",
    f"""WITH {EVENTS_SQL}, a AS (SELECT *, row_number() OVER ({ALONG}) AS n FROM e), c AS (SELECT * FROM a WHERE event_type <> 'error'),
    b AS (SELECT *, CASE WHEN n = lag(n) OVER (PARTITION BY user_id ORDER BY n) + 1 THEN 0 ELSE 1 END AS new FROM c),
    d AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY n) AS episode FROM b)
    SELECT user_id, episode, count(*) AS steps, min(event_id) AS first_event FROM d GROUP BY ALL""",
)
def seq_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-10/11: accepted rows in runs of neighbouring indices."""
    a = events(spark, sf_dir).withColumn("n", F.row_number().over(along())).where("event_type <> 'error'")
    w = W.partitionBy("user_id").orderBy("n")
    d = a.withColumn("_gap", F.coalesce(F.col("n") != F.lag("n").over(w) + 1, F.lit(True)))
    d = sequences.episodes(d, ["user_id"], ["n"], F.col("_gap"))
    return d.groupBy("user_id", "episode").agg(F.count("*").alias("steps"), F.min("event_id").alias("first_event"))


@query(
    "seq_round_robin",
    """WITH d AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS depth FROM orders),
    p AS (SELECT *, row_number() OVER (ORDER BY depth, o_orderpriority) AS place FROM d) SELECT o_orderkey, place FROM p WHERE place <= 200""",
)
def seq_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-12, TOP-04: groups take turns; a top-200 report, so each group's first 200 are enough to place."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    first = o.withColumn("_n", F.row_number().over(W.partitionBy("o_orderpriority").orderBy("o_orderkey"))).where("_n <= 200").drop("_n")
    return sequences.round_robin(first, "o_orderpriority", ["o_orderkey"]).where("place <= 200").select("o_orderkey", "place")


@query(
    "seq_stratified",
    f"""WITH {EVENTS_SQL}, b AS (SELECT *, least(4, 5 * (t - min(t) OVER w) // greatest(1, max(t) OVER w - min(t) OVER w)) AS part, sha256(event_id::VARCHAR) AS h FROM e WINDOW w AS (PARTITION BY user_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, part ORDER BY h DESC) AS rn FROM b),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn, event_type, part) AS place FROM r) SELECT user_id, event_id FROM p WHERE place <= 12""",
)
def seq_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-13, TOP-07: rows of (type, fifth of the time) buckets in hash order, buckets taking turns."""
    w = W.partitionBy("user_id")
    part = F.least(F.lit(4), F.floor(5 * (F.col("t") - F.min("t").over(w)) / F.greatest(F.lit(1), F.max("t").over(w) - F.min("t").over(w))))
    b = events(spark, sf_dir).withColumn("part", part).withColumn("h", F.sha2(F.col("event_id").cast("string"), 256))
    r = b.withColumn("rn", F.row_number().over(W.partitionBy("user_id", "event_type", "part").orderBy(F.desc("h"))))
    return r.withColumn("place", F.row_number().over(w.orderBy("rn", "event_type", "part"))).where("place <= 12").select("user_id", "event_id")


@query(
    "seq_repetition_guard",
    f"""WITH {EVENTS_SQL}, l AS (SELECT event_id, event_type AS x0, {', '.join(f"lag(event_type, {k}) OVER ({ALONG}) AS x{k}" for k in range(1, 12))} FROM e)
    SELECT event_id, coalesce(x0 = x1 AND x1 = x2, false) OR coalesce(x0 = x2 AND x1 = x3 AND x2 = x4 AND x3 = x5, false)
    OR coalesce(x0 = x3 AND x1 = x4 AND x2 = x5 AND x3 = x6 AND x4 = x7 AND x5 = x8, false)
    OR coalesce(x0 = x4 AND x1 = x5 AND x2 = x6 AND x3 = x7 AND x4 = x8 AND x5 = x9 AND x6 = x10 AND x7 = x11, false) AS repeated FROM l""",
)
def seq_repetition_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-15: third repetition in a row of a cycle of one to four actions."""
    e = events(spark, sf_dir)
    return e.select("event_id", sequences.repeats_cycle(e, ["user_id"], ["t", "event_id"], "event_type").alias("repeated"))


@query(
    "seq_lag_audit",
    f"""WITH {EVENTS_SQL}, l AS (SELECT *, t - lag(t) OVER ({ALONG}) AS dt, count(*) OVER (PARTITION BY user_id, event_type, k ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM e)
    SELECT event_type, count(*) FILTER (WHERE dt < 0) AS backwards, count(*) FILTER (WHERE dt > {24 * HOUR}) AS gaps, count(*) FILTER (WHERE seen > 1) AS repeats FROM l GROUP BY 1""",
)
def seq_lag_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-16, FLT-12: order, gaps and repeated fingerprints."""
    seen = F.count("*").over(W.partitionBy("user_id", "event_type", "k").orderBy("t", "event_id").rowsBetween(W.unboundedPreceding, 0))
    d = events(spark, sf_dir).select("event_type", (F.col("t") - F.lag("t").over(along())).alias("dt"), seen.alias("seen"))
    return d.groupBy("event_type").agg(F.count_if(F.col("dt") < 0).alias("backwards"), F.count_if(F.col("dt") > 24 * HOUR).alias("gaps"), F.count_if(F.col("seen") > 1).alias("repeats"))


@query(
    "seq_latest_state",
    f"WITH {EVENTS_SQL} SELECT user_id, event_type, max_by(event_id, (t, event_id)) AS event_id, max_by(k, (t, event_id)) AS k FROM e GROUP BY ALL",
)
def seq_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-18, STR-10: last row of each key."""
    d = events(spark, sf_dir).select("user_id", "event_type", "t", "event_id", "k")
    return keyed.latest(d, ["user_id", "event_type"], ["t", "event_id"]).select("user_id", "event_type", "event_id", "k")


@query(
    "seq_recovery_budget",
    f"""WITH {EVENTS_SQL}, g AS (SELECT *, sum((event_type = 'purchase')::INT) OVER ({ALONG}) AS run FROM e),
    c AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, run ORDER BY t, event_id) AS failures FROM g)
    SELECT user_id, count(*) FILTER (WHERE failures >= 4) AS over_budget, max(failures)::BIGINT AS worst FROM c GROUP BY user_id""",
)
def seq_recovery_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11: failures since the last progress."""
    d = sequences.episodes(events(spark, sf_dir), ["user_id"], ["t", "event_id"], F.col("event_type") == "purchase", "run")
    failures = F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(along("run").rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("failures", failures)
    return d.groupBy("user_id").agg(F.count_if(F.col("failures") >= 4).alias("over_budget"), F.max("failures").alias("worst"))


@query(
    "str_rate_limit",
    f"""WITH RECURSIVE {EVENTS_SQL}, a AS (SELECT user_id, t, row_number() OVER ({ALONG}) AS n FROM e WHERE event_type = 'signup'),
    w AS (SELECT user_id, n, t, t AS start_t, 1 AS used FROM a WHERE n = 1
      UNION ALL SELECT a.user_id, a.n, a.t, CASE WHEN a.t - w.start_t >= {48 * HOUR} THEN a.t ELSE w.start_t END, CASE WHEN a.t - w.start_t >= {48 * HOUR} THEN 1 ELSE w.used + 1 END FROM w JOIN a ON a.user_id = w.user_id AND a.n = w.n + 1)
    SELECT user_id, count(*) AS attempts, count(*) FILTER (WHERE used > 3) AS refused FROM w GROUP BY user_id""",
)
def str_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-08: fixed windows that start at the first attempt; each client's attempts stream past."""
    attempts = events(spark, sf_dir).where("event_type = 'signup'").select("user_id", "t", "event_id")
    schema = f"user_id {attempts.schema['user_id'].dataType.simpleString()}, attempts long, refused long"
    return sequences.fold(attempts, ["user_id"], ["t", "event_id"], lambda: sequences.FixedWindow(48 * HOUR, 3), schema)


@query(
    "str_call_budget",
    f"""WITH {EVENTS_SQL}, n AS (SELECT *, count(*) OVER ({ALONG}) AS calls, t - min(t) OVER (PARTITION BY user_id) AS age FROM e WHERE event_type = 'view')
    SELECT event_id, calls <= 8 AND age <= {240 * HOUR} AS allowed FROM n""",
)
def str_call_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-18: calls within a count and a deadline."""
    v = events(spark, sf_dir).where("event_type = 'view'")
    calls = F.count("*").over(along().rowsBetween(W.unboundedPreceding, 0))
    age = F.col("t") - F.min("t").over(W.partitionBy("user_id"))
    return v.select("event_id", ((calls <= 8) & (age <= 240 * HOUR)).alias("allowed"))


@query(
    "agg_event_histogram",
    "SELECT event_type, count(*) AS n, min(event_id) AS first_seen, row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS rank FROM events GROUP BY event_type",
)
def agg_event_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01: most common first, ties by first occurrence."""
    c = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen"))
    return c.withColumn("rank", F.row_number().over(W.partitionBy().orderBy(F.desc("n"), "first_seen")))


@query(
    "agg_nearest_rank",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(value) FILTER (WHERE i = round_even(0.5 * (n - 1), 0)) AS p50, max(value) FILTER (WHERE i = round_even(0.95 * (n - 1), 0)) AS p95, max(value) FILTER (WHERE i = n - 1) AS p100 FROM r GROUP BY 1""",
)
def agg_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03/04/06: nearest-rank percentiles, half to even."""
    return statistics.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p100": 1.0})


@query(
    "agg_leave_one_out",
    f"""WITH {EVENTS_SQL}, g AS (SELECT user_id, event_id, k, sum(k) OVER (PARTITION BY user_id) AS s, count(*) OVER (PARTITION BY user_id) AS n FROM e)
    SELECT event_id, CASE WHEN n > 1 THEN k - (s - k) / (n - 1) END AS advantage FROM g""",
)
def agg_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: advantage over the others of the group."""
    return events(spark, sf_dir).select("event_id", statistics.leave_one_out(F.col("k"), "user_id").alias("advantage"))


@query("agg_cross_tab", "SELECT event_type, count(*) FILTER (WHERE k < 50) AS low, count(*) FILTER (WHERE k >= 50) AS high FROM (SELECT event_type, json_extract_string(props, '$.k')::INT AS k FROM events) GROUP BY 1")
def agg_cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15: counts by two keys."""
    side = F.when(F.col("k") < 50, "low").otherwise("high")
    return events(spark, sf_dir).withColumn("side", side).groupBy("event_type").pivot("side", ["low", "high"]).count().fillna(0)


@query(
    "agg_issue_samples",
    f"""WITH {EVENTS_SQL}, i AS (SELECT event_type AS issue, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM e WHERE k % 10 = 0)
    SELECT issue, n, string_agg(event_id::VARCHAR, ',' ORDER BY rn) AS samples FROM i WHERE rn <= 8 GROUP BY issue, n""",
)
def agg_issue_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12: each issue's count and first eight samples (a report's limit)."""
    bad = events(spark, sf_dir).where("k % 10 = 0").select(F.col("event_type").alias("issue"), "event_id")
    first = bad.withColumn("rn", F.row_number().over(W.partitionBy("issue").orderBy("event_id"))).where("rn <= 8")
    samples = first.groupBy("issue").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("samples"))
    return bad.groupBy("issue").agg(F.count("*").alias("n")).join(samples, "issue").select("issue", "n", "samples")


@query(
    "agg_arg_min_sample",
    f"WITH {EVENTS_SQL} SELECT event_type, k % 5 AS bucket, min_by(event_id, sha256(event_id::VARCHAR)) AS event_id FROM e GROUP BY ALL",
)
def agg_arg_min_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13: one row a bucket, least by hash."""
    return events(spark, sf_dir).groupBy("event_type", (F.col("k") % 5).alias("bucket")).agg(F.min_by("event_id", F.sha2(F.col("event_id").cast("string"), 256)).alias("event_id"))


@query(
    "join_upsert",
    """WITH b AS (SELECT user_id, event_type, event_id, 0 AS side FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT user_id, event_type, event_id, 1 FROM events WHERE event_id % 3 = 0)
    SELECT user_id, min((side, event_id))[2] AS event_id, max_by(event_type, (side, event_id)) AS event_type FROM (SELECT user_id, event_type, event_id, side FROM b) GROUP BY user_id""",
)
def join_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-16, SET-06: last write wins, first position stays."""
    d = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return keyed.upsert(d.where("event_id % 3 <> 0"), d.where("event_id % 3 = 0"), ["user_id"], "event_id").drop("side")


@query(
    "join_reconcile",
    """SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN b.event_id IS NULL THEN 'lost' WHEN a.event_id IS NULL THEN 'added' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS status
    FROM (SELECT event_id, event_type AS v FROM events WHERE event_id % 5 <> 0) a FULL JOIN (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'x' ELSE event_type END AS v FROM events WHERE event_id % 4 <> 0) b ON a.event_id = b.event_id""",
)
def join_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-08/31, FLT-13: two versions of one table."""
    d = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("v"))
    new = d.withColumn("v", F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.col("v"))).where("event_id % 4 <> 0")
    return keyed.reconcile(d.where("event_id % 5 <> 0"), new, "event_id", "v")


@query(
    "join_except_latest",
    """WITH a AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events), g AS (SELECT user_id, count(*) AS c FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT event_id FROM a LEFT JOIN g USING (user_id) WHERE n > coalesce(c, 0)""",
)
def join_except_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-25: multiset difference from the tail."""
    d = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return keyed.except_latest(d, d.where("event_type = 'purchase'"), "user_id", "event_id").select("event_id")


@query("str_dedupe_log", "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_id, event_type FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 2 = 0)) GROUP BY 1")
def str_dedupe_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16, STR-01: appends with an id seen before don't count."""
    d = table(spark, sf_dir, "events").select("event_id", "event_type")
    return d.union(d.where("event_id % 2 = 0")).dropDuplicates(["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "top_paged",
    "SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS place, (SELECT count(*) FROM events) AS total FROM events ORDER BY value DESC, event_id LIMIT 20 OFFSET 40",
)
def top_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-10/12: one page of a ranking with its total; only the pages up to it are ranked."""
    d = table(spark, sf_dir, "events")
    top = d.orderBy(F.desc("value"), "event_id").limit(60).select("event_id", "value")
    placed = top.withColumn("place", F.row_number().over(W.partitionBy().orderBy(F.desc("value"), "event_id"))).where("place > 40")
    return placed.crossJoin(d.agg(F.count("*").alias("total"))).select("event_id", "place", "total")


@query(
    "seq_gestures",
    f"""WITH {EVENTS_SQL}, d AS (SELECT user_id AS workflow, t, event_id, value AS x, k::DOUBLE AS y, CASE event_type WHEN 'click' THEN 'press' WHEN 'view' THEN 'move' WHEN 'purchase' THEN 'release' WHEN 'error' THEN 'close' END AS kind FROM e),
    n AS (SELECT *, count(*) FILTER (WHERE kind <> 'move') OVER (PARTITION BY workflow ORDER BY t, event_id) AS edge FROM d WHERE kind IS NOT NULL),
    p AS (SELECT workflow, edge, t, x, y FROM n WHERE kind = 'press'),
    c AS (SELECT p.workflow, p.edge, p.t, p.x, p.y, count(m.t) FILTER (WHERE m.kind = 'move') AS path, max(m.t) FILTER (WHERE m.kind = 'release') AS released,
      coalesce(max(m.t) FILTER (WHERE m.kind = 'release'), NULL) IS NOT NULL AS done, arg_max(m.x, (m.t, m.event_id)) AS ex, arg_max(m.y, (m.t, m.event_id)) AS ey
      FROM p LEFT JOIN n m ON m.workflow = p.workflow AND ((m.kind = 'move' AND m.edge = p.edge) OR (m.kind = 'release' AND m.edge = p.edge + 1)) GROUP BY ALL),
    g AS (SELECT *, coalesce(ex, x) AS lx, coalesce(ey, y) AS ly, sqrt((coalesce(ex, x) - x) ** 2 + (coalesce(ey, y) - y) ** 2) >= 4 AS drag FROM c)
    SELECT workflow, t, CASE WHEN drag THEN 'drag' ELSE 'click' END AS type, x, y, CASE WHEN drag THEN lx END AS end_x, CASE WHEN drag THEN ly END AS end_y, CASE WHEN drag THEN path END AS path_points, CASE WHEN drag THEN released - t END AS duration FROM g""",
)
def seq_gestures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-01: presses, moves and releases of each stream as clicks and drags."""
    kind = F.create_map(*(F.lit(x) for x in ("click", "press", "view", "move", "purchase", "release", "error", "close")))
    d = events(spark, sf_dir).select(F.col("user_id").alias("workflow"), "t", F.col("event_id").alias("line_no"), F.get(F.array(kind), F.lit(0))[F.col("event_type")].alias("kind"), F.col("value").alias("x"), F.col("k").cast("double").alias("y"))
    return sequences.gestures(d.where("kind is not null"))


@query(
    "seq_scroll_runs",
    f"""WITH RECURSIVE {EVENTS_SQL}, s AS (SELECT user_id AS workflow, t / 1e6 AS t, (k % 7 - 3)::DOUBLE AS delta, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e WHERE event_type = 'view'),
    w AS (SELECT workflow, i, 1 AS run, t AS start, t AS last, delta AS total, 1 AS n FROM s WHERE i = 1
      UNION ALL SELECT s.workflow, s.i, CASE WHEN j.on_ THEN w.run ELSE w.run + 1 END, CASE WHEN j.on_ THEN w.start ELSE s.t END, s.t, CASE WHEN j.on_ THEN w.total + s.delta ELSE s.delta END, CASE WHEN j.on_ THEN w.n + 1 ELSE 1 END
      FROM w JOIN s ON s.workflow = w.workflow AND s.i = w.i + 1, LATERAL (SELECT s.t - w.last <= 86400 AND s.delta * w.total > 0 AND abs(w.total + s.delta) <= 10 AS on_) j)
    SELECT workflow, min(start) AS t, max(last) AS end_t, arg_max(total, i) AS delta, max(n)::BIGINT AS n FROM w GROUP BY workflow, run""",
)
def seq_scroll_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-05: the cap on the sum depends on the path, so it is a fold over each stream."""
    d = events(spark, sf_dir).where("event_type = 'view'").select(F.col("user_id").alias("workflow"), (F.col("t") / 1e6).alias("t"), F.col("event_id").alias("line_no"), (F.col("k") % 7 - 3).cast("double").alias("delta"))
    return sequences.fold(d, ["workflow"], ["t", "line_no"], lambda: sequences.ScrollRuns(gap=86_400.0), "workflow long, t double, end_t double, delta double, n long")
