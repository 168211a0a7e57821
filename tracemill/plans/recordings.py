"""Queries over recorded input as atomic actions, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.operators import atoms as A
from tracemill.operators import sequences
from tracemill.plans.registry import query
from tracemill.sources.tables import EVENTS_SQL, events, turns
from tracemill.streaming import jobs

#: Each user's events as one recording: 120 to 180 ms apart, of all kinds, pointers at four places of the screen.
RECORDED = {
    "t": "(i * 120 + k % 7 * 10) / 1000.0D",
    "kind": """CASE WHEN event_type = 'signup' THEN CASE WHEN k < 30 THEN 'active_app' WHEN k < 40 THEN 'screen_config' WHEN k < 55 THEN 'modifier_change' WHEN k < 60 THEN 'window_moved'
        WHEN k < 62 THEN 'privacy_mask_start' WHEN k < 75 THEN 'privacy_mask_end' ELSE 'key' END WHEN event_type IN ('click', 'purchase') THEN CASE WHEN k % 8 = 7 THEN 'drag' ELSE 'click' END WHEN event_type = 'view' THEN 'scroll' ELSE 'key' END""",
    "app": "CASE WHEN event_type = 'signup' AND k < 30 THEN CASE WHEN k % 10 = 0 THEN 'Browser' WHEN k % 2 = 0 THEN 'SolidWorks 2024' ELSE 'SolidWorks' END END",
    "screens": "CASE WHEN k = 39 THEN 2 ELSE 1 END",
    "width": "CASE WHEN k % 4 = 0 THEN 1280 ELSE 1920 END",
    "height": "1080",
    "modifiers": "CASE WHEN event_type = 'signup' THEN CASE WHEN k < 50 THEN 0 ELSE k % 4 END WHEN k = 98 THEN 16 END",
    "x": "CASE WHEN event_type = 'view' AND k = 97 THEN -1.0D WHEN value < 400 THEN 100.0D ELSE 600.0D END",
    "y": "CASE WHEN k < 80 THEN 100.0D ELSE 400.0D END",
    "button": "CASE WHEN k % 25 = 24 THEN 'right' ELSE 'left' END",
    "down": "k % 2 = 0",
    "clicks": "CASE WHEN k % 8 < 5 THEN 1 + k % 3 ELSE 2 END",
    "key": "CASE WHEN k >= 90 THEN 'Shift' WHEN k >= 85 THEN 'Enter' ELSE chr(97 + k % 26) END",
    "text": "CASE WHEN k >= 90 THEN NULL WHEN k >= 85 THEN chr(13) ELSE chr(97 + k % 26) END",
    "delta_x": "0.0D",
    "delta_y": "CASE WHEN k = 99 THEN 12.0D ELSE k % 7 - 2.0D END",
}


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(workflow, EVENT): the events table as recordings."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy("t", "event_id"))
    d = events(spark, sf_dir).withColumn("i", place).selectExpr("user_id AS workflow", "cast(i as long) AS line", *(f"{rule} AS {name}" for name, rule in RECORDED.items()))
    # keys go down only
    d = d.withColumn("down", F.when(F.col("kind") == "click", F.col("down")))
    return d.withColumn("on_app", A.app_matches(F.col("app"), "solidworks", "SolidWorks"))


RECORDED_SQL = (
    f"{EVENTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM (SELECT * FROM e)), "
    "s AS (SELECT user_id AS workflow, i AS line, " + ", ".join(f"({rule.replace('.0D', '.0::DOUBLE')}) AS {name}" for name, rule in RECORDED.items()) + " FROM (SELECT event_id, user_id, event_type, value, k, i FROM o))"
)
ACTION = "STRUCT(line BIGINT, type VARCHAR, t DOUBLE, end_t DOUBLE, lower DOUBLE, epoch BIGINT, x DOUBLE, y DOUBLE, end_x DOUBLE, end_y DOUBLE, button VARCHAR, modifiers INT, clicks INT, key VARCHAR, text VARCHAR, delta_y DOUBLE, inputs BIGINT, w INT, h INT)"
PRESS = "STRUCT(line BIGINT, t DOUBLE, epoch BIGINT, x DOUBLE, y DOUBLE, button VARCHAR, modifiers INT, count INT)"
REFUSAL = "STRUCT(line BIGINT, reason VARCHAR, t DOUBLE, epoch BIGINT)[]"
#: One step of the automaton a row: q tells what the event is, r how many epochs end and what the input is, z whether it goes on.
ATOMS_SQL = f"""WITH RECURSIVE {RECORDED_SQL},
w AS (SELECT workflow, 0::BIGINT AS line, NULL::VARCHAR AS app, false AS on_app, 0 AS held, false AS masked, 1920 AS w, 1080 AS h, 1 AS n, 0::BIGINT AS epoch, 0::DOUBLE AS barrier, 0::DOUBLE AS ended,
        NULL::{PRESS} AS p, NULL::{ACTION} AS l, NULL::{ACTION} AS done, []::{REFUSAL} AS refused FROM (SELECT DISTINCT workflow FROM s)
  UNION ALL
  SELECT w.workflow, s.line, q.app, q.on_app, CASE WHEN s.kind = 'modifier_change' THEN s.modifiers ELSE w.held END, CASE s.kind WHEN 'privacy_mask_start' THEN true WHEN 'privacy_mask_end' THEN false ELSE w.masked END,
      q.w, q.h, q.n, (w.epoch + r.cuts)::BIGINT, CASE WHEN r.cuts > 0 THEN greatest(w.barrier, s.t) ELSE w.barrier END, CASE WHEN r.a IS NULL THEN w.ended ELSE greatest(w.ended, s.t) END,
      CASE WHEN q.pressed THEN {{line: s.line, t: s.t, epoch: w.epoch + r.cuts, x: s.x / w.w, y: s.y / w.h, button: s.button, modifiers: q.held, count: s.clicks}} WHEN r.cuts > 0 OR q.released THEN NULL ELSE w.p END,
      CASE WHEN r.a IS NULL THEN w.l WHEN NOT z.grows THEN r.a ELSE {{line: w.l.line, type: w.l.type, t: w.l.t, end_t: s.t, lower: w.l.lower, epoch: w.l.epoch, x: w.l.x, y: w.l.y, end_x: w.l.end_x, end_y: w.l.end_y, button: w.l.button, modifiers: w.l.modifiers,
        clicks: CASE WHEN r.a.type = 'click' THEN w.p.count END, key: w.l.key, text: w.l.text || r.a.text, delta_y: w.l.delta_y + r.a.delta_y, inputs: w.l.inputs + 1, w: w.l.w, h: w.l.h}} END,
      CASE WHEN r.a IS NOT NULL AND NOT z.grows THEN w.l END,
      list_filter([CASE WHEN q.over THEN {{line: s.line, reason: 'overlapping_pointer_and_input', t: s.t, epoch: w.epoch}} END, CASE WHEN q.why IS NOT NULL THEN {{line: s.line, reason: q.why, t: s.t, epoch: w.epoch + q.over::INT}} END,
        CASE WHEN r.cuts > 0 AND w.p IS NOT NULL THEN {{line: w.p.line, reason: 'incomplete_pointer_gesture', t: w.p.t, epoch: w.p.epoch}} END], lambda x: x IS NOT NULL)
  FROM w JOIN s ON s.workflow = w.workflow AND s.line = w.line + 1,
  LATERAL (SELECT coalesce(s.modifiers, w.held) AS held, s.kind IN ('click', 'drag', 'scroll', 'key') AS input) f,
  LATERAL (SELECT CASE WHEN NOT f.input THEN NULL WHEN w.masked OR w.n <> 1 THEN 'privacy_or_multiscreen' WHEN NOT w.on_app THEN 'off_target_or_unknown_app' WHEN f.held & 4294967280 <> 0 THEN 'unknown_modifiers'
      WHEN s.kind <> 'key' AND NOT (s.x >= 0 AND s.x < w.w AND s.y >= 0 AND s.y < w.h) THEN 'invalid_pointer_coordinates' END AS barred) b,
  LATERAL (SELECT f.held, CASE WHEN s.kind = 'active_app' THEN s.app ELSE w.app END AS app, CASE WHEN s.kind = 'active_app' THEN coalesce(s.app LIKE 'SolidWorks%', false) ELSE w.on_app END AS on_app,
      CASE WHEN s.kind = 'screen_config' THEN s.width ELSE w.w END AS w, CASE WHEN s.kind = 'screen_config' THEN s.height ELSE w.h END AS h, CASE WHEN s.kind = 'screen_config' THEN s.screens ELSE w.n END AS n,
      CASE WHEN b.barred IS NOT NULL THEN b.barred WHEN s.kind = 'click' AND NOT s.down AND w.p IS NOT NULL AND (w.p.button <> s.button OR w.p.modifiers <> f.held) THEN 'changing_pointer_button_or_modifiers'
        WHEN s.kind = 'scroll' AND abs(s.delta_y) > 10 THEN 'unsupported_scroll_magnitude' END AS why,
      b.barred IS NULL AND s.kind IN ('scroll', 'key') AND w.p IS NOT NULL AS over, b.barred IS NULL AND s.kind = 'click' AND s.down AS pressed,
      b.barred IS NULL AND s.kind = 'click' AND NOT s.down AND w.p IS NOT NULL AND w.p.button = s.button AND w.p.modifiers = f.held AS released) q,
  LATERAL (SELECT ((s.kind = 'active_app' AND s.app IS DISTINCT FROM w.app) OR (s.kind = 'screen_config' AND (s.width, s.height, s.screens) <> (w.w, w.h, w.n)) OR s.kind IN ('window_moved', 'privacy_mask_start', 'privacy_mask_end'))::INT
      + (q.why IS NOT NULL)::INT + q.over::INT + (q.pressed AND w.p IS NOT NULL)::INT AS cuts) c,
  LATERAL (SELECT c.cuts, greatest(w.ended, CASE WHEN c.cuts > 0 THEN greatest(w.barrier, s.t) ELSE w.barrier END) AS lower, q.released AND sqrt((s.x - w.p.x * w.w) ** 2 + (s.y - w.p.y * w.h) ** 2) >= 4 AS far,
      CASE WHEN q.why IS NOT NULL OR NOT f.input THEN NULL WHEN q.released THEN 'pointer' WHEN s.kind = 'scroll' THEN 'scroll' WHEN s.kind = 'key' AND s.key <> 'Shift' THEN CASE WHEN s.text <> chr(13) AND f.held & 4294967294 = 0 THEN 'type_text' ELSE 'key' END END AS act) d,
  LATERAL (SELECT d.cuts, CASE WHEN d.act = 'pointer' THEN {{line: w.p.line, type: CASE WHEN d.far THEN 'drag' ELSE 'click' END, t: w.p.t, end_t: s.t, lower: d.lower, epoch: w.p.epoch, x: w.p.x, y: w.p.y, end_x: CASE WHEN d.far THEN s.x / w.w END, end_y: CASE WHEN d.far THEN s.y / w.h END,
        button: w.p.button, modifiers: w.p.modifiers, clicks: CASE WHEN NOT d.far THEN 1 END, key: NULL, text: NULL, delta_y: NULL, inputs: 1, w: w.w, h: w.h}}
      WHEN d.act IS NOT NULL THEN {{line: s.line, type: d.act, t: s.t, end_t: s.t, lower: d.lower, epoch: w.epoch + d.cuts, x: CASE WHEN d.act = 'scroll' THEN s.x / w.w END, y: CASE WHEN d.act = 'scroll' THEN s.y / w.h END, end_x: NULL, end_y: NULL,
        button: NULL, modifiers: f.held, clicks: NULL, key: CASE WHEN d.act = 'key' THEN s.key END, text: CASE WHEN d.act <> 'scroll' THEN s.text END, delta_y: CASE WHEN d.act = 'scroll' THEN s.delta_y END, inputs: 1, w: w.w, h: w.h}} END::{ACTION} AS a) r,
  LATERAL (SELECT coalesce(w.l.type = r.a.type AND w.l.epoch = r.a.epoch AND w.l.modifiers = r.a.modifiers AND w.l.w = r.a.w AND w.l.h = r.a.h AND r.a.t - w.l.end_t >= 0 AND CASE r.a.type
      WHEN 'type_text' THEN r.a.t - w.l.end_t <= 0.75::DOUBLE WHEN 'scroll' THEN r.a.t - w.l.end_t <= 0.15::DOUBLE AND abs(r.a.x - w.l.x) < 0.002 AND abs(r.a.y - w.l.y) < 0.002 AND r.a.delta_y * w.l.delta_y >= 0 AND abs(r.a.delta_y + w.l.delta_y) <= 10
      WHEN 'click' THEN r.a.t - w.l.end_t <= 0.5::DOUBLE AND abs(r.a.x - w.l.x) < 0.002 AND abs(r.a.y - w.l.y) < 0.002 AND r.a.button = w.l.button AND w.p.count = w.l.clicks + 1 AND w.p.count <= 3 ELSE false END, false) AS grows) z),
last AS (SELECT workflow, arg_max(l, line) AS l, arg_max(p, line) AS p FROM (SELECT workflow, line, {{v: l}} AS l, {{v: p}} AS p FROM w) GROUP BY workflow),
acts AS (SELECT workflow, done AS a FROM w WHERE done IS NOT NULL UNION ALL SELECT workflow, l.v FROM last WHERE l.v IS NOT NULL),
refusals AS (SELECT workflow, unnest(refused) AS r FROM w UNION ALL SELECT workflow, {{line: p.v.line, reason: 'incomplete_pointer_gesture', t: p.v.t, epoch: p.v.epoch}} FROM last WHERE p.v IS NOT NULL)
"""
#: The columns of the queries; a scroll's delta_x is always zero here.
TOLD = ["workflow", *(c for c in A.FIELDS if c != "delta_x")]
ATOMS_TWIN = (
    ATOMS_SQL + "SELECT workflow, a.line, a.type, NULL AS reason, " + ", ".join(f"a.{c}" for c in TOLD[4:]) + " FROM acts UNION ALL SELECT workflow, r.line, 'reject', r.reason, "
    + ", ".join(f"r.{c}" if c in ("t", "epoch") else "NULL" for c in TOLD[4:]) + " FROM refusals"
)


@query("seq_atoms", ATOMS_TWIN)
def seq_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-02/05/06, STR-07, FLT-03/09, SCL-10: each recording's atomic actions and rejected inputs."""
    return A.atoms(recorded(spark, sf_dir)).select(TOLD)


@query("agg_input_rejects", ATOMS_SQL + "SELECT r.reason, count(*) AS n, count(DISTINCT workflow) AS workflows FROM refusals GROUP BY 1")
def agg_input_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-09: rejected inputs by reason."""
    d = A.atoms(recorded(spark, sf_dir)).where("type = 'reject'")
    return d.groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("workflow").alias("workflows"))


#: Each conversation's turn as an operation: deltas of 16 characters with holes and stale pieces, one of four endings.
OPERATION_EVENTS = {
    "start": ("turn % 9 <> 8", "'start'", "0", "-1", "''", "NULL"),
    "done": ("turn % 4 IN (0, 1)", "'settle'", "1000", "-2", "''", "'completed'"),
    "stop": ("turn % 4 = 1", "'settle'", "12", "-3", "''", "'cancelled'"),
    "cut": ("turn % 4 = 2", "'settle'", "14", "-4", "''", "'interrupted'"),
    "late": ("turn % 4 = 2", "'settle'", "20", "-5", "''", "'cancelled'"),
}
SECOND, DAY = 1_000_000, 86_400
OPERATIONS_SQL = (
    "t AS (SELECT DISTINCT conv_id || ':' || turn AS operation, turn, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL), "
    "i AS (SELECT operation, turn, text, unnest(range((length(text) + 15) // 16)) AS i FROM t), "
    "v AS (SELECT operation, 'delta' AS kind, (10 + i) AS ts, i * 16 AS place, substr(text, i * 16 + 1, 16) AS piece, NULL AS status, i AS no FROM i WHERE (i + turn) % 11 <> 10 "
    "UNION ALL SELECT operation, 'delta', 10 + i, i * 16 - 5, 'zzz', NULL, 100000 + i FROM i WHERE i % 4 = 3 "
    + " ".join(f"UNION ALL SELECT operation, {kind}, {ts}, {at}, {piece}, {status}, {at} FROM t WHERE {where}" for where, kind, ts, at, piece, status in OPERATION_EVENTS.values())
    + ")"
)


def operation_events(turns: DataFrame) -> DataFrame:
    """(operation, event_id, ts, kind, offset, text, status), in no order that means anything; some come twice."""
    t = turns.where("conv_id is not null and turn is not null and text is not null").selectExpr("concat(conv_id, ':', turn) AS operation", "cast(turn as long) AS turn", "text")
    i = t.selectExpr("operation", "turn", "text", "explode(sequence(0, greatest(0, (char_length(text) + 15) div 16 - 1))) AS i").where("char_length(text) > 0")
    kinds = "'delta' AS kind", "cast(10 + i as long) AS ts"
    found = i.where("(i + turn) % 11 <> 10").selectExpr("operation", *kinds, "cast(i * 16 as long) AS offset", "substr(text, cast(i * 16 + 1 as int), 16) AS text", "cast(NULL as string) AS status", "cast(i as long) AS no")
    found = found.union(i.where("i % 4 = 3").selectExpr("operation", *kinds, "cast(i * 16 - 5 as long)", "'zzz'", "NULL", "cast(100000 + i as long)"))
    for where, kind, ts, at, piece, status in OPERATION_EVENTS.values():
        found = found.union(t.where(where).selectExpr("operation", kind, f"cast({ts} as long)", f"cast({at} as long)", piece, status, f"cast({at} as long)"))
    told = found.selectExpr("operation", "concat(operation, '/', no) AS event_id", f"(ts + {DAY}) * {SECOND} AS ts", "kind", "offset", "text", "status")
    return told.union(told.where("crc32(event_id) % 5 = 0"))


#: The text grows piece by piece; a hole or a piece past the settlement ends it.
SETTLED_TWIN = f"""WITH RECURSIVE {OPERATIONS_SQL}, s AS (SELECT operation, min(ts) FILTER (WHERE kind = 'settle') AS settled_at, arg_min(status, ts) FILTER (WHERE kind = 'settle') AS first,
      coalesce(bool_or(status = 'cancelled'), false) AS cancelled FROM v GROUP BY operation HAVING bool_or(kind = 'start')),
    d AS (SELECT operation, place, arg_min(piece, (ts, operation || '/' || no)) AS piece FROM v JOIN s USING (operation) WHERE kind = 'delta' AND place >= 0 AND (settled_at IS NULL OR ts <= settled_at) GROUP BY ALL),
    w AS (SELECT operation, '' AS text FROM s UNION ALL SELECT w.operation, w.text || d.piece FROM w JOIN d ON d.operation = w.operation AND d.place = length(w.text)),
    f AS (SELECT operation, arg_max(text, length(text)) AS text FROM w GROUP BY operation)
    SELECT operation, CASE WHEN first = 'interrupted' AND cancelled THEN 'cancelled' ELSE coalesce(first, 'running') END AS status, (settled_at + {DAY}) * {SECOND} AS settled_at, text FROM s JOIN f USING (operation)"""


@query("seq_settled_operations", SETTLED_TWIN)
def seq_settled_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-17 in batch: operations' last states, whatever the order of events."""
    return sequences.settled(operation_events(turns(spark, sf_dir)))


@query("stream_settled_operations", SETTLED_TWIN)
def stream_settled_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-17, STR-09: the same as a keyed stream, whose state expires."""
    raw = jobs.table_stream(spark, sf_dir, "conversations")
    with jobs.durable_state(spark):
        seen = jobs.to_end(jobs.operations(operation_events(raw)), "update")
    newest = F.max_by(F.struct("status", "settled_at", "text"), "revision").alias("_s")
    return seen.groupBy("operation").agg(newest).select("operation", "_s.*")


LOOKUPS = {"t": "cast(i * 10 + k % 10 AS bigint)", "subject": "k % 15", "aspect": "k % 4", "page": "k % 2 = 0", "failed": "event_type = 'error' AND k % 3 = 0"}


@query(
    "str_lookup_cache",
    f"""WITH RECURSIVE {EVENTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM (SELECT * FROM e)),
    s AS (SELECT user_id, i AS n, event_id AS lookup, {", ".join(f"{rule} AS {name}" for name, rule in LOOKUPS.items())} FROM (SELECT user_id, event_id, event_type, k, i FROM o)),
    w AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS lookup, NULL::VARCHAR AS outcome, []::STRUCT(s INT, a INT, t BIGINT)[] AS kept, []::STRUCT(s INT, t BIGINT)[] AS bad FROM (SELECT DISTINCT user_id FROM s)
      UNION ALL SELECT s.user_id, s.n, s.lookup, q.outcome,
        CASE WHEN q.outcome <> 'fetched' THEN w.kept WHEN len(q.same) > 0 THEN list_transform(w.kept, lambda x: {{s: x.s, a: x.a, t: CASE WHEN x.s = s.subject AND x.a = s.aspect THEN s.t ELSE x.t END}})
          ELSE list_append(w.kept, {{s: s.subject, a: s.aspect, t: s.t}})[CASE WHEN len(w.kept) = 24 THEN 2 ELSE 1 END:] END,
        CASE WHEN q.outcome = 'failed' THEN list_append(list_filter(w.bad, lambda x: x.s <> s.subject), {{s: s.subject, t: s.t}}) ELSE w.bad END
      FROM w JOIN s ON s.user_id = w.user_id AND s.n = w.n + 1,
      LATERAL (SELECT list_filter(w.kept, lambda x: x.s = s.subject AND x.a = s.aspect) AS same, list_filter(w.bad, lambda x: x.s = s.subject) AS ill) l,
      LATERAL (SELECT l.same, CASE WHEN len(l.ill) > 0 AND s.t - l.ill[1].t < CASE WHEN s.page THEN 3600 ELSE 90 END THEN 'suppressed' WHEN len(l.same) > 0 AND s.t - l.same[1].t < 900 THEN 'hit' WHEN s.failed THEN 'failed' ELSE 'fetched' END AS outcome) q)
    SELECT user_id, lookup, outcome FROM w WHERE n > 0""",
)
def str_lookup_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-20: each user's lookups through a bounded cache with lifetimes for results and failures."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy("t", "event_id"))
    d = events(spark, sf_dir).withColumn("i", place).selectExpr("user_id", "event_id AS lookup", *(f"{rule} AS {name}" for name, rule in LOOKUPS.items()))
    return sequences.fold(d, ["user_id"], ["t", "lookup"], sequences.LookupCache, "user_id long, lookup long, outcome string")
