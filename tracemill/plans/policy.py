"""Queries that turn neutral actions into targets and check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import actions as A
from tracemill.functions import keys as K
from tracemill.operators import graph, metrics, splits
from tracemill.plans.registry import query
from tracemill.sources.tables import EVENTS_SQL, events
from tracemill.storage import checkpointed, table, written

KEY_SQL = f"coalesce({K.sql_map(K.windows_table())}[k + 8], CASE WHEN k % 2 = 0 THEN lower(chr(33 + k)) END)"
NEUTRAL_SQL = f"""{EVENTS_SQL}, n AS (SELECT event_id, user_id, t, k, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'scroll' WHEN 'purchase' THEN 'drag' WHEN 'signup' THEN 'type_text' ELSE 'key' END AS type,
    value / 400.0 AS x, k / 100.0 AS y, (k - 50) / 10.0 AS d, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Left' ELSE 'RIGHT' END AS button, CASE WHEN k % 2 = 0 THEN chr(33 + k) ELSE '' END AS txt, {KEY_SQL} AS name,
    CASE WHEN k % 4 > 0 THEN k % 16 END AS mask, CASE WHEN k % 5 = 0 THEN 1 + k % 3 END AS clicks FROM e),
    g AS (SELECT *, round_even(x * 999, 0)::INT AS gx, round_even(y * 999, 0)::INT AS gy, (sign(d) * greatest(1.0, round_even(abs(d), 0)))::INT AS gd, coalesce(lower(button), 'left') AS b,
      '[' || array_to_string(list_filter([CASE WHEN mask & 2 > 0 THEN '"ctrl"' END, CASE WHEN mask & 1 > 0 THEN '"shift"' END, CASE WHEN mask & 4 > 0 THEN '"alt"' END, CASE WHEN mask & 8 > 0 THEN '"meta"' END], lambda m: m IS NOT NULL), ',') || ']' AS names FROM n),
    r AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'no_actions' WHEN k % 13 = 0 THEN 'no_image' WHEN type = 'scroll' AND d = 0 THEN 'conversion_error:zero_scroll'
      WHEN type IN ('click', 'scroll', 'drag') AND NOT (x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1) THEN 'conversion_error:coordinates'
      WHEN type = 'type_text' AND txt = '' THEN 'conversion_error:text' WHEN type = 'key' AND name IS NULL THEN CASE WHEN txt = '' THEN 'only_modifier_keys' ELSE 'conversion_error:unmapped_key' END
      WHEN type = 'key' AND name IN ('Shift', 'Control', 'Alt', 'Meta', 'CapsLock', 'NumLock', 'ScrollLock') THEN 'only_modifier_keys' WHEN type = 'drag' AND k % 7 > 0 THEN 'drag_excluded' END AS reason FROM g)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, t, actions, reason): one neutral action a row or none; every seventh k lets drags in."""
    kinds = {"click": "click", "view": "scroll", "purchase": "drag", "signup": "type_text", "error": "key"}
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("event_type")]
    k = F.col("k")
    x, y = F.col("value") / 400.0, k / 100.0
    button = F.when(k % 3 == 1, "Left").when(k % 3 == 2, "RIGHT")
    action = F.struct(
        kind.alias("type"), x.alias("x"), y.alias("y"), x.alias("end_x"), y.alias("end_y"), button.alias("button"), ((k - 50) / 10.0).alias("delta_x"), F.lit(0.0).alias("delta_y"),
        F.when(k % 2 == 0, F.char(k + 33)).otherwise("").alias("text"), (k + 8).alias("key_code"), F.when(k % 4 > 0, k % 16).alias("modifiers"), F.when(k % 5 == 0, 1 + k % 3).alias("clicks"), F.lit(0.0).alias("dt"),
    )
    actions = F.filter(F.array(F.when(k % 17 > 0, action)), lambda a: a.isNotNull())
    image = F.when(k % 13 > 0, "frame.png")
    # written once: reasons and targets refer to the judged actions many times, and a filter would put them in at each
    d = written(events(spark, sf_dir).select("event_id", "user_id", "t", "k", A.judged(actions).alias("actions"), image.alias("image")))
    reason = A.row_reason(F.col("actions"), F.col("image"), drags=k % 7 == 0)
    return d.select("event_id", "user_id", "t", "actions", reason.alias("reason"))


@query("policy_rejects", f"WITH {NEUTRAL_SQL} SELECT coalesce(split_part(reason, ':', 1), 'kept') AS reason, count(*) AS n FROM r GROUP BY 1")
def policy_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-08, SCL-16: reasons counted by their prefix."""
    reason = F.substring_index(F.coalesce("reason", F.lit("kept")), ":", 1)
    return _rows(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    "policy_completions",
    f"""WITH {NEUTRAL_SQL}, h AS (SELECT *, CASE WHEN mask IS NULL THEN '' ELSE ',"modifiers":' || names END AS held FROM r WHERE reason IS NULL), j AS (SELECT event_id,
      CASE type WHEN 'click' THEN '{{"type":"click","x":' || gx || ',"y":' || gy || ',"button":"' || b || '"' || held || coalesce(',"clicks":' || clicks, '') || '}}'
      WHEN 'drag' THEN '{{"type":"drag","x":' || gx || ',"y":' || gy || ',"end_x":' || gx || ',"end_y":' || gy || ',"button":"' || b || '"' || held || '}}'
      WHEN 'scroll' THEN '{{"type":"scroll","x":' || gx || ',"y":' || gy || ',"delta_x":' || gd || ',"delta_y":0' || held || '}}' WHEN 'type_text' THEN '{{"type":"type_text","text":' || to_json(txt) || '}}'
      ELSE '{{"type":"key","key":' || to_json(name) || ',"modifiers":' || coalesce(names, '[]') || '}}' END AS t FROM h)
    SELECT event_id, '{{"actions":[' || t || ']}}' AS completion, 0 AS errors FROM j""",
)
def policy_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-04/05/06: canonical targets, all of which pass the strict validator."""
    kept = _rows(spark, sf_dir).where("reason is null")
    c = kept.select("event_id", A.completion(F.transform(A.chunk(F.col("actions")), A.target)).alias("completion"))
    return c.select("event_id", "completion", F.size(A.errors(F.col("completion"))).alias("errors"))


@query(
    "policy_statistics",
    f"""WITH {NEUTRAL_SQL}, k AS (SELECT * FROM r WHERE reason IS NULL) SELECT type, count(*) AS n, count(DISTINCT user_id) AS workflows, min(t) AS first_t FROM k GROUP BY 1""",
)
def policy_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03: counts of kept targets by type."""
    kept = _rows(spark, sf_dir).where("reason is null")
    return kept.groupBy(F.get("actions", F.lit(0))["type"].alias("type")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("workflows"), F.min("t").alias("first_t"))


#: Documents as workflows of applications of very different size; equal texts are a shared artifact.
WORKFLOWS = "concat('app', cast(CASE WHEN doc_id % 50 = 0 THEN 9 WHEN doc_id % 97 = 0 THEN 8 WHEN doc_id < 4 THEN 7 ELSE doc_id % 5 END AS string))"
#: A step of the recursion takes one candidate; left, held (validation) and tested count by application.
SPLITS_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORKFLOWS.replace("AS string", "AS VARCHAR")} AS app, min(doc_id) OVER (PARTITION BY coalesce(text, doc_id::VARCHAR)) AS grp FROM documents),
    p AS (SELECT DISTINCT app, grp FROM d), a AS (SELECT app, count(*) AS n, row_number() OVER (ORDER BY app) AS no FROM p GROUP BY app),
    g AS (SELECT grp, list(no ORDER BY no) AS apps FROM p JOIN a USING (app) GROUP BY grp),
    c AS (SELECT row_number() OVER (ORDER BY a.n, a.app, sha256('7/' || grp)) AS i, a.no, g.grp, g.apps, CASE WHEN n >= 2 THEN greatest(1, round_even(0.1 * n, 0)) ELSE 0 END AS v, CASE WHEN n >= 3 THEN greatest(1, round_even(0.1 * n, 0)) ELSE 0 END AS t
      FROM p JOIN a USING (app) JOIN g USING (grp)),
    w AS (SELECT 0::BIGINT AS i, (SELECT list(n ORDER BY no) FROM a) AS left_, (SELECT list(0::BIGINT) FROM a) AS held, (SELECT list(0::BIGINT) FROM a) AS tested, []::BIGINT[] AS gone, NULL::BIGINT AS grp, NULL::VARCHAR AS split
      UNION ALL SELECT c.i, CASE WHEN s.split IS NULL THEN left_ ELSE list_transform(left_, lambda x, k: x - list_contains(c.apps, k)::BIGINT) END,
        CASE WHEN s.split = 'validation' THEN list_transform(held, lambda x, k: x + list_contains(c.apps, k)::BIGINT) ELSE held END, CASE WHEN s.split = 'test' THEN list_transform(tested, lambda x, k: x + list_contains(c.apps, k)::BIGINT) ELSE tested END,
        CASE WHEN s.split IS NULL THEN gone ELSE list_append(gone, c.grp) END, c.grp, s.split
      FROM w JOIN c ON c.i = w.i + 1, LATERAL (SELECT CASE WHEN list_contains(w.gone, c.grp) OR len(list_filter(c.apps, lambda k: w.left_[k] <= 1)) > 0 THEN NULL WHEN w.held[c.no] < c.v THEN 'validation' WHEN w.tested[c.no] < c.t THEN 'test' END AS split) s)
    SELECT d.doc_id, d.app, d.grp, coalesce(w.split, 'train') AS split FROM d LEFT JOIN (SELECT grp, split FROM w WHERE split IS NOT NULL) w ON w.grp = d.grp"""


@query("split_assignment", SPLITS_SQL)
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17/18: groups of shared artifacts to splits, each application keeping a group to train on."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(WORKFLOWS).alias("app"), F.coalesce("text", F.col("doc_id").cast("string")).alias("artifact"))
    groups = splits.artifact_groups(d.select(F.col("doc_id").alias("workflow")), d.select(F.col("doc_id").alias("workflow"), "artifact"))
    placed = checkpointed(d.select("doc_id", "app").join(groups.withColumnRenamed("workflow", "doc_id"), "doc_id"))
    return placed.join(splits.guarded_splits(placed.select("app", "grp"), "7"), "grp").select("doc_id", "app", "grp", "split")


#: By number a row is predicted as it is, as a click in the middle, as a text that isn't JSON, or as no action.
MIDDLE = '{"actions":[{"button":"left","type":"click","y":500,"x":500}]}'
GUESSES = (None, MIDDLE, "no json", '{"actions":[]}')
RATES_SQL = ", ".join(f"avg({c}::INT) AS {n}" for n, c in metrics.RATES.items())
WITHIN_SQL = ", ".join(f"avg((px <= {r})::INT) AS within_{r}" for r in metrics.RADII)
MACRO_SQL = ", ".join(f"avg({c}) AS {c}" for c in (*metrics.MACRO, *(f"within_{r}" for r in metrics.RADII)))


@query(
    "policy_metrics",
    f"""WITH {NEUTRAL_SQL}, q AS (SELECT *, user_id % 5 AS app, event_id % 4 AS g FROM r WHERE reason IS NULL),
    s AS (SELECT app, g <> 2 AS json_ok, g < 2 AS schema_ok, g = 0 OR g = 1 AND type = 'click' AS type_ok, type_ok AS sequence_types_ok, g < 2 AS length_ok,
      g = 0 OR g = 1 AND type = 'click' AND gx = 500 AND gy = 500 AND b = 'left' AND mask IS NULL AND clicks IS NULL AS exact_ok,
      CASE WHEN g < 2 AND type = 'key' THEN g = 0 END AS key_ok, CASE WHEN g < 2 AND type = 'type_text' THEN g = 0 END AS text_ok,
      CASE WHEN type IN ('click', 'drag', 'scroll') THEN CASE g WHEN 0 THEN 0 WHEN 1 THEN sqrt(((500 / 999.0::DOUBLE * 1920 - gx / 999.0::DOUBLE * 1920)) ** 2 + ((500 / 999.0::DOUBLE * 1080 - gy / 999.0::DOUBLE * 1080)) ** 2) END END AS px,
      CASE WHEN type IN ('click', 'drag', 'scroll') THEN CASE g WHEN 0 THEN 0 WHEN 1 THEN sqrt(((500 - gx) / 999.0::DOUBLE) ** 2 + ((500 - gy) / 999.0::DOUBLE) ** 2) END END AS norm FROM q),
    z AS (SELECT 'group' AS scope, app, * EXCLUDE (app) FROM s UNION ALL SELECT 'overall', NULL, * EXCLUDE (app) FROM s),
    m AS (SELECT scope, app, count(*) AS count, {RATES_SQL}, avg(key_ok::INT) AS key_accuracy, count(key_ok) AS key_count, avg(text_ok::INT) AS type_text_accuracy, count(text_ok) AS type_text_count,
      count(px) AS coord_count, avg(px) AS coord_error_px_mean, avg(norm) AS coord_error_norm_mean, {WITHIN_SQL}, median(px) AS coord_error_px_median FROM z GROUP BY ALL)
    SELECT * FROM m UNION ALL BY NAME SELECT 'macro' AS scope, {MACRO_SQL} FROM m WHERE scope = 'group'""",
)
def policy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-19, AGG-07/08: every measure of predicted completions for each application, overall and on average."""
    kept = _rows(spark, sf_dir).where("reason is null")
    told = written(kept.select((F.col("user_id") % 5).alias("app"), "event_id", A.completion(F.transform(A.chunk(F.col("actions")), A.target)).alias("target")))
    guess = F.get(F.array(*map(F.lit, GUESSES)), (F.col("event_id") % len(GUESSES)).cast("int"))
    d = told.withColumn("predicted", F.coalesce(guess, "target"))
    return metrics.summary(metrics.scored(d, "predicted", "target"), "app")


DAG_SQL = """n AS (SELECT p_partkey AS id FROM part), e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey >= 2 AND p_partkey // 2 IN (SELECT p_partkey FROM part))"""


@query(
    "geo_dag_depth",
    f"WITH RECURSIVE {DAG_SQL}, d AS (SELECT id, 0 AS depth FROM n WHERE id NOT IN (SELECT src FROM e) UNION ALL SELECT e.src, d.depth + 1 FROM d JOIN e ON e.dst = d.id) SELECT id, max(depth) AS depth FROM d GROUP BY 1",
)
def geo_dag_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-04, FLT-17: depth of each feature over its inputs."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    e = p.where("p_partkey >= 2").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    e = e.join(p.select(F.col("p_partkey").alias("dst")), "dst", "left_semi").select("src", "dst")
    return graph.depths(p.select(F.col("p_partkey").alias("id")), e)


#: A vector's mesh: a tetrahedron of varying length, by vec_id with a hole, a turned facet, a cavity, a second solid, or
#: slivers that close by their neighbours. Corners are whole numbers, which 32-bit floats hold.
BODY = ["0,0,0, 0,300,0, A,0,0", "0,0,0, A,0,0, 0,0,100", "0,0,0, 0,0,100, 0,300,0", "A,0,0, 0,300,0, 0,0,100"]


def _moved(facets: list[str], by: int, part: float, turned: bool) -> list[str]:
    out = []
    for f in facets:
        c = [v.strip() for v in f.split(",")]
        c = [f"({v} * {part} + {by})" for v in c]
        out.append(", ".join(c[0:3] + c[6:9] + c[3:6] if turned else c))
    return out


MESH_ROWS = [  # rule, facets
    ("true", BODY[:1]), ("vec_id % 7 <> 1", BODY[1:2]), ("vec_id % 7 <> 2", BODY[2:3]), ("vec_id % 7 = 2", ["0,0,0, 0,300,0, 0,0,100"]), ("true", BODY[3:]),
    ("vec_id % 7 = 3", _moved(BODY, 10, 0.25, True)), ("vec_id % 7 IN (1, 4)", _moved(BODY, 1000, 0.5, False)), ("vec_id % 7 = 5", ["0,0,0, 0,0,0, A,0,0", "0,0,100, A,0,0, 0,0,100"]),
]
MESH_FACETS = "filter(flatten(array(" + ", ".join(f"transform(array({', '.join(f'array({f})' for f in fs)}), f -> IF({rule}, transform(f, v -> cast(v as double)), NULL))" for rule, fs in MESH_ROWS) + ")), f -> f is not null)"
MESH_A = "(round(cast(embedding[{}] as double) * 100) + 200) * 4"
MESH_SQL = (
    f"p AS (SELECT vec_id, ({MESH_A.format(1).replace('as double', 'AS DOUBLE')}) AS a FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL), f AS ("
    + " UNION ALL ".join(f"SELECT vec_id, {k}::BIGINT AS facet, list_transform([{f.replace('A', 'a')}], lambda v: v::DOUBLE) AS c FROM p WHERE {rule}" for k, (rule, f) in enumerate((rule, f) for rule, fs in MESH_ROWS for f in fs))
    + "), g AS (SELECT vec_id AS mesh_id, facet, c, (c[1], c[2], c[3])::VARCHAR AS c1, (c[4], c[5], c[6])::VARCHAR AS c2, (c[7], c[8], c[9])::VARCHAR AS c3 FROM f),"
)
MESH_TWIN = f"""WITH RECURSIVE {MESH_SQL} h AS (SELECT *, c1 = c2 OR c2 = c3 OR c3 = c1 AS sliver, c[1] * (c[5] * c[9] - c[6] * c[8]) - c[2] * (c[4] * c[9] - c[6] * c[7]) + c[3] * (c[4] * c[8] - c[5] * c[7]) AS six FROM g),
    e AS (SELECT mesh_id, facet, least(p, q) AS a, greatest(p, q) AS b, CASE WHEN p < q THEN 1 ELSE -1 END AS turn FROM (SELECT mesh_id, facet, unnest([c1, c2, c3]) AS p, unnest([c2, c3, c1]) AS q FROM h WHERE NOT sliver)),
    u AS (SELECT mesh_id, a, b, count(*) AS n, sum(turn) AS t FROM e GROUP BY ALL), k AS (SELECT mesh_id, count(*) FILTER (WHERE n = 1) AS open_edges, count(*) FILTER (WHERE n > 2 OR (n = 2 AND t <> 0)) AS bad_edges FROM u GROUP BY 1),
    r AS (SELECT mesh_id, facet, facet AS other FROM h WHERE NOT sliver UNION SELECT r.mesh_id, r.facet, y.facet FROM r JOIN e x ON x.mesh_id = r.mesh_id AND x.facet = r.other JOIN e y ON y.mesh_id = x.mesh_id AND y.a = x.a AND y.b = x.b),
    s AS (SELECT mesh_id, facet, min(other) AS shell FROM r GROUP BY ALL), v AS (SELECT mesh_id, shell, sum(six) / 6 AS v FROM s JOIN h USING (mesh_id, facet) GROUP BY ALL),
    w AS (SELECT mesh_id, count(*) AS shells, count(*) FILTER (WHERE v > 0) AS solids, count(*) FILTER (WHERE v < 0) AS cavities, sum(v) AS volume FROM v GROUP BY 1),
    b AS (SELECT mesh_id, count(*) AS facets, count(*) FILTER (WHERE sliver) AS degenerate, max(greatest(c[1], c[4], c[7])) - min(least(c[1], c[4], c[7])) AS size_x FROM h GROUP BY 1)
    SELECT mesh_id, facets, degenerate, open_edges, bad_edges, shells, solids, cavities, volume, size_x FROM b JOIN k USING (mesh_id) JOIN w USING (mesh_id)"""


@query("geo_mesh_audit", MESH_TWIN)
def geo_mesh_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-01, SRC-15: each vector's mesh as a binary file, read back as facets and audited."""
    from tracemill.operators import geometry
    from tracemill.sources import stl

    v = table(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null").selectExpr("vec_id", f"{MESH_A.format(0)} AS A")
    files = v.select(F.col("vec_id").alias("mesh_id"), stl.binary(F.expr(MESH_FACETS)).alias("content"))
    told = geometry.mesh_audit(stl.facets(files)).select("mesh_id", "facets", "degenerate", "open_edges", "bad_edges", "shells", "solids", "cavities", "volume", "size_x")
    return told
