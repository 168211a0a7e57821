"""Queries over keyed records: merges, evidence, excerpts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.functions import keys as K
from tracemill.functions import text as T
from tracemill.operators import graph, keyed, sequences
from tracemill.plans.registry import query
from tracemill.sources.tables import EVENTS_SQL, events, turns
from tracemill.storage import table

HOUR = 3_600_000_000
ALONG = "PARTITION BY user_id ORDER BY t, event_id"


def along():
    return W.partitionBy("user_id").orderBy("t", "event_id")


@query("scl_key_names", f"WITH {EVENTS_SQL} SELECT event_id, coalesce(CASE WHEN user_id % 3 = 0 THEN {K.sql_map(K.MAC)}[k + 8] ELSE {K.sql_map(K.windows_table())}[k + 8] END, CASE WHEN k = 94 THEN 'Delete' WHEN k % 2 = 0 AND k < 94 THEN lower(chr(33 + k)) END) AS name FROM e")
def scl_key_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-11, JOIN-12: key codes to names by each recording's platform, then characters."""
    chars = F.when(F.col("k") % 2 == 0, F.char(F.col("k") + 33))
    platform = F.when(F.col("user_id") % 3 == 0, "mac").when(F.col("user_id") % 3 == 1, "windows")
    return events(spark, sf_dir).select("event_id", K.key_name(F.col("k") + 8, chars, platform).alias("name"))


@query(
    "seq_atomic_epochs",
    f"""WITH {EVENTS_SQL}, l AS (SELECT *, coalesce(last_value(CASE WHEN event_type = 'signup' THEN k END IGNORE NULLS) OVER ({ALONG} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last_k FROM e),
    b AS (SELECT *, sum(CASE WHEN event_type = 'error' OR (event_type = 'signup' AND k <> last_k) THEN 1 ELSE 0 END) OVER ({ALONG}) AS epoch, max(CASE WHEN event_type = 'error' THEN t END) OVER ({ALONG}) AS barrier FROM l)
    SELECT user_id, epoch, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS actions, min(t - barrier) AS since FROM b GROUP BY ALL""",
)
def seq_atomic_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-02, STR-07: epochs that boundaries open (errors, a changed configuration), and the barrier before each action."""
    config = F.when(F.col("event_type") == "signup", F.col("k"))
    last = F.last(config, ignorenulls=True).over(along().rowsBetween(W.unboundedPreceding, -1))
    e = events(spark, sf_dir).withColumn("_last", last)
    breaks = (F.col("event_type") == "error") | ((F.col("event_type") == "signup") & (F.col("k") != F.coalesce("_last", F.lit(-1))))
    d = sequences.episodes(e, ["user_id"], ["t", "event_id"], breaks, "epoch")
    barrier = F.max(F.when(F.col("event_type") == "error", F.col("t"))).over(along().rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("since", F.col("t") - barrier)
    return d.groupBy("user_id", "epoch").agg(F.count_if(F.col("event_type").isin("click", "view")).alias("actions"), F.min("since").alias("since"))


@query(
    "seq_joined_typing",
    f"""WITH RECURSIVE {EVENTS_SQL}, s AS (SELECT user_id AS workflow, event_id AS segment, t / (8.0 * {HOUR}) AS t, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'type_text' ELSE 'key' END AS kind, k::VARCHAR AS text,
      row_number() OVER (PARTITION BY user_id ORDER BY t / (8.0 * {HOUR}), event_id) AS i FROM e),
    w AS (SELECT workflow, i, segment, t, kind, text FROM s WHERE i = 1
      UNION ALL SELECT s.workflow, s.i, CASE WHEN j.on_ THEN w.segment ELSE s.segment END, CASE WHEN j.on_ THEN w.t ELSE s.t END, s.kind, CASE WHEN j.on_ THEN w.text || s.text ELSE s.text END
      FROM w JOIN s ON s.workflow = w.workflow AND s.i = w.i + 1, LATERAL (SELECT w.kind = 'type_text' AND s.kind = 'type_text' AND s.t - w.t BETWEEN 0 AND 0.75 * length(w.text) AS on_) j)
    SELECT workflow, segment, min(t) AS t, min(kind) AS kind, arg_max(text, i) AS text FROM w GROUP BY workflow, segment""",
)
def seq_joined_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-07: texts that boundaries cut joined again; each join depends on the text so far."""
    kind = F.when(F.col("event_type").isin("click", "view", "signup"), "type_text").otherwise("key")
    d = events(spark, sf_dir).select(F.col("user_id").alias("workflow"), F.col("event_id").alias("segment"), (F.col("t") / (8.0 * HOUR)).alias("t"), kind.alias("kind"), F.col("k").cast("string").alias("text"))
    return sequences.fold(d, ["workflow"], ["t", "segment"], sequences.JoinedTyping, "workflow long, segment long, t double, kind string, text string")


@query("seq_priority_pick", f"""WITH {EVENTS_SQL}, g AS (SELECT user_id, k AS item, max(CASE event_type WHEN 'purchase' THEN 100 WHEN 'signup' THEN 90 WHEN 'click' THEN 80 ELSE 40 END) AS priority, max(event_id) AS event_id FROM e GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, event_id DESC) AS rank FROM g) SELECT * FROM r WHERE rank <= 6""")  # fmt: skip
def seq_priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-19: distinct items by priority, then recency."""
    p = F.when(F.col("event_type") == "purchase", 100).when(F.col("event_type") == "signup", 90).when(F.col("event_type") == "click", 80).otherwise(40)
    d = events(spark, sf_dir).select("user_id", F.col("k").alias("item"), "event_id", "event_type")
    return sequences.priority_pick(d, ["user_id"], "item", "event_id", p, 6).select("user_id", "item", "priority", "event_id", "rank")


@query("str_cache_hits", f"""WITH {EVENTS_SQL}, l AS (SELECT event_type, t - lag(t) OVER (PARTITION BY user_id, k % 4 ORDER BY t, event_id) AS age FROM e)
    SELECT event_type, count(*) FILTER (WHERE age <= {12 * HOUR}) AS hits, count(*) AS lookups FROM l GROUP BY 1""")  # fmt: skip
def str_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-20: lookups within the lifetime of the same key's last one."""
    age = F.col("t") - F.lag("t").over(W.partitionBy("user_id", F.col("k") % 4).orderBy("t", "event_id"))
    d = events(spark, sf_dir).select("event_type", age.alias("age"))
    return d.groupBy("event_type").agg(F.count_if(F.col("age") <= 12 * HOUR).alias("hits"), F.count("*").alias("lookups"))


@query("str_reconcile_baseline", f"""WITH {EVENTS_SQL}, b AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN k END IGNORE NULLS) OVER ({ALONG} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM e)
    SELECT event_id, base, CASE WHEN base IS NULL THEN 'unknown' WHEN base = k THEN 'same' ELSE 'changed' END AS status FROM b WHERE event_type = 'view'""")  # fmt: skip
def str_reconcile_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-19: observations against the last acknowledged baseline."""
    base = F.last(F.when(F.col("event_type") == "purchase", F.col("k")), ignorenulls=True).over(along().rowsBetween(W.unboundedPreceding, -1))
    status = F.when(F.col("base").isNull(), "unknown").when(F.col("base") == F.col("k"), "same").otherwise("changed")
    return events(spark, sf_dir).withColumn("base", base).where("event_type = 'view'").select("event_id", "base", status.alias("status"))


@query("join_spec_merge", """WITH o AS (SELECT user_id AS id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), p AS (SELECT user_id AS id, count(*) AS n FROM events WHERE event_type = 'error' AND value > 150 GROUP BY 1)
    SELECT coalesce(o.id, p.id) AS id, coalesce(p.n, o.n) AS n, CASE WHEN p.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'new' WHEN p.n <> o.n THEN 'open' ELSE 'confirmed' END AS status FROM o FULL JOIN p ON o.id = p.id""")  # fmt: skip
def join_spec_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-17: a patch upserts by id, never removes, and a changed row loses its confirmation."""
    count = lambda where, name: table(spark, sf_dir, "events").where(where).groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias(name))
    j = count("event_type = 'click'", "o").join(count("event_type = 'error' and value > 150", "p"), "id", "full_outer")
    status = F.when(F.col("p").isNull(), "kept").when(F.col("o").isNull(), "new").when(F.col("p") != F.col("o"), "open").otherwise("confirmed")
    return j.select("id", F.coalesce("p", "o").alias("n"), status.alias("status"))


@query("join_already_tried", "SELECT o_orderkey FROM orders c WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders f WHERE f.o_orderstatus = 'F' AND f.o_custkey = c.o_custkey AND f.o_orderpriority = c.o_orderpriority)")
def join_already_tried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-30: candidates whose composite key hasn't failed yet."""
    o = table(spark, sf_dir, "orders")
    keys = ["o_custkey", "o_orderpriority"]
    return o.where("o_orderstatus = 'O'").join(o.where("o_orderstatus = 'F'").select(*keys), keys, "left_anti").select("o_orderkey")


@query("join_retention", """WITH c AS (SELECT source, doc_id, lang = 'en' AS opened, row_number() OVER (PARTITION BY source ORDER BY (lang = 'en')::INT DESC, doc_id) AS rank FROM documents) SELECT source, doc_id, opened FROM c WHERE rank <= 20""")
def join_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-29, TOP-09: opened pages are kept before mere leads, up to a cap (the feature's own)."""
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("opened"), "doc_id"))
    d = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("lang") == "en").alias("opened"))
    return d.withColumn("rank", rank).where("rank <= 20").drop("rank")


@query("join_alias_entities", """WITH RECURSIVE a AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages), g AS (SELECT DISTINCT x.page_id AS p, y.page_id AS q FROM a x JOIN a y USING (u)),
    r AS (SELECT page_id AS node, page_id AS seen FROM pages UNION SELECT r.node, g.q FROM r JOIN g ON g.p = r.seen), c AS (SELECT node, min(seen) AS entity FROM r GROUP BY 1)
    SELECT entity, count(*) AS n, max(length(html)) AS most FROM c JOIN pages ON page_id = node GROUP BY 1""")  # fmt: skip
def join_alias_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-26: sources merged through shared addresses."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("u"), F.char_length("html").alias("size"))
    first = p.groupBy("u").agg(F.min("page_id").alias("first"))
    c = graph.connected_components(p.join(first, "u"), "page_id", "first")
    return c.join(p, c["node"] == p["page_id"]).groupBy(F.col("component").alias("entity")).agg(F.count("*").alias("n"), F.max("size").alias("most"))


@query("flt_row_audit", """WITH i AS (SELECT doc_id, list_filter([CASE WHEN length(text) < 40 THEN 'short' END, CASE WHEN text LIKE '% | %' THEN 'table' END, CASE WHEN regexp_matches(text, '[#*$%&]{3}') THEN 'marks' END, CASE WHEN upper(text) = text THEN 'shout' END, CASE WHEN n_chars <> length(text) THEN 'length' END], lambda x: x IS NOT NULL) AS issues FROM documents)
    SELECT issue, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, unnest(issues) AS issue FROM i) GROUP BY 1""")  # fmt: skip
def flt_row_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12/13: all predicates of a row in one pass, exploded to an issue table."""
    t = F.col("text")
    checks = {"short": F.char_length(t) < 40, "table": F.contains(t, F.lit(" | ")), "marks": t.rlike("[#*$%&]{3}"), "shout": F.upper(t) == t, "length": F.col("n_chars") != F.char_length(t)}
    issues = F.explode(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items()))))
    return table(spark, sf_dir, "documents").select("doc_id", issues.alias("issue")).groupBy("issue").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("txt_excerpts", """WITH p AS (SELECT doc_id, i AS part, substr(text, i * 800 + 1, 1000) AS c FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 201, 0) // 800 + 1)) AS i FROM documents)),
    s AS (SELECT *, 3 * len(regexp_extract_all(lower(c), ' (?:the|la|der) ')) + least(6, len(regexp_extract_all(c, '\\|'))) AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, part) AS rn FROM s)
    SELECT doc_id, string_agg(part::VARCHAR, ',' ORDER BY part) AS parts, sum(score)::BIGINT AS score FROM r WHERE rn <= 3 GROUP BY 1""")  # fmt: skip
def txt_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-14/15: the best parts by word hits and measures, back in the text's order."""
    p = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.parts(F.col("text"), 1000, 200)).alias("part", "c"))
    score = 3 * F.regexp_count(F.lower("c"), F.lit(" (?:the|la|der) ")) + F.least(F.lit(6), F.regexp_count("c", F.lit("\\|")))
    r = p.select("doc_id", "part", score.alias("score")).withColumn("rn", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "part"))).where("rn <= 3")
    parts = F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda x: x.cast("string")), ",")
    return r.groupBy("doc_id").agg(parts.alias("parts"), F.sum("score").alias("score"))


@query(
    "txt_relevant",
    f"""WITH w AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: length(x) > 1 AND NOT regexp_full_match(x, '[0-9]+')) AS w FROM benchmark),
    a AS (SELECT item_id, w, list_filter(w, lambda x: NOT list_contains({list(T.GENERIC)}, x)) AS a FROM w), q AS (SELECT item_id, CASE WHEN len(a) > 0 THEN a ELSE w END AS q FROM a),
    c AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations)
    SELECT conv_id, turn, item_id, len(list_intersect(q, w)) AS shared FROM q JOIN c ON len(q) > 0 AND len(list_intersect(q, w)) >= least(2, len(q))""",
)
def txt_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-21: results (here turns) that hold two of a query's anchors, or the only one."""
    q = table(spark, sf_dir, "benchmark").select("item_id", T.anchors(F.col("text")).alias("tokens"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    c = turns(spark, sf_dir).select(F.struct("conv_id", "turn").alias("at"), words.alias("tokens"))
    need = q.where(F.size("tokens") > 0).select("item_id", F.least(F.lit(2), F.size("tokens")).alias("need"))
    found = keyed.Overlaps(q, c, "item_id", "at").at_least(need)
    return found.select("at.conv_id", "at.turn", "item_id", F.col("score").alias("shared"))


@query(
    "txt_citations",
    """WITH s AS (SELECT 'web_' || substr(sha256(url), 1, 12) AS id, bool_or(page_id % 3 = 0) AS opened FROM pages GROUP BY 1), a AS (SELECT page_id, 'web_' || substr(sha256(url), 1, 12) AS x, 'web_' || substr(sha256(regexp_replace(url, '[?#].*$', '')), 1, 12) AS y FROM pages),
    c AS (SELECT page_id, x AS id, 1 AS place FROM a UNION ALL SELECT page_id, y, 2 FROM a WHERE y <> x) SELECT page_id, id, place, CASE WHEN opened THEN 'opened' ELSE 'discovered' END AS evidence FROM c JOIN s USING (id)""",
)
def txt_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-34: an answer's citations of known sources, by first place; each page gives an answer that cites itself and its bare address."""
    p = table(spark, sf_dir, "pages").select("page_id", T.source_id(F.col("url")).alias("x"), T.source_id(F.regexp_replace("url", "[?#].*$", "")).alias("y"))
    answers = p.select("page_id", F.format_string("As [%s] says ([%s], [WEB_0], [web_12]); again [%s].", "x", "y", "x").alias("text"))
    return keyed.citations(answers, p.groupBy(F.col("x").alias("id")).agg(F.bool_or(F.col("page_id") % 3 == 0).alias("opened")), "page_id")


@query("agg_ratios", "SELECT source, round(count(*) FILTER (WHERE lang = 'en') / count(*), 6) AS ratio FROM documents GROUP BY 1")
def agg_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02: guarded ratio."""
    n = F.count("*")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.when(n > 0, F.round(F.count_if(F.col("lang") == "en") / n, 6)).otherwise(0.0).alias("ratio"))


@query("agg_unique_bytes", "SELECT lang, sum(size)::BIGINT AS bytes, count(*) AS files FROM (SELECT DISTINCT lang, text, octet_length(encode(text)) AS size FROM documents) GROUP BY 1")
def agg_unique_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21: bytes of distinct contents, told apart by digest."""
    d = table(spark, sf_dir, "documents").select("lang", F.sha2("text", 256).alias("h"), F.octet_length("text").alias("size")).dropDuplicates(["lang", "h"])
    return d.groupBy("lang").agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))


@query("agg_run_report", f"""WITH {EVENTS_SQL}, n AS (SELECT *, row_number() OVER ({ALONG}) AS step FROM e)
    SELECT user_id, min_by(k, step) AS first_k, min(k) AS least_k, max_by(k, step) AS last_k, count(*) FILTER (WHERE step % 10 = 0) AS logged FROM n GROUP BY 1""")  # fmt: skip
def agg_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23: first, least and last values of a run and every tenth row."""
    d = events(spark, sf_dir).withColumn("step", F.row_number().over(along()))
    return d.groupBy("user_id").agg(F.min_by("k", "step").alias("first_k"), F.min("k").alias("least_k"), F.max_by("k", "step").alias("last_k"), F.count_if(F.col("step") % 10 == 0).alias("logged"))


@query("agg_variant_means", "SELECT role, count(*) AS n, round(avg(length(text)), 3) AS mean, sum(length(text))::BIGINT AS chars, bool_or(length(text) > 2000) AS truncated FROM conversations GROUP BY 1")
def agg_variant_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-24: means, totals and flags of each variant."""
    n = F.char_length("text")
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(n), 3).alias("mean"), F.sum(n).alias("chars"), F.bool_or(n > 2000).alias("truncated"))


@query("top_workers", "SELECT source, (row_number() OVER (ORDER BY source) - 1) % 4 AS worker FROM (SELECT DISTINCT source FROM documents)")
def top_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-08: sorted keys dealt to workers in turn; the keys are a small dimension."""
    s = table(spark, sf_dir, "documents").select("source").distinct()
    return s.select("source", ((F.row_number().over(W.partitionBy().orderBy("source")) - 1) % 4).alias("worker"))


@query("set_concat", "SELECT 'a/' || url AS path, page_id FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 'b/' || url, page_id FROM pages WHERE page_id % 2 = 1")
def set_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01: shards put together with their paths rewritten."""
    p = table(spark, sf_dir, "pages")
    shard = lambda k, name: p.where(f"page_id % 2 = {k}").select(F.concat(F.lit(f"{name}/"), "url").alias("path"), "page_id")
    return shard(0, "a").unionByName(shard(1, "b"))


@query("scl_rewards", """SELECT o_orderkey, CASE WHEN abs(o_totalprice - 150000) / 150000 <= 0.05 AND o_custkey % 10 <= 3 THEN 1.0 ELSE round(least(0.8, 0.8 * greatest(0.0, 1 - abs(o_totalprice - 150000) / 150000)), 9) END AS reward FROM orders""")
def scl_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-20: full reward within bounds, else bounded partial credit."""
    off = F.abs(F.col("o_totalprice") - 150000) / 150000
    part = F.round(F.least(F.lit(0.8), 0.8 * F.greatest(F.lit(0.0), 1 - off)), 9)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when((off <= 0.05) & (F.col("o_custkey") % 10 <= 3), 1.0).otherwise(part).alias("reward"))


@query("geo_merkle")
def geo_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-05: subtree signatures over a feature graph."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))
    e = p.where("id >= 2").select(F.col("id").alias("src"), F.expr("id div 2").alias("dst"))
    return graph.merkle(p, e.join(p.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
