"""Queries over documents, dialogues, pages, labels and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.functions import scalars as S
from tracemill.functions import text as T
from tracemill.operators import geometry, graph, keyed, sequences, statistics
from tracemill.plans.registry import query
from tracemill.sources.tables import turns
from tracemill.storage import table

SPLIT_SQL = "CASE WHEN {s} < 0.8 THEN 'train' WHEN {s} < 0.9 THEN 'validation' ELSE 'test' END"
SHARE_SQL = "(('0x' || substr(sha256({k}::VARCHAR), 1, 8))::BIGINT / 4294967296.0)"
#: Radius of a vector's outline: no two are equal, so no corner lies on another outline.
OUTLINE_RADIUS = "50 + abs(round({e} * 1000)) + vec_id / 1000003e0"
DOC_SPLIT_SQL = SPLIT_SQL.format(s=SHARE_SQL.format(k="doc_id"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("scl_split", f"SELECT doc_id, {DOC_SPLIT_SQL} AS split FROM documents")
def scl_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-15: split by hash of the key."""
    return _docs(spark, sf_dir).select("doc_id", S.split_of(F.col("doc_id")).alias("split"))


@query("scl_compact", "SELECT doc_id, sha256(lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g'))) AS digest FROM documents")
def scl_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-09, SRC-23: digest of the compact text."""
    return _docs(spark, sf_dir).select("doc_id", F.sha2(S.compact(F.col("text")), 256).alias("digest"))


@query("scl_text_tokens", "SELECT doc_id, (floor(length(text) / 2.5) + 1)::BIGINT AS tokens FROM documents")
def scl_text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-18: estimated tokens."""
    return _docs(spark, sf_dir).select("doc_id", S.text_tokens(F.col("text")).alias("tokens"))


@query("src_digest", "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS size FROM documents")
def src_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-23/26: content digest and size."""
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


@query(
    "agg_ordered_digest",
    "SELECT source, count(*) AS files, sha256(string_agg(doc_id::VARCHAR || chr(9) || sha256(text), chr(10) ORDER BY doc_id::VARCHAR || chr(9) || sha256(text))) AS sha256 FROM documents GROUP BY source",
)
def agg_ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14, SRC-28: digest over sorted (name, digest) lines."""
    d = _docs(spark, sf_dir).select("source", F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("digest"))
    return statistics.ordered_digest(d, ["source"], "name", "digest")


@query("join_split_leaks", f"SELECT sha256(text) AS task, string_agg(DISTINCT {DOC_SPLIT_SQL}, ',' ORDER BY {DOC_SPLIT_SQL}) AS splits, count(*) AS n FROM documents GROUP BY text HAVING count(DISTINCT {DOC_SPLIT_SQL}) > 1")
def join_split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-10/11, SET-02: equal texts in two splits or more."""
    d = _docs(spark, sf_dir).select(F.sha2("text", 256).alias("task"), S.split_of(F.col("doc_id")).alias("split"))
    return keyed.leaks(d, "task", "split")


@query("set_duplicate_keys", "SELECT lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def set_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-07, TXT-33: normalised keys that occur more than once."""
    return _docs(spark, sf_dir).groupBy(T.normal_key(F.col("text")).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("set_operations", "SELECT 'both' AS side, count(*) AS n FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1) UNION ALL SELECT 'left', count(*) FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT text FROM documents WHERE doc_id % 2 = 1)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-02/03/04: intersection and difference."""
    d = _docs(spark, sf_dir)
    even, odd = (d.where(f"doc_id % 2 = {k}").select("text") for k in (0, 1))
    count = lambda x, name: x.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return count(even.intersect(odd), "both").union(count(even.subtract(odd), "left"))


@query("join_labels_default", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_labels_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-05: optional side input with a default."""
    l = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("has"))
    return _docs(spark, sf_dir).select("doc_id").join(l, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("has", F.lit(False)).alias("labelled"))


@query("join_missing_files", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-07/14/15, SET-03: rows without a partner."""
    return _docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("join_first_match", "SELECT text AS text, min(doc_id) AS doc_id, min_by(source, doc_id) AS source FROM documents GROUP BY text HAVING count(*) > 1")
def join_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-24, SET-05: the first of equal keys wins."""
    return _docs(spark, sf_dir).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"), F.count("*").alias("n")).where("n > 1").drop("n")


@query(
    "join_ranked_matches",
    """WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS token FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS token FROM documents),
    s AS (SELECT item_id, doc_id, count(*) AS shared FROM q JOIN d USING (token) GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM s)
    SELECT * FROM r WHERE rank <= 5""",
)
def join_ranked_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-20, TOP-05: best five by shared tokens, through an index entered by rare tokens."""
    return keyed.ranked_matches(table(spark, sf_dir, "benchmark"), _docs(spark, sf_dir), "item_id", "doc_id", 5)


@query(
    "txt_design_notes",
    """WITH t AS (SELECT item_id AS topic_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS q FROM benchmark), d AS (SELECT doc_id AS note_id, length(text)::BIGINT AS l, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS body, list_distinct(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z0-9]+')) AS title FROM documents),
    s AS (SELECT topic_id, note_id, l, 3 * len(list_intersect(q, title)) + len(list_intersect(q, body)) AS score FROM t, d), r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, note_id) AS rank FROM s WHERE score > 0),
    c AS (SELECT *, coalesce(sum(l) OVER (PARTITION BY topic_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r WHERE rank <= 2)
    SELECT topic_id, note_id, rank, score, least(l, 6000 - before)::BIGINT AS chars FROM c WHERE rank = 1 OR 6000 - before > 0 AND l > 0""",
)
def txt_design_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-26: the two documents that best fit each topic, titles weighted, within 6,000 characters."""
    topics = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic_id"), "text")
    notes = _docs(spark, sf_dir).select(F.col("doc_id").alias("note_id"), F.substring_index("text", "\n", 1).alias("title"), "text")
    return keyed.noted(topics, notes)


@query("agg_macro_average", """WITH g AS (SELECT lang, count(*) AS n, avg((length(text) > 1000)::INT) AS mean, sum((length(text) > 1000)::INT) AS s FROM documents GROUP BY 1)
    SELECT 'group:' || lang AS scope, n, mean FROM g UNION ALL SELECT 'overall', sum(n)::BIGINT, sum(s) / sum(n) FROM g UNION ALL SELECT 'macro', count(*), avg(mean) FROM (SELECT mean FROM g ORDER BY lang)""")  # fmt: skip
def agg_macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07/08: groups, overall, and the unweighted mean of groups."""
    return statistics.with_macro(_docs(spark, sf_dir), "lang", F.when(F.char_length("text") > 1000, 1).otherwise(0))


@query("agg_balanced_weights", "WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, n, round(sqrt(n) / (SELECT sum(sqrt(n)) FROM g) / n, 12) AS weight FROM g")
def agg_balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09: tempered sampling weights."""
    return statistics.balanced_weights(_docs(spark, sf_dir), "source", 0.5).withColumn("weight", F.round("weight", 12))


@query("agg_expected_coverage", """WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS total, sqrt(n) / sum(sqrt(n)) OVER () / n AS weight FROM g), c AS (SELECT source, n, total, 1 - (1 - weight) ** total AS share FROM t)
    SELECT source, n, round(share, 9) AS coverage, round(sum(n * share) OVER () / total, 9) AS overall FROM c""")  # fmt: skip
def agg_expected_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10: share of distinct rows that as many draws with replacement as there are rows should meet."""
    c = statistics.expected_coverage(_docs(spark, sf_dir), "source", 0.5)
    return c.select("source", "n", F.round("coverage", 9).alias("coverage"), F.round("overall", 9).alias("overall"))


@query("agg_split_quotas", "SELECT lang, count(*) AS n, CASE WHEN count(*) >= 2 THEN greatest(1, round_even(0.1 * count(*), 0)) ELSE 0 END::INT AS validation, CASE WHEN count(*) >= 3 THEN greatest(1, round_even(0.1 * count(*), 0)) ELSE 0 END::INT AS test FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY 1")
def agg_split_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17: held-out groups of each application."""
    quota = lambda least: F.when(F.col("n") >= least, F.greatest(F.lit(1.0), F.bround(0.1 * F.col("n")))).otherwise(0).cast("int")
    n = _docs(spark, sf_dir).select("lang", "source").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    return n.select("lang", "n", quota(2).alias("validation"), quota(3).alias("test"))


@query("agg_coverage", "SELECT l.lang, s.source FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.lang = l.lang AND d.source = s.source AND length(d.text) > 2500)")
def agg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19: combinations of two small dimensions that nothing covers."""
    d = _docs(spark, sf_dir)
    every = d.select(F.lit(1).alias("one"), "lang").distinct().join(d.select(F.lit(1).alias("one"), "source").distinct(), "one").drop("one")
    return every.join(d.where(F.char_length("text") > 2500), ["lang", "source"], "left_anti")


@query("agg_status", "SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN quality = 1 THEN 'complete' ELSE 'failed' END AS status, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def agg_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20, SRC-08: plan against manifest."""
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 1, "complete").otherwise("failed")
    return d.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("agg_text_lengths", "SELECT lang, min(n) AS least, round(avg(n), 1) AS mean, max(n) AS most, list_sort(list(n))[count(*) // 2 + 1] AS upper_median, median(n) AS median FROM (SELECT lang, length(text) AS n FROM documents) GROUP BY 1")
def agg_text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05/07: upper and true medians, from counts of equal values."""
    d = _docs(spark, sf_dir).select("lang", F.char_length("text").cast("long").alias("n"))
    counts = d.groupBy("lang", "n").agg(F.count("*").alias("c"))
    w = W.partitionBy("lang")
    r = counts.withColumn("upto", F.sum("c").over(w.orderBy("n"))).withColumn("all", F.sum("c").over(w))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("n")))
    upper, lower = at(F.expr("all div 2")), at(F.expr("(all - 1) div 2"))
    return r.groupBy("lang").agg(F.min("n").alias("least"), F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 1).alias("mean"), F.max("n").alias("most"), upper.alias("upper_median"), ((upper + lower) / 2).alias("median"))


@query("txt_parts", "SELECT doc_id, i AS part, sha256(substr(text, i * 800 + 1, 1000)) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 201, 0) // 800 + 1)) AS i FROM documents)")
def txt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-13: overlapping parts."""
    p = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.parts(F.col("text"), 1000, 200)).alias("part", "c"))
    return p.select("doc_id", F.col("part").cast("long").alias("part"), F.sha2("c", 256).alias("digest"))


@query("txt_sources", "SELECT page_id, 'web_' || substr(sha256(url), 1, 12) AS id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, CASE WHEN host LIKE 'm.%' THEN 'mobile' WHEN host LIKE 'blog.%' THEN 'blog' WHEN host LIKE '%.org' THEN 'reference' ELSE 'other' END AS kind FROM pages")
def txt_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-17: ids and classes of web sources."""
    host = T.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", T.source_id(F.col("url")).alias("id"), host.alias("host"), T.host_class(host).alias("kind"))


@query("txt_page_dedupe", "SELECT host, count(*) AS n FROM (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS u, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages) GROUP BY host")
def txt_page_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-19, TOP-06: distinct addresses without query or fragment."""
    u = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("u"), T.host(F.col("url")).alias("host")).distinct()
    return u.groupBy("host").agg(F.count("*").alias("n"))


@query("txt_quotes", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(lower(regexp_replace(d.text, '\\s+', '', 'g')), lower(regexp_replace(b.text, '\\s+', '', 'g')))")
def txt_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-25, FLT-15/16: quotes that documents hold verbatim."""
    return keyed.quotes(table(spark, sf_dir, "benchmark"), _docs(spark, sf_dir))


@query("seq_dialogue_context", """WITH u AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations)
    SELECT conv_id, count(*) AS kept, min(turn) AS first_turn FROM u WHERE used <= 1500 GROUP BY 1""")  # fmt: skip
def seq_dialogue_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-17/20, TOP-11: newest turns within a budget of characters."""
    kept = sequences.newest_within(turns(spark, sf_dir), ["conv_id"], ["turn"], F.char_length("text"), 1500)
    return kept.groupBy("conv_id").agg(F.count("*").alias("kept"), F.min("turn").alias("first_turn"))


@query("join_reply_to", """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reply_to FROM conversations""")
def join_reply_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-13, STR-04: each turn's latest question before it."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return turns(spark, sf_dir).select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("reply_to"))


@query("join_unanswered", "SELECT conv_id, turn FROM conversations q WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant')")
def join_unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-14: calls without a result."""
    t = turns(spark, sf_dir)
    answers = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return t.where("role = 'user'").select("conv_id", "turn").join(answers, ["conv_id", "turn"], "left_anti")


@query("txt_conversation", "SELECT conv_id, sha256(string_agg('<' || role || '>' || trim(text), chr(10) ORDER BY turn)) AS digest, count(*) AS turns FROM conversations GROUP BY 1")
def txt_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-01/02/10, SRC-20: turns in order as one prompt."""
    line = F.struct("turn", F.concat(F.lit("<"), "role", F.lit(">"), F.trim("text")).alias("line"))
    g = turns(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(line)).alias("lines"), F.count("*").alias("turns"))
    return g.select("conv_id", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 256).alias("digest"), "turns")


WINDOWS_SQL = """WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, (floor(length(text) / 2.5) + 25)::BIGINT AS c,
      coalesce(sum((floor(length(substr(text, 1, 60)) / 2.5) + 2)::BIGINT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p FROM conversations),
    h AS (SELECT s.conv_id, s.i, s.c, s.i - coalesce(min(o.i), s.i) AS kept, s.p - coalesce(min(o.p), s.p) AS used FROM s LEFT JOIN s o ON o.conv_id = s.conv_id AND o.i < s.i AND s.p - o.p <= 80 GROUP BY s.conv_id, s.i, s.c, s.p),
    w AS (SELECT conv_id, i, 0::BIGINT AS first_step, 0::BIGINT AS history, 40 + c AS total FROM h WHERE i = 0
      UNION ALL SELECT h.conv_id, h.i, CASE WHEN w.total + h.c > 368 THEN h.i ELSE w.first_step END, CASE WHEN w.total + h.c > 368 THEN h.kept ELSE w.history END,
        CASE WHEN w.total + h.c > 368 THEN 40 + h.used + CASE WHEN h.kept < h.i THEN 12 ELSE 0 END + h.c ELSE w.total + h.c END FROM w JOIN h ON h.conv_id = w.conv_id AND h.i = w.i + 1)
    SELECT conv_id AS workflow, first_step, max(i) + 1 AS end_step, max(history) AS history, first_step - max(history) AS omitted, max(total) AS tokens FROM w GROUP BY conv_id, first_step"""


@query("seq_windows", WINDOWS_SQL)
def seq_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-09: steps cut greedily into windows of a token budget, each with the newest earlier lines that fit a fifth of it."""
    cost, line = S.text_tokens(F.col("text")) + 24, S.text_tokens(F.substring("text", 1, 60)) + 1
    d = turns(spark, sf_dir).select(F.col("conv_id").alias("workflow"), "turn", cost.alias("cost"), line.alias("log_cost"))
    schema = "workflow long, first_step long, end_step long, history long, omitted long, tokens long"
    return sequences.fold(d, ["workflow"], ["turn"], lambda: sequences.Windows(400, header=40), schema)


@query("seq_prompt_fit", """WITH s AS (SELECT conv_id, turn, sum((floor(length(text) / 2.5) + 1)::BIGINT) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations),
    v AS (SELECT * FROM (VALUES (0, 60), (1, 20), (2, 0)) v(variant, header)),
    f AS (SELECT conv_id, variant, count(*) AS n FROM s, v WHERE upto + header <= 400 GROUP BY ALL)
    SELECT conv_id, max(n) AS steps, min_by(variant, (-n, variant)) AS variant FROM f GROUP BY 1""")  # fmt: skip
def seq_prompt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-22, TXT-12, FLT-14: most steps that fit, by the first prompt variant that allows them."""
    upto = F.sum(S.text_tokens(F.col("text"))).over(W.partitionBy("conv_id").orderBy("turn"))
    variants = F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), F.lit(h).alias("header")) for k, h in enumerate((60, 20, 0))))).alias("v")
    s = turns(spark, sf_dir).select("conv_id", upto.alias("upto")).select("*", variants).where(F.col("upto") + F.col("v.header") <= 400)
    f = s.groupBy("conv_id", "v.variant").agg(F.count("*").alias("n"))
    return f.groupBy("conv_id").agg(F.max("n").alias("steps"), F.min_by("variant", F.struct(-F.col("n"), F.col("variant"))).alias("variant"))


@query("score_predictions", """WITH p AS (SELECT vec_id, label, (vec_id * 7) % 3 AS guess, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
    SELECT label, count(*) AS n, count(*) FILTER (WHERE guess = label % 3) AS type_hits, count(*) FILTER (WHERE sqrt(x * x + y * y) <= 0.1) AS within_10, count(*) FILTER (WHERE sqrt(x * x + y * y) <= 0.2) AS within_20 FROM p GROUP BY 1""")  # fmt: skip
def score_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-19, AGG-07: hits by type and by distance bound."""
    x, y = F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double")
    far, hit = F.sqrt(x * x + y * y), (F.col("vec_id") * 7) % 3 == F.col("label") % 3
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n"), F.count_if(hit).alias("type_hits"), F.count_if(far <= 0.1).alias("within_10"), F.count_if(far <= 0.2).alias("within_20"))


@query("join_metric_delta", """WITH a AS (SELECT l_returnflag AS k, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1), b AS (SELECT l_returnflag AS k, count(*) AS n FROM lineitem WHERE l_linenumber % 3 = 0 GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.k = b.k""")  # fmt: skip
def join_metric_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-19: baseline against current."""
    count = lambda where, name: table(spark, sf_dir, "lineitem").where(where).groupBy(F.col("l_returnflag").alias("k")).agg(F.count("*").alias(name))
    j = count("l_linenumber % 2 = 0", "a").join(count("l_linenumber % 3 = 0", "b"), "k", "full_outer")
    return j.select("k", (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("delta"))


@query("join_evidence_tolerance", """SELECT o.o_orderkey, count(*) AS checks, count(*) FILTER (WHERE abs(l.l_quantity - 25) <= 10) AS passed, bool_and(abs(l.l_quantity - 25) <= 10) AS all_passed
    FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F' GROUP BY 1""")  # fmt: skip
def join_evidence_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-18, AGG-16: checks against evidence within a tolerance, all of which must pass."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    j = o.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity"), "o_orderkey")
    ok = F.abs(F.col("l_quantity") - 25) <= 10
    return j.groupBy("o_orderkey").agg(F.count("*").alias("checks"), F.count_if(ok).alias("passed"), F.bool_and(ok).alias("all_passed"))


@query("join_foreign_keys", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def join_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-27, SET-03: references to what isn't there."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey"))
    good = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey")
    return l.join(good, "s_suppkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(
    "geo_outline_roles",
    f"""WITH o AS (SELECT label AS drawing, vec_id AS path_id, round(embedding[1]::DOUBLE * 1000) AS x, round(embedding[2]::DOUBLE * 1000) AS y, {OUTLINE_RADIUS.format(e="embedding[3]::DOUBLE")} AS r FROM embeddings),
    d AS (SELECT o.drawing, o.path_id, o.r, count(b.path_id) AS depth FROM o LEFT JOIN o b ON b.drawing = o.drawing AND b.path_id <> o.path_id
      AND greatest(abs(o.x + o.r - b.x) + abs(o.y - b.y), abs(o.x - o.r - b.x) + abs(o.y - b.y), abs(o.x - b.x) + abs(o.y + o.r - b.y), abs(o.x - b.x) + abs(o.y - o.r - b.y)) < b.r GROUP BY ALL)
    SELECT drawing, path_id, depth, CASE WHEN depth % 2 = 1 THEN 'hole' ELSE 'outer' END AS role, round(2 * r * r, 3) AS area FROM d""",
)
def geo_outline_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-02/13: nesting depth of outlines, and the roles that follow; each vector gives a diamond of its drawing."""
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    o = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("drawing"), F.col("vec_id").alias("path_id"), F.round(e(0) * 1000).alias("x"), F.round(e(1) * 1000).alias("y"),
        F.expr(OUTLINE_RADIUS.format(e="embedding[2]")).alias("r"),
    )
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    corners = F.array(*(F.struct(px.alias("x"), py.alias("y")) for px, py in ((x + r, y), (x, y + r), (x - r, y), (x, y - r))))
    points = o.select("drawing", "path_id", F.posexplode(corners).alias("i", "p")).select("drawing", "path_id", "i", "p.x", "p.y")
    return geometry.outline_roles(points, cell=250.0).select("drawing", "path_id", "depth", "role", F.round(F.abs("area"), 3).alias("area"))


@query("geo_shoelace", """WITH p AS (SELECT label AS path_id, vec_id AS i, round(embedding[1]::DOUBLE * 1000) AS x, round(embedding[2]::DOUBLE * 1000) AS y FROM embeddings),
    e AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM p WINDOW w AS (PARTITION BY path_id ORDER BY i))
    SELECT path_id, count(*) AS n, sum(x * ny - nx * y) / 2 AS area FROM e GROUP BY 1""")  # fmt: skip
def geo_shoelace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-02: signed areas."""
    c = lambda k: F.round(F.get("embedding", F.lit(k)).cast("double") * 1000)
    return geometry.signed_areas(table(spark, sf_dir, "embeddings").select(F.col("label").alias("path_id"), F.col("vec_id").alias("i"), c(0).alias("x"), c(1).alias("y")))


@query("geo_crossings", """WITH s AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE * 1000) AS x1, round(embedding[2]::DOUBLE * 1000) AS y1, round(embedding[1]::DOUBLE * 1000) + round(embedding[3]::DOUBLE * 100) AS x2, round(embedding[2]::DOUBLE * 1000) + round(embedding[4]::DOUBLE * 100) AS y2 FROM embeddings)
    SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id < b.id
    AND sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) < 0
    AND sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) < 0""")  # fmt: skip
def geo_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-21, GEO-03: crossing segments through a grid."""
    c = lambda k, by: F.round(F.get("embedding", F.lit(k)).cast("double") * by)
    e = table(spark, sf_dir, "embeddings")
    return geometry.crossings(e.select(F.col("vec_id").alias("id"), c(0, 1000).alias("x1"), c(1, 1000).alias("y1"), (c(0, 1000) + c(2, 100)).alias("x2"), (c(1, 1000) + c(3, 100)).alias("y2")), 50.0)


@query("graph_components", """WITH RECURSIVE g AS (SELECT DISTINCT a.doc_id AS u, b.doc_id AS v FROM documents a JOIN documents b ON a.text = b.text OR (a.source = b.source AND a.lang = b.lang AND a.lang <> 'en')),
    r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, g.v FROM r JOIN g ON g.u = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY 1""")  # fmt: skip
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-09, GEO-11: groups that share an artifact; documents link to the artifact's first holder."""
    d = _docs(spark, sf_dir)
    artifact = F.explode(F.array_compact(F.array(F.sha2("text", 256), F.when(F.col("lang") != "en", F.concat_ws("/", "lang", "source")))))
    held = d.select("doc_id", artifact.alias("artifact"))
    first = held.groupBy("artifact").agg(F.min("doc_id").alias("first"))
    return graph.connected_components(held.join(first, "artifact"), "doc_id", "first")


@query("top_hash_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR)) AS rn FROM documents) WHERE rn <= 5")
def top_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-07, SEQ-14: five a group in hash order."""
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.sha2(F.col("doc_id").cast("string"), 256)))
    return _docs(spark, sf_dir).select("source", "doc_id", rank.alias("rn")).where("rn <= 5").drop("rn")
