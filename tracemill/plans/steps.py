"""Queries over steps, journals, evidence and revisions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.functions import text as T
from tracemill.operators import keyed, sequences, statistics
from tracemill.plans.registry import query
from tracemill.sources import build, ledger
from tracemill.sources.tables import EVENTS_SQL, events, turns
from tracemill.storage import shared_dir, table

HOUR = 3_600_000_000
ALONG = "PARTITION BY user_id ORDER BY t, event_id"


def along():
    return W.partitionBy("user_id").orderBy("t", "event_id")


@query(
    "flt_event_rejects",
    f"""WITH {EVENTS_SQL}, r AS (SELECT CASE WHEN event_type = 'error' THEN 'off_target_or_unknown_app' WHEN k % 13 = 0 THEN 'unknown_modifiers' WHEN value / 400 > 1 THEN 'invalid_pointer_coordinates' WHEN event_type = 'view' AND abs(k - 50) > 40 THEN 'unsupported_scroll_magnitude' ELSE 'accepted' END AS reason FROM e)
    SELECT reason, count(*) AS n FROM r GROUP BY 1""",
)
def flt_event_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-03/04/09: event rejects, the first match counts."""
    k = F.col("k")
    reason = (
        F.when(F.col("event_type") == "error", "off_target_or_unknown_app").when(k % 13 == 0, "unknown_modifiers").when(F.col("value") / 400 > 1, "invalid_pointer_coordinates")
        .when((F.col("event_type") == "view") & (F.abs(k - 50) > 40), "unsupported_scroll_magnitude").otherwise("accepted")
    )
    return events(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    "flt_answer_options",
    f"""WITH {EVENTS_SQL}, q AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN k END IGNORE NULLS) OVER ({ALONG} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM e)
    SELECT CASE WHEN question IS NULL THEN 'no_question' WHEN k % 5 NOT IN (question % 5, (question + 1) % 5) THEN 'unknown_option' ELSE 'valid' END AS status, count(*) AS n FROM q WHERE event_type = 'click' GROUP BY 1""",
)
def flt_answer_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-19: answers against the open question's options."""
    question = F.last(F.when(F.col("event_type") == "signup", F.col("k")), ignorenulls=True).over(along().rowsBetween(W.unboundedPreceding, -1))
    q = events(spark, sf_dir).withColumn("q", question).where("event_type = 'click'")
    known = F.array_contains(F.array(F.col("q") % 5, (F.col("q") + 1) % 5), F.col("k") % 5)
    status = F.when(F.col("q").isNull(), "no_question").when(~known, "unknown_option").otherwise("valid")
    return q.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(
    "join_by_ordinal",
    """WITH a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, length(text) AS size FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, length(text) AS size FROM conversations WHERE role = 'assistant')
    SELECT a.conv_id, a.n, a.size AS asked, b.size AS answered FROM a LEFT JOIN b ON a.conv_id = b.conv_id AND a.n = b.n""",
)
def join_by_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-06/22: partners by position within their key."""
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    side = lambda role, name: turns(spark, sf_dir).where(F.col("role") == role).select("conv_id", n.alias("n"), F.char_length("text").alias(name))
    return side("user", "asked").join(side("assistant", "answered"), ["conv_id", "n"], "left")


@query("join_cited_sources", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)")
def join_cited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-23: what at least one finding cites."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("join_quotes_of_source", "SELECT c_nationkey, sha256(string_agg(c_name, ' | ' ORDER BY c_custkey)) AS quotes, count(*) AS n FROM customer GROUP BY 1")
def join_quotes_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-28: a source's quotes in order, carried as one text; they stream past, no list is built."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_name").alias("line"))
    schema = f"c_nationkey {c.schema['c_nationkey'].dataType.simpleString()}, n long, quotes string"
    return sequences.fold(c, ["c_nationkey"], ["c_custkey"], lambda: statistics.Digest(" | "), schema)


@query(
    "scl_bounds",
    """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size * 1.0 WHEN 1 THEN 2.0 * p_size ELSE NULL END AS width, CASE p_size % 3 WHEN 0 THEN p_size * 2.0 WHEN 1 THEN 2.0 * p_size ELSE NULL END AS depth, coalesce(lower(CASE WHEN p_size % 2 = 0 THEN 'LEFT' END), 'left') AS button FROM part""",
)
def scl_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-14/22: bounds of primitives by kind, none for turned ones; default and lower-cased names."""
    s = F.col("p_size").cast("double")
    box, cylinder = F.col("p_size") % 3 == 0, F.col("p_size") % 3 == 1
    button = F.coalesce(F.lower(F.when(F.col("p_size") % 2 == 0, F.lit("LEFT"))), F.lit("left"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(box, s).when(cylinder, 2 * s).alias("width"), F.when(box, 2 * s).when(cylinder, 2 * s).alias("depth"), button.alias("button"))


@query("scl_freshness", f"WITH {EVENTS_SQL}, m AS (SELECT max(t) AS now FROM e) SELECT event_type, count(*) FILTER (WHERE now - t BETWEEN 0 AND {5 * 24 * HOUR}) AS fresh, count(*) AS n FROM e, m GROUP BY 1")
def scl_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-23: readings young enough to count."""
    e = events(spark, sf_dir)
    now = e.agg(F.max("t")).first()[0] or 0
    return e.groupBy("event_type").agg(F.count_if((now - F.col("t")).between(0, 5 * 24 * HOUR)).alias("fresh"), F.count("*").alias("n"))


@query(
    "set_map_merge",
    f"""WITH {EVENTS_SQL} SELECT user_id, event_type, t // {24 * HOUR} % 7 AS day, coalesce(max(event_id) FILTER (WHERE event_id % 2 = 1), max(event_id) FILTER (WHERE event_id % 2 = 0)) AS setting FROM e GROUP BY ALL""",
)
def set_map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-08: each user's settings (type -> day -> number) over a base of the same shape; nested maps merge, leaves are replaced."""
    e = events(spark, sf_dir).select("user_id", "event_type", F.expr(f"t div {24 * HOUR} % 7").alias("day"), (F.col("event_id") % 2).alias("side"), "event_id")
    e = e.groupBy("user_id", "side", "event_type", "day").agg(F.max("event_id").alias("v"))
    as_map = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v))).alias("v")
    sides = e.groupBy("user_id", "side", "event_type").agg(as_map("day", "v")).groupBy("user_id", "side").agg(as_map("event_type", "v"))
    side = lambda s: F.any_value(F.when(F.col("side") == s, F.col("v")), ignoreNulls=True)
    m = sides.groupBy("user_id").agg(side(0).alias("base"), side(1).alias("own")).select("user_id", keyed.merged("base", "own", 2).alias("m"))
    return m.select("user_id", F.explode("m").alias("event_type", "days")).select("user_id", "event_type", F.explode("days").alias("day", "setting"))


@query("src_report", """SELECT '{"documents":' || count(*) || ',"languages":' || count(DISTINCT lang) || ',"longest":' || max(length(text)) || '}' AS report FROM documents""")
def src_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10/11: one report row with sorted keys."""
    return table(spark, sf_dir, "documents").agg(F.to_json(F.struct(F.count("*").alias("documents"), F.countDistinct("lang").alias("languages"), F.max(F.char_length("text")).alias("longest"))).alias("report"))


@query(
    "src_journal",
    """WITH s AS (SELECT conv_id, turn, sum(octet_length(encode(text)) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations)
    SELECT conv_id, count(*) FILTER (WHERE used <= 2000) AS kept, count(*) FILTER (WHERE used > 2000) AS refused FROM s GROUP BY 1""",
)
def src_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-17: a journal takes rows until its bytes are used up, then no more."""
    used = F.sum(F.octet_length("text") + 1).over(W.partitionBy("conv_id").orderBy("turn"))
    s = turns(spark, sf_dir).select("conv_id", used.alias("used"))
    return s.groupBy("conv_id").agg(F.count_if(F.col("used") <= 2000).alias("kept"), F.count_if(F.col("used") > 2000).alias("refused"))


@query("src_remember", "SELECT left(text, 600) AS statement, source, min(doc_id) AS doc_id FROM documents d WHERE doc_id % 2 = 1 AND text <> '' AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 2 = 0 AND o.text = d.text AND o.source = d.source) GROUP BY text, source")
def src_remember(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-18: new facts (odd ids) that aren't known (even ids), one of each (whole statement, source); 600 characters are kept."""
    d = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.sha2("text", 256).alias("key"), F.left("text", F.lit(600)).alias("statement"), "source")
    new = d.where("doc_id % 2 = 1").join(d.where("doc_id % 2 = 0").select("key", "source"), ["key", "source"], "left_anti")
    return new.groupBy("key", "source").agg(F.min_by("statement", "doc_id").alias("statement"), F.min("doc_id").alias("doc_id")).drop("key")


@query("src_tasks", "SELECT i AS task, ['small', 'medium', 'large'][1 + ('0x' || substr(sha256(i::VARCHAR), 1, 6))::BIGINT % 3] AS size, 10 + ('0x' || substr(sha256(i::VARCHAR), 7, 6))::BIGINT % 90 AS width FROM (SELECT p_partkey AS i FROM part)")
def src_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-27: a task for each part, which follows from its number alone."""
    part = lambda at: F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), at, 6), 16, 10).cast("long")
    sizes = F.array(F.lit("small"), F.lit("medium"), F.lit("large"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).select(F.col("id").alias("task"), F.get(sizes, (part(1) % 3).cast("int")).alias("size"), (10 + part(7) % 90).alias("width"))


@query(
    "str_incremental",
    """WITH u AS (SELECT coalesce(source, 'none') AS unit, count(*) AS rows, sum(length(text))::BIGINT AS chars, bool_or(text IS NULL OR length(text) < 4) AS spoilt FROM documents GROUP BY 1)
    SELECT unit, 'complete' AS status, NULL AS reason, rows, CASE WHEN spoilt THEN 2 ELSE 1 END AS number, chars FROM u UNION ALL SELECT 'planned', 'skipped', 'no rows', 0, 1, NULL""",
)
def str_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-16, SRC-11: sources built in two runs; the first fails those with a text under four characters, the second
    does only these again, and none is built twice."""
    root = f"{shared_dir(spark)}/builds/{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("source", F.lit("none")).alias("source"))
    planned = d.select(F.col("source").alias("unit")).union(spark.createDataFrame([("planned",)], "unit string"))
    short = F.when(F.coalesce(F.char_length("text") < 4, F.lit(True)), "text under four characters")
    build.run(spark, root, d, "source", short, planned)
    build.run(spark, root, d, "source", F.lit(None).cast("string"), planned)
    chars = build.built(spark, root).groupBy(F.col("source").alias("unit")).agg(F.sum(F.char_length("text")).alias("chars"))
    return build.state(spark, root).select("unit", "status", "reason", "rows", "number").join(chars, "unit", "left")


@query(
    "str_snapshot",
    f"""WITH {EVENTS_SQL}, c AS (SELECT *, max((event_type = 'view')::INT) OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS read FROM e)
    SELECT user_id, count(*) AS missed, CASE WHEN count(*) > 2 THEN 'snapshot' ELSE 'events' END AS sent, CASE WHEN count(*) > 2 THEN 1 ELSE count(*) END AS messages, arg_max(k, (t, event_id)) AS state FROM c WHERE read = 0 GROUP BY 1""",
)
def str_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02: a reader (up to its last view) gets the events it missed, or beyond a bounded queue one snapshot of the state."""
    newest_first = W.partitionBy("user_id").orderBy(F.desc("t"), F.desc("event_id"))
    unread = events(spark, sf_dir).withColumn("read", F.max(F.col("event_type") == "view").over(newest_first)).where("not read")
    g = unread.groupBy("user_id").agg(F.count("*").alias("missed"), F.max_by("k", F.struct("t", "event_id")).alias("state"))
    late = F.col("missed") > 2
    return g.select("user_id", "missed", F.when(late, "snapshot").otherwise("events").alias("sent"), F.when(late, F.lit(1).cast("long")).otherwise(F.col("missed")).alias("messages"), "state")


@query("top_first_examples", "SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 4 ORDER BY source, doc_id LIMIT 30")
def top_first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-01/02/03: stable order, a prefix of each group, and an early stop (the feature's own limits)."""
    n = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    d = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", n.alias("n")).where("n <= 4")
    return d.orderBy("source", "doc_id").limit(30).drop("n")


@query("txt_messages", """SELECT conv_id, sha256('[{"role":"system","chars":6},' || string_agg('{"role":"' || role || '","chars":' || length(text) || '}', ',' ORDER BY turn) || ']') AS digest FROM conversations GROUP BY 1""")
def txt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-03/08/09: system message and turns as one array of messages."""
    message = F.struct("role", F.char_length("text").alias("chars"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"])
    g = turns(spark, sf_dir).groupBy("conv_id").agg(rows.alias("rows"))
    system = F.array(F.struct(F.lit("system").alias("role"), F.lit(6).alias("chars")))
    return g.select("conv_id", F.sha2(F.to_json(F.concat(system, "rows")), 256).alias("digest"))


@query("txt_supervised_spans", "SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS supervised, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def txt_supervised_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-11: spans that count in training, as positions in the joined text."""
    upto = F.sum(F.char_length("text")).over(W.partitionBy("conv_id").orderBy("turn"))
    s = turns(spark, sf_dir).select("conv_id", "role", (upto - F.char_length("text")).alias("start"), upto.alias("end"))
    return s.groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "assistant", F.col("end") - F.col("start")).otherwise(0)).alias("supervised"), F.max("end").alias("chars"))


REDIRECTED_SQL = """u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://duckduckgo.com/l/?kl=x&uddg=' || url_encode(url) WHEN 1 THEN 'https://www.bing.com/ck/a?u=a1' || rtrim(replace(replace(to_base64(encode(url)), '+', '-'), '/', '_'), '=') || '&n=1'
      WHEN 2 THEN 'https://www.bing.com/search?u=a1aHR0' ELSE url END AS raw, url FROM pages)"""


@query("txt_redirects", f"WITH {REDIRECTED_SQL} SELECT page_id, CASE WHEN page_id % 4 = 2 THEN raw ELSE url END AS target FROM u")
def txt_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-20: search engines' redirects unwrapped; the addresses are wrapped here in one of four ways by number."""
    url, by = F.col("url"), F.col("page_id") % 4
    coded = F.rtrim(F.translate(F.base64(F.encode(url, "UTF-8")), "+/\r\n", "-_"), F.lit("="))
    raw = (
        F.when(by == 0, F.concat(F.lit("https://duckduckgo.com/l/?kl=x&uddg="), F.url_encode(url)))
        .when(by == 1, F.concat(F.lit("https://www.bing.com/ck/a?u=a1"), coded, F.lit("&n=1")))
        .when(by == 2, F.lit("https://www.bing.com/search?u=a1aHR0"))
        .otherwise(url)
    )
    return table(spark, sf_dir, "pages").select("page_id", T.unwrapped(raw).alias("target"))


PUBLIC_CASES = ("", "//user@", "//10.1.2.3/", "//172.20.0.1/", "//8.8.8.8/", "//localhost/", "//box.local/", "//[::1]/", "//[2606:4700::1]/", "//a.example.org:8080/", "//a.example.org:443/")
PUBLIC_OK = ("", "//8.8.8.8/", "//[2606:4700::1]/")


@query(
    "txt_public_addresses",
    f"""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url, {list(PUBLIC_CASES)}[1 + page_id % {len(PUBLIC_CASES)}] AS c FROM pages)
    SELECT page_id, CASE WHEN c = '' THEN url WHEN c IN {PUBLIC_OK[1:]} OR c = '//a.example.org:443/' AND url LIKE 'https:%' THEN regexp_replace(regexp_replace(url, '//[^/]+/', c), ':443', '') END AS address FROM u""",
)
def txt_public_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-19: normal form of public addresses, null for what isn't one; by number the pages' hosts are swapped for odd ones."""
    case = F.get(F.array(*(F.lit(c) for c in PUBLIC_CASES)), (F.col("page_id") % len(PUBLIC_CASES)).cast("int"))
    odd = F.when(case == "", F.col("url")).when(case == "//user@", F.replace("url", F.lit("//"), F.lit("//user@"))).otherwise(F.regexp_replace(F.col("url"), F.lit("//[^/]+/"), case))
    return table(spark, sf_dir, "pages").select("page_id", T.public_address(odd).alias("address"))


@query(
    "txt_unsupported_numbers",
    """WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS number FROM documents), k AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]+')) AS number FROM documents WHERE doc_id % 10 = 0)
    SELECT doc_id, count(*) AS unsupported FROM s WHERE number NOT IN (SELECT number FROM k) GROUP BY 1""",
)
def txt_unsupported_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-24: numbers that no known text has."""
    d = table(spark, sf_dir, "documents")
    number = F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("number")
    known = d.where("doc_id % 10 = 0").select(number).distinct()
    return d.select("doc_id", number).join(known, "number", "left_anti").groupBy("doc_id").agg(F.count("*").alias("unsupported"))


@query(
    "txt_equivalent_actions",
    f"""WITH {EVENTS_SQL}, p AS (SELECT *, lag(event_type) OVER ({ALONG}) AS last_type, lag(k) OVER ({ALONG}) AS last_k FROM e)
    SELECT event_id, coalesce(event_type = last_type AND abs(k - last_k) <= 8, false) AS same FROM p""",
)
def txt_equivalent_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-30: equal kind, coordinates within eight grid units."""
    same = (F.col("event_type") == F.lag("event_type").over(along())) & (F.abs(F.col("k") - F.lag("k").over(along())) <= 8)
    return events(spark, sf_dir).select("event_id", F.coalesce(same, F.lit(False)).alias("same"))


@query("txt_control_terms", "SELECT source, count(*) AS n FROM documents WHERE regexp_matches(text, '(disgusting|worthless|trash)') OR contains(text, '<|') GROUP BY 1")
def txt_control_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-32: literal terms and control tokens."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").where(t.rlike("(disgusting|worthless|trash)") | F.contains(t, F.lit("<|"))).groupBy("source").agg(F.count("*").alias("n"))


@query(
    "geo_parameters",
    """WITH RECURSIVE p AS (SELECT p_brand AS design, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, p_size FROM part), r AS (SELECT design, n, p_size::BIGINT AS v FROM p WHERE n = 1
      UNION ALL SELECT p.design, p.n, (r.v * 3 + p.p_size) % 1009 FROM r JOIN p ON p.design = r.design AND p.n = r.n + 1)
    SELECT design, max(n) AS parameters, max_by(v, n) AS last_value FROM r GROUP BY 1""",
)
def geo_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-06: parameters in order, each from the one before; a design's parameters stream past."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("design"), "p_partkey", "p_size")
    return sequences.fold(p, ["design"], ["p_partkey"], Parameters, "design string, parameters long, last_value long")


class Parameters:
    """(n, value): the value of each parameter is formed from the one before and its own number."""

    def __init__(self):
        self.n, self.value = 0, 0

    def take(self, row) -> list[tuple]:
        self.n, self.value = self.n + 1, (self.value * 3 + int(row.p_size)) % 1009
        return []

    def end(self) -> list[tuple]:
        return [(self.n, self.value)]


@query(
    "geo_revisions",
    """WITH RECURSIVE a AS (SELECT o_custkey AS project, o_orderkey AS attempt, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
    x AS (SELECT *, greatest(0, i * 6 // 10 - (attempt % 4 = 0)::INT) AS expected FROM a),
    w AS (SELECT project, i, attempt, (expected = 0)::BIGINT AS head, expected = 0 AS won FROM x WHERE i = 1
      UNION ALL SELECT x.project, x.i, x.attempt, w.head + (x.expected = w.head)::BIGINT, x.expected = w.head FROM w JOIN x ON x.project = w.project AND x.i = w.i + 1)
    SELECT project, attempt, CASE WHEN won THEN 'r' || lpad(head::VARCHAR, 4, '0') END AS revision, CASE WHEN won AND head > 1 THEN 'r' || lpad((head - 1)::VARCHAR, 4, '0') END AS parent FROM w""",
)
def geo_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-08: logged attempts against the head that each had read; those that read another lose."""
    i = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("attempt"), i.cast("long").alias("at"))
    read = F.greatest(F.lit(0), F.expr("at * 6 div 10") - F.when(F.col("attempt") % 4 == 0, 1).otherwise(0))
    return ledger.replayed(a.withColumn("expected", read))


@query(
    "geo_ledger",
    """SELECT 'r' || lpad((row_number() OVER (ORDER BY o))::VARCHAR, 4, '0') AS id, CASE WHEN row_number() OVER (ORDER BY o) > 1 THEN 'r' || lpad((row_number() OVER (ORDER BY o) - 1)::VARCHAR, 4, '0') END AS parent, restored_from, name, rows FROM
    (SELECT r_regionkey AS o, NULL AS restored_from, r_name AS name, count(c_custkey) AS rows FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL
    UNION ALL SELECT 1000, 'r0001', arg_min(r_name, r_regionkey), (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = (SELECT min(r_regionkey) FROM region)) FROM region)""",
)
def geo_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-08: a table's revisions, one a region, each tried by two writers; the first restored at the end."""
    log = ledger.Ledger(spark, f"{shared_dir(spark)}/ledgers/{uuid.uuid4().hex}")
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "c_custkey", "c_name")
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        head = log.head()
        log.commit(customers.where(F.col("n_regionkey") == r["r_regionkey"]), head, r["r_name"])
        try:
            log.restore("r0001", head)
            raise AssertionError("two writers committed against one head")
        except ledger.Conflict:
            pass
    log.restore("r0001", log.head())
    return spark.createDataFrame(log.revisions(), "id string, parent string, restored_from string, name string, rows long")


@query("geo_checks", "SELECT p_brand, count(*) FILTER (WHERE p_size BETWEEN 10 AND 30) AS holes, max(p_size) - min(p_size) AS gap, bool_and(p_retailprice < 2500) AS bounds FROM part WHERE p_size / 50.0 > 0.2 GROUP BY 1")
def geo_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-09/14: counts, gaps and bounds of parts whose overlap passes a filter."""
    p = table(spark, sf_dir, "part").where(F.col("p_size") / 50.0 > 0.2)
    return p.groupBy("p_brand").agg(F.count_if(F.col("p_size").between(10, 30)).alias("holes"), (F.max("p_size") - F.min("p_size")).alias("gap"), F.bool_and(F.col("p_retailprice") < 2500).alias("bounds"))
