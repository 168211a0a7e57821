"""Queries over search results and images: budgets, header sizes and crops of crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions import budget
from tracemill.functions import scalars as S
from tracemill.operators import lineage
from tracemill.operators.links import A_NAME, A_PDF, A_WORD, PLAIN, TECHNICAL, ranked_links
from tracemill.plans.registry import query
from tracemill.sources import images
from tracemill.sources.tables import EVENTS_SQL, events, turns
from tracemill.storage import table


def results_of(said: DataFrame) -> DataFrame:
    """(conv_id, result): each dialogue as a search result, a turn a source."""
    text = F.coalesce("text", F.lit(""))
    source = F.struct(
        "turn",
        F.substring_index(text, "\n", 1).alias("title"),
        F.substring(text, 1, 2000).alias("snippet"),
        text.alias("text"),
        F.split(F.substring(text, 1, 90), " ").alias("headings"),
    )
    sources = F.transform(F.array_sort(F.collect_list(source)), lambda s: s.dropFields("turn"))
    return said.groupBy("conv_id").agg(F.to_json(F.struct(F.lit("web_search").alias("operation"), sources.alias("sources"), F.concat_ws(",", F.array_sort(F.collect_list("role"))).alias("diagnostics"))).alias("result"))


@query("txt_bounded_results")
def txt_bounded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-22: dialogues as search results, each within 1,200 characters."""
    cut = results_of(turns(spark, sf_dir)).select("conv_id", budget.bounded(F.col("result"), 1200).alias("result"))
    told = F.from_json(F.get_json_object("result", "$.truncation"), "original_characters long, omitted_sources long, shortened_fields array<string>")
    return cut.select("conv_id", F.char_length("result").alias("chars"), told.alias("told"), "result").select("conv_id", "chars", "told.*", "result")


#: Headers made of orders: a PNG, or a JPEG with an application segment, of one frame kind of three; some are cut off or
#: of another format.
IMAGE_HEADS = """CASE WHEN o_orderkey % 17 = 0 THEN cast('GIF89a' AS binary)
    WHEN o_orderkey % 3 = 0 THEN substr(unhex(concat('89504E470D0A1A0A0000000D49484452', lpad(hex(w), 8, '0'), lpad(hex(h), 8, '0'), '0802000000')), 1, CASE WHEN o_orderkey % 19 = 0 THEN 20 ELSE 99 END)
    ELSE unhex(concat('FFD8FFE0', lpad(hex(n + 2), 4, '0'), repeat('C0', n), 'FFDB000400', CASE WHEN o_orderkey % 19 = 0 THEN '00D9' ELSE concat('00FFC', o_orderkey % 3, '001108', lpad(hex(h), 4, '0'), lpad(hex(w), 4, '0'), '03') END)) END"""
IMAGE_SIZES = {"w": "64 + o_custkey * 7 % 4000", "h": "64 + o_orderkey * 13 % 3000", "n": "cast(o_orderkey * 31 % 900 AS int)"}


@query(
    "src_image_sizes",
    f"""WITH s AS (SELECT o_orderkey AS image_id, {", ".join(f"{rule} AS {name}" for name, rule in IMAGE_SIZES.items())} FROM orders),
    p AS (SELECT *, CASE WHEN image_id % 17 = 0 THEN 'unsupported image format' WHEN image_id % 19 = 0 THEN CASE WHEN image_id % 3 = 0 THEN 'malformed PNG' ELSE 'malformed JPEG' END END AS problem FROM s),
    q AS (SELECT *, CASE WHEN problem IS NULL THEN w END AS width, CASE WHEN problem IS NULL THEN h END AS height, greatest(32.0, round_even(h / 32.0, 0) * 32) AS hb, greatest(32.0, round_even(w / 32.0, 0) * 32) AS wb, sqrt(h * w / 1048576.0) AS dn, sqrt(65536.0 / (h * w)) AS up FROM p)
    SELECT image_id, width, height, problem, CASE WHEN problem IS NULL THEN (CASE WHEN hb * wb > 1048576 THEN greatest(32.0, floor(h / dn / 32.0) * 32) WHEN hb * wb < 65536 THEN ceil(h * up / 32.0) * 32 ELSE hb END / 32.0 *
      (CASE WHEN hb * wb > 1048576 THEN greatest(32.0, floor(w / dn / 32.0) * 32) WHEN hb * wb < 65536 THEN ceil(w * up / 32.0) * 32 ELSE wb END / 32.0))::BIGINT END AS tokens FROM q""",
)
def src_image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14, SCL-17: sizes read from the headers of images, and the tokens of the readable ones."""
    made = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", *(f"{rule} AS {name}" for name, rule in IMAGE_SIZES.items()))
    read = made.selectExpr("o_orderkey AS image_id", f"{IMAGE_HEADS} AS content").select("image_id", images.size_of(F.col("content")).alias("s")).select("image_id", "s.*")
    return read.withColumn("tokens", F.when(F.col("problem").isNull(), S.image_tokens(F.col("width"), F.col("height"))))


#: Each event as an image: an original, or a crop of an earlier image of the user; a few of a later one, of none, or a copy.
CROPPED = {
    "parent_id": "CASE WHEN k < 8 OR k = 97 AND later IS NULL THEN NULL WHEN k = 97 THEN later WHEN k = 98 THEN -1 - event_id ELSE earlier END",
    "width": "600 + k * 30",
    "height": "400 + k * 20",
    "shown_width": "CASE WHEN k % 3 = 0 THEN 300 + k * 15 ELSE 600 + k * 30 END",
    "shown_height": "CASE WHEN k % 3 = 0 THEN 200 + k * 10 ELSE 400 + k * 20 END",
    "l": "k * 3",
    "t": "k - 9",
    "r": "CASE WHEN k = 60 THEN 5 ELSE 9 * k + 40 END",
    "b": "4 * k + 30",
}
AROUND = "OVER (PARTITION BY user_id ORDER BY t, event_id)"


@query(
    "join_crop_lineage",
    f"""WITH RECURSIVE {EVENTS_SQL}, a AS (SELECT event_id, k, lag(event_id) {AROUND} AS earlier, lead(event_id) {AROUND} AS later FROM e),
    v AS (SELECT event_id AS image_id, k, {", ".join(f"{rule} AS {name}" for name, rule in CROPPED.items())} FROM a),
    m AS (SELECT *, width::DOUBLE / shown_width AS sx, height::DOUBLE / shown_height AS sy FROM v),
    p AS (SELECT *, greatest(0, least(round_even(l * sx, 0)::BIGINT, width - 1)) AS pl, greatest(0, least(round_even(t * sy, 0)::BIGINT, height - 1)) AS pt FROM m),
    q AS (SELECT *, greatest(pl + 1, least(round_even(r * sx, 0)::BIGINT, width)) AS pr, greatest(pt + 1, least(round_even(b * sy, 0)::BIGINT, height)) AS pb FROM p),
    i AS (SELECT image_id, parent_id, CASE WHEN k % 11 <> 0 THEN concat_ws(',', pl, pt, pr, pb) || CASE WHEN greatest(pr - pl, pb - pt) < 1000 THEN ' x' || least(4, ceil(1000.0 / greatest(pr - pl, pb - pt)))::INT ELSE ' x1' END END AS crop
      FROM q WHERE k % 11 = 0 OR r > l AND b > t AND pr - pl >= 2 AND pb - pt >= 2),
    w AS (SELECT image_id, coalesce(parent_id, image_id) AS original_id, (parent_id IS NOT NULL)::INT::BIGINT AS depth, CASE WHEN parent_id IS NOT NULL AND crop IS NOT NULL THEN [crop] ELSE []::VARCHAR[] END AS crops,
        CASE WHEN parent_id IS NOT NULL THEN 'missing' END AS problem FROM i WHERE parent_id IS NULL OR parent_id NOT IN (SELECT image_id FROM i)
      UNION ALL SELECT i.image_id, w.original_id, w.depth + 1, CASE WHEN i.crop IS NULL THEN w.crops ELSE list_append(w.crops, i.crop) END, w.problem FROM w JOIN i ON i.parent_id = w.image_id)
    SELECT image_id, original_id, depth, array_to_string(crops, ';') AS crops, problem FROM w
    UNION ALL SELECT image_id, NULL, NULL, NULL, 'cycle' FROM i WHERE image_id NOT IN (SELECT image_id FROM w)""",
)
def join_crop_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-25: images cut from images, back to their originals; crops in pixels of the image before."""
    along = W.partitionBy("user_id").orderBy("t", "event_id")
    around = events(spark, sf_dir).select("event_id", "k", F.lag("event_id").over(along).alias("earlier"), F.lead("event_id").over(along).alias("later"))
    made = around.selectExpr("event_id AS image_id", "k", *(f"{rule} AS {name}" for name, rule in CROPPED.items()))
    placed = lineage.placed_crop(F.array("l", "t", "r", "b"), F.col("width"), F.col("height"), F.col("shown_width"), F.col("shown_height"))
    kept = made.withColumn("at", placed).where("k % 11 = 0 or at is not null")
    crop = F.when(F.col("k") % 11 != 0, F.concat(F.array_join("at", ","), F.lit(" x"), lineage.enlargement(F.col("at"))))
    traced = lineage.lineage(kept.select("image_id", "parent_id", crop.alias("crop")))
    return traced.withColumn("crops", F.array_join("crops", ";"))


#: An address and a title of each link, and a page's title as what is looked for.
LINK, TITLE = '<a href="([^"]*)"[^>]*>([^<]*)</a>', "<title>([^<]*)</title>"


@query(
    "txt_ranked_links",
    f"""WITH p AS (SELECT page_id, list_distinct(list_filter(regexp_extract_all(lower(regexp_extract(html, '{TITLE}', 1) || ' ' || url), '[\\p{{L}}\\p{{N}}_.-]{{3,}}'), lambda w: w NOT IN {PLAIN})) AS words,
      regexp_extract_all(html, '{LINK}', 1) AS urls, regexp_extract_all(html, '{LINK}', 2) AS titles FROM pages),
    l AS (SELECT page_id, words, unnest(range(len(urls))) AS place, unnest(urls) AS url, unnest(titles) AS title FROM p),
    t AS (SELECT *, lower(title || '  ' || url) AS told FROM l),
    s AS (SELECT *, {A_WORD} * len(list_filter(words, lambda w: contains(told, w))) + CASE WHEN regexp_matches(told, '{TECHNICAL}') THEN {A_NAME} ELSE 0 END + CASE WHEN contains(told, '.pdf') THEN {A_PDF} ELSE 0 END AS score FROM t),
    b AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY score DESC, place) = 1)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, place)::INT AS rank, left(title, 100) AS title, NULL::VARCHAR AS section, url, score::BIGINT AS score FROM b QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, place) <= 12""",
)
def txt_ranked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-16: each page's links that best fit its title and address."""
    pages = table(spark, sf_dir, "pages")
    found = [F.regexp_extract_all("html", F.lit(LINK), F.lit(k)).alias(name) for k, name in ((1, "url"), (2, "title"))]
    links = pages.select("page_id", F.posexplode(F.arrays_zip(*found)).alias("place", "_l")).select("page_id", "place", "_l.url", "_l.title", F.lit("").alias("context"))
    focus = pages.select("page_id", F.concat_ws(" ", F.regexp_extract("html", TITLE, 1), "url").alias("text"))
    return ranked_links(links, focus, "page_id")
