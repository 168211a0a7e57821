"""Links of pages by how far they promise to answer what is looked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words that say nothing, what technical documents are called, points a word, such a name and a PDF.
PLAIN = ("the", "and", "for", "with", "pdf", "link", "url")
TECHNICAL = "drawing|datasheet|dimension|spec|mechanical|\\.pdf|download|technical|step|dxf|schematic|footprint"
A_WORD, A_NAME, A_PDF = 2, 3, 2


def asked(text: Column) -> Column:
    """The distinct words of three characters or more that a focus names, in lower case."""
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_.-]{3,}"), F.lit(0)), F.array(*map(F.lit, PLAIN)))


def ranked_links(links: DataFrame, focus: DataFrame, by: str, most: int = 12) -> DataFrame:
    """(by, rank, title, section, url, score): the `most` best links (by, place, title, context, url) for each focus (by, text).

    A link scores by focus words that its title, context or address holds, by technical names and PDFs; without a point
    it goes. Ties keep their places; of links to one address the best stays. Titles are cut to 100 characters, contexts
    to 80. Null titles and contexts are empty. One exchange: both windows are of the focus's key, so a page of many
    links is sorted on disk, not held.
    """
    told = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("context", F.lit("")), F.coalesce("url", F.lit(""))))
    named = F.size(F.filter("_words", lambda w: F.contains("_told", w))) * A_WORD
    score = named + F.when(F.col("_told").rlike(TECHNICAL), A_NAME).otherwise(0) + F.when(F.contains("_told", F.lit(".pdf")), A_PDF).otherwise(0)
    met = links.join(focus.select(by, asked(F.coalesce("text", F.lit(""))).alias("_words")), by)
    scored = met.withColumn("_told", told).withColumn("score", score.cast("long")).where("score > 0")
    best = F.row_number().over(W.partitionBy(by, "url").orderBy(F.desc("score"), "place"))
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), "place"))
    first = scored.repartition(by).withColumn("_best", best).where("_best = 1").withColumn("rank", rank).where(F.col("rank") <= most)
    section = F.when(F.col("context") != "", F.substring("context", 1, 80))
    return first.select(by, "rank", F.substring(F.coalesce("title", F.lit("")), 1, 100).alias("title"), section.alias("section"), "url", "score")
