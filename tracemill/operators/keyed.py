"""Keyed operators: merges, reconciliation, leakage, retrieval."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.functions import text as T
from tracemill.storage import written

#: Rows of queries' tokens that may be broadcast.
MOST_BROADCAST = 1_000_000


def latest(d: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by one pre-aggregated max."""
    rest = [c for c in d.columns if c not in by]
    return d.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, *(F.col(f"_r.{c}").alias(c) for c in rest))


def upsert(old: DataFrame, new: DataFrame, by: list[str], order: str) -> DataFrame:
    """old and new rows merged by key: the last by (side, order) wins, the first position of the key stays."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    rest = [c for c in old.columns if c not in [*by, order]]
    place = F.struct("_side", order)
    return both.groupBy(*by).agg(F.min(place).alias("_p"), F.max_by(F.struct(*rest), place).alias("_r")).select(*by, F.col("_p._side").alias("side"), F.col(f"_p.{order}").alias(order), *(F.col(f"_r.{c}").alias(c) for c in rest))


def reconcile(left: DataFrame, right: DataFrame, by: str, value: str) -> DataFrame:
    """(key, status): lost, added, changed or same, from a full outer join of unique keys."""
    a, b = left.select(F.col(by).alias(by), F.col(value).alias("_a"), F.lit(True).alias("_in_a")), right.select(F.col(by).alias(by), F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    status = F.when(F.col("_in_b").isNull(), "lost").when(F.col("_in_a").isNull(), "added").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, by, "full_outer").select(by, status.alias("status"))


def leaks(d: DataFrame, group: str, split: str) -> DataFrame:
    """Groups whose members lie in two splits or more."""
    return d.groupBy(group).agg(F.array_join(F.sort_array(F.collect_set(split)), ",").alias("splits"), F.count("*").alias("n")).where(F.contains("splits", F.lit(",")))


def except_latest(all_rows: DataFrame, gone: DataFrame, content: str, order: str) -> DataFrame:
    """all_rows without, for each content, as many of its latest occurrences as `gone` has rows of it."""
    number = F.row_number().over(W.partitionBy(content).orderBy(F.desc(order)))
    counts = gone.groupBy(content).agg(F.count("*").alias("_gone"))
    numbered = all_rows.withColumn("_n", number).join(counts, content, "left")
    return numbered.where(F.col("_n") > F.coalesce("_gone", F.lit(0))).drop("_n", "_gone")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0)))


class Overlaps:
    """Texts that share tokens with queries, through an inverted index entered by each query's rarest tokens only.

    queries: (query_id, tokens); texts: (text_id, tokens) and, where titles count `heavy` times more, title, each an array
    of distinct tokens. A query whose rarest p tokens lead to no text can share at most its other tokens with it; so the
    prefix that a lower bound on the score calls for finds all texts that reach it, and the frequent tokens beyond are
    never joined. What is found is verified on both token lists.
    """

    def __init__(self, queries: DataFrame, texts: DataFrame, query_id: str, text_id: str, heavy: int = 0):
        self.query_id, self.text_id, self.heavy = query_id, text_id, heavy
        held = texts.select(F.col(text_id).alias("_d"), "tokens", *(["title"] if heavy else []))
        self.texts = written(held)
        self.asked = queries.select(F.col(query_id).alias("_q"), F.array_distinct("tokens").alias("wanted"))

    @cached_property
    def index(self) -> DataFrame:
        both = F.array_union("tokens", "title") if self.heavy else F.col("tokens")
        return self.texts.select("_d", F.explode(both).alias("token"))

    @cached_property
    def tokens(self) -> DataFrame:
        """Tokens that some text has, each query's rarest first; postings before and with each."""
        frequency = self.index.groupBy("token").agg(F.count("*").alias("df"))
        known = self.asked.select("_q", F.explode("wanted").alias("token")).join(frequency, "token")
        rare = W.partitionBy("_q").orderBy("df", "token")
        placed = known.withColumn("place", F.row_number().over(rare)).withColumn("postings", F.sum("df").over(rare.rowsBetween(W.unboundedPreceding, 0)))
        return written(placed.withColumn("size", F.count("*").over(W.partitionBy("_q"))))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        shared = F.size(F.array_intersect("wanted", "tokens"))
        if self.heavy:
            shared = shared + self.heavy * F.size(F.array_intersect("wanted", "title"))
        return pairs.join(self.asked, "_q").join(self.texts, "_d").select("_q", "_d", shared.cast("long").alias("score"))

    def _met(self, tokens: DataFrame) -> DataFrame:
        return tokens.select("_q", "token").join(self.index, "token").select("_q", "_d").distinct()

    def _prefix(self, score) -> Column:
        """Places that a text of that score can't miss: those beyond can't make it up, each at its heaviest."""
        return F.col("size") - F.ceil(score / F.lit(1 + self.heavy)) + 1

    def _counted(self, wanted: DataFrame) -> DataFrame:
        """(_q, _d, need, score) of all pairs with a shared token. wanted: (_q, _i, need, token), a row a query and token."""
        weighed = [F.transform("tokens", lambda t: F.struct(t.alias("token"), F.lit(1).cast("long").alias("weight")))]
        if self.heavy:
            weighed.append(F.transform("title", lambda t: F.struct(t.alias("token"), F.lit(self.heavy).cast("long").alias("weight"))))
        # dealt by _n: grouping by it and the query needs no other exchange
        parts = int(self.texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = self.texts.withColumn("_n", F.monotonically_increasing_id()).repartition(parts, "_n")
        held = dealt.select("_n", "_d", F.explode(F.concat(*weighed)).alias("_w")).select("_n", "_d", "_w.*")
        met = held.join(F.broadcast(wanted), "token")
        return met.groupBy("_n", "_i").agg(F.first("_q").alias("_q"), F.first("_d").alias("_d"), F.first("need").alias("need"), F.sum("weight").alias("score"))

    def _wanted(self, asked: DataFrame) -> DataFrame:
        return written(asked.withColumn("_i", F.monotonically_increasing_id()).select("_q", "_i", "need", F.explode("wanted").alias("token")))

    def at_least(self, need: DataFrame) -> DataFrame:
        """(query_id, text_id, score) with the score that need (query_id, need) asks of each query.

        Where the queries' tokens can be broadcast, scores are counted where the texts lie: each text is shuffled once by a
        number of its own and no pair is, however many there are.
        """
        needs = need.select(F.col(self.query_id).alias("_q"), "need")
        wanted = self._wanted(self.asked.join(needs, "_q"))
        if wanted.count() <= MOST_BROADCAST:
            found = self._counted(wanted).where("score >= need")
            return found.select(F.col("_q").alias(self.query_id), F.col("_d").alias(self.text_id), "score")
        tokens = self.tokens.join(needs, "_q").where(F.col("place") <= self._prefix(F.col("need")))
        found = self._verified(self._met(tokens)).join(needs, "_q").where("score >= need")
        return found.select(F.col("_q").alias(self.query_id), F.col("_d").alias(self.text_id), "score")

    def best(self, k: int, least: int = 1, postings: int = 256) -> DataFrame:
        """(query_id, text_id, score, rank): the k best of at least `least`, ties to the smaller text_id.

        Where the queries' tokens can be broadcast, scores are counted where the texts lie, and each task passes on k texts a
        query. Else a first look follows each query's rarest tokens up to a number of postings; the k-th score that it
        gives decides how many more tokens must be followed.
        """
        rank = F.row_number().over(W.partitionBy("_q").orderBy(F.desc("score"), "_d"))
        told = (F.col("_q").alias(self.query_id), F.col("_d").alias(self.text_id), "score", "rank")
        wanted = self._wanted(self.asked.withColumn("need", F.lit(least)))
        if wanted.count() <= MOST_BROADCAST:
            return self._counted(wanted).where("score >= need").withColumn("rank", rank).where(F.col("rank") <= k).select(*told)
        begun = (F.col("postings") <= postings) | (F.col("place") == 1)
        first = written(self._verified(self._met(self.tokens.where(begun))))
        bound = first.withColumn("rank", rank).where(F.col("rank") == k).select("_q", F.col("score").alias("kth"))
        open_ = self.tokens.where(~begun).join(bound, "_q", "left").where(F.col("place") <= self._prefix(F.greatest(F.coalesce("kth", F.lit(0)), F.lit(least))))
        new = self._met(open_).join(first.select("_q", "_d"), ["_q", "_d"], "left_anti")
        every = first.unionByName(self._verified(new)).where(F.col("score") >= least)
        return every.withColumn("rank", rank).where(F.col("rank") <= k).select(*told)


def ranked_matches(queries: DataFrame, texts: DataFrame, query_id: str, text_id: str, k: int, least: int = 2) -> DataFrame:
    """(query_id, text_id, shared, rank): the k texts that share most distinct tokens with each query."""
    told = lambda d, i: d.select(i, tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return Overlaps(told(queries, query_id), told(texts, text_id), query_id, text_id).best(k, least).withColumnRenamed("score", "shared")


def noted(topics: DataFrame, notes: DataFrame, most: int = 6000, k: int = 2) -> DataFrame:
    """(topic_id, note_id, rank, score, chars): the k notes that best fit each topic, title tokens counting three times
    more, and how many characters of each are within the topic's `most`. topics: (topic_id, text); notes: (note_id, title, text)."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    found = Overlaps(topics.select("topic_id", words("text").alias("tokens")), notes.select("note_id", words("text").alias("tokens"), words("title").alias("title")), "topic_id", "note_id", heavy=3).best(k)
    sized = found.join(notes.select("note_id", F.char_length("text").cast("long").alias("length")), "note_id")
    before = F.coalesce(F.sum("length").over(W.partitionBy("topic_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("chars", F.least("length", most - before)).where((F.col("rank") == 1) | (F.col("chars") > 0)).drop("length")


def quotes(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) of items (item_id, text) that docs (doc_id, text) hold verbatim as T.quoted says.

    A quote's opening, some characters without white space, finds the pages to compare: 24 of them, or four
    (no quote has fewer) for a quote under 24. Pages are cut at every character, so no opening is missed.
    """
    q = items.select("item_id", F.col("text").alias("quote"), T.bare(F.col("text")).alias("b")).where(F.char_length(T.folded(F.col("text"))) >= 6)
    pages, pairs = docs.select("doc_id", T.bare(F.col("text")).alias("b")), None
    for size, some in ((24, q.where(F.char_length("b") >= 24)), (4, q.where(F.char_length("b") < 24))):
        if not (n := some.count()):
            continue
        openings = some.select("item_id", F.left("b", F.lit(size)).alias("g"))
        cuts = F.regexp_extract_all("b", F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
        grams = pages.select("doc_id", F.explode(cuts).alias("g"))
        found = grams.join(F.broadcast(openings) if n < 100_000 else openings, "g").select("item_id", "doc_id")
        pairs = found if pairs is None else pairs.union(found)
    if pairs is None:
        return items.join(docs, F.lit(False)).select("item_id", "doc_id")
    texts = docs.select("doc_id", "text")
    return pairs.distinct().join(q.select("item_id", "quote"), "item_id").join(texts, "doc_id").where(T.quoted(F.col("quote"), F.col("text"))).select("item_id", "doc_id")


def merged(base: str | Column, own: str | Column, depth: int) -> Column:
    """base with own's entries over it; maps that both sides hold are merged down to `depth` levels, other values replaced."""
    base, own = (F.col(m) if isinstance(m, str) else m for m in (base, own))
    inner = (lambda k, a, b: F.coalesce(b, a)) if depth == 1 else (lambda k, a, b: merged(a, b, depth - 1))
    return F.when(base.isNull(), own).when(own.isNull(), base).otherwise(F.map_zip_with(base, own, inner))


def citations(answers: DataFrame, sources: DataFrame, answer_id: str) -> DataFrame:
    """(answer_id, id, place, evidence): sources (id, opened) that answers (answer_id, text) cite as [id], each at its first place."""
    ids = F.array_distinct(F.regexp_extract_all("text", F.lit("\\[(web_[a-f0-9]{12})\\]"), F.lit(1)))
    cited = answers.select(answer_id, F.posexplode(ids).alias("place", "id"))
    evidence = F.when(F.col("opened"), "opened").otherwise("discovered")
    return cited.join(sources, "id").select(answer_id, "id", (F.col("place") + 1).alias("place"), evidence.alias("evidence"))
