"""Spelling variants by pairless wildcard groups.

A word with one place left open is a key: the letters before the place, a mark, the letters after it. Words with the
same key differ at that place only, so a group's size less one is each member's number of near words by replacement
there, and its two most frequent words are enough to name every member's best: the first, or the second for the first
itself. No group has more words than the alphabet has letters. For insertions and deletions each word's results of
deleting one letter are joined with the vocabulary: a match is a near word of both sides, at most one for each letter of
the longer. Group figures, matches and the vocabulary are then combined by word in one aggregation; pairs of a group are
never formed.

Forms are followed to the last by pointer doubling: a form is at least ten times as frequent as its word, so chains are
no longer than the decimal digits of the largest count.

All DataFrame functions. Occurrences are aggregated before they are shuffled, so a word that holds a third of all
occurrences is one row of each task. Keys of groups and deletions grow with the vocabulary, not with the text.

Defined results: a null or empty text has no words; a null doc_id counts as an empty one in the checksum; repeated rows
count each; equal counts are ordered by code points; an empty table gives no rows. Extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.storage import kept_at, removed, written

#: Runs of ASCII letters and of Latin-1 from U+00C0 on; the pattern takes runs of LEAST or more.
LETTERS, LEAST = "A-Za-zÀ-ÿ", 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of the runs, those whose checksum EVERY divides lose a letter.
EVERY = 31
OCCURRENCES, TIMES = 2, 10
#: Stands for the open place of a key; no letter.
OPEN = "*"


def without(word: Column, at: Column) -> Column:
    """The word without its letter at a place, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def occurrences(docs: DataFrame, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """(word): runs of at least `least` letters in lower case, those with a checksum that `every` divides less one letter."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTERS}]{{{least},}}+"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))
    marked = each.select("run", h.alias("h"))
    cut = without(F.col("run"), (F.col("h") % F.char_length("run")).cast("int"))
    return marked.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least)


def vocabulary(words: DataFrame, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words that occur often enough."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def _best(n: Column, word: Column) -> Column:
    """Least for the largest n, then for the smallest word."""
    return F.struct((-n).alias("less"), word.alias("word"))


def _places(word: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), F.char_length(word) - 1))


def replacements(vocab: DataFrame) -> DataFrame:
    """(word, near, best): near words that differ at one place, from that place's group."""
    placed = vocab.select("word", "n", _places(F.col("word")).alias("at"))
    start = F.substring(F.col("word"), F.lit(1), F.col("at"))
    key = F.concat(start, F.lit(OPEN), F.substring(F.col("word"), F.col("at") + 2, F.char_length("word")))
    keyed = placed.select(key.alias("key"), "word", "n")
    ordered = W.partitionBy("key").orderBy(F.desc("n"), "word")
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    top = lambda k: F.nth_value(_best(F.col("n"), F.col("word")), k).over(whole)
    told = keyed.select("word", (F.count("*").over(whole) - 1).alias("near"), F.row_number().over(ordered).alias("rank"), top(1).alias("first"), top(2).alias("second"))
    return told.where("near > 0").select("word", "near", F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("first")).alias("best"))


def indels(vocab: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, near, best): near words with one letter more or less, one row for each side of a match."""
    word = F.col("word")
    # equal letters in a row give the same word: only the first of them is deleted
    first = F.substring(word, F.col("at") + 1, F.lit(1)) != F.substring(word, F.col("at"), F.lit(1))
    longer = vocab.where(F.char_length("word") > least).select("word", "n", _places(word).alias("at")).where((F.col("at") == 0) | first)
    short = longer.select(without(word, F.col("at")).alias("shorter"), F.col("word").alias("longer"), F.col("n").alias("longer_n"))
    met = short.join(vocab.select(F.col("word").alias("shorter"), F.col("n").alias("shorter_n")), "shorter")
    side = lambda a, b: F.struct(F.col(a).alias("word"), _best(F.col(f"{b}_n"), F.col(b)).alias("best"))
    both = met.select(F.explode(F.array(side("shorter", "longer"), side("longer", "shorter"))).alias("_s"))
    return both.select("_s.word", F.lit(1).cast("long").alias("near"), "_s.best")


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends, by pointer doubling; no cycles."""
    at, path = kept_at(links.select("word", F.col("form").alias("root")))
    while True:
        after = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved, now = kept_at(at.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        removed(links.sparkSession, path)
        at, path = moved.select("word", "root"), now
        if moved.where("moved").isEmpty():
            return at


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the vocabulary."""
    vocab = written(vocabulary(occurrences(docs)))
    nothing = vocab.select("word", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<less:long, word:string>").alias("best"), "n")
    told = replacements(vocab).unionByName(indels(vocab)).withColumn("n", F.lit(None).cast("long")).unionByName(nothing)
    words = told.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    chosen = -F.col("best.less") >= TIMES * F.col("n")
    only = lambda c: F.when(chosen, c)
    formed = written(words.select("word", only(F.col("best.word")).alias("form"), "n", "n_near", only(-F.col("best.less")).alias("form_n")))
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
