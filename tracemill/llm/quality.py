"""Quality rules with robust multivariate outliers (minimum covariance determinant), in DataFrame functions only.

Base counts are taken of every whole text. Documents that pass the base rules give a vector of four
transformed statistics: mean word length, symbols, repeated lines and repeated words. For each language
and source the minimum-covariance-determinant estimate is found by concentration steps from two starts: each step
takes the share COVER of the group's documents that lie nearest by the current Mahalanobis distance and estimates
centre and covariance anew from them; the start that ends with the smaller determinant is kept, and a last step
reweights. A document is rejected if a distance as large as its own has a probability below ALPHA, the number
of documents behind the estimate considered. Each step draws a group's estimate to its language's, and a language's to
that of all documents, as if PRIOR documents of the larger group belonged to it: an estimate of few documents is close to
the larger group's, one of many is its own, and there is no size at which the rule changes. A group takes the whole
part of its share, so that a lone document has no say in its own estimate.

Documents are first counted by (language, source, vector); a step is one aggregation of these counts by (group,
distance bin), so a group of any size is pre-aggregated before it is shuffled. Statistics are whole numbers (1/SCALE
units), so sums and verdicts don't depend on the order of rows.

Defined results: a null text has no words and fails the base rules; null lang and null source are groups
of their own; repeated rows count and are judged one by one; without any document that passes the base
rules nothing is estimated; where even all documents are too few for the distribution (five or fewer taken), only
the base rules judge; in an empty table there are no rows. Extra columns of the input don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.llm.batches import whole_row
from tracemill.storage import checkpointed, written

MIN_WORDS, WINDOW, MOST_REPEATED_PERCENT = 10, 5, 20
#: Documents of the next larger group that count towards an estimate, where it has so many more.
PRIOR = 20
COVER, REWEIGHT, STEPS = 0.75, 0.975, 5
#: Probability of a distance below which a document is rejected.
ALPHA = 1e-6
SCALE = 256
#: Least deviation of each statistic (the earlier ones given), so that statistics that are the same for most
#: documents don't turn small differences into outliers.
FLOORS = (0.06, 0.25, 0.35, 0.35)
#: Pseudo-counts that draw the statistics of short documents to what is usual.
PSEUDO_WORDS, PSEUDO_LINES, USUAL_LENGTH = 50, 10, 5
#: Groups whose estimates may be broadcast (a row of some 200 bytes each); beyond, rows are joined by shuffle.
MOST_BROADCAST = 20_000
BINS_PER_OCTAVE = 16
DIMS = range(len(FLOORS))
SPACE = "[\\x20\\x09-\\x0D]+"


def counted(docs: DataFrame) -> DataFrame:
    """docs with a struct column `_q` of the base counts (n_words, word_chars, ...) of each whole text."""
    text = F.coalesce("text", F.lit(""))
    spaces, symbols = " \t\n\x0b\x0c\r", "#*$%&|<>"
    d = docs.withColumn("_words", F.array_remove(F.split(text, SPACE), ""))
    d = d.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    d = d.withColumn("_n", F.size("_words"))
    starts = F.when(F.col("_n") >= WINDOW, F.sequence(F.lit(0), F.col("_n") - WINDOW)).otherwise(F.array().cast("array<int>"))
    # single elements are read in place, a slice would copy the array
    d = d.withColumn("_windows", F.transform(starts, lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(WINDOW)))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    d = d.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("_again", F.sort_array(F.transform(F.filter("_sorted", _has_twin), lambda x: x["i"])))
    covered = F.aggregate(
        "_again",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("words")),
        lambda a, i: F.struct(i.alias("last"), (a["words"] + F.least(F.lit(WINDOW), i - a["last"])).alias("words")),
    )["words"]
    repeated = F.coalesce(covered, F.lit(0).cast("long"))
    n = F.col("_n").cast("long")
    q = F.struct(
        n.alias("n_words"),
        F.char_length(F.translate(text, spaces, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, symbols, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n)).alias("base_failed"),
    )
    return d.withColumn("_q", q).drop("_words", "_lines", "_n", "_windows", "_sorted", "_again")


def _has_twin(x: Column, k: Column) -> Column:
    """Whether a neighbour in the sorted array has the same window; beyond its ends there is none."""
    return F.coalesce(F.get("_sorted", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_sorted", k + 1)["h"] == x["h"], F.lit(False))


def statistics(q: str = "_q") -> list[Column]:
    """The four transformed statistics as whole numbers of 1/SCALE."""
    c = lambda name: F.col(f"{q}.{name}")
    words = c("n_words") + PSEUDO_WORDS
    values = (
        F.log((c("word_chars") + USUAL_LENGTH * PSEUDO_WORDS) / words),
        F.log1p(100 * c("n_symbols") / words),
        F.log1p(10 * c("n_dup_lines") / (c("n_lines") + PSEUDO_LINES)),
        F.log1p(10 * c("n_repeat_words") / words),
    )
    return [F.round(SCALE * v).cast("long") for v in values]


def _keys() -> list[Column]:
    """A row's groups, finest first, as strings that differ for different groups (nulls included)."""
    levels = (["lang", "source"], ["lang"], [])
    return [F.to_json(F.struct(F.lit(k).alias("level"), *cols)) for k, cols in enumerate(levels)]


def _share_below(x: float, k: int) -> float:
    """Distribution function of chi-square with an even number k of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def _quantile(p: float, k: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _share_below(middle, k) < p else (low, middle)
    return low


def _consistent(p: float) -> float:
    """Factor by which the covariance of the innermost share p of a normal sample is too small."""
    k = len(FLOORS)
    return p / _share_below(_quantile(p, k), k + 2)


SQUARES = [(i, j) for i in DIMS for j in range(i + 1)]
TOTALS = [f"sum(n * x{i}) as s{i}" for i in DIMS] + [f"sum(n * x{i} * x{j}) as s{i}{j}" for i, j in SQUARES]
SUMS = [f"s{i}" for i in DIMS] + [f"s{i}{j}" for i, j in SQUARES]
FOUND = [f"m{i}" for i in DIMS] + [f"l{i}{j}" for i, j in SQUARES]


def _factored(stats: DataFrame, *by: str, factor: float, prior: DataFrame | None = None) -> DataFrame:
    """(by, n, w, m0.., l00..): centres and Cholesky factors from (by, n, w, s*, s**), w documents summed. No
    pivot (the deviation of a statistic, the earlier ones given) is less than its floor. prior: (by, pw, pm0.., pl00..),
    the next larger group's estimate; w then counts the documents that it adds."""
    if prior is None:
        d = stats.selectExpr("*", "0.0D as pw", *(f"0.0D as pm{i}" for i in DIMS), *(f"0.0D as pl{i}{j}" for i, j in SQUARES))
    else:
        d = stats.join(prior, [*by], "left").na.fill(0.0, ["pw", *(f"pm{i}" for i in DIMS), *(f"pl{i}{j}" for i, j in SQUARES)])
    d = d.withColumn("v", F.least(F.lit(float(PRIOR)), F.greatest(F.col("pw") - F.col("w"), F.lit(0.0)))).withColumn("all", F.nullif(F.col("w") + F.col("v"), F.lit(0.0)))
    d = d.selectExpr("*", *(f"(s{i} + v * pm{i}) / all as m{i}" for i in DIMS))
    low = []  # each row of the factor refers to the ones before it
    for i, j in SQUARES:
        own = f"coalesce(s{i} * s{j} / nullif(w, 0), 0.0D)"
        larger = " + ".join(f"pl{i}{k} * pl{j}{k}" for k in range(j + 1))
        rest = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        c = f"({factor!r}D * (s{i}{j} - {own}) + {own} + v * ({larger} + pm{i} * pm{j})) / all - m{i} * m{j}{rest}"
        low.append(f"sqrt(greatest({c}, {(FLOORS[i] * SCALE) ** 2!r}D)) as l{i}{j}" if i == j else f"({c}) / l{j}{j} as l{i}{j}")
    return checkpointed(d.selectExpr(*by, "n", "all as w", *(f"m{i}" for i in DIMS), *low))


def _larger(found: DataFrame, parents: DataFrame, few: bool, *by: str) -> DataFrame:
    """(by, pw, pm0.., pl00..): for each key the estimate of the key above it. parents: (key, parent)."""
    up = found.select(F.col("key").alias("parent"), *(c for c in by if c != "key"), F.col("w").alias("pw"), *(F.col(c).alias(f"p{c}") for c in FOUND))
    return parents.join(_sided(up, few), "parent").drop("parent")


def _distance(d: DataFrame, of: str = "") -> DataFrame:
    """Adds d2, the squared Mahalanobis distance of x0.. from the estimate in the same row."""
    z = [f"(x{i} - {of}m{i}{''.join(f' - {of}l{i}{k} * _z{k}' for k in range(i))}) / {of}l{i}{i} as _z{i}" for i in DIMS]
    squared = " + ".join(f"_z{i} * _z{i}" for i in DIMS)
    return d.selectExpr("*", *z, f"{squared} as d2").drop(*(f"_z{i}" for i in DIMS))


def _bin(d2: Column) -> Column:
    return F.floor(BINS_PER_OCTAVE * F.log2(1 + d2)).cast("int")


def _sided(estimates: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(estimates) if few else estimates


def _step(spread: DataFrame, estimates: DataFrame, few: bool, *by: str, reweight: bool = False) -> DataFrame:
    """One concentration step: sums over the nearest share COVER of each group's documents, the bin that the share
    ends in with the part that is missing; reweight: also all within the normal quantile REWEIGHT. The share is rounded
    down, but up for all documents, which no larger group helps out."""
    placed = _distance(spread.join(_sided(estimates.drop("n", "w"), few), "key")).withColumn("bin", _bin(F.col("d2")))
    binned = placed.groupBy(*by, "bin").agg(F.expr("sum(n) as w"), *map(F.expr, TOTALS))
    below = F.sum("w").over(W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) - F.col("w")
    total = F.sum("w").over(W.partitionBy(*by))
    wanted = F.when(F.col("key") == _keys()[2], F.ceil(COVER * F.col("n"))).otherwise(F.floor(COVER * F.col("n")))
    share = (wanted - F.col("below")) / F.col("w")
    if reweight:
        share = F.when(F.col("bin") <= int(BINS_PER_OCTAVE * math.log2(1 + _quantile(REWEIGHT, len(FLOORS)))), 1.0).otherwise(share)
    chosen = binned.withColumn("below", below).withColumn("n", total).withColumn("part", F.greatest(F.lit(0.0), F.least(share, F.lit(1.0))))
    # whole bins add up in whole numbers, so the order of rows doesn't matter; one bin at most is taken in part
    add = "coalesce(sum({0}) filter (where part = 1), 0) + coalesce(max(part * {0}) filter (where part > 0 and part < 1), 0.0D) as {0}"
    return chosen.groupBy(*by).agg(F.expr("max(n) as n"), *(F.expr(add.format(c)) for c in ("w", *SUMS)))


def _starts(spread: DataFrame) -> DataFrame:
    """(key, start, n, w, sums): what the concentration starts from. 0: coordinate-wise medians and quartile
    distances, from counts of equal values; 1: the mean and covariance of the whole group."""
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("x")) for i in DIMS))).alias("v")
    counts = spread.select("key", "n", values).groupBy("key", "v.i", "v.x").agg(F.sum("n").alias("w"))
    by = W.partitionBy("key", "i")
    ranked = counts.withColumn("upto", F.sum("w").over(by.orderBy("x"))).withColumn("n", F.sum("w").over(by))
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("n"), F.col("x")))
    parts = ranked.groupBy("key", "i").agg(F.max("n").alias("n"), at(0.5).alias("m"), ((at(0.75) - at(0.25)) / 1.349).alias("s"))
    one = lambda name, i: F.max(F.when(F.col("i") == i, F.col(name)))
    wide = parts.groupBy("key").agg(F.max("n").alias("n"), *(one("m", i).alias(f"m{i}") for i in DIMS), *(one("s", i).alias(f"d{i}") for i in DIMS))
    second = [(F.col(f"m{i}") * F.col(f"m{j}") + (F.col(f"d{i}") * F.col(f"d{i}") if i == j else 0.0)).alias(f"s{i}{j}") for i, j in SQUARES]
    medians = wide.select("key", F.lit(0).alias("start"), "n", F.lit(1.0).alias("w"), *(F.col(f"m{i}").cast("double").alias(f"s{i}") for i in DIMS), *second)
    totals = spread.groupBy("key").agg(F.expr("sum(n) as n"), F.expr("cast(sum(n) as double) as w"), *map(F.expr, TOTALS))
    means = totals.selectExpr("key", "n", "w", *(f"cast({c} as double) as {c}" for c in SUMS))
    return medians.unionByName(means.withColumn("start", F.lit(1)))


def estimates(rows: DataFrame) -> DataFrame:
    """(group, n, w, m0.., l00..): the estimate that each language and source is judged by. rows: lang, source, x0..
    of documents that passed the base rules.

    All languages and sources, all languages and all documents are estimated side by side; each step draws on what the
    step before found for the larger group.
    """
    xs = [f"x{i}" for i in DIMS]
    names = [k.alias(f"k{level}") for level, k in enumerate(_keys())]
    vectors = checkpointed(rows.groupBy("lang", "source", *xs).agg(F.count("*").alias("n")).select(*names, *xs, "n"))
    groups = checkpointed(vectors.select("k0", "k1", "k2").distinct())
    few = groups.count() <= MOST_BROADCAST
    parents = groups.select(F.col("k0").alias("key"), F.col("k1").alias("parent")).union(groups.select("k1", "k2")).distinct()
    larger = [vectors.select(F.col(f"k{level}").alias("key"), *xs, "n") for level in range(3)]
    spread = checkpointed(larger[0].unionByName(larger[1].unionByName(larger[2]).groupBy("key", *xs).agg(F.sum("n").alias("n"))))
    found = _factored(_starts(spread), "key", "start", factor=1.0)
    for _ in range(STEPS):
        found = _factored(_step(spread, found, few, "key", "start"), "key", "start", factor=_consistent(COVER), prior=_larger(found, parents, few, "key", "start"))
    size = F.struct(F.round(sum((F.log(f"l{i}{i}") for i in DIMS), F.lit(0.0)), 9), "start")  # of the determinant
    best = found.groupBy("key").agg(F.min_by(F.struct("n", "w", *FOUND), size).alias("b")).select("key", "b.*")
    last = _factored(_step(spread, best, few, "key", reweight=True), "key", factor=_consistent(REWEIGHT), prior=_larger(best, parents, few, "key"))
    return checkpointed(groups.join(_sided(last.withColumnRenamed("key", "k0"), few), "k0").select(F.col("k0").alias("group"), "n", "w", *FOUND))


def _surprise(d2: Column, w: Column) -> Column:
    """Log probability of a squared distance or more from an estimate of w documents, if all were normal: k statistics
    and w - k degrees of freedom (F distribution, in closed form for k = 4)."""
    k = len(FLOORS)
    half = (w - k) / 2
    tail = d2 * w / ((w - 1) * (w + 1))  # k / (w - k) times an F-distributed value
    y = 1 / (1 + tail)
    return F.when(w > k + 1, half * F.log(y) + F.log1p(half * (1 - y))).otherwise(F.lit(0.0))


def judged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (lang, source, x0.., base_failed) with d2 and kept."""
    side = found.select(F.col("group").alias("_group"), F.struct("w", *FOUND).alias("_e"))
    few = side.count() <= MOST_BROADCAST
    d = rows.withColumn("_group", _keys()[0]).join(_sided(side, few), "_group", "left")
    d = _distance(d, "_e.").withColumn("_p", _surprise(F.col("d2"), F.col("_e.w")))
    return d.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("_p") >= math.log(ALPHA), F.lit(True))).drop("_e", "_group", "_p")


def _measured(docs: DataFrame, *names: str) -> DataFrame:
    d = counted(docs.select(*names, "lang", "source", "text"))
    return d.select(*names, "lang", "source", "_q", *(s.alias(f"x{i}") for i, s in enumerate(statistics())))


def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept)."""
    rows = written(_measured(docs, "doc_id").select("doc_id", "lang", "source", "_q.*", *(f"x{i}" for i in DIMS)))
    found = estimates(rows.where(~F.col("base_failed")))
    return judged(rows, found).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept")


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with docs' columns. Rows are written once with their statistics, so texts are
    counted once and not shuffled."""
    x = F.struct(F.col("_q.base_failed").alias("base_failed"), *(s.alias(f"x{i}") for i, s in enumerate(statistics())))
    rows = written(counted(docs.select(whole_row(docs).alias("_row"), "lang", "source", "text")).select("_row", "lang", "source", x.alias("_x")))
    rows = rows.select("_row", "lang", "source", "_x.*")
    found = estimates(rows.where(~F.col("base_failed")).drop("_row"))
    return judged(rows, found).where("kept").select("_row.*")
