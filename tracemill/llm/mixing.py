"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

A document of s words in source k gets the rate 2 / (1 + exp(-lambda_k x)), x being s over the source's
mean size: the rates in (0, 2) of least relative entropy to one copy each whose tokens meet the source's
target. lambda_k minimises a convex dual; Newton steps (kept within a bracket) run for all sources at
once, each step one aggregation over the counts of equal (source, size). Rates become copies in two exact
steps: each size's number of copies is the whole number nearest to what the rates ask, with what a source then
owes put right from large sizes to small ones, and a size's copies are dealt out evenly over its documents in the
order of a hash. A source's taken words then miss its target by less than its smallest size or so. One row a
source passes through the driver; documents and sizes don't.

Defined results: null and empty texts have size 0 and are taken as the rate says, which takes no words; a
null source is a source of its own, last in order; repeated rows are separate documents; a source without
words has target 0; an empty table gives no rows. Extra columns of the input are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.llm.batches import whole_row
from tracemill.storage import checkpointed, written

WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2
NEWTON_STEPS, CLOSE = 80, 1e-9
#: Ranges of sizes in an octave, of which one size each settles what is owed.
RANGES = 8
#: Parts that one size of one source is dealt into, so that no task ranks an unbounded group.
SALTS = 256


def measured(docs: DataFrame, rows: bool = False) -> DataFrame:
    """(doc_id, src, size, mark: a hash of id and text) of each document, and with `rows` its row as a struct `_row`. src: "=" and the
    source, or nothing for a null source; size: words of the whole text."""
    size = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    src = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    whole = [whole_row(docs).alias("_row")] if rows else []
    mark = F.xxhash64(F.col("doc_id").cast("long"), "text", F.lit("order")).alias("mark")
    return docs.select(*whole, F.col("doc_id").cast("long"), src.alias("src"), size.alias("size"), mark)


def targets(sizes: dict[str, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> dict[str, float]:
    """Target of each source (by src). What exceeds `most` times a source's size is shared anew by weight."""
    order = sorted(sizes, key=lambda s: (not s, [ord(c) for c in s]))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, out = share * sum(sizes.values()), {}
    while rest := [s for s in order if s not in out]:
        each = left / sum(weight[s] for s in rest)
        full = {s: float(most * sizes[s]) for s in rest if each * weight[s] > most * sizes[s]}
        out |= full or {s: each * weight[s] for s in rest}
        left -= sum(full.values())
    return out


def _literals(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A relation of the driver's rows: one a source."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def _solve(levels: DataFrame, mean: dict[str, float], goal: dict[str, float]) -> dict[str, float]:
    """lambda of each source in goal. levels: (src, size, n). Each step evaluates all open sources in one job."""
    at = {s: (0.0, -math.inf, math.inf) for s in goal}  # lambda and its bracket
    out: dict[str, float] = {}
    gaps: dict[str, float] = {}
    for _ in range(NEWTON_STEPS):
        if not (open_ := [s for s in goal if s not in out]):
            break
        now = _literals(levels.sparkSession, [{"src": s, "lam": at[s][0], "mean": mean[s]} for s in open_], "src: string, lam: double, mean: double")
        x, up = F.col("size") / F.col("mean"), 1 / (1 + F.exp(-F.col("lam") * F.col("size") / F.col("mean")))
        words = F.col("n") * F.col("size") * 2 * up
        sums = levels.join(F.broadcast(now), "src").groupBy("src").agg(F.sum(words).alias("took"), F.sum(words * x * (1 - up)).alias("slope"))
        for r in sums.collect():
            s, gap, (lam, low, high) = r["src"], r["took"] - goal[r["src"]], at[r["src"]]
            gaps[s] = abs(gap)
            if abs(gap) <= CLOSE * goal[s]:
                out[s] = lam
                continue
            low, high = (low, lam) if gap > 0 else (lam, high)
            new = lam - gap / r["slope"] if r["slope"] > 0 else math.nan
            if not low < new < high:  # out of the bracket: halve it, or widen it while it is open
                new = (low + high) / 2 if math.isfinite(low + high) else lam - max(1, abs(lam)) if gap > 0 else lam + max(1, abs(lam))
            at[s] = (new, low, high)
    far = [s for s in goal if s not in out and gaps[s] > max(1.0, 1e-6 * goal[s])]
    if far:
        raise RuntimeError(f"no convergence in {NEWTON_STEPS} steps: {far[:5]}")
    return {s: out.get(s, at[s][0]) for s in goal}


def _copies(levels: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, size, n, level_copies): copies of each size, near what the rates ask, so that a source's words meet its target.

    Each size first gets the nearest whole number of copies. The words that a source then owes (or has over) are put
    right, from the largest size down, on one size of each range of sizes, the most frequent: RANGES ranges an octave,
    so what is folded in order is a short list however many sizes there are.
    """
    rate = F.when(F.col("full"), F.lit(float(MOST_COPIES))).otherwise(2 / (1 + F.exp(-F.col("lam") * F.col("size") / F.col("mean"))))
    most = F.col("n") * MOST_COPIES
    rated = levels.join(sources, "src").withColumn("wanted", F.col("n") * rate)
    first = rated.select("src", "size", "n", "wanted", F.least(F.floor(F.col("wanted") + 0.5), most).cast("long").alias("k"))
    first = checkpointed(first.withColumn("range", F.when(F.col("size") > 0, F.floor(RANGES * F.log2("size")))))
    owed = first.groupBy("src").agg(F.sum(F.col("size") * (F.col("wanted") - F.col("k"))).alias("owed"))
    row = F.struct("size", "n", "k")
    chosen = first.where("size > 0").groupBy("src", "range").agg(F.max_by(row, F.struct("n", -F.col("size"))).alias("row"))
    lists = chosen.groupBy("src").agg(F.sort_array(F.collect_list("row"), asc=False).alias("rows")).join(owed, "src")
    start = F.struct(F.col("owed").alias("owed"), F.array().cast("array<struct<size:bigint,more:bigint>>").alias("out"))

    def settle(a, r):
        low, high = -r["k"], r["n"] * MOST_COPIES - r["k"]
        more = F.greatest(F.least(F.round(a["owed"] / r["size"]), high), low).cast("bigint")
        return F.struct((a["owed"] - more * r["size"]).alias("owed"), F.concat(a["out"], F.array(F.struct(r["size"].alias("size"), more.alias("more")))).alias("out"))

    put = lists.select("src", F.explode(F.aggregate("rows", start, settle)["out"]).alias("p")).select("src", "p.*")
    settled = first.join(put, ["src", "size"], "left")
    return settled.select("src", "size", "n", (F.col("k") + F.coalesce("more", F.lit(0))).alias("level_copies"))


def mixed(docs: DataFrame, rows: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for each document, and with `rows` its row as `_row`."""
    spark = docs.sparkSession
    asked_of = measured(docs, rows).withColumn("salt", F.pmod(F.col("mark"), F.lit(SALTS)))
    slim = asked_of if rows else written(asked_of)
    parts = checkpointed(slim.groupBy("src", "size", "salt").agg(F.count("*").alias("n")))
    levels = checkpointed(parts.groupBy("src", "size").agg(F.sum("n").alias("n")))
    totals = levels.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")).collect()
    sizes, mean = {r["src"]: r["size"] for r in totals}, {r["src"]: max(r["size"] / r["n"], 1e-9) for r in totals}
    target = targets(sizes)
    lam = _solve(levels, mean, {s: t for s, t in target.items() if 0 < t < MOST_COPIES * sizes[s]})
    known = [{"src": s, "lam": lam.get(s, 0.0), "full": s not in lam, "mean": mean[s], "source_size": sizes[s], "target": target[s]} for s in sizes]
    sources = _literals(spark, known, "src: string, lam: double, full: boolean, mean: double, source_size: bigint, target: double")
    below = W.partitionBy("src", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    dealt = parts.join(_copies(levels, sources).withColumnRenamed("n", "level_n"), ["src", "size"])
    dealt = dealt.select("src", "size", "salt", "level_n", "level_copies", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("before"))
    within = W.partitionBy("src", "size", "salt").orderBy("mark", "doc_id")
    placed = slim.withColumn("place", F.row_number().over(within)).join(dealt, ["src", "size", "salt"])
    upto = "(before + place{}) * level_copies div level_n"
    copies = F.expr(upto.format("")) - F.expr(upto.format(" - 1"))
    out = placed.withColumn("copies", copies.cast("long")).join(F.broadcast(sources.select("src", "source_size", "target")), "src")
    whole = ["_row"] if rows else []
    return out.select(*whole, "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """docs' rows as often as the mix takes them."""
    taken = mixed(docs, rows=True).where(F.col("copies") > 0)
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
