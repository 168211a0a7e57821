"""Aggregates with exact definitions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.operators import sequences


def nearest_rank(d: DataFrame, by: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles, ranks rounded half to even; from counts of equal values, so no list is built."""
    counts = d.groupBy(*by, x).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*by)
    ranked = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(x))).withColumn("_n", F.sum("_c").over(w))
    at = lambda p: F.min(F.when(F.col("_upto") > F.bround(F.lit(p) * (F.col("_n") - 1)), F.col(x)))
    return ranked.groupBy(*by).agg(*(at(p).alias(name) for name, p in shares.items()))


def with_macro(d: DataFrame, group: str, value: Column) -> DataFrame:
    """(scope, n, mean): each group, all rows, and the unweighted mean of group means."""
    each = d.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("_s"))
    whole = each.agg(F.sum("n").alias("n"), (F.sum("_s") / F.sum("n")).alias("mean")).select(F.lit("overall").alias("scope"), "n", "mean")
    macro = each.agg(F.count("mean").alias("n"), F.avg("mean").alias("mean")).select(F.lit("macro").alias("scope"), "n", "mean")
    return each.select(F.concat(F.lit("group:"), F.col(group)).alias("scope"), "n", "mean").unionByName(whole).unionByName(macro)


def leave_one_out(value: Column, group: str) -> Column:
    """Value minus the mean of the others of its group; null alone."""
    w = W.partitionBy(group)
    n = F.count(value).over(w)
    return F.when(n > 1, value - (F.sum(value).over(w) - value) / (n - 1))


def balanced_weights(d: DataFrame, group: str, temperature: float) -> DataFrame:
    """(group, n, weight): each row's sampling weight when groups get count^T of all draws."""
    n = d.groupBy(group).agg(F.count("*").alias("n"))
    power = F.pow(F.col("n").cast("double"), F.lit(temperature))
    return n.withColumn("weight", power / F.sum(power).over(W.partitionBy()) / F.col("n"))


def expected_coverage(d: DataFrame, group: str, temperature: float) -> DataFrame:
    """(group, n, coverage, overall): expected share of distinct rows met by as many draws as there are rows, with replacement."""
    n, every = balanced_weights(d, group, temperature), W.partitionBy()
    met = 1 - F.pow(1 - F.col("weight"), F.sum("n").over(every))
    c = n.select(group, "n", met.alias("coverage"))
    return c.withColumn("overall", F.sum(F.col("n") * F.col("coverage")).over(every) / F.sum("n").over(every))


class Digest:
    """(n, sha256): running digest of the lines, joined by a separator; a null line is empty."""

    def __init__(self, between: str = "\n"):
        self.between, self.n, self.hash = between.encode(), 0, hashlib.sha256()

    def take(self, row) -> list[tuple]:
        self.hash.update((self.between if self.n else b"") + (row.line or "").encode())
        self.n += 1
        return []

    def end(self) -> list[tuple]:
        return [(self.n, self.hash.hexdigest())]


def ordered_digest(d: DataFrame, by: list[str], name: str, digest: str) -> DataFrame:
    """(key, files, sha256): digest over the sorted (name, digest) lines of each key, streamed in order."""
    lines = d.select(*by, F.concat_ws("\t", name, digest).alias("line"))
    keys = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in by)
    return sequences.fold(lines, by, ["line"], Digest, f"{keys}, files long, sha256 string")
