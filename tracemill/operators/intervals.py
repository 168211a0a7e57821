"""Interval, overlap and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def interval_join(points: DataFrame, spans: DataFrame, by: list[str], t: str, start: str, end: str, width: int) -> DataFrame:
    """Points with every span of the same keys that holds them, start <= t < end.

    Both sides meet on (keys, time bucket of `width`), so a plain hash join distributes them even where one
    key has most of the rows; a span is repeated in each bucket that it touches. Choose `width` near a
    usual span's length.
    """
    bucket = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))
    wide = spans.where(F.col(end) > F.col(start)).withColumn("_bucket", bucket)
    return points.withColumn("_bucket", F.floor(F.col(t) / width)).join(wide, [*by, "_bucket"]).where((F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))).drop("_bucket")


def overlaps(left: DataFrame, right: DataFrame, by: list[str], start: str, end: str, width: int, anti: bool = False) -> DataFrame:
    """Rows of left that overlap (or with anti: don't overlap) a row of right, by the same bucketing."""
    spread = lambda d: d.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    r = spread(right).select(*(F.col(c).alias(f"_r_{c}") for c in by), F.col("_bucket").alias("_r_bucket"), F.col(start).alias("_r_start"), F.col(end).alias("_r_end"))
    numbered = left.withColumn("_row", F.struct(*left.columns))
    same = [F.col(c) == F.col(f"_r_{c}") for c in by] + [F.col("_bucket") == F.col("_r_bucket"), F.col("_r_start") < F.col(end), F.col("_r_end") > F.col(start)]
    hit = spread(numbered).join(r, same, "left_semi").select("_row").distinct()
    return numbered.join(hit, "_row", "left_anti" if anti else "left_semi").drop("_row")


def last_before(points: DataFrame, states: DataFrame, by: list[str], t: str, order: str, carry: list[str], lag: int = 0) -> DataFrame:
    """Points with the columns `carry` of the latest state of the same keys at t - lag or before (else null).

    As-of join in one sort: both sides are stacked and the last state is carried along the order.
    """
    state = F.struct(*(F.col(c).alias(c) for c in carry))
    names = points.columns
    up = states.select(*by, (F.col(t) + lag).alias("_at"), F.lit(0).alias("_side"), F.col(order).alias("_o"), state.alias("_state"))
    down = points.select(*by, F.col(t).alias("_at"), F.lit(1).alias("_side"), F.col(order).alias("_o"), F.struct(*names).alias("_point"))
    along = W.partitionBy(*by).orderBy("_at", "_side", "_o").rowsBetween(W.unboundedPreceding, 0)
    both = up.unionByName(down, allowMissingColumns=True).withColumn("_last", F.last("_state", ignorenulls=True).over(along))
    return both.where("_side = 1").select("_point.*", *(F.col(f"_last.{c}").alias(f"last_{c}") for c in carry))


def merged(spans: DataFrame, by: list[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """Unions of spans that touch within `gap`, one row each: (keys, start, end, n)."""
    before = W.partitionBy(*by).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    new = F.when(F.col(start) <= F.max(end).over(before) + gap, 0).otherwise(1)
    along = W.partitionBy(*by).orderBy(start, end).rowsBetween(W.unboundedPreceding, 0)
    marked = spans.withColumn("_new", new).withColumn("_island", F.sum("_new").over(along))
    return marked.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def until_next(marks: DataFrame, by: list[str], t: str, order: str, end: str | None = None) -> DataFrame:
    """Spans from each mark to the next of the same keys. The last runs to the column `end`, where its record ends (it is
    left out where that is null or isn't after it); without such a column it is dropped."""
    follow: Column = F.lead(t).over(W.partitionBy(*by).orderBy(t, order))
    until = F.coalesce(follow, F.when(F.col(end) > F.col(t), F.col(end))) if end else follow
    return marks.select(*by, F.col(order).alias("span_id"), F.col(t).alias("start_t"), until.alias("end_t")).where("end_t is not null")
