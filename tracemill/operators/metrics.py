"""Predicted completions scored against target completions, and their averages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.functions import actions as A
from tracemill.functions import scalars as S
from tracemill.storage import written

#: Radii in pixels, the screen where none is known.
RADII, WIDTH, HEIGHT = (8, 16, 32, 64), 1920.0, 1080.0
#: Rates (averages of yes and no), and averages that macro takes over groups.
RATES = {"json_parse_rate": "json_ok", "schema_valid_rate": "schema_ok", "action_type_accuracy": "type_ok", "sequence_type_accuracy": "sequence_types_ok", "chunk_length_accuracy": "length_ok", "exact_match": "exact_ok"}
MACRO = ("json_parse_rate", "schema_valid_rate", "action_type_accuracy", "sequence_type_accuracy", "exact_match", "coord_error_px_mean", "coord_error_px_median")


def _actions(completion: Column) -> Column:
    """Actions of a valid completion in typed fields; two are equal whatever the order of their keys."""
    items = F.try_variant_get(F.try_parse_json(F.trim(completion)), "$.actions", "array<variant>")
    return F.transform(items, lambda i: A.typed(i).withField("found", F.array_sort(A.typed(i)["found"])))


def scored(d: DataFrame, predicted: str, target: str, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """d with one score struct a row: what a predicted completion gets right of a valid target completion.

    A completion that isn't valid (null ones included) fails all rates; keys, texts and points are null for it, as they
    are where the target has none. Keys and texts are judged on the first action, points where both first actions have one.
    """
    wide = F.coalesce(F.nullif(width, F.lit(0)), F.lit(WIDTH)) if width is not None else F.lit(WIDTH)
    high = F.coalesce(F.nullif(height, F.lit(0)), F.lit(HEIGHT)) if height is not None else F.lit(HEIGHT)
    errors = F.coalesce(A.errors(F.col(predicted)), F.array(F.lit("not_json")))
    read = d.withColumn("_e", errors).withColumn("_p", F.when(F.size("_e") == 0, _actions(F.col(predicted)))).withColumn("_t", _actions(F.col(target)))
    p, t = F.get("_p", F.lit(0)), F.get("_t", F.lit(0))
    first = read.withColumn("_p1", p).withColumn("_t1", t)
    ok = lambda c: F.coalesce(c, F.lit(False))
    both = lambda field: ok(F.col(f"_p1.{field}") == F.col(f"_t1.{field}"))
    valid, kind = F.size("_e") == 0, F.col("_t1.type")
    key = both("type") & both("key") & ok(F.array_sort("_p1.modifiers") == F.array_sort("_t1.modifiers"))
    apart = lambda axis, extent: S.from_grid(F.col(f"_p1.{axis}"), extent) - S.from_grid(F.col(f"_t1.{axis}"), extent)
    pixels = F.hypot(apart("x", wide), apart("y", high))
    score = F.struct(
        F.when(F.get("_e", F.lit(0)) == "not_json", False).otherwise(True).alias("json_ok"),
        valid.alias("schema_ok"),
        both("type").alias("type_ok"),
        ok(F.col("_p.type") == F.col("_t.type")).alias("sequence_types_ok"),
        ok(F.size("_p") == F.size("_t")).alias("length_ok"),
        (valid & F.col("_p").eqNullSafe(F.col("_t"))).alias("exact_ok"),
        F.when(valid & (kind == "key"), key).alias("key_ok"),
        F.when(valid & (kind == "type_text"), both("type") & both("text")).alias("text_ok"),
        pixels.alias("coord_error_px"),
        F.hypot(apart("x", F.lit(1.0)), apart("y", F.lit(1.0))).alias("coord_error_norm"),
        kind.alias("target_type"),
        F.col("_p1.type").alias("predicted_type"),
    )
    return first.withColumn("score", score).drop("_e", "_p", "_t", "_p1", "_t1")


def medians(d: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    """(keys, name): true median, the mean of the middle two of an even number; from counts of equal values."""
    counts = d.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("_x")).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*by)
    ranked = counts.withColumn("_upto", F.sum("_c").over(w.orderBy("_x"))).withColumn("_n", F.sum("_c").over(w))
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_x")))
    return ranked.groupBy(*by).agg(((at(F.expr("_n div 2")) + at(F.expr("(_n - 1) div 2"))) / 2).alias(name))


def summary(d: DataFrame, group: str, radii: tuple[int, ...] = RADII) -> DataFrame:
    """One row a scope: each group (null is a group), `overall` of all rows, `macro` of the groups' means, unweighted.

    Averages leave nulls out and are null where nothing is left; counts tell how many were judged. Rows are folded once,
    by (scope, group); sums of points and keys come with it. Nothing is collected, groups are of any size and number.
    """
    scopes = F.explode(F.array(F.struct(F.lit("group").alias("scope"), F.col(group).alias("_g")), F.struct(F.lit("overall").alias("scope"), F.lit(None).cast(d.schema[group].dataType).alias("_g"))))
    # written once: rates and medians are two passes, and scoring is dearer than reading
    s = written(d.select(group, "score")).select(scopes.alias("_s"), "score").select("_s.*", "score.*")
    rate = lambda c: F.avg(F.col(c).cast("double"))
    keys = ["scope", "_g"]
    px = F.col("coord_error_px")
    folded = s.groupBy(*keys).agg(
        F.count("*").alias("count"),
        *(rate(c).alias(n) for n, c in RATES.items()),
        rate("key_ok").alias("key_accuracy"), F.count("key_ok").alias("key_count"),
        rate("text_ok").alias("type_text_accuracy"), F.count("text_ok").alias("type_text_count"),
        F.count(px).alias("coord_count"), F.avg(px).alias("coord_error_px_mean"), F.avg("coord_error_norm").alias("coord_error_norm_mean"),
        *(F.avg((px <= r).cast("double")).alias(f"within_{r}") for r in radii),
    )
    middle = medians(s, keys, "coord_error_px", "coord_error_px_median").select(*(F.col(k).alias(f"_m{k}") for k in keys), "coord_error_px_median")
    each = folded.join(middle, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_m{k}")) for k in keys)), "left").drop(*(f"_m{k}" for k in keys))
    averaged = (*MACRO, *(f"within_{r}" for r in radii))
    macro = each.where("scope = 'group'").agg(F.count("*").alias("_n"), *(F.avg(c).alias(c) for c in averaged)).where("_n > 0").drop("_n").withColumn("scope", F.lit("macro"))
    return each.unionByName(macro, allowMissingColumns=True).withColumnRenamed("_g", group)


def target_types(d: DataFrame, group: str) -> DataFrame:
    """(group, target_type, n): how often each first action is asked for."""
    return d.select(group, "score.target_type").where("target_type is not null").groupBy(group, "target_type").agg(F.count("*").alias("n"))
