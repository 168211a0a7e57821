"""Images cut from images: places of crops, and each image's original through any number of crops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.storage import written

#: A crop whose longer side is under LEGIBLE pixels is enlarged by a whole factor of up to LARGEST.
LEGIBLE, LARGEST = 1000, 4


def placed_crop(crop: Column, width: Column, height: Column, shown_width: Column, shown_height: Column) -> Column:
    """A crop [left, top, right, bottom] of the picture as shown, in pixels of the stored one and within it.

    Null where the crop is empty as given, or under two pixels wide or high where it is placed."""
    across, down = width / F.greatest(shown_width, F.lit(1)), height / F.greatest(shown_height, F.lit(1))
    at = [F.rint(crop[k] * (down if k % 2 else across)).cast("long") for k in range(4)]
    left = F.greatest(F.lit(0), F.least(at[0], width - 1))
    top = F.greatest(F.lit(0), F.least(at[1], height - 1))
    right = F.greatest(left + 1, F.least(at[2], width))
    bottom = F.greatest(top + 1, F.least(at[3], height))
    ok = (crop[2] > crop[0]) & (crop[3] > crop[1]) & (right - left >= 2) & (bottom - top >= 2)
    return F.when(ok, F.array(left, top, right, bottom))


def enlargement(crop: Column) -> Column:
    """The whole factor by which a placed crop is enlarged, so that small print can be read."""
    longest = F.greatest(crop[2] - crop[0], crop[3] - crop[1])
    return F.when(longest < LEGIBLE, F.least(F.lit(LARGEST), F.ceil(LEGIBLE / longest))).otherwise(1).cast("int")


def _doubled(rows: DataFrame, rounds: int, crops: bool) -> DataFrame:
    """Pointers `up` followed until they are null, twice as far each round; rows end where `up` is null.

    A row that has ended is written once and only read from then on; a round writes the rows that were open before it."""
    ended, open_ = [rows.where("up is null")], rows.where("up is not null")
    for _ in range(rounds):
        if open_.isEmpty():
            break
        known = reduce(DataFrame.unionByName, [*ended, open_])
        other = known.select(F.col("image_id").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("depth").alias("_depth"), *([F.col("crops").alias("_crops")] if crops else []))
        further = [F.col("_up").alias("up"), F.col("_top").alias("top"), (F.col("depth") + F.col("_depth")).alias("depth")]
        gone = written(open_.join(other, "up").select("image_id", *further, *([F.concat("_crops", "crops").alias("crops")] if crops else [])))
        ended, open_ = [*ended, gone.where("up is null")], gone.where("up is not null")
    return reduce(DataFrame.unionByName, [*ended, open_])


def lineage(images: DataFrame) -> DataFrame:
    """(image_id, original_id, depth, crops, problem) of images (image_id, parent_id, crop).

    original_id is the first ancestor, depth the number of steps to it, crops those on the way, the original's first;
    a null crop is a copy and adds none. problem: "missing" if the chain leads to an image that isn't there (which is
    then original_id), "cycle" if it has no end (no original, depth or crops). Pointer doubling: log2 of the longest
    chain many joins, each of one row an image; crops are gathered after cycles are known, so no list grows without end.
    Image ids are unique.
    """
    known = images.select(F.col("image_id").alias("parent_id"), F.lit(True).alias("_known"))
    told = images.select("image_id", "parent_id", "crop").join(known, "parent_id", "left")
    up = F.when(F.col("_known"), F.col("parent_id"))
    step = F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long")
    top = F.when(F.col("_known"), None).otherwise(F.coalesce("parent_id", "image_id"))
    lost = F.col("parent_id").isNotNull() & F.col("_known").isNull()
    own = F.when(F.col("parent_id").isNotNull() & F.col("crop").isNotNull(), F.array("crop")).otherwise(F.filter(F.array("crop"), lambda _: F.lit(False)))
    start = written(told.select("image_id", up.alias("up"), top.alias("top"), step.alias("depth"), own.alias("crops"), lost.alias("lost")))
    rounds = max(start.count(), 2).bit_length() + 1
    ends = _doubled(start.select("image_id", "up", "top", "depth"), rounds, False)
    endless = written(ends.where("up is not null").select("image_id"))
    gathered = _doubled(written(start.drop("lost").join(endless, "image_id", "left_anti")) if not endless.isEmpty() else start.drop("lost"), rounds, True)
    outside = start.where("lost").select(F.col("top").alias("original_id"), F.lit("missing").alias("problem")).distinct()
    whole = gathered.select("image_id", F.col("top").alias("original_id"), "depth", "crops").join(outside, "original_id", "left")
    return whole.select("image_id", "original_id", "depth", "crops", "problem").unionByName(endless.withColumn("problem", F.lit("cycle")), allowMissingColumns=True)
