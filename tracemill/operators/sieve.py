"""A bit map that tells most rows of a large table from the few that a join has to look at.

The map's size is fixed by the number of keys and has a bound, so it can be broadcast whatever the tables' sizes; rows
that are not marked need not be moved. A marked row may be a false one, so the join itself stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.storage import written

#: Bits for each key (one in BITS of the other rows is marked), and of the whole map at most (16 MB).
BITS, MOST_BITS = 64, 1 << 27


def marked(rows: DataFrame, wanted: DataFrame, key: str, mark: str = "_marked") -> DataFrame:
    """rows with a boolean `mark`, true for all rows whose `key` is one of wanted's and for few others.

    key: a long that is evenly spread, such as a hash; never null."""
    place = F.pmod(F.col(key), F.lit(min(MOST_BITS, BITS * max(1, wanted.count())))) + 1
    part, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = written(wanted.groupBy(part.alias("_part")).agg(F.bitmap_construct_agg(bit).alias("_map")))
    byte = F.conv(F.hex(F.substring("_map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_part", part).join(F.broadcast(maps), "_part", "left")
    return found.withColumn(mark, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("_part", "_map")
