"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are range-partitioned by (doc_id, text_crc32) and sorted. Each partition's total of bytes and rows
goes to the driver (one small row a partition) and comes back as that partition's offset, so every row
knows how many bytes lie before it in the global order. The row whose middle byte falls in the k-th
equal part of all bytes belongs to shard k; shards are contiguous and differ from the target by less
than one row.

Defined results: a null text has one byte and checksum 0; null doc_ids come first; repeated rows are
adjacent and keep one row each; an empty table gives no rows; ids of any size stay exact. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.storage import checkpointed

SHARDS = 8


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32): UTF-8 bytes of the text plus one, unsigned checksum."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long"), size.alias("size"), crc.alias("text_crc32"))


def prefix_sums(rows: DataFrame, order: list[str], size: str) -> tuple[DataFrame, int, int]:
    """rows with `before` (sizes before the row) and `position` (rows before it) in the order of the given
    columns, the total size and the row count. Rows are dealt by ranges of the order columns."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    number = F.spark_partition_id()
    totals = dealt.groupBy(number.alias("part")).agg(F.sum(size).alias("size"), F.count("*").alias("n")).collect()
    starts, before, position = {}, 0, 0
    for t in sorted(totals):
        starts[t["part"]] = (before, position)
        before, position = before + t["size"], position + t["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            if not b.num_rows:
                continue
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            part = columns.pop("_part")  # of each batch, not of a partition's first alone
            at = at or starts[part[0].as_py()]
            sizes = columns[size].to_numpy()
            sums = np.cumsum(sizes)
            columns |= {"before": pa.array(at[0] + sums - sizes), "position": pa.array(at[1] + np.arange(len(sizes)))}
            at = (at[0] + int(sums[-1]), at[1] + len(sizes))
            yield pa.RecordBatch.from_pydict(columns)

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", before long, position long"
    return dealt.withColumn("_part", number).mapInArrow(run, kinds), before, position


def shards(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each document."""
    rows, total, _ = prefix_sums(sized(docs), ["doc_id", "text_crc32"], "size")
    middle = f"(2 * before + size) * {n} div {max(1, 2 * total)}"
    shard = F.least(F.expr(f"cast({middle} as int)"), F.lit(n - 1))
    placed = rows.withColumn("shard", shard)
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("position").alias("first")).collect()}
    start = F.lit(0).cast("long")
    for k, v in first.items():
        start = F.when(F.col("shard") == k, F.lit(v)).otherwise(start)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("position") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
