import zlib

from tracemill.llm import sharding

SCHEMA = "doc_id long, text string"


def check(spark, rows, n):
    got = sharding.shards(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as size", "2 as before", "3 as part"), n).collect()
    assert len(got) == len(rows)
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"]) for r in order]
    assert keys == sorted(keys)  # contiguous
    want = sorted((d is not None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t in rows)
    assert [k + (r["size"],) for k, r in zip(keys, order)] == want
    total, largest = sum(w[3] for w in want), max((w[3] for w in want), default=0)
    for s in {r["shard"] for r in got}:
        mine = [r for r in order if r["shard"] == s]
        assert [r["slot"] for r in mine] == list(range(len(mine)))
    for s in range(n):
        assert abs(sum(r["size"] for r in got if r["shard"] == s) - total / n) <= largest
    assert {(r["law"], r["grown_shard"]) for r in got} <= {("bytes", None)}


def test_shards(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, 8)
    check(spark, [(i % 5 or None, "é" * (i % 7) if i % 3 else None) for i in range(100)] + [(3, "same")] * 50, 8)
    check(spark, [(1, "x" * 100_000), (2, ""), (2, "")], 8)
    check(spark, [(1, None)], 3)


def test_partitions_of_several_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        check(spark, [(i % 70 or None, "é" * (i % 7) if i % 3 else None) for i in range(200)], 8)
    finally:
        spark.conf.set(name, before)


def test_empty(spark):
    assert sharding.shards(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_beyond_doubles(spark):
    ids = [2**60 + 1, None, 2**60 + 3]
    d = spark.createDataFrame([(i, f"text number {k}") for k, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in sharding.shards(d).collect()} == set(ids)
