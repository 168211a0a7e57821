from pyspark.sql import functions as F

from tracemill.operators import sieve


def test_all_wanted_rows_and_few_others_are_marked(spark, monkeypatch):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"), F.lit("x").alias("part"))
    for n, most, others in ((0, 1 << 27, 0), (1, 1 << 27, 1000), (700, 1 << 27, 600), (700, 1 << 11, 20_000)):
        monkeypatch.setattr(sieve, "MOST_BITS", most)
        found = sieve.marked(rows, rows.where(F.col("id") < n), "h")
        assert found.columns == ["id", "h", "part", "_marked"]
        got = {r["id"]: r["_marked"] for r in found.collect()}
        assert len(got) == 20_000 and all(got[i] for i in range(n))
        assert sum(got.values()) - n <= others
