"""Folds keep keys and values exact, whatever else a batch holds."""

from tracemill.operators import sequences, statistics

BIG = [2**60 + 1, None, 2**60 + 3]


def test_null_and_long_keys(spark):
    rows = [(k, t, n, 1.0) for k in BIG for n, t in enumerate((0.0, 0.1, 5.0))]
    d = spark.createDataFrame(rows, "workflow long, t double, line_no long, delta double").repartition(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = sequences.fold(d, ["workflow"], ["t", "line_no"], sequences.ScrollRuns, "workflow long, t double, end_t double, delta double, n long").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(map(tuple, got), key=str) == sorted([(k, *r) for k in BIG for r in ((0.0, 0.1, 2.0, 2), (5.0, 5.0, 1.0, 1))], key=str)


class Largest:
    """(largest, nulls) of v."""

    def __init__(self):
        self.most, self.nulls = None, 0

    def take(self, row):
        self.nulls += row.v is None
        self.most = max((v for v in (self.most, row.v) if v is not None), default=None)
        return []

    def end(self):
        return [(self.most, self.nulls)]


def test_null_values_dont_widen(spark):
    d = spark.createDataFrame([("a", BIG[0]), ("a", None), ("b", None)], "k string, v long").repartition(1)
    got = sequences.fold(d, ["k"], ["v"], Largest, "k string, most long, nulls long").collect()
    assert sorted(map(tuple, got)) == [("a", BIG[0], 1), ("b", None, 1)]


def test_null_line(spark):
    d = spark.createDataFrame([(1, None), (1, "x")], "k int, line string")
    got = sequences.fold(d, ["k"], ["line"], statistics.Digest, "k int, n long, sha256 string").collect()
    assert got[0]["n"] == 2
    assert sequences.fold(d.where("k > 1"), ["k"], ["line"], statistics.Digest, "k int, n long, sha256 string").count() == 0
