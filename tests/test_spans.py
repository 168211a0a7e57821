"""Spans between marks."""

from tracemill.operators import intervals


def test_last_span_runs_to_the_end(spark):
    rows = [("a", 5, 1, 20), ("a", 9, 2, 20), ("b", 7, 3, 8), ("c", 7, 4, 7), ("d", 7, 5, None), ("e", 3, 6, 9), ("e", 3, 7, 9)]
    d = spark.createDataFrame(rows, "k string, t long, id long, stop long")
    got = {(r.k, r.span_id, r.start_t, r.end_t) for r in intervals.until_next(d, ["k"], "t", "id", end="stop").collect()}
    assert got == {("a", 1, 5, 9), ("a", 2, 9, 20), ("b", 3, 7, 8), ("e", 6, 3, 3), ("e", 7, 3, 9)}
    assert {r.span_id for r in intervals.until_next(d, ["k"], "t", "id").collect()} == {1, 6}
    assert intervals.until_next(d.limit(0), ["k"], "t", "id", end="stop").count() == 0
