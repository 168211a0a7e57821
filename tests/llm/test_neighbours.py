import math
from functools import reduce
from operator import add

import numpy as np

from tracemill.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def dot(x, y):
    return reduce(add, (x * y).tolist())


def brute(rows, k=5, every=50, kind=np.float32):
    good = [(i, np.array(v, kind).astype(float)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    good = [(i, v / 2.0 ** math.frexp(abs(v).max())[1]) for i, v in good]
    out = []
    for at, (q, x) in enumerate(good):
        if q % every == 0:
            scored = sorted((-(dot(x, y) / (math.sqrt(dot(x, x)) * math.sqrt(dot(y, y)))), i) for k, (i, y) in enumerate(good) if k != at and len(x) == len(y))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_matches_brute_force(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows += [(None, rows[0][1]), (9001, None), (9002, [0.0] * 64), (9003, [float("nan")] + [1.0] * 63), (9004, [None] + [1.0] * 63), (9005, [float("inf")] * 64)]
    rows += [(9100 + i, rows[3][1]) for i in range(20)]  # ties
    rows += [(rows[0][0] // 50 * 50, rows[5][1]), (100, rows[7][1]), (100, rows[7][1]), (150, rows[4][1][:3]), (151, rows[4][1][:3]), (2**60 + 1, rows[8][1])]
    for sizes in ((16384, 1024, 4096, 16384), (7, 3, 17, 60)):
        for name, v in zip(("QUERY_BLOCK", "ROWS", "TILE", "SIDE"), sizes):
            monkeypatch.setattr(neighbours, name, v)
        frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as q", "2 as label")
        assert sorted(map(tuple, neighbours.nearest(frame).collect())) == brute(rows)


def test_small_tables(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])]
    assert sorted(map(tuple, neighbours.nearest(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(1, [1.0])], SCHEMA)).count() == 0
    assert sorted(map(tuple, neighbours.nearest(spark.createDataFrame([(0, [1.0]), (0, [1.0])], SCHEMA)).collect())) == [(0, 1, 0, 1.0)] * 2
    wild = [(0, [1e200, 2e200]), (1, [1e200, 1e200]), (2, [1e-300, 0.0]), (3, [0.0, 5e-324]), (50, [-1e200, 0.0]), (4, [1.0]), (5, [])]
    assert sorted(map(tuple, neighbours.nearest(spark.createDataFrame(wild, "vec_id long, embedding array<double>")).collect())) == brute(wild, kind=float)
