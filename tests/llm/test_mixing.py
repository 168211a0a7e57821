import math
import re
from collections import defaultdict

import pytest

from tracemill.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def naive_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    t, fixed, left = {}, {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        t = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 2 * sizes[s]]
        if not over:
            return fixed | t
        for s in over:
            fixed[s] = 2 * sizes[s]
            left -= fixed[s]


def check(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as size", "2 as src", "3 as salt")
    got = mixing.mixed(frame).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mixed(frame).collect()))
    words = [(d, len([w for w in re.split("[ \t-\r]+", t or "") if w]), s) for d, t, s in rows]
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, n, s in words:
        sizes[s] += n
        largest[s] = max(largest[s], n)
    want = naive_targets(sizes)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["source_size"]) for r in got) == sorted((d is None, d or 0, n, sizes[s]) for d, n, s in words)
    taken, target = defaultdict(int), {}
    of = defaultdict(set)
    for d, n, s in words:
        of[(d, n, sizes[s])].add(s)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        (s,) = of[(r["doc_id"], r["size"], r["source_size"])]
        taken[s] += r["taken"]
        assert r["target"] == pytest.approx(want[s])
    for s in sizes:
        # copies are whole: a document that is most of its source can't be split
        assert abs(taken[s] - want[s]) <= 0.005 * want[s] + 2 + largest[s] * (2 * largest[s] > sizes[s]), (s, taken[s], want[s])


def test_targets_and_rounding(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").collect()]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(i, "w " * (i % 13), None if i % 4 == 0 else "ab\U0001f600é"[i % 4]) for i in range(200)]
    rows += [(500 + i, "same text here", "hot") for i in range(300)] + [(1, "", "void"), (2, None, "void"), (None, "x y", "hot"), (None, "x y", "hot")]
    rows += [(900, "long " * 50_000, "a")]
    check(spark, rows)
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    mix = mixing.mixture(spark.createDataFrame(rows, SCHEMA))
    assert mix.columns == ["doc_id", "text", "source"] and mix.count() > 0


def test_dual_against_bisection(spark):
    levels = [("=a", k, 3 + k % 5) for k in range(1, 200, 3)] + [("=b", 7, 50), ("=b", 9000, 1), ("", 3, 4)]
    size = {s: sum(k * n for x, k, n in levels if x == s) for s in ("=a", "=b", "")}
    count = {s: sum(n for x, _, n in levels if x == s) for s in size}
    mean = {s: size[s] / count[s] for s in size}
    goal = {"=a": 0.2 * size["=a"], "=b": 1.7 * size["=b"], "": 1.99 * size[""]}
    got = mixing._solve(spark.createDataFrame(levels, "src string, size long, n long"), mean, goal)
    for s in size:
        low, high = -1e3, 1e3
        for _ in range(200):
            lam = (low + high) / 2
            took = sum(2 * n * k / (1 + math.exp(-max(-700, min(700, lam * k / mean[s])))) for x, k, n in levels if x == s)
            low, high = (low, lam) if took > goal[s] else (lam, high)
        assert got[s] == pytest.approx(low, rel=1e-4, abs=1e-6)
