"""Literal cases of the address, anchor, merge, citation and outline rules."""

import hashlib
import random
import time

from pyspark.sql import functions as F

from tracemill.functions import text as T
from tracemill.operators import geometry, keyed, sequences, statistics


def each(spark, values, rule):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["r"] for r in d.select("i", rule(F.col("v")).alias("r")).orderBy("i").collect()]


def test_public_address(spark):
    good = {
        "HTTP://Example.ORG": "http://example.org/", "https://a.example.org:443/x?q=1#top": "https://a.example.org/x?q=1", "http://8.8.8.8/": "http://8.8.8.8/",
        "http://172.32.0.1/": "http://172.32.0.1/", "https://[2606:4700::1111]/": "https://[2606:4700::1111]/", "http://example.org.": "http://example.org/",
    }
    bad = [
        "ftp://example.org/", "http://user@example.org/", "http://user:x@example.org/", "http://example.org:8080/", "https://example.org:80/", "http://localhost/",
        "http://a.local/", "http://b.internal/x", "http://10.0.0.1/", "http://127.0.0.1/", "http://192.168.1.1/", "http://169.254.169.254/", "http://172.16.0.1/",
        "http://100.64.0.1/", "http://224.0.0.1/", "http://0.0.0.0/", "http://[::1]/", "http://[fe80::1]/", "http://[2002:a00:1::]/", "http://[2001:db8::1]/", "http://[::ffff:10.0.0.1]/",
        "http://example.org/a b", "http://example.org/\\x", "http://ex%61mple.org/", "http://256.1.1.1/", "http://1.2.3/", "http://example.org/" + "a" * 8192, "", None,
    ]
    assert each(spark, [*good, *bad], T.public_address) == [*good.values(), *[None] * len(bad)]


def test_unwrapped(spark):
    cases = {
        "https://duckduckgo.com/l/?uddg=https%3A%2F%2Fa.org%2Fx%3Fy%3D1&rut=2": "https://a.org/x?y=1", "https://duckduckgo.com/about": "https://duckduckgo.com/about",
        "https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9hLm9yZy8_eA&n=1": "https://a.org/?x", "https://www.bing.com/search?u=a1aHR0": "https://www.bing.com/search?u=a1aHR0", "https://www.bing.com/ck/a?u=a1_w": None,
        "not an address": "not an address", None: None,
    }
    assert each(spark, list(cases), T.unwrapped) == list(cases.values())


def test_anchors(spark):
    assert [sorted(a) if a is not None else None for a in each(spark, ["The USB board of NanoPi 3 R5S", "what is the size", "a 1 22", None], T.anchors)] == [["nanopi", "of", "r5s"], ["is"], [], None]
    assert each(spark, ["the size the"], T.anchors) == [["the", "size"]]


def test_merged(spark):
    d = spark.createDataFrame([({"a": {"x": 1, "y": 2}, "b": {"z": 3}}, {"a": {"y": 5}, "c": {"w": 4}}), (None, {"a": {"x": 1}}), ({"a": None}, {"a": {"q": 1}})], "p map<string,map<string,int>>, q map<string,map<string,int>>")
    got = [r["m"] for r in d.select(keyed.merged("p", "q", 2).alias("m")).collect()]
    assert got == [{"a": {"x": 1, "y": 5}, "b": {"z": 3}, "c": {"w": 4}}, {"a": {"x": 1}}, {"a": {"q": 1}}]


def test_citations(spark):
    x, y, z = (f"web_{c * 12}" for c in "abc")
    answers = spark.createDataFrame([(1, f"[{x}] then [{y}], [{x}] and [{z}]"), (2, f"{x} [web_abc] [{y.upper()}]"), (3, None)], "answer int, text string")
    sources = spark.createDataFrame([(x, True), (y, False)], "id string, opened boolean")
    assert sorted(map(tuple, keyed.citations(answers, sources, "answer").collect())) == [(1, x, 1, "opened"), (1, y, 2, "discovered")]


def test_outline_roles(spark):
    square = lambda drawing, k, x, y, r: [(drawing, k, i, x + a * r, y + b * r) for i, (a, b) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))]
    l_shape = [(1, 5, i, float(x), float(y)) for i, (x, y) in enumerate(((100, 0), (140, 0), (140, 10), (110, 10), (110, 40), (100, 40)))]
    rows = square(1, 1, 0.0, 0.0, 20.0) + square(1, 2, 0.0, 0.0, 10.0) + square(1, 3, 1.0, 1.0, 3.0) + square(1, 4, 20.0, 0.0, 5.0) + l_shape
    rows += square(1, 6, 130.0, 30.0, 2.0) + square(1, 7, 105.0, 5.0, 2.0) + square(2, 1, 0.0, 0.0, 1.0) + [(2, 2, 0, 0.5, 0.0), (2, 2, 1, 0.0, 0.5)]
    d = spark.createDataFrame(rows, "drawing int, path_id int, i int, x double, y double")
    got = {(r["drawing"], r["path_id"]): (r["depth"], r["role"]) for r in geometry.outline_roles(d, 7.0).collect()}
    assert got == {(1, 1): (0, "outer"), (1, 2): (1, "hole"), (1, 3): (2, "outer"), (1, 4): (0, "outer"), (1, 5): (0, "outer"), (1, 6): (0, "outer"), (1, 7): (1, "hole"), (2, 1): (0, "outer"), (2, 2): (1, "hole")}


def test_streamed_folds(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(400), i) for k in "abc" for i in range(200)]
    d = spark.createDataFrame(rows, "k string, t long, i long")
    lines = d.select("k", F.col("i").cast("string").alias("name"), F.col("t").cast("string").alias("digest"))
    got = {r["k"]: (r["files"], r["sha256"]) for r in statistics.ordered_digest(lines, ["k"], "name", "digest").collect()}
    assert got == {k: (200, hashlib.sha256("\n".join(sorted(f"{i}\t{t}" for kk, t, i in rows if kk == k)).encode()).hexdigest()) for k in "abc"}
    limited = {r["k"]: (r["n"], r["refused"]) for r in sequences.fold(d, ["k"], ["t", "i"], lambda: sequences.FixedWindow(50, 20), "k string, n long, refused long").collect()}
    for k in "abc":
        opened, used, refused = -1000, 0, 0
        for t in sorted(t for kk, t, _ in rows if kk == k):
            if t - opened >= 50:
                opened, used = t, 0
            used += 1
            refused += used > 20
        assert limited[k] == (200, refused)
    near = sequences.near_prefix(d, ["k"], ["t", "i"], "t", 30, 3).groupBy("k").count().collect()
    for r in near:
        ts = sorted(t for kk, t, _ in rows if kk == r["k"])
        stops = [i for i in range(1, len(ts)) if ts[i] - ts[i - 1] > 3]
        assert r["count"] == min([30, *stops])


def test_expected_coverage(spark):
    d = spark.createDataFrame([("a",)] * 4 + [("b",)], "g string")
    got = {r["g"]: r for r in statistics.expected_coverage(d, "g", 1.0).collect()}
    assert abs(got["a"]["coverage"] - (1 - 0.8**5)) < 1e-12 and abs(got["b"]["overall"] - (1 - 0.8**5)) < 1e-12


def test_lookup_cache(spark):
    def told(rows, **more):
        d = spark.createDataFrame([("u", n, *r) for n, r in enumerate(rows)], "u string, lookup long, t long, subject int, aspect int, page boolean, failed boolean")
        got = sequences.fold(d, ["u"], ["t", "lookup"], lambda: sequences.LookupCache(**more), "u string, lookup long, outcome string").collect()
        return [r["outcome"] for r in sorted(got, key=lambda r: r["lookup"])]

    ok = lambda t, s, a=0: (t, s, a, False, False)
    assert told([ok(0, 1), ok(899, 1), ok(900, 1), ok(901, 1, 1)]) == ["fetched", "hit", "fetched", "fetched"]
    # two entries: the third pushes the first out, and a renewed one keeps its place
    assert told([ok(0, 1), ok(1, 2), ok(2, 3), ok(3, 1), ok(4, 3)], most=2) == ["fetched", "fetched", "fetched", "fetched", "hit"]
    assert told([ok(0, 1), ok(1, 2), ok(900, 1), ok(901, 3), ok(902, 1)], most=2) == ["fetched"] * 5
    bad = lambda t, s, page: (t, s, 0, page, True)
    assert told([bad(0, 1, False), ok(89, 1), ok(90, 1), bad(100, 2, True), (3699, 2, 1, True, False), (3700, 2, 1, True, False)]) == ["failed", "suppressed", "fetched", "failed", "suppressed", "fetched"]


def test_outlines_meet_without_their_corners_being_shuffled(spark):
    """Nested squares: a pair of outlines is tested where it meets; boxes meet once and get their depths."""
    n = 60
    rows = [("d", p, i, float(x * (p + 1)), float(y * (p + 1))) for p in range(n) for i, (x, y) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))]
    out = geometry.outline_roles(spark.createDataFrame(rows, "drawing string, path_id int, i int, x double, y double"), 1000.0)
    assert {r["path_id"]: r["depth"] for r in out.collect()} == {p: n - 1 - p for p in range(n)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def holds(outer, inner):
    """Even-odd rule for all corners of inner, and the boxes'."""
    box = lambda p: (min(x for x, _ in p), -max(x for x, _ in p), min(y for _, y in p), -max(y for _, y in p))
    if len(outer) < 3 or any(a > b for a, b in zip(box(outer), box(inner), strict=True)):
        return False
    for cx, cy in inner:
        cuts = 0
        for (sx, sy), (nx, ny) in zip(outer, outer[1:] + outer[:1], strict=True):
            cuts += (sy > cy) != (ny > cy) and cx < sx + (cy - sy) * (nx - sx) / (ny - sy)
        if cuts % 2 == 0:
            return False
    return True


def test_depths_of_all_forms(spark, monkeypatch):
    """Diamonds, rectangles, octagons, stars, bow ties, lines and points on a coarse grid, where many touch; in blocks too."""
    rng, shapes = random.Random(9), {}
    forms = [
        [(1, 0), (0, 1), (-1, 0), (0, -1)], [(-1, -1), (1, -1), (1, 1), (-1, 1)], [(2, 1), (1, 2), (-1, 2), (-2, 1), (-2, -1), (-1, -2), (1, -2), (2, -1)],
        [(0, 3), (1, 1), (3, 0), (1, -1), (0, -3), (-1, -1), (-3, 0), (-1, 1)], [(-2, -2), (2, 2), (2, -2), (-2, 2)], [(-1, 0), (1, 0)], [(0, 0)], [(-3, -1), (3, -1), (0, 2)],
        [(-2, -2), (2, -2), (2, -2), (2, 2), (0, 0), (-2, 2)], [(2, 0), (2, 2), (0, 2), (0, 0)],
    ]
    for p in range(400):
        form, r, x, y = rng.choice(forms), rng.choice((0.5, 1.0, 2.0, 3.7, 6.0, 11.1)), rng.randrange(-9, 9), rng.randrange(-9, 9)
        turned = form if rng.random() < 0.5 else form[::-1]
        shapes["ab"[p % 2], p] = [(x + r * a, y + r * b) for a, b in turned]
    rows = [(d, p, i, x, y) for (d, p), s in shapes.items() for i, (x, y) in enumerate(s)]
    rows += [("a", 900, 0, None, 1.0), ("a", 900, 1, 1.0, 1.0), (None, 901, 0, 0.0, 0.0)]
    want = {(d, p): sum(e == d and q != p and holds(t, s) for (e, q), t in shapes.items()) for (d, p), s in shapes.items()} | {("a", 900): 0, (None, 901): 0}
    points = spark.createDataFrame(rows, "drawing string, path_id int, i int, x double, y double")
    for corners in (geometry.CORNERS, 100):
        monkeypatch.setattr(geometry, "CORNERS", corners)
        assert {(r["drawing"], r["path_id"]): r["depth"] for r in geometry.outline_roles(points, 7.0).collect()} == want


def test_nested_outlines_are_not_compared_one_by_one(spark):
    """20,000 diamonds, each in all larger ones: 200 million pairs."""
    n, began = 20_000, time.monotonic()
    points = spark.range(n).selectExpr("0 as drawing", "id as path_id", "posexplode(array(struct(1d as a, 0d as b), struct(0d as a, 1d as b), struct(-1d as a, 0d as b), struct(0d as a, -1d as b))) as (i, p)")
    points = points.selectExpr("drawing", "path_id", "i", "(path_id + 1) * p.a as x", "(path_id + 1) * p.b as y")
    out = geometry.outline_roles(points, 1e6)
    assert out.where(f"depth <> {n - 1} - path_id").count() == 0 and out.count() == n
    assert time.monotonic() - began < 60
