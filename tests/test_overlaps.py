"""Overlap joins through rare tokens against all pairs."""

import random

from pyspark.sql import functions as F

from tracemill.operators import keyed


def tables(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    text = lambda n: sorted(set(rng.choices(words, weights, k=n)))
    q = [(i, text(rng.randrange(0, 12))) for i in range(40)] + [(100, []), (101, ["nowhere"]), (102, ["w0"]), (103, ["w0", "nowhere", "w59"])]
    d = [(i, text(rng.randrange(0, 25)), text(rng.randrange(0, 4))) for i in range(150)] + [(500, [], []), (501, [], ["w0"])]
    return q, d, spark.createDataFrame(q, "q long, tokens array<string>"), spark.createDataFrame(d, "d long, tokens array<string>, title array<string>")


def test_best(spark):
    for seed, heavy, k, least, postings in ((1, 0, 3, 2, 256), (2, 0, 5, 1, 1), (3, 3, 2, 1, 20), (4, 3, 4, 5, 1)):
        q, d, qs, ds = tables(spark, seed)
        want = set()
        for i, a in q:
            scored = sorted((-(len(set(a) & set(t)) + heavy * len(set(a) & set(h))), j) for j, t, h in d)
            want |= {(i, j, -s, r) for r, (s, j) in enumerate([x for x in scored if -x[0] >= least][:k], 1)}
        got = keyed.Overlaps(qs, ds, "q", "d", heavy).best(k, least, postings)
        assert {tuple(r) for r in got.select("q", "d", "score", "rank").collect()} == want


def test_at_least(spark):
    q, d, qs, ds = tables(spark, 9)
    need = qs.select("q", F.least(F.lit(3), F.greatest(F.lit(1), F.size("tokens"))).alias("need"))
    want = {(i, j, n) for i, a in q for j, t, _ in d if (n := len(set(a) & set(t))) >= min(3, max(1, len(a)))}
    assert {tuple(r) for r in keyed.Overlaps(qs, ds, "q", "d").at_least(need).select("q", "d", "score").collect()} == want


def test_frequent_tokens_stay_out_of_the_join(spark):
    """Queries of one rare and many frequent tokens meet the rare one's texts only."""
    common = [f"c{k}" for k in range(20)]
    ds = spark.createDataFrame([(i, common + [f"r{i % 50}"]) for i in range(400)], "d long, tokens array<string>")
    qs = spark.createDataFrame([(i, common[:3] + [f"r{i}"]) for i in range(50)], "q long, tokens array<string>")
    o = keyed.Overlaps(qs, ds, "q", "d")
    need = qs.select("q", F.lit(4).alias("need"))
    followed = o.tokens.join(need, "q" if "q" in o.tokens.columns else o.tokens["_q"] == need["q"]).where(F.col("place") <= o._prefix(F.col("need")))
    assert {r["token"][0] for r in followed.collect()} == {"r"} and o.at_least(need).count() == 400


def test_none(spark):
    q, d, qs, ds = tables(spark, 1)
    assert keyed.Overlaps(qs.limit(0), ds, "q", "d").best(3).count() == 0
    assert keyed.Overlaps(qs, ds.limit(0), "q", "d").best(3).count() == 0


def test_pairs_are_not_shuffled(spark, monkeypatch):
    """Scores of many pairs are counted where the texts lie, repeated texts each by itself; the index gives the same."""
    q, d, qs, ds = tables(spark, 5)
    need = qs.select("q", F.lit(1).alias("need"))
    for heavy in (0, 2):
        want = sorted((i, j, n) for i, a in q for j, t, h in [*d, d[0]] if (n := len(set(a) & set(t)) + heavy * len(set(a) & set(h))) >= 1)
        for most in (keyed.MOST_BROADCAST, 0):
            monkeypatch.setattr(keyed, "MOST_BROADCAST", most)
            found = keyed.Overlaps(qs, ds if not most else ds.union(ds.where(f"d = {d[0][0]}")), "q", "d", heavy).at_least(need)
            got = sorted(tuple(r) for r in found.select("q", "d", "score").collect())
            assert got == (want if most else sorted(set(want)))
            if most:
                plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
                assert plan.count("Exchange hashpartitioning") == 1
        monkeypatch.undo()


def test_best_moves_few_pairs(spark, monkeypatch):
    """Only each task's best are dealt by query; where the tokens are too many to broadcast, the index gives the same."""
    q, d, qs, ds = tables(spark, 6)
    found = keyed.Overlaps(qs, ds, "q", "d", 3).best(2)
    got = sorted(tuple(r) for r in found.collect())
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 2 and "WindowGroupLimit" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(keyed, "MOST_BROADCAST", 0)
    assert got and got == sorted(tuple(r) for r in keyed.Overlaps(qs, ds, "q", "d", 3).best(2).collect())
