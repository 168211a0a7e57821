"""Guarded splits against a plain greedy over all groups."""

import hashlib
import random

from tracemill.operators import splits


def plain(pairs, seed):
    apps_of, groups_of = {}, {}
    for app, g in pairs:
        apps_of.setdefault(g, set()).add(app)
        groups_of.setdefault(app, set()).add(g)
    split = dict.fromkeys(apps_of, "train")
    for app in sorted(groups_of, key=lambda a: (len(groups_of[a]), a)):
        n = len(groups_of[app])
        for name, least in (("validation", 2), ("test", 3)):
            want = max(1, round(n * 0.1)) if n >= least else 0
            for g in sorted(groups_of[app], key=lambda g: hashlib.sha256(f"{seed}/{g}".encode()).hexdigest()):
                if sum(split[h] == name for h in groups_of[app]) >= want:
                    break
                if split[g] == "train" and all(sum(split[h] == "train" for h in groups_of[a]) > 1 for a in apps_of[g]):
                    split[g] = name
    return split


def told(spark, pairs, seed="s"):
    d = spark.createDataFrame(pairs, "app string, grp long")
    return {r["grp"]: r["split"] for r in splits.guarded_splits(d, seed).collect()}


def test_greedy(spark):
    for seed in range(3):
        rng = random.Random(seed)
        pairs = {(f"a{rng.randrange(8)}", g) for g in range(120) for _ in range(rng.choice([1, 1, 1, 2, 4]))}
        pairs |= {(f"small{k}", 1000 + k * 2 + j) for k in range(4) for j in range(k)} | {("small3", 5), ("lone", 7), ("pair", 8), ("pair", 9), ("a1", 8), ("other", 8)}
        got = told(spark, sorted(pairs), f"s{seed}")
        assert got == plain(pairs, f"s{seed}")
        for app in {a for a, _ in pairs}:
            assert "train" in {got[g] for a, g in pairs if a == app}


def test_nulls_repeats_and_none(spark):
    pairs = [("a", g) for g in range(30)] + [("a", 3), (None, 4), ("b", None), (None, None)]
    assert told(spark, pairs) == plain({(a, g) for a, g in pairs if a and g is not None}, "s")
    assert told(spark, []) == {}


def test_artifacts_join_workflows(spark):
    w = spark.createDataFrame([(i,) for i in range(8)], "workflow long")
    a = spark.createDataFrame([(1, "x"), (4, "x"), (4, "y"), (6, "y"), (2, None), (3, None), (5, "z"), (5, "z")], "workflow long, artifact string")
    assert {r["workflow"]: r["grp"] for r in splits.artifact_groups(w, a).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 1, 5: 5, 6: 1, 7: 7}
