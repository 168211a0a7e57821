import numpy as np
import pandas as pd
import xxhash

from tracemill.llm import simhash


def naive_print(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint_matches_naive():
    for t in [None, "", " \n", "One", "a b c d", "a b c d e", "É a\tB\x0bC  d e f g " * 7, " x y z w q"]:
        assert simhash.fingerprint(t) == naive_print(t)


def test_keys_meet_within_four_bits():
    rng = np.random.default_rng(1)
    for bits in (0, 1, 2, 3, 4):
        for _ in range(300):
            x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
            y = x
            for b in rng.choice(64, bits, replace=False):
                y ^= 1 << int(b)
            row, key = simhash.keys_of(np.array([x, y], np.uint64))
            assert set(key[row == 0]) & set(key[row == 1])


def brute(rows):
    fps = [naive_print(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows) if d is not None)


def test_components_match_brute_force(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 30
    rows += [(1000, None), (1001, ""), (1002, "x y"), (1002, "x y"), (None, "x y"), *((2000 + i, base + f"w{i}") for i in range(60))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as key")
    for block in (20_000, 7):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = simhash.near_duplicates(frame).where("doc_id is not null").collect()
        assert sorted(map(tuple, got)) == brute(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_beyond_doubles(spark):
    ids = [2**60 + 1, None, 2**60 + 3]
    d = spark.createDataFrame([(i, f"text number {k}") for k, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in simhash.near_duplicates(d).collect()} == set(ids)


def test_stage_is_the_same_each_time(spark):
    rows = [(1, "some words of a text", "x"), (1, "some words of a text", "y"), (2, "some words of a text", "z"), (2**60 + 1, "another text", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    got = [sorted(map(repr, simhash.one_of_each_group(docs.orderBy(order)).collect())) for order in ("`a.b`", "text")]
    assert got[0] == got[1] and len(got[0]) == 3


def shingle_set(text, size=5):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_groups(rows):
    """Component of each (doc_id, text): links of five-word Jaccard similarity 0.8 or more, all pairs compared."""
    sets = [shingle_set(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not either or both >= 0.8 * either:
                comp[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def brute_kept(rows):
    """Smallest doc_id of each component."""
    least = {}
    for (d, _), c in zip(rows, brute_groups(rows), strict=True):
        least[c] = min(least.get(c, d), d)
    return sorted(least.values())


def edited(rng, words, changes):
    out = list(words)
    for at in rng.choice(len(out), changes, replace=False):
        out[at] = f"changed{rng.integers(1 << 30)}"
    return " ".join(out)


def test_stage_finds_unequal_copies(spark):
    """Groups of 1 to 40 unequal copies at 0.8 and above, texts that share half, long and very short ones."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(120):
        size = int(rng.integers(60, 400)) if g else 6000
        words = [f"w{rng.integers(20000)}" for _ in range(size)]
        copies = 40 if g == 1 else int(rng.integers(0, 4))
        rows.append(" ".join(words))
        rows += [edited(rng, words, max(1, size // 60)) for _ in range(copies)]
        rows.append(" ".join(words[: size // 2] + [f"v{rng.integers(20000)}" for _ in range(size // 2)]))
    rows += [None, "", " \n", "one two", "One  two", "one three", "a b c d e", "a b c d f"]
    rows = list(enumerate(rows))
    got = simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept, wanted = {r["doc_id"] for r in got}, set(brute_kept(rows))
    # sketches of the texts of 6,000 words are estimates
    assert len(wanted - kept) <= 1 and len(kept - wanted) <= 0.02 * (len(rows) - len(wanted))


def test_stage_on_odd_tables(spark):
    empty = simhash.one_of_each_group(spark.createDataFrame([], "doc_id long, text string, key int"))
    assert empty.columns == ["doc_id", "text", "key"] and empty.count() == 0
    long_text = " ".join(f"word{i}" for i in range(200_000))
    rows = [(2**60 + 1, long_text, 1), (2**60 + 3, long_text + " end", 2), (None, long_text, 3), (7, "x", 4), (7, "x", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `set` int").withColumnsRenamed({"set": "id"})
    assert sorted(r["doc_id"] for r in simhash.one_of_each_group(docs).collect()) == [7, 2**60 + 1]


def test_sketches_are_kept_of_candidates_only(spark, monkeypatch):
    rng, held = np.random.default_rng(4), []
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 5000, 120))) for i in range(60)]
    rows += [(100, rows[7][1] + " more"), (101, rows[8][1]), (101, rows[8][1])]

    def kept(df):
        out = plain(df)
        held.append(out)
        return out

    plain = simhash.written
    monkeypatch.setattr(simhash, "written", kept)
    got = simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(60))
    sketched = [t for t in held if "sketch" in t.columns]
    assert sketched and all(t.count() == 2 for t in sketched)  # 7 and 100


def test_whole_rows_are_moved_once(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        rows = [(i, f"text number {i // 2} of {i // 2}") for i in range(40)]
        out = simhash.one_of_each_group(spark.createDataFrame(rows * 2, "doc_id long, text string"))
        assert sorted(r["doc_id"] for r in out.collect()) == list(range(0, 40, 2))
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    finally:
        spark.conf.set(name, before)
    # by the digest of a row: the rows, and the chosen digests
    assert len([x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and ("one#" in x or "_digest#" in x)]) == 2


def test_rows_that_are_alone_are_not_moved(spark):
    name, sc = "spark.sql.autoBroadcastJoinThreshold", spark.sparkContext._jsc.sc()
    before = spark.conf.get(name)

    def moved():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).head().totalShuffleWrite()

    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 1 << 30, 4000))) for i in range(150)]
    rows += [(200, rows[7][1] + " more"), (201, rows[8][1]), (9, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set(name, "-1")
    try:
        start = moved()
        got = simhash.one_of_each_group(docs).collect()
        assert sorted(r["doc_id"] for r in got) == list(range(150))
        assert moved() - start < 0.4 * sum(len(t) for _, t in rows)
    finally:
        spark.conf.set(name, before)


def near_the_limit(rng, groups, copies):
    """Groups of unequal copies of texts that aren't there themselves; many pairs lie just below the similarity of a link."""
    rows = []
    for _ in range(groups):
        words = [f"w{rng.integers(20000)}" for _ in range(300)]
        rows += [edited(rng, words, int(rng.integers(3, 6))) for _ in range(copies)]
    return list(enumerate(rows))


def test_links_that_a_forest_of_candidates_passes_by(spark, monkeypatch):
    rows = near_the_limit(np.random.default_rng(11), 12, 25)
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string"), brute_kept(rows)
    assert sorted(r["doc_id"] for r in simhash.one_of_each_group(docs).collect()) == wanted
    monkeypatch.setattr(simhash, "MEMBERS", 4)  # groups of several blocks
    assert sorted(r["doc_id"] for r in simhash.one_of_each_group(docs).collect()) == wanted


def test_links_within_a_forest_of_fingerprints(spark, monkeypatch):
    """Without the bands: a fingerprint's links are verified although a forest of the bucket goes another way."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    rows = list(enumerate(edited(rng, words, int(rng.integers(4, 8))) for _ in range(60)))
    sets = [shingle_set(t) for _, t in rows]
    fps = [simhash._majority(simhash._hashes(t, 5)) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    monkeypatch.setattr(simhash, "_banded", lambda sets: sets.selectExpr("id", "id as other").limit(0))
    got = {r["doc_id"] for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) <= len(set(comp))
