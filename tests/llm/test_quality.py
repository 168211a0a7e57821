import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracemill.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string"


def naive(text):
    text = text or ""
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


ODD = [None, "", " \n\t", "a b c d e a b c d e", "a b c d e f a b c d e", "x x x x x x x x", "one\none\n\n \none \ntwo", "\x0b\x0c# * $%&|<> é\U0001f600", "a b c d " * 3 + "e", "w" * 1000]


def test_base_counts(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD)]
    rows += [(100 + r[0], r[1], None, None) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[1:7] for r in quality.verdicts(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as n_words")).collect()}
    assert got == {d: naive(t) for d, t, _, _ in rows}


def vector(text):
    n, chars, symbols, dup, rep, _ = naive(text)
    lines = len([x for x in (text or "").split("\n") if re.search("[^ \t-\r]", x)])
    values = np.log((chars + 250) / (n + 50)), np.log1p(100 * symbols / (n + 50)), np.log1p(10 * dup / (lines + 10)), np.log1p(10 * rep / (n + 50))
    return np.floor(256 * np.array(values) + 0.5)


def factor(cov):
    """Cholesky factor whose pivots are at least the floors."""
    low = np.zeros((4, 4))
    for i in range(4):
        for j in range(i):
            low[i, j] = (cov[i, j] - low[i, :j] @ low[j, :j]) / low[j, j]
        low[i, i] = max(cov[i, i] - low[i, :i] @ low[i, :i], (quality.FLOORS[i] * 256) ** 2) ** 0.5
    return low


def distances(x, m, low):
    return (np.linalg.solve(low, (x - m).T) ** 2).sum(0)


def weighted(x, f):
    m = f @ x / f.sum()
    return m, (x.T * f) @ x / f.sum() - np.outer(m, m)


def nearest_share(d2, taken):
    """Weight of each document: bins of distance in order until so many are taken, the last bin in part."""
    b, left, f = np.floor(16 * np.log2(1 + d2)), taken, np.zeros(len(d2))
    for v in np.unique(b):
        f[b == v] = min(1, max(0, left / (b == v).sum()))
        left -= (b == v).sum()
    return f, b


def blended(x, f, c, larger):
    """(w, m, low) of the weighted documents with those that the larger group (w, m, low) lends."""
    w = f.sum()
    own, cov = weighted(x, f) if w else (np.zeros(4), np.zeros((4, 4)))
    if larger is None:
        return w, own, factor(c * cov)
    v = min(quality.PRIOR, max(larger[0] - w, 0))
    m = (w * own + v * larger[1]) / (w + v)
    spread = w * (c * cov + np.outer(own - m, own - m)) + v * (larger[2] @ larger[2].T + np.outer(larger[1] - m, larger[1] - m))
    return w + v, m, factor(spread / (w + v))


def estimates(groups):
    """Of each (lang, source): (w, m, low). groups: vectors of each."""
    x = {k: np.array(v) for k, v in groups.items()}
    for lang, _ in groups:
        x[(lang,)] = np.concatenate([x[k] for k in groups if k[0] == lang])
    x[()] = np.concatenate([x[k] for k in groups])
    above = lambda k: None if not k else () if len(k) == 1 else k[:1]
    taken = lambda k: np.floor(0.75 * len(x[k])) if k else np.ceil(0.75 * len(x[k]))
    starts = []
    for start in (0, 1):
        found = {}
        for k, v in x.items():
            at = lambda p: np.sort(v, 0)[int(np.ceil(p * len(v))) - 1]  # noqa: B023, E731
            m, cov = (at(0.5), np.diag(((at(0.75) - at(0.25)) / 1.349) ** 2)) if start == 0 else weighted(v, np.ones(len(v)))
            found[k] = (1 if start == 0 else len(v), m, factor(cov))
        for _ in range(quality.STEPS):
            found = {k: blended(v, nearest_share(distances(v, *found[k][1:]), taken(k))[0], quality._consistent(0.75), found.get(above(k))) for k, v in x.items()}
        starts.append(found)
    best = {k: min((round(np.log(np.diag(s[k][2])).sum(), 9), n) for n, s in enumerate(starts)) for k in x}
    best = {k: starts[n][k] for k, (_, n) in best.items()}
    out = {}
    for k in groups:
        f, b = nearest_share(distances(x[k], *best[k][1:]), taken(k))
        f[b <= int(16 * np.log2(1 + quality._quantile(0.975, 4)))] = 1
        out[k] = blended(x[k], f, quality._consistent(0.975), best[above(k)])
    return out


def log_tail(d2, w):
    if w <= 5:
        return 0.0
    k = w - 4
    y = k / (k + 4 * d2 * w * k / (4 * (w - 1) * (w + 1)))
    return k / 2 * np.log(y) + np.log1p(k / 2 * (1 - y))


def test_estimates_match_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = docs.collect()
    got = {r["doc_id"]: r for r in quality.verdicts(docs).collect()}
    own = {}
    for r in rows:
        if not naive(r["text"])[5]:
            own.setdefault((r["lang"], r["source"]), []).append(vector(r["text"]))
    of = estimates(own)
    assert min(map(len, own.values())) < 8 < max(map(len, own.values()))
    for r in rows:
        if (r["lang"], r["source"]) not in of:
            assert not got[r["doc_id"]]["kept"]
            continue
        w, m, low = of[(r["lang"], r["source"])]
        (d2,) = distances(vector(r["text"])[None], m, low)
        assert abs(got[r["doc_id"]]["d2"] - d2) <= 1e-6 * max(1, d2)
        assert got[r["doc_id"]]["kept"] == (not naive(r["text"])[5] and log_tail(d2, w) >= np.log(quality.ALPHA))


def test_junk_in_groups_of_any_size(spark):
    """Symbol junk is rejected and prose kept in a source of 1 to 19 documents, beside a large source of the language."""
    import random

    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(800)]
    prose = lambda: " ".join(rng.choices(vocabulary, k=rng.randrange(60, 300)))
    junk = lambda: " ".join("#$%|*<>"[k % 7] * 3 + str(k) for k in rng.sample(range(10_000), 120))
    rows = [(k, prose(), "en", "large") for k in range(400)]
    for n in (1, 2, 3, 5, 8, 10, 14, 19):
        rows += [(1000 * n + k, prose(), "en", f"s{n}") for k in range(n - 1)] + [(1000 * n + 999, junk(), "en", f"s{n}")]
    got = {r["doc_id"]: r for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    wrong = {d for d, r in got.items() if r["base_failed"] or r["kept"] == (d % 1000 == 999)}
    assert not wrong


def test_tail_probability_by_simulation(spark):
    rng = np.random.default_rng(4)
    w, n = 12, 40_000
    x = rng.standard_normal((n, w, 4))
    m, c = x.mean(1), np.einsum("nwi,nwj->nij", x, x) / w
    c -= np.einsum("ni,nj->nij", m, m)
    d = rng.standard_normal((n, 4)) - m
    d2 = np.einsum("ni,nij,nj->n", d, np.linalg.inv(c * w / (w - 1)), d)
    for at in (5.0, 20.0, 60.0):
        p = np.exp(spark.range(1).select(quality._surprise(F.lit(at), F.lit(float(w)))).first()[0])
        assert abs(p - (d2 >= at).mean()) < 4 * (p / n) ** 0.5 + 1e-4


def test_clean_kept_and_junk_rejected(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.verdicts(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert all(r["kept"] for r in rows if r["quality"])
    assert sum(r["kept"] for r in rows if not r["quality"]) <= 0.1 * sum(not r["quality"] for r in rows) + 1


def test_stage_keeps_rows_and_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = quality.good_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in quality.verdicts(docs).where("kept").collect())


def test_empty_and_all_failed(spark):
    assert quality.verdicts(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = quality.verdicts(spark.createDataFrame([(None, None, None, None)] * 2, SCHEMA)).collect()
    assert [r["kept"] for r in rows] == [False, False]
    few = spark.createDataFrame([(2**60 + 1, "a few plain words that are all different from each other here", None, "s", 1)] * 3 + [(None, "x " * 50_000, "en", None, 2)], "doc_id long, text string, lang string, source string, `a.b` int")
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in quality.verdicts(few).collect()) == [(0, False)] + [(2**60 + 1, True)] * 3
    assert quality.good_documents(few).columns == few.columns and quality.good_documents(few).count() == 3
