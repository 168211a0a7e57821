import random

import numpy as np

from tracemill.llm import licenses, queries

INDEX = licenses.indexes(licenses.TEMPLATES)[0]
FILL = "stone river walked under the old bridge and sang of many small boats".split()


def prose(rng, n):
    return " ".join(rng.choice(FILL) for _ in range(n))


def full_alignment(template, text):
    """Best score and, for it, the most matched words and least words spanned (below zero), by the whole unbanded matrix."""
    row, best = [(0, 0, 0)] * (len(text) + 1), (0, 0, 0)
    for t in template:
        new = [(0, 0, 0)]
        for j, w in enumerate(text):
            s, m, n = row[j]
            step = (s + licenses.MATCH, m + 1, n - 1) if t == w else (s - licenses.MISS, m, n - 1)
            (s, m, n), (x, y, z) = row[j + 1], new[j]
            new.append(max(step, (s - licenses.MISS, m, n), (x - licenses.MISS, y, z - 1), (0, 0, 0)))
            best = max(best, new[-1])
        row = new
    return best


def test_exact_notices_and_their_spans():
    rng = random.Random(1)
    for name, notice in licenses.TEMPLATES.items():
        before = prose(rng, 40)
        text = f"{before}\n{notice}\n{prose(rng, 40)}"
        found = {x[0]: x for x in licenses.found_in(text, INDEX)}
        _, spans = licenses.words_of(notice)
        assert found[name][1:] == (len(before) + 1 + spans[0, 0], len(before) + 1 + spans[-1, 1], len(spans), len(spans), 1.0)


def test_changed_notices_against_brute_force():
    rng = random.Random(2)
    for turn in range(60):
        name, notice = rng.choice(list(licenses.TEMPLATES.items()))
        words = licenses.words_of(notice)[0]
        for at in rng.sample(range(len(words)), rng.randint(0, len(words) // 4)):
            words[at] = rng.choice(["", "changed", words[at] + " added"])
        text = f"{prose(rng, 30)} {' '.join(words)} {prose(rng, 30)}"
        template = licenses.words_of(notice)[0]
        _, matched, spanned = full_alignment(template, licenses.words_of(text)[0])
        found = [x for x in licenses.found_in(text, INDEX) if x[0] == name]
        if matched >= licenses.COVERAGE * max(len(template), -spanned):
            assert [x[3] for x in found] == [matched], (turn, name)
        else:
            assert all(x[3] >= licenses.COVERAGE * len(template) for x in found)


def test_one_change_in_a_short_line_and_many_places():
    assert [x[0] for x in licenses.found_in("Released under your MIT License.", INDEX)] == ["mit-line"]
    line = licenses.TEMPLATES["mit-line"]
    assert len(licenses.found_in(f"{line}\n" * 30, INDEX)) == 30
    assert licenses.found_in("the license of a driver, released under a bridge " * 50, INDEX) == []


def test_winnowing_keeps_one_of_each_window():
    words = np.random.default_rng(3).integers(0, 5, 200).astype(np.uint64)
    runs, at = licenses.winnowed(words)
    assert (np.diff(at) <= licenses.WINDOW).all() and at[0] < licenses.WINDOW and len(runs) < 198


def test_odd_rows_and_several_passes(spark):
    line = licenses.TEMPLATES["mit-line"]
    rows = [(1, None), (None, line), (2, ""), (3, "... --"), (4, line), (4, line), (5, "a " * 200_000 + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as license", "2 as coverage")
    want = [(None, "mit-line", 0), (4, "mit-line", 0), (4, "mit-line", 0), (5, "mit-line", 400_000)]
    for most in (licenses.MAX_POSTINGS, 60):
        got = licenses.scanned(docs, licenses.TEMPLATES | {"none": "-"}, most=most).collect()
        assert sorted(((r[0], r[1], r[2]) for r in got), key=lambda r: (r[0] or 0, r[2])) == want
    assert licenses.scanned(docs.limit(0)).count() == 0
    assert licenses.scanned(docs, {}).columns == licenses.scanned(docs).columns


def test_whole_table_has_every_line(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r["doc_id"], r["license"]) for r in licenses.scanned(docs).collect()}
    for name in ("apache-2.0-line", "mit-line", "gpl-3.0-line", "cc-by-nc-4.0-line"):
        want = {r[0] for r in docs.where(docs["text"].contains(licenses.TEMPLATES[name])).select("doc_id").collect()}
        assert want and want <= {i for i, n in got if n == name}


def test_registered_library_finds_whole_texts_and_notices(spark, tmp_path):
    rng = random.Random(4)
    library = licenses.library()
    names = sorted(library)
    for wanted in ("bsd-3-clause-text", "lgpl-2.1-notice", "agpl-3.0-notice", "gpl-2.0-text", "cc-by-4.0-notice", "cc-by-sa-4.0-text", "cc0-1.0-text", "unlicense-text", "bsl-1.0-text", "isc-text"):
        assert wanted in library
    rows = [(i, f"{prose(rng, 40)}\n{library[name]}\n{prose(rng, 40)}") for i, name in enumerate(names)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["license"], r["coverage"]) for r in queries.op2_licenses(spark, str(tmp_path)).collect()}
    assert {(i, name, 1.0) for i, name in enumerate(names)} <= got


def test_ids_beyond_doubles(spark):
    ids = [2**60 + 1, None, 2**60 + 3]
    d = spark.createDataFrame([(i, licenses.TEMPLATES["mit"]) for i in ids], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in licenses.scanned(d).collect()} == set(ids)
