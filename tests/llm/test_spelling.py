import random
import re
import zlib
from collections import Counter

from tracemill.llm import spelling

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def words_of(rows):
    """The words as the rule tells them, one occurrence at a time."""
    found = Counter()
    for doc_id, text in rows:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    vocab, out = words_of(rows), {}
    for w, n in vocab.items():
        others = [v for v in vocab if v != w and near(w, v)]
        best = min(others, key=lambda v: (-vocab[v], v), default=None)
        form = best if best and vocab[best] >= 10 * n else None
        out[w] = [form, None, n, len(others), vocab[form] if form else None]
    for w, row in out.items():
        row[1] = w
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return sorted((w, *r) for w, r in out.items())


def told(d):
    return sorted(tuple(r) for r in d.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_tables_rows_against_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert told(spelling.variants(docs)) == brute(rows)


def edited(word, rng):
    k, c = rng.randrange(len(word)), rng.choice("abcdeé÷ÀÿZ")
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :]])


def test_chains_ties_and_letters(spark):
    rng = random.Random(7)
    base = ["aaaaaaaa", "committee", "fenêtres", "naÏvetés", "sevenle", "abababab"]
    pool = base + [edited(w, rng) for w in base for _ in range(25)]
    pool += [edited(w, rng) for w in pool for _ in range(3)]
    texts = [(k, " ".join(rng.choices(pool, [40 if w in base else 1 for w in pool], k=80))) for k in range(300)]
    # a chain of forms: each ten times as frequent as the one before
    chain = [("chainaaa", 2000), ("chainaab", 200), ("chainabb", 20), ("chainbbb", 2)]
    texts += [(5000 + k, f"{w}-" * n) for k, (w, n) in enumerate(chain)]
    texts += [(None, "nullable1nullable"), (1, None), (2, ""), (3, "Same WORDING here"), (3, "Same WORDING here"), (2**60 + 1, "biggest words"), (9, "verylongtext " * 50_000), (10, "x" * 300_000)]
    d = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as word", "2 as `a.b`", "3 as n", "'q' as doc")
    got = told(spelling.variants(d))
    assert got == brute(texts)
    assert len({r[2] for r in got if r[0].startswith("chain")}) >= 1 and any(r[1] for r in got) and any(r[1] != r[2] for r in got if r[1])


def test_no_pairs_of_a_group(spark):
    """A wildcard group of k words makes k rows, not their pairs."""
    letters = [c for c in spelling.LOWER] + [chr(c) for c in range(0xE0, 0x100)]
    vocab = spark.createDataFrame([("wordpl" + c, k + 2) for k, c in enumerate(letters)], "word string, n long")
    rows = spelling.replacements(vocab).collect()
    assert len(rows) == len(letters) and all(r["near"] == len(letters) - 1 for r in rows)
    top = "wordpl" + letters[-1]
    assert all((r["best"]["word"] == top) == (r["word"] != top) for r in rows)


def test_empty(spark):
    for rows in ([], [(1, None)], [(1, "short one two")]):
        assert spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
