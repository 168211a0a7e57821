import hashlib
import random
import unicodedata

import numpy as np
import pytest

from corpus_pipeline import tokenizer_path
from tracemill.llm import bpe

ODD = ["hello <|endoftext|> there", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|><|endoftext|>", "it's we'll 'Twas a_b 12 x3y ÉCOLE straße a.b,c x́y İ ΣΑΣ ΟΔΟΣ, 中文字 ½ x² ٣ don't!? \x1c \x00z     ﻿", "", " \n", "A" * 500, "’s naïve—dash “q”", "<|endoftext|", "ȩ́́ ﬁ ǅ Å"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    model.no_padding()
    model.no_truncation()
    return model


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(tokenizer_path())


def ids(own, text):
    return np.frombuffer(b"".join(own.encoded(text)), "<i4").tolist()


def test_equals_the_library(library, own):
    rng = random.Random(3)
    letters = "aAbBeE'sStT 1 2½²éÉȩ́Σσ ς\n\t<|>endoftext.,!?_-中文"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(3000)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(own, text) == want, text
        assert own.decoded(np.array(want, "i4")) == library.decode(want, skip_special_tokens=False)


def test_each_code_point(library, own):
    """All that Python's tables know, in steps through the larger planes."""
    for cp in [*range(0x3000), *range(0x3000, 0xD800, 37), *range(0xE000, 0x20000, 11)]:
        c = chr(cp)
        if unicodedata.category(c) in ("Cn", "Co"):
            continue
        text = f"{c} A{c}b{c}'{c}1"
        assert ids(own, text) == library.encode(text, add_special_tokens=False).ids, hex(cp)


def test_long_parts_by_heap_and_by_scan(library, own, monkeypatch):
    rng = random.Random(5)
    parts = ["".join(rng.choices("abcdehinorst", k=n)) for n in (2, 63, 64, 65, 200, 700)] + ["ab" * 150, "a" * 333]
    by_heap = [own._pieces_of_long(p + bpe.END) for p in parts]
    monkeypatch.setattr(bpe, "SHORT", 10_000)
    assert by_heap == [own.pieces(p + bpe.END) for p in parts]
    assert ids(own, "qz" * 100_000 + " " + "hello" * 40_000) == library.encode("qz" * 100_000 + " " + "hello" * 40_000, add_special_tokens=False).ids


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "PARTS_KEPT", 2)
    own = bpe.Bpe(tokenizer_path())
    for text in ODD * 2:
        assert ids(own, text) == library.encode(text, add_special_tokens=False).ids


def test_runs_of_a_long_text(own, monkeypatch):
    text = " ".join(ODD * 3)
    want = ids(own, text)
    monkeypatch.setattr(bpe, "STRETCH", 10)
    assert ids(own, text) == want and len([*own.encoded(text)]) > 20 and "".join(bpe._runs(text)) == text


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests(spark, library):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, None), (7000, "same"), (7000, "same"), (2**60 + 1, "long " * 200_000), (2**60 + 3, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as `a.b`", "3 as decoded")
    got = sorted((tuple(r) for r in bpe.digests(d, tokenizer_path()).collect()), key=str)
    want = []
    for i, t in rows:
        found = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(found), sha(" ".join(map(str, found))), sha(library.decode(found, skip_special_tokens=False))))
    assert got == sorted(want, key=str)


def test_ids_and_texts(spark, library):
    rows = [(i, t) for i, t in enumerate([*ODD, None])]
    got = bpe.tokenised(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path()).collect()
    for r in got:
        want = library.encode(dict(rows)[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_decode_of_null_and_unknown_ids(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(1, [3306, 267]), (2, None), (3, []), (4, [10**6, 267])], "k int, ids array<int>")
    got = {r["k"]: r["t"] for r in d.select("k", bpe.decode(F.col("ids"), tokenizer_path()).alias("t")).collect()}
    assert got == {1: "hello</w> ,</w>", 2: None, 3: "", 4: ",</w>"}
