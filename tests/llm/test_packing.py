import zlib
from collections import defaultdict

import numpy as np
import pytest

from tracemill.llm import packing, wordids
from corpus_pipeline import tokenizer_path

ODD = ["hello <|endoftext|> there", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|><|endoftext|>", "it's we'll a_b 12 x3y ÉCOLE straße <|endoftext|> a.b,c x́y İ ΣΑΣ ΟΔΟΣ, 中文字 ½ x² ٣ don't!? \x1c z", "", " \n", "A" * 500, "’s naïve—dash “q”"]


def ids_of(model, text):
    return [*model.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_word_ids_equal_the_tokenizers(model, monkeypatch):
    for kept in (wordids.WORDS_KEPT, 3):
        monkeypatch.setattr(wordids, "WORDS_KEPT", kept)
        known = wordids.WordIds(tokenizer_path())
        for text, got in zip(ODD * 2, known.texts(ODD * 2)):
            assert np.frombuffer(got, "<u4").tolist() == ids_of(model, text)[:-1]


def test_balance_is_near_equal():
    sizes = np.sort(np.random.default_rng(3).integers(1, 1000, 400))[::-1]
    load = np.bincount(packing.balance(sizes, 40), sizes, minlength=40)
    assert load.sum() == sizes.sum() and load.max() - load.min() < 60
    for sizes in ([4096] * 3, [3000] * 5, [1], [2000, 2000, 2000, 97, 97], []):
        w = packing.pack(np.array(sizes, np.int64))
        assert not len(w) or np.bincount(w, sizes).max() <= 4096


def test_packed_round_trip(spark, model):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, None), (7000, "same text"), (7000, "same text"), (8000, "long " * 20_000)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as start"), tokenizer_path()).collect()
    spans, want = defaultdict(list), defaultdict(list)
    for r in got:
        spans[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for d, t in rows:
        ids = np.array(ids_of(model, t), "<u4")
        cuts = [c[0] for c in spans[d]]
        for start, length, crc, n in spans[d]:
            assert crc == zlib.crc32(ids[start : start + length].tobytes()) and n == len(ids)
        want[d].append(len(ids))
        assert sum(c[1] for c in spans[d]) in (len(ids), 2 * len(ids)) and 0 in cuts
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for at in sequences.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= 4096
    tokens = sum(r["length"] for r in got)
    assert tokens == sum(sum(v) for v in want.values())
    assert len(sequences) * 4096 < 1.03 * tokens


def test_empty(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_ids_beyond_doubles(spark):
    ids = [2**60 + 1, None, 2**60 + 3]
    got = packing.packed(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string").coalesce(1), tokenizer_path()).collect()
    assert {r["doc_id"] for r in got} == set(ids)


def test_many_short_pieces():
    sizes = np.ones(786_432, np.int64)
    window = packing.pack(sizes)
    assert np.bincount(window, sizes).max() <= 4096 and window.max() + 1 <= 194


def test_new_words_of_many_texts_take_one_call(model, monkeypatch):
    texts = [f"only{chr(97 + i % 26)}here{chr(97 + i // 26)} Said it's, {i}" for i in range(300)]
    known, calls = wordids.WordIds(tokenizer_path()), []
    encode = known._ids
    monkeypatch.setattr(known, "_ids", lambda text: calls.append(text) or encode(text))
    assert [np.frombuffer(got, "<u4").tolist() for got in known.texts(texts)] == [ids_of(model, t)[:-1] for t in texts]
    assert len(calls) == 1
