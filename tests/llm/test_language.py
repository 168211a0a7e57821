import zlib

import numpy as np

from tracemill.llm import language


def test_gradients_match_differences():
    net = language.Network(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    codes, labels = np.array([[5, 1], [9, 5], [200, 5], [7, 30]]), np.array([2, 0])
    _, g = net.gradients(codes, labels)
    for k in net.p:
        for at in list(np.argwhere(np.abs(g[k]) > 1e-5))[:3]:
            at = tuple(at)
            was, e = net.p[k][at], 1e-5
            net.p[k][at] = was + e
            up, _ = net.gradients(codes, labels)
            net.p[k][at] = was - e
            down, _ = net.gradients(codes, labels)
            net.p[k][at] = was
            assert abs((up - down) / (2 * e) - g[k][at]) < 1e-4 * max(1, abs(g[k][at]))


def by_position(net, text):
    """Reads one window after another, one byte after another, from the definition."""
    raw, margin, core = text.lower().encode(), language.MARGIN, max(language.CORES)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    s = lambda x: x / (1 + abs(x))
    n, total = language.HIDDEN, 0

    def read(codes, d):
        h, out = np.zeros(n), []
        for c in codes:
            x, u = p["embed"][c] @ p[f"in_{d}"] + p[f"off_{d}"], h @ p[f"rec_{d}"]
            z, r = (s(x[:n] + u[:n]) + 1) / 2, (s(x[n : 2 * n] + u[n : 2 * n]) + 1) / 2
            h = (1 - z) * s(x[2 * n :] + r * u[2 * n :]) + z * h
            out.append(h)
        return out

    for a in range(0, len(raw), core):
        left = len(raw) - a
        size = next((c for c in language.CORES if left <= c), core)
        padded = b" " * margin + raw + b" " * (margin + size)
        window = padded[a : a + size + 2 * margin]
        f, b = read(window[: size + margin], "f")[margin:], read(window[margin:][::-1], "b")[::-1]
        for k in range(min(size, left)):
            e = np.exp(np.r_[f[k], b[k]] @ p["out"] + p["bias"])
            total = total + e / e.sum()
    return total / len(raw)


def test_reader_against_position_by_position(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = language.training_texts(docs)
    net = language.Network(len(texts))
    net.fit(list(texts.values()), steps=80)
    rows = [r["text"] for r in docs.orderBy("doc_id").limit(30).collect() if len(r["text"]) < 4000][:12] + ["é", "straße ÉCOLE", "a" * 224, "a" * 225]
    got = list(language.Reader(net, len(texts)).texts(rows))
    for text, p in zip(rows, got):
        assert np.allclose(p, by_position(net, text), atol=2e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(5000, None, "en"), (5001, " 12 !?", "en"), (5002, "", None), (None, "the thing and the", "en"), (5003, "x" * 5000, None)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(odd).selectExpr("*", "1 as _found", "2 as score")
    got = language.languages(both, "doc_id", "lang").collect()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    odd = {r["doc_id"]: r for r in got if r["doc_id"] is None or r["doc_id"] >= 5000}
    assert [odd[i]["lang_pred"] for i in (5000, 5001, 5002)] == ["und"] * 3 and odd[None]["lang_pred"] == "en" and odd[5003]["lang_pred"] != "und"
    held = [r for r in got if r["held_out"] and r["doc_id"] < 5000]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_texts_do_not_depend_on_others(monkeypatch):
    net = language.Network(2)
    net.fit([[b"the and of " * 9, b"x"], [b"der und ein " * 9]], steps=30)
    texts = ["the of the", "der ein " * 500, "of the", None, "zz der", "12"]
    one = [next(language.Reader(net, 2).texts([t])) for t in texts]
    for held in (language.HELD, 10):
        monkeypatch.setattr(language, "HELD", held)
        for a, b in zip(one, language.Reader(net, 2).texts(texts), strict=True):
            assert (a is None) == (b is None) and (a is None or np.allclose(a, b, atol=1e-4))


def test_word_order_matters():
    """The network's state goes on over spaces."""
    net = language.Network(2)
    net.fit([[b"the and of " * 9], [b"der und ein " * 9]], steps=30)
    a, b = language.Reader(net, 2).texts(["the of der ein and und", "und der the ein of and"])
    assert not np.allclose(a, b, atol=1e-6)


def test_stage_and_nothing_to_learn(spark):
    rows = spark.createDataFrame([(1, "abc", None, "s"), (2, None, None, "s"), (2**60 + 1, "1 2", None, "s")], "doc_id long, text string, lang string, `a.b` string")
    assert [r["lang_pred"] for r in language.languages(rows).collect()] == ["und"] * 3
    assert [r["doc_id"] for r in language.known_language(rows).collect()] == [1]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = language.known_language(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert language.languages(rows.limit(0), "doc_id").count() == 0


def test_known_language_heeds_what_is_predicted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    french = next(r for r in docs.where("lang = 'fr' and length(text) > 400").collect())
    ids = [d for d in range(9000, 9100) if zlib.crc32(str(d).encode()) % 4 == 2][:4]  # none is learnt from
    more = [(d, french.text, lang, french.source, len(french.text)) for d, lang in zip(ids, ("en", None, "xx", "fr"))]
    rows = docs.unionByName(spark.createDataFrame(more, docs.schema))
    kept = {r.doc_id for r in language.known_language(rows).collect()}
    assert {*ids[1:]} <= kept and ids[0] not in kept
    read = {r.doc_id: r.score for r in language.languages(rows, "doc_id").collect()}
    assert all(read[d] > language.TOLD for d in kept)
