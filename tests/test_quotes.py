from tracemill.plans import PLANS

FOLD = str.maketrans({"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "Ø": "o", "ø": "o", "⌀": "o"})


def normal(text):
    return " ".join(text.lower().translate(FOLD).split())


def test_quotes_against_brute_force(spark, tmp_path):
    items = [(1, "bore 40 mm"), (2, "it's ⌀40 – “wide”, as the drawing of the left bracket says"), (3, "one two three four five six seven"), (4, "short"), (5, "a b c d"), (6, "holes"), (7, "not there at all")]
    docs = [
        (1, "The BORE  40\nmm deep"),
        (2, "see: It’s Ø40 - \"wide\", as the draw ing of the left bracket says."),
        (3, "zone two th ree four five six sevens"),
        (4, "short a b c dark holes"),
        (5, ""),
        (6, None),
        (7, "one " * 9),
    ]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(*d, "en") for d in docs], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(i, d) for i, q in items for d, t in docs if len(normal(q)) >= 6 and normal(q).replace(" ", "") in normal(t or "").replace(" ", "")]
    got = sorted(map(tuple, PLANS["txt_quotes"](spark, str(tmp_path)).select("item_id", "doc_id").collect()))
    assert got == want and len(want) == 4
