from collections import Counter

import corpus_pipeline as p
from tests.llm.test_quality import naive
from tests.llm.test_simhash import brute_kept
from tracemill.storage import written


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(9000, None, "en", "src0", 0), (9001, "1 2 3", "en", None, 5), (9002, "same words " * 3, None, "src0", 9)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).union(docs.limit(1))
    columns = docs.columns
    tables = [docs]
    for name, stage in p.STAGES:
        tables.append(written(stage(spark, tables[-1], sf)))
        assert name == "packing" or tables[-1].columns == columns
    rows = [Counter(map(tuple, t.collect())) for t in tables[:-1]]
    assert all(not (b - a) for a, b in zip(rows[:3], rows[1:4]))
    assert {r[0] for r in rows[0]} - {r[0] for r in rows[1]} == {9000, 9001}
    assert all(not naive(r[1])[5] for r in rows[2])
    kept = brute_kept([r[:2] for r in rows[2].elements()])
    assert sorted(r[0] for r in rows[3].elements()) == kept
    assert set(rows[4]) <= set(rows[3]) and max(rows[4].values()) <= 2
    pieces = tables[-1].collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(r[0] for r in rows[4].elements())
