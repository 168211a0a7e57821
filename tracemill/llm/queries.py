"""The numbered queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from tracemill.llm import bpe, html, language, licenses, mixing, neighbours, packing, pitman_yor, quality, sharding, simhash, spelling, whitening
from tracemill.storage import table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(table(spark, sf_dir, "pages"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"), licenses.library())


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"), "doc_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scores(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), corpus_pipeline.tokenizer_path())


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), corpus_pipeline.tokenizer_path())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH v AS (SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT u, vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS l FROM v
      WHERE len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT q.u, q.vec_id AS query_id, c.vec_id,
             list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) / (q.l * c.l) AS score
      FROM w q JOIN w c ON q.vec_id % 50 = 0 AND c.u <> q.u AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, n::INT AS rank, vec_id, score FROM r WHERE n <= 5
"""

#: The checksum is told bit by bit, since DuckDB has no crc32; near words are pairs here.
OP11_SQL = """
WITH RECURSIVE e AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents),
d AS (SELECT doc, run, count(*) AS n FROM e GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [(192 | (ord(c) >> 6))::BIGINT, (128 | (ord(c) & 63))::BIGINT] END)) AS bytes FROM d),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda c, x: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda s, k: xor(s >> 1, 3988292384 * (s & 1)), xor(c, x)), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM b),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
o AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
c AS (SELECT word, n, left(word, i::INT) || substr(word, i::INT + 2) AS less, left(word, i::INT) || '*' || substr(word, i::INT + 2) AS hole FROM o),
p AS (SELECT a.word, b.word AS near, b.n FROM c a JOIN c b ON a.hole = b.hole AND a.word <> b.word
      UNION SELECT c.word, v.word, v.n FROM c JOIN v ON c.less = v.word UNION SELECT v.word, c.word, c.n FROM c JOIN v ON c.less = v.word),
g AS (SELECT word, count(*) AS n_near, max(n) AS most FROM p GROUP BY word),
f AS (SELECT g.word, min(p.near) AS form, g.most AS form_n FROM g JOIN p ON p.word = g.word AND p.n = g.most JOIN v ON v.word = g.word AND g.most >= 10 * v.n GROUP BY ALL),
r AS (SELECT word, word AS root, 0 AS depth FROM v UNION ALL SELECT r.word, f.form, depth + 1 FROM r JOIN f ON f.word = r.root),
l AS (SELECT word, arg_max(root, depth) AS root FROM r GROUP BY word)
SELECT v.word, f.form, l.root, v.n, coalesce(g.n_near, 0) AS n_near, f.form_n FROM v JOIN l USING (word) LEFT JOIN g USING (word) LEFT JOIN f USING (word)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html": op1_html,
        "op2_licenses": op2_licenses,
        "op3_sharding": op3_sharding,
        "op4_simhash": op4_simhash,
        "op5_language": op5_language,
        "op6_mixing": op6_mixing,
        "op7_pitman_yor": op7_pitman_yor,
        "op8_neighbours": op8_neighbours,
        "op9_quality": op9_quality,
        "op10_packing": op10_packing,
        "op11_spelling": op11_spelling,
        "op12_bpe": op12_bpe,
        "op13_whitening": op13_whitening,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_neighbours": OP8_SQL, "op11_spelling": OP11_SQL}
