"""Exact nearest neighbours by cosine with int8 product tiles.

Vectors are scaled to unit length and rounded to int8 with a scale of their own; the rounding error's
length is kept. Query blocks meet candidate blocks in a block join; a tile's int8 products give each
cosine to within a bound that follows from both error lengths (Cauchy-Schwarz). A pair survives unless
its upper bound is below the tile's K-th best lower bound for that query. Survivors are recomputed in
double precision from the original vectors and the tiles' best lists are merged by heaps.

Defined results: null vectors, and those with only zeros or with a null or non-finite component, take no part; a row
with a null vec_id is no query and no candidate. Vectors are compared with those of the same number of components. Of
rows with one vec_id each is a query (several lists then bear that query_id) and a candidate of the others. Components
of any finite size are scaled by a power of two before they are squared, which doesn't change a score. Fewer than K
candidates give all. Extra columns of the input are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.storage import written

K, QUERY_EVERY = 5, 50
#: Vectors of a query block, of a candidate block, and of a tile's two sides. A candidate travels once for each query block.
QUERY_BLOCK, SIDE, ROWS, TILE = 16384, 16384, 1024, 4096
LEVELS = 127


def valid(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, embedding) of the rows that take part; row tells rows with one vec_id apart."""
    known = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & known)
    return written(rows.withColumn("row", F.monotonically_increasing_id()))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, the largest component from 1/2 to 1: exact, and squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def lengths(v: np.ndarray) -> np.ndarray:
    """Euclidean lengths, components added in order."""
    return np.sqrt(np.cumsum(v * v, axis=1)[:, -1])


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers from -127 to 127 (as floats, for matrix products), each row's scale and error length."""
    unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / LEVELS
    whole = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - whole * scale[:, None]) ** 2).sum(axis=1))
    return whole, scale, error


def _tile(q: tuple, c: tuple, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) indices of the pairs that may be among a query's k best of the tile."""
    (qw, qs, qe), (cw, cs, ce) = q, c
    # products of int8 are whole numbers below 2^24 for up to 1000 components, so float32 holds them exactly
    kind = np.float32 if qw.shape[1] <= 1000 else np.float64
    near = (qw.astype(kind) @ cw.astype(kind).T).astype(np.float64) * (qs[:, None] * cs[None, :])
    slack = qe[:, None] + (1 + qe[:, None]) * ce[None, :] + 1e-12
    near[own], slack = -np.inf, np.broadcast_to(slack, near.shape)
    least = np.partition(near - slack, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
    return np.nonzero((near + slack >= least[:, None]) & ~own)


def _cosines(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    return np.cumsum(a * b, axis=1)[:, -1] / (la * lb)


def _search(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one candidate block for each query of one query block, kept in a heap a query."""
    out = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
    if len(queries) and len(block):
        qr, qi, qv = queries["row"].to_numpy(), queries["vec_id"].to_numpy(), scaled(np.stack(queries["embedding"].to_numpy()))
        cr, ci, cv = block["row"].to_numpy(), block["vec_id"].to_numpy(), scaled(np.stack(block["embedding"].to_numpy()))
        ql, cl, heaps = lengths(qv), lengths(cv), [[] for _ in qi]
        for q in range(0, len(qi), ROWS):
            side = quantised(qv[q : q + ROWS])
            for c in range(0, len(ci), TILE):
                rows, cols = _tile(side, quantised(cv[c : c + TILE]), qr[q : q + ROWS, None] == cr[None, c : c + TILE], k)
                rows, cols = rows + q, cols + c
                scores = _cosines(qv[rows], cv[cols], ql[rows], cl[cols])
                for r, s, i in zip(rows.tolist(), scores.tolist(), ci[cols].tolist(), strict=True):
                    _offer(heaps[r], s, i, k)
        found = [(row, i, -n, s) for row, i, h in zip(qr.tolist(), qi.tolist(), heaps, strict=True) for s, n in h]
        out = dict(zip(out, zip(*found, strict=True), strict=True)) if found else out
    return pd.DataFrame(out).astype({"query_row": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})


def _offer(heap: list, score: float, vec_id: int, k: int) -> None:
    if len(heap) < k:
        heapq.heappush(heap, (score, -vec_id))
    elif (score, -vec_id) > heap[0]:
        heapq.heapreplace(heap, (score, -vec_id))


def _merged(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Merges the blocks' lists of each query; rows come sorted by query."""
    query, heap = None, []

    def best() -> list[tuple]:
        return [(query[1], n, -i, s) for n, (s, i) in enumerate(sorted(heap, reverse=True), 1)]

    names = ["query_id", "rank", "vec_id", "score"]
    for b in batches:
        done = []
        for row, q, i, s in zip(b["query_row"].tolist(), b["query_id"].tolist(), b["vec_id"].tolist(), b["score"].tolist(), strict=True):
            if (row, q) != query:
                done += best() if heap else []
                query, heap = (row, q), []
            _offer(heap, s, i, k)
        yield pd.DataFrame(done, columns=names)
    if heap:
        yield pd.DataFrame(best(), columns=names)


def nearest(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest candidates of each row whose vec_id `every` divides."""
    rows = valid(vectors).withColumn("size", F.size("embedding"))
    asked = rows.where(F.col("vec_id") % every == 0)
    n, n_asked = rows.count(), asked.count()
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n_asked // QUERY_BLOCK))
    sides = max(1, -(-n // SIDE), -(-parts // blocks))
    # each query goes to every candidate block and each candidate to every query block
    dealt = lambda salt, into: F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(into))
    every_one = lambda into: F.explode(F.sequence(F.lit(0), F.lit(into - 1)).cast("array<long>"))
    columns, key = ["row", "vec_id", "embedding", "size"], ["size", "q", "c"]
    left = asked.select(*columns, dealt(3, blocks).alias("q"), every_one(sides).alias("c"))
    right = rows.select(*columns, dealt(7, sides).alias("c"), every_one(blocks).alias("q"))
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda a, b: _search(a, b, k), "query_row long, query_id long, vec_id long, score double")
    lists = found.repartition(parts, "query_row").sortWithinPartitions("query_row")
    return lists.mapInPandas(lambda batches: _merged(batches, k), "query_id long, rank int, vec_id long, score double")
