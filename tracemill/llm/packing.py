"""Packing token sequences with Karmarkar-Karp multiway differencing.

Documents are tokenised where they are read. Each whole run of CAPACITY ids fills a sequence of its own;
what remains of a document is cut into pieces of at most PIECE ids. Pieces are dealt to blocks of about WINDOWS sequences. Within a
block, partial partitions (at first one piece each) are merged in the order of their imbalance, the
fullest window of one with the emptiest of the other, which leaves windows near-equal. If the fullest
exceeds the capacity, the block is packed again with one more window.

Defined results: a null or empty text has only the closing id; repeated rows are packed one by one; null
doc_ids are kept and ids of any size stay exact; an empty table gives no rows; the name of a special token within a
text is that token, as in the tokenizer's own call. Extra columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.batches import id_text
from tracemill.llm.wordids import word_ids
from tracemill.storage import checkpointed

CAPACITY, END_ID = 4096, 2
#: Most ids of a piece that shares its sequence: short enough for differencing to level the windows.
PIECE = 1024
#: Pieces shorter than this are first laid together.
BUNDLE = 64
#: Sequences of one block: the unit of work of one task.
WINDOWS = 192


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): runs of `capacity` ids, the rest in runs of at most `piece`."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, end = word_ids(tokenizer), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            out = []
            for found in known.texts(["" if t is None else t for t in b]):
                ids = memoryview(found + end)
                n, whole = len(ids) // 4, len(ids) // 4 // capacity * capacity
                cuts = [*range(0, whole, capacity), *range(whole, n, piece), n]
                out.append([{"start": at, "length": to - at, "ids_crc32": zlib.crc32(ids[4 * at : 4 * to]), "doc_tokens": n} for at, to in zip(cuts, cuts[1:], strict=False)])
            yield pd.Series(out)

    cut = F.pandas_udf(run, "array<struct<start:long, length:long, ids_crc32:long, doc_tokens:long>>")
    return docs.select(F.col("doc_id").cast("long"), F.explode(cut("text")).alias("_piece")).select("doc_id", "_piece.*")


def balance(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window of each size by multiway differencing: the largest imbalances are merged in opposite order."""
    slots = np.arange(windows)
    #: A partial partition: window sums, largest first, and for each the items or earlier partitions' windows in it.
    sums = {k: np.r_[s, np.zeros(windows - 1, np.int64)] for k, s in enumerate(sizes.tolist())}
    merged: dict[int, tuple[int, np.ndarray, int, np.ndarray]] = {}
    heap = [(-int(s), k) for k, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    new = len(sizes)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        place = np.empty(windows, np.int64)
        place[order] = slots  # where each window of a goes; b's k-th goes where a's last-k-th does
        sums[new] = both[order]
        merged[new] = (a, place, b, place[::-1])
        heapq.heappush(heap, (-int(both[order[0]] - both[order[-1]]), new))
        new += 1
    window = np.zeros(len(sizes), np.int64)
    todo = [(heap[0][1], slots)] if heap else []
    while todo:
        k, where = todo.pop()
        if k < len(sizes):
            window[k] = where[0]
        else:
            a, pa, b, pb = merged[k]
            todo += [(a, where[pa]), (b, where[pb])]
    return window


def bundled(sizes: np.ndarray, least: int = BUNDLE) -> np.ndarray:
    """Bundle of each size: sizes of `least` or more alone, smaller ones together, in order, up to about that size.

    A block's partial partitions are then bounded by its tokens, however short its pieces are.
    """
    small = sizes < least
    into = np.cumsum(np.where(small, sizes, 0)) // least
    alone = np.flatnonzero(~small)
    bundle = np.empty(len(sizes), np.int64)
    bundle[alone] = np.arange(len(alone))
    _, bundle[small] = np.unique(into[small], return_inverse=True)
    bundle[small] += len(alone)
    return bundle


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Window of each size; as few windows as fit, one more whenever the fullest exceeds the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    bundle = bundled(sizes)
    together = np.bincount(bundle, sizes).astype(np.int64)
    while True:
        window = balance(together, windows)
        if not len(sizes) or np.bincount(window, together, minlength=windows).max() <= capacity:
            return window[bundle]
        windows += 1


def _pack_block(block: pd.DataFrame, capacity: int) -> pd.DataFrame:
    block = block.sort_values(["length", "at"], ascending=[False, True], kind="stable", ignore_index=True)
    full = block["length"].to_numpy() == capacity
    window = np.cumsum(full) - 1
    if (~full).any():
        window[~full] = full.sum() + pack(block["length"].to_numpy()[~full], capacity)
    block["sequence_id"] = block["block"] * (1 << 32) + window
    block = block.sort_values(["sequence_id", "at"], kind="stable", ignore_index=True)
    block["offset"] = block.groupby("sequence_id")["length"].cumsum() - block["length"]
    return block.drop(columns=["block", "at"])


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece."""
    cut = checkpointed(pieces(docs, tokenizer, capacity)).withColumn("at", F.monotonically_increasing_id())
    tokens = cut.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, round(tokens / (capacity * WINDOWS)))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(blocks))).withColumn("doc_id", id_text())
    kinds = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    out = dealt.groupBy("block").applyInPandas(lambda b: _pack_block(b, capacity), kinds)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
