"""BPE encoding and decoding by a contiguous rank array.

A text is cut as the tokenizer file says: names of special tokens first, then each stretch between them is normalised
(NFC, white space, lower case) and cut into parts by the file's pattern. A part's bytes are merged on two flat arrays:
the boundaries of its present pieces, and the rank of each adjacent pair. The least rank (the leftmost of equals) is
looked up by a scan, its boundary deleted, and the ranks left and right of it refreshed, until no pair has a rank.
A scan a merge suits short parts; parts over SHORT symbols take their least rank from a heap instead, with the same
result.

Nothing in the cut or the merges reaches across ASCII white space, so a long text is encoded run by run between spaces.
A Python worker remembers the ids of up to PARTS_KEPT parts and then starts anew.

Defined results: a null or empty text has no ids, and decodes to the empty string; the name of a special token within a
text is that token; repeated rows are encoded one by one; null doc_ids are kept; an empty table gives no rows. Extra
columns of the input are ignored. Code points that are newer than the Unicode tables of Python (15.1) may be cut otherwise than by
the tokenizers library; all others are cut alike (checked one by one).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols of a part that is merged by scans; longer ones use a heap.
SHORT = 64
#: Parts that a worker remembers (some 200 MB). Beyond these it forgets and starts again; results don't change.
PARTS_KEPT = 1_000_000
#: Characters of a part that is worth remembering.
LONGEST_KEPT = 100

#: Characters of a text that are cut into parts together.
STRETCH = 1 << 18

SPACE = re.compile(r"[ \t-\r]")
#: Stands for the end-of-word suffix, so that a piece is a slice of one string.
END = "\0"
NONE = 1 << 60


def byte_letters() -> list[str]:
    """The letter of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Bpe:
    """Encoder and decoder of a BPE tokenizer file with byte-level letters and an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        suffix = model["end_of_word_suffix"] or ""
        inner = lambda t: t[: -len(suffix)] + END if suffix and t.endswith(suffix) else t
        self.letters = byte_letters()
        self.ids = {inner(t): i for t, i in model["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(inner(a), inner(b)): k for k, (a, b) in reversed([*enumerate(pairs)])}
        #: of letters before any merge one slice tells the pair
        self.letter_ranks = {a + b: k for (a, b), k in self.ranks.items() if len(a) == 1 and len(b.removesuffix(END)) == 1}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.names = np.array([names.get(i, "") for i in range(max(names) + 1)], object)
        self.parts: dict[str, bytes] = {}

    def pieces(self, word: str) -> list[str]:
        """Pieces of a part's letters (the last one is END) after all merges."""
        if len(word) - 1 > SHORT:
            return self._pieces_of_long(word)
        rank, first, n = self.ranks.get, self.letter_ranks.get, len(word) - 1
        bounds = [*range(n), n + 1]  # the last letter holds END
        ranks = [first(word[a : a + 2], NONE) for a in range(n - 2)]
        ranks += [first(word[n - 2 :], NONE)] if n > 1 else []
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((word[bounds[i] : bounds[i + 1]], word[bounds[i + 1] : bounds[i + 2]]), NONE)
            if i:
                ranks[i - 1] = rank((word[bounds[i - 1] : bounds[i]], word[bounds[i] : bounds[i + 1]]), NONE)
        return [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _pieces_of_long(self, word: str) -> list[str]:
        """As pieces; the least rank comes from a heap, and boundaries are links to the next and the one before."""
        n, rank = len(word) - 1, self.ranks.get
        after, before = [*range(1, n), len(word)], [*range(-1, n - 1)]
        alive, heap = [True] * n, []

        def offer(a: int) -> None:
            b = after[a]
            if b < n:
                r = rank((word[a:b], word[b : after[b]]))
                if r is not None:
                    heapq.heappush(heap, (r, a, b, after[b]))

        for a in range(n):
            offer(a)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if not (alive[a] and after[a] == b and alive[b] and after[b] == c):
                continue
            alive[b], after[a] = False, c
            if c < n:
                before[c] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [word[a : after[a]] for a in range(n) if alive[a]]

    def _part(self, part: str) -> bytes:
        known = self.parts.get(part)
        if known is None:
            word = "".join(map(self.letters.__getitem__, part.encode())) + END
            known = np.array([*map(self.ids.__getitem__, self.pieces(word))], "<i4").tobytes()
            if len(part) <= LONGEST_KEPT:
                if len(self.parts) >= PARTS_KEPT:
                    self.parts.clear()
                self.parts[part] = known
        return known

    def _stretch(self, text: str) -> bytes:
        # one letter at a time: a final sigma is lower-cased like any other
        lowered = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        parts = self.pattern.findall(lowered)
        try:
            return b"".join(map(self.parts.__getitem__, parts))
        except KeyError:
            return b"".join(map(self._part, parts))

    def encoded(self, text: str | None) -> Iterator[bytes]:
        """Ids of a text as little-endian 32-bit integers, in runs of up to about STRETCH characters."""
        for run in _runs(text or ""):
            stretches = self.cut.split(run) if self.cut else [run]
            for k, s in enumerate(stretches):
                yield np.array([self.special[s]], "<i4").tobytes() if k % 2 else self._stretch(s)

    def decoded(self, ids: np.ndarray) -> str:
        """The tokens' names with a space between, as a file without a decoder says; unknown ids are left out."""
        names = self.names[ids[(ids >= 0) & (ids < len(self.names))]]
        return " ".join(n for n in names.tolist() if n)


def _runs(text: str) -> Iterator[str]:
    """A text in runs that end before white space, so that a very long text's parts are never held at once."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= STRETCH else at + STRETCH
        space = SPACE.search(text, end)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


_KNOWN: dict[str, Bpe] = {}


def _bpe(path: str) -> Bpe:
    if path not in _KNOWN:
        _KNOWN[path] = Bpe(path)
    return _KNOWN[path]


def encode(text: str | Column, path: str) -> Column:
    """array<int>: ids of each text by the tokenizer file at path, which every worker can read."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _bpe(path)
        for b in batches:
            found = [b"".join(bpe.encoded(t.as_py())) for t in b]
            ends = np.cumsum([0, *(len(f) // 4 for f in found)], dtype=np.int64)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))

    return ids(text)


def decode(ids: str | Column, path: str) -> Column:
    """The text of each list of ids; null gives null."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _bpe(path)
        for b in batches:
            values, at, known = b.values.to_numpy(zero_copy_only=False), b.offsets.to_numpy(), b.is_valid().to_numpy(zero_copy_only=False)
            yield pa.array([bpe.decoded(values[x:y]) if k else None for x, y, k in zip(at, at[1:], known, strict=False)], pa.string())

    return texts(ids)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of each document."""
    ids = docs.select(F.col("doc_id").cast("long"), encode("text", path).alias("ids"))
    return ids.withColumn("decoded", decode("ids", path))


def digest(text: str | Column, path: str) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256> of each text: what encode and decode give, hashed run by run where
    it is made, so that neither ids nor decoded texts travel or are held whole."""

    @F.arrow_udf("struct<n_tokens:long, ids_sha256:string, decoded_sha256:string>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _bpe(path)
        for b in batches:
            columns = ([], [], [])
            for text in b:
                n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                for run in bpe.encoded(text.as_py()):
                    ids = np.frombuffer(run, "<i4")
                    if not len(ids):
                        continue
                    between = " " if n else ""
                    of_ids.update((between + " ".join(map(str, ids.tolist()))).encode())
                    of_text.update((between + bpe.decoded(ids)).encode())
                    n += len(ids)
                for column, value in zip(columns, (n, of_ids.hexdigest(), of_text.hexdigest()), strict=True):
                    column.append(value)
            yield pa.StructArray.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return hashed(text)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document."""
    return docs.select(F.col("doc_id").cast("long"), digest("text", path).alias("_d")).select("doc_id", "_d.*")
