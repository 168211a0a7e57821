"""Ids of texts by a public BPE tokenizer with word ends, faster where words repeat."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex

from tracemill.llm.bpe import _runs

#: Parts that a Python worker remembers the ids of, and parts encoded in one call. Beyond the first it forgets and
#: starts again; results don't change.
WORDS_KEPT, PARTS_A_CALL = 800_000, 2000
#: Characters of texts that are cut before their new parts are encoded.
TOGETHER = 1 << 20

#: The pattern of the file, and what it cuts in lower-cased ASCII as Python's own, faster expressions say it.
SAID = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")


class WordIds:
    """No id spans two of the parts that the file's pattern cuts, so a text's ids are those of its parts in order.

    Texts are normalised as the file says (NFC, lower case) and cut; parts that aren't known yet are encoded by the
    tokenizer, many in one call. What has been learnt is kept by the Python worker across tasks. A run of text that holds
    the name of a special token goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.model.get_added_tokens_decoder().values()]
        self.parts: dict[str, bytes] = {}
        vocab = self.model.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        with open(path, encoding="utf-8") as f:
            said = next(p["pattern"]["Regex"] for p in json.load(f)["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.cut = regex.compile(said).findall
        self.cut_ascii = ASCII.findall if said == SAID else self.cut

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, parts: list[str]) -> None:
        for at in range(0, len(parts), PARTS_A_CALL):
            chunk = parts[at : at + PARTS_A_CALL]
            ids = self._ids(" ".join(chunk))
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) == len(chunk):  # each part has one word end
                whole = ids.tobytes()
                self.parts.update((p, whole[4 * a : 4 * b]) for p, a, b in zip(chunk, [0, *ends], ends, strict=False))
            else:
                self.parts.update((p, self._ids(p).tobytes()) for p in chunk)

    def _cut(self, text: str) -> list[list[str] | bytes]:
        """Of each run of a text its parts, or its ids if it holds a special token's name."""
        out = []
        for run in _runs(text):
            if run.isascii():
                lowered, cut = run.lower(), self.cut_ascii
            else:  # one letter at a time: a final sigma is lower-cased like any other
                lowered, cut = unicodedata.normalize("NFC", run).replace("Σ", "σ").lower(), self.cut
            out.append(self._ids(run).tobytes() if any(s in lowered for s in self.special) else cut(lowered))
        return out

    def _told(self, texts: list[list[list[str] | bytes]]) -> Iterator[bytes]:
        new = set().union(*(run for runs in texts for run in runs if isinstance(run, list))).difference(self.parts)
        if len(self.parts) + len(new) > WORDS_KEPT:
            self.parts.clear()
            new = set().union(*(run for runs in texts for run in runs if isinstance(run, list)))
        self._learn(sorted(new))
        known = self.parts.__getitem__
        for runs in texts:
            yield b"".join(b"".join(map(known, run)) if isinstance(run, list) else run for run in runs)

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        held, size = [], 0
        for text in texts:
            held.append(self._cut(text))
            size += len(text)
            if size >= TOGETHER:
                yield from self._told(held)
                held, size = [], 0
        yield from self._told(held)


_KNOWN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    return _KNOWN[path]
