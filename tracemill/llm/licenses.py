"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and texts become lower-case runs of letters and digits. Hashes of a template's GRAM-word runs are
winnowed: the least of every WINDOW neighbours is kept (the last one of ties), so any GRAM + WINDOW - 1 = 4 of
its words in a row hold a fingerprint. Of a template of SHORT words or fewer all pairs of words are kept. So a
text that has at least 4/5 of a template's words in order, with others changed or missing, shares one. The
fingerprints form an inverted index (hash -> template, place); every run of a text is looked up. Hits of one
template whose diagonals lie close are one candidate, aligned with the template within BAND words of those
diagonals (Smith-Waterman on words).

An alignment is reported if it matches at least `coverage` of the template's words and of the words it spans. The index is of bounded
size: at most MAX_POSTINGS fingerprints travel with the tasks; a larger library is scanned in several
passes of that size. Texts never leave their partition: no shuffle.

Defined results: null, empty and wordless texts match nothing; repeated rows report each; a null doc_id is
kept; templates of under two words are ignored; several places of one template are several rows; a text may
match several templates. Extra columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from importlib import resources

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, WINDOW, BAND = 3, 2, 12
SHORT_GRAM, SHORT = 2, 15
COVERAGE = 0.8
MAX_POSTINGS = 1_000_000
#: Scores of an alignment: a matched word, a differing or missing one.
MATCH, MISS = 2, 1
WORD = re.compile(r"[^\W_]+")

#: Notices by which licences are granted or named; the four lines are worded as in the supplied documents.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


def library() -> dict[str, str]:
    """TEMPLATES, and the notices and whole licence texts of license_texts: NAME-notice and NAME-text."""
    files = sorted((f for f in resources.files("tracemill.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    names = [f.name.removesuffix(".txt") for f in files]
    return TEMPLATES | {name if name.endswith("-notice") else f"{name}-text": f.read_text("utf-8") for name, f in zip(names, files, strict=True)}


def words_of(text: str | None) -> tuple[list[str], np.ndarray]:
    """The words, and the (start, end) of each in the text in code points."""
    found = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text or "")]
    return [w for w, _, _ in found], np.array([(a, b) for _, a, b in found], np.int64).reshape(-1, 2)


def hashes_of(words: list[str]) -> np.ndarray:
    """Hash of each word."""
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def runs_of(words: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of gram words."""
    n = max(0, len(words) - gram + 1)
    runs = np.full(n, gram, np.uint64)
    for k in range(gram):
        runs = (runs ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    return runs


def winnowed(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of its first word) of a template's chosen runs."""
    if len(words) <= SHORT:
        runs = runs_of(words, SHORT_GRAM)
        return runs, np.arange(len(runs))
    runs = runs_of(words, GRAM)
    windows = np.lib.stride_tricks.sliding_window_view(runs, WINDOW)
    last_least = WINDOW - 1 - windows[:, ::-1].argmin(axis=1)
    at = np.unique(last_least + np.arange(len(windows)))
    return runs[at], at


class Index:
    """Inverted index of the fingerprints of templates, given as (name, hashes of words)."""

    def __init__(self, templates: list[tuple[str, np.ndarray]]):
        self.names = [name for name, _ in templates]
        self.words = [words for _, words in templates]
        found = [winnowed(words) for words in self.words]
        key = np.concatenate([runs for runs, _ in found])
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.which = np.repeat(np.arange(len(found)), [len(at) for _, at in found])[order]
        self.place = np.concatenate([at for _, at in found])[order]

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template, diagonal: place in the text less that in the template) of all runs that the index holds."""
        which, diagonal = [], []
        for gram in (SHORT_GRAM, GRAM):
            runs = runs_of(words, gram)
            low = np.searchsorted(self.key, runs, "left")
            count = np.searchsorted(self.key, runs, "right") - low
            posting = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            which.append(self.which[posting])
            diagonal.append(np.repeat(np.arange(len(runs)), count) - self.place[posting])
        return np.concatenate(which), np.concatenate(diagonal)

    def candidates(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, least, largest diagonal) of hits whose diagonals lie within BAND of the next."""
        which, diagonal = self.hits(words)
        if not len(which):
            return
        order = np.lexsort((diagonal, which))
        which, diagonal = which[order], diagonal[order]
        first = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (diagonal[1:] - diagonal[:-1] > BAND)])
        for a, b in zip(first, np.r_[first[1:], len(which)], strict=True):
            yield int(which[a]), int(diagonal[a]), int(diagonal[b - 1])


def _may_match(template: np.ndarray, text: np.ndarray, low: int, high: int, enough: int) -> bool:
    """Whether enough of the template's words have an equal word of the text on diagonals low to high."""
    if np.isin(template, text[max(0, low) : high + len(template)]).sum() < enough:
        return False
    met = np.zeros(len(template), bool)
    for d in range(max(low, 1 - len(template)), min(high, len(text) - 1) + 1):
        a, b = max(0, -d), min(len(template), len(text) - d)
        met[a:b] |= template[a:b] == text[a + d : b + d]
    return int(met.sum()) >= enough


def aligned(template: np.ndarray, text: np.ndarray, least: int, most: int, coverage: float) -> list[tuple[int, int, int]]:
    """(first word, word after the last, matched words) of alignments in the band of diagonals least - BAND to
    most + BAND that match that share of the template and of what they span; best first, none overlapping a better one."""
    enough = int(np.ceil(coverage * len(template) - 1e-9))
    low, high = least - BAND, most + BAND
    from_word, to_word = max(0, low), min(len(text), high + len(template))
    if to_word - from_word < enough or not _may_match(template, text, low, high, enough):
        return []
    wide = high - low + 1
    at = np.arange(wide)
    score, matched, start = np.zeros(wide + 1, np.int64), np.zeros(wide + 1, np.int64), np.r_[at + low, high + 1]
    ends = []
    for i, word in enumerate(template):
        j = at + low + i
        inside = (j >= 0) & (j < len(text))
        same = inside & (text[np.clip(j, 0, len(text) - 1)] == word)
        straight, over = score[:-1] + np.where(same, MATCH, -MISS), score[1:] - MISS
        best = np.maximum(np.maximum(straight, over), 0)
        took = straight == best
        hits = np.where(took, matched[:-1] + same, matched[1:])
        origin = np.where(took, start[:-1], start[1:])
        fresh = best == 0
        hits[fresh], origin[fresh] = 0, j[fresh] + 1
        best[~inside] = hits[~inside] = 0
        level = best + MISS * at  # a word of the text passed over costs MISS
        peak = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == peak, at, 0))
        passed = peak - MISS * at
        score = np.r_[passed, 0]
        matched, start = np.r_[hits[source], 0], np.r_[origin[source], high + i + 2]
        ends += [(-score[k], start[k], j[k] + 1, matched[k]) for k in np.flatnonzero(inside & same & (matched[:-1] >= enough) & (matched[:-1] >= coverage * (j + 1 - start[:-1]) - 1e-9))]
    out = []
    for _, a, b, n in sorted(ends):
        if all(b <= x or a >= y for x, y, _ in out):
            out.append((int(a), int(b), int(n)))
    return out


def found_in(text: str | None, index: Index, coverage: float = COVERAGE) -> list[tuple[str, int, int, int, int, float]]:
    """(license, first code point, code point after the last, matched words, template's words, share matched)."""
    words, spans = words_of(text)
    hashed = hashes_of(words)
    out = set()
    for k, least, most in index.candidates(hashed):
        n = len(index.words[k])
        for a, b, matched in aligned(index.words[k], hashed, least, most, coverage):
            out.add((index.names[k], int(spans[a, 0]), int(spans[b - 1, 1]), matched, n, matched / n))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def indexes(templates: dict[str, str], most: int = MAX_POSTINGS) -> list[Index]:
    """The library as indexes of at most so many fingerprints (or of one template)."""
    groups, held = [], 0
    for name, text in templates.items():
        words = hashes_of(words_of(text)[0])
        if len(words) >= SHORT_GRAM:
            if not groups or held + len(words) > most:
                groups, held = [*groups, []], 0
            groups[-1].append((name, words))
            held += len(words)
    return [Index(group) for group in groups]


FOUND = "license string, start_char long, end_char long, matched_words long, template_words long, coverage double"


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, most: int = MAX_POSTINGS) -> DataFrame:
    """One row for each place of a license in a text: doc_id, license, start_char, end_char, matched_words,
    template_words, coverage. Narrow; a pass over the texts for each index of the library."""
    columns = [x.split()[0] for x in FOUND.split(", ")]

    def by(index: Index) -> DataFrame:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield b.map(lambda text: [dict(zip(columns, row, strict=True)) for row in found_in(text, index, coverage)], na_action=None)

        found = F.pandas_udf(run, f"array<struct<{FOUND.replace(' ', ':').replace(',:', ', ')}>>")
        return docs.select(F.col("doc_id").cast("long"), F.explode(found("text")).alias("_found")).select("doc_id", "_found.*")

    passes = [by(index) for index in indexes(templates, most)]
    return reduce(DataFrame.unionByName, passes) if passes else docs.sparkSession.createDataFrame([], f"doc_id long, {FOUND}")
