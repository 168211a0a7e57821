"""Search results cut to a number of characters as structured content, never as serialized text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a source's fields are cut to at first, the fields that go then, the least length that halving
#: leaves, and the entries of a result that are never left out.
FIRST, EXTRA, LEAST, KEPT = {"text": 12000, "snippet": 1600, "title": 1000}, ("links", "headings"), 120, ("operation", "sources", "truncation")


def _chars(value: object) -> int:
    return len(json.dumps(value, ensure_ascii=False))


class _Cut:
    """A result's sources within a budget: a running size, and a heap of fields by length."""

    def __init__(self, result: dict, limit: int):
        self.result, self.limit, self.sources = result, limit, result.get("sources") or []
        self.told = {"truncated": True, "original_characters": _chars(result), "limit": limit, "shortened_fields": [], "omitted_sources": 0}
        self.named = set()

    def name(self, place: int | None, field: str) -> None:
        field = field if place is None else f"sources[{place}].{field}"
        if field not in self.named:
            self.named.add(field)
            self.told["shortened_fields"].append(field)

    def first(self) -> None:
        for place, source in enumerate(self.sources):
            for field, most in FIRST.items():
                if len(source.get(field) or "") > most:
                    source[field] = source[field][:most]
                    self.name(place, field)
            for field in EXTRA:
                if source.get(field):
                    del source[field]
                    self.name(place, field)

    def halve(self) -> None:
        """Halves the longest field, of equals the last source's, until all fits or no field is long; then sources go, the last first."""
        self.size = _chars(self.result)
        rank = {field: k for k, field in enumerate(sorted(FIRST))}
        long = [(-len(s[f]), -i, -rank[f], f) for i, s in enumerate(self.sources) for f in FIRST if len(s.get(f) or "") > LEAST]
        heapify(long)
        while self.size > self.limit and (long or self.sources):
            told = _chars(self.told)
            if long:
                length, place, order, field = heappop(long)
                source = self.sources[-place]
                before = _chars(source)
                source[field] = source[field][: max(LEAST, -length // 2)]
                source.setdefault("truncation", {})[field] = True
                self.name(-place, field)
                if len(source[field]) > LEAST:
                    heappush(long, (-len(source[field]), place, order, field))
                self.size += _chars(source) - before
            else:
                self.size -= _chars(self.sources.pop()) + (2 if self.sources else 0)
                self.told["omitted_sources"] += 1
            self.size += _chars(self.told) - told

    def run(self) -> dict:
        self.result["truncation"] = self.told
        self.first()
        self.halve()
        if self.size > self.limit:
            for key in [k for k in self.result if k not in KEPT]:
                del self.result[key]
                self.name(None, key)
        return self.result


def within(text: str, limit: int) -> str:
    result = json.loads(text)
    if isinstance(result, dict) and _chars(result) > limit:
        result = _Cut(result, limit).run()
    return json.dumps(result, ensure_ascii=False)


def bounded(result: Column, limit: int = 24_000) -> Column:
    """A result (JSON text) as JSON of at most `limit` characters, as far as cutting its sources can do that.

    Longer results say so under "truncation". First text, snippet and title are cut to fixed lengths and links and
    headings go; then the longest field is halved again and again, down to LEAST; then sources are left out from the
    last on; at last every entry but KEPT. Null stays null; text that isn't JSON is an error."""

    @F.arrow_udf("string")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if t is None else within(t, limit) for t in b.to_pylist()], pa.string())

    return cut(result)
