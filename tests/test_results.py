import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tracemill.functions import budget
from tracemill.operators import lineage, links
from tracemill.plans.results import results_of
from tracemill.sources import images
from tracemill.sources.tables import turns

SF = "/root/testdata/sf0.001"


def plainly(result, limit):
    """The rule with every size taken anew."""
    size = lambda: len(json.dumps(result, ensure_ascii=False))
    if (before := size()) <= limit:
        return result
    fields = []
    result["truncation"] = {"truncated": True, "original_characters": before, "limit": limit, "shortened_fields": fields, "omitted_sources": 0}
    note = lambda i, f: fields.append(f"sources[{i}].{f}") if f"sources[{i}].{f}" not in fields else None
    sources = result.get("sources", [])
    for i, s in enumerate(sources):
        for f, most in (("text", 12000), ("snippet", 1600), ("title", 1000)):
            if len(s.get(f, "")) > most:
                s[f] = s[f][:most]
                note(i, f)
        for f in ("links", "headings"):
            if s.get(f):
                s.pop(f)
                note(i, f)
    while size() > limit:
        long = sorted((len(s[f]), i, f) for i, s in enumerate(sources) for f in ("text", "snippet", "title") if len(s.get(f, "")) > 120)
        if long:
            n, i, f = long[-1]
            sources[i][f] = sources[i][f][: max(120, n // 2)]
            note(i, f)
            sources[i].setdefault("truncation", {})[f] = True
        elif sources:
            sources.pop()
            result["truncation"]["omitted_sources"] += 1
        else:
            for key in [k for k in result if k not in ("operation", "sources", "truncation")]:
                del result[key]
                fields.append(key)
            break
    return result


def test_budget_against_plain_rule():
    draw = random.Random(3)
    letters = 'ab "\\\né€\U0001f600'
    for n in range(150):
        text = lambda most: "".join(draw.choices(letters, k=draw.randrange(most)))
        sources = [{"id": f"web_{i}", "text": text(draw.choice([5, 300, 15000])), "title": text(1500), "snippet": text(2500), "links": draw.choice([[], [text(20)]]), "headings": [text(9)]} for i in range(draw.randrange(7))]
        if n % 5 == 0 and sources:
            sources[-1] = dict(sources[0])
            sources[0].pop("title")
        result = {"operation": "search", "sources": sources, "notes": text(draw.choice([10, 3000])), "more": {"a": [1]}}
        if n % 30 == 0:
            del result["sources"]
        for limit in (200, 1000, 4000, 24000):
            want = plainly(json.loads(json.dumps(result)), limit)
            got = budget.within(json.dumps(result), limit)
            assert got == json.dumps(want, ensure_ascii=False)


def test_budget_of_dialogues(spark):
    d = results_of(turns(spark, SF)).select("result", budget.bounded(F.col("result"), 1200).alias("cut")).collect()
    assert all(r["cut"] == json.dumps(plainly(json.loads(r["result"]), 1200), ensure_ascii=False) for r in d)
    assert any(json.loads(r["cut"])["truncation"]["omitted_sources"] for r in d if len(r["cut"]) != len(json.dumps(json.loads(r["result"]), ensure_ascii=False)))
    odd = spark.createDataFrame([(None,), ("[1]",), ("{}",)], "r string").select(budget.bounded(F.col("r"), 1)).collect()
    assert [r[0] for r in odd][:2] == [None, "[1]"] and json.loads(odd[2][0])["truncation"]["original_characters"] == 2


def png(w, h):
    chunk = lambda name, body: len(body).to_bytes(4, "big") + name + body + zlib.crc32(name + body).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x08\x00\x00\x00\x00"
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(bytes((w + 1) * h))) + chunk(b"IEND", b"")


def jpeg(w, h, frame, *segments):
    body = b"".join(b"\xff\xe1" + (len(s) + 2).to_bytes(2, "big") + s for s in segments)
    return b"\xff\xd8" + body + b"\xff" + bytes([frame]) + b"\x00\x11\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x03" + bytes(9) + b"\xff\xd9"


IMAGES = {
    "a.png": (png(31, 7), (31, 7, None)),
    "b.jpg": (jpeg(640, 480, 0xC0), (640, 480, None)),
    "c.jpg": (jpeg(70, 65535, 0xC2, b"\xff\xc0" * 300, bytes(65533)), (70, 65535, None)),
    "d.jpg": (jpeg(9, 9, 0xC1, b"x")[:-15], (None, None, "malformed JPEG")),
    "e.jpg": (b"\xff\xd8\xff\xe0\xff\xff" + bytes(20), (None, None, "malformed JPEG")),
    "f.jpg": (b"\xff\xd8", (None, None, "malformed JPEG")),
    "g.png": (png(3, 3)[:20], (None, None, "malformed PNG")),
    "h.gif": (b"GIF89a", (None, None, "unsupported image format")),
    "i.bin": (b"", (None, None, "unsupported image format")),
    "j.jpg": (b"\xff\xd8\xff\xe0\x00\x00" + bytes(20), (None, None, "malformed JPEG")),
}


def test_image_sizes(spark, tmp_path):
    for name, (content, _) in IMAGES.items():
        (tmp_path / name).write_bytes(content)
    found = images.sizes_of_files(images.files(spark, str(tmp_path))).collect()
    assert {r["path"].rsplit("/", 1)[1]: (r["width"], r["height"], r["problem"]) for r in found} == {n: want for n, (content, want) in IMAGES.items() if content}
    gone = spark.createDataFrame([(f"{tmp_path}/none.png",), (None,)], "path string")
    assert {r["problem"] for r in images.sizes_of_files(gone).collect()} == {"missing"}
    held = spark.createDataFrame([(n, c) for n, (c, _) in IMAGES.items()] + [("z", None)], "name string, content binary")
    got = {r["name"]: tuple(r["s"]) for r in held.select("name", images.size_of(F.col("content")).alias("s")).collect()}
    assert got == {n: want for n, (_, want) in IMAGES.items()} | {"z": (None, None, "missing")}


def test_headers_are_read_by_position():
    content, asked = jpeg(5, 6, 0xC0, bytes(60000), bytes(60000)), []

    def read(at, n):
        asked.append(n)
        return content[at : at + n]

    assert images._size(read) == {"width": 5, "height": 6} and sum(asked) < 100


def test_lineage(spark):
    rows = [("o", None, None), ("a", "o", [1, 1, 9, 9]), ("b", "a", [0, 0, 5, 5]), ("copy", "b", None), ("d", "copy", [2, 2, 4, 4]), ("lost", "gone", [1, 1, 2, 2]), ("lost2", "lost", None)]
    rows += [("self", "self", None), ("x", "y", [1, 1, 3, 3]), ("y", "z", None), ("z", "x", None), ("into", "y", [3, 3, 6, 6])]
    rows += [(f"n{i}", f"n{i - 1}" if i else None, [i, 0, i + 2, 2]) for i in range(300)]
    got = {r["image_id"]: r for r in lineage.lineage(spark.createDataFrame(rows, "image_id string, parent_id string, crop array<int>")).collect()}
    assert len(got) == len(rows)
    told = lambda i: (got[i]["original_id"], got[i]["depth"], got[i]["crops"], got[i]["problem"])
    assert told("o") == ("o", 0, [], None) and told("a") == ("o", 1, [[1, 1, 9, 9]], None)
    assert told("d") == ("o", 4, [[1, 1, 9, 9], [0, 0, 5, 5], [2, 2, 4, 4]], None)
    assert told("lost2") == ("gone", 2, [[1, 1, 2, 2]], "missing")
    assert all(told(i) == (None, None, None, "cycle") for i in ("self", "x", "y", "z", "into"))
    assert told("n299") == ("n0", 299, [[i, 0, i + 2, 2] for i in range(1, 300)], None)
    assert lineage.lineage(spark.createDataFrame([], "image_id long, parent_id long, crop string")).count() == 0


@pytest.mark.parametrize(
    "crop, sizes, want, times",
    [
        ([10, 10, 20, 20], (100, 100, 100, 100), [10, 10, 20, 20], 4),
        ([10, 10, 20, 20], (4000, 2000, 1000, 500), [40, 40, 80, 80], 4),
        ([-5, -5, 2000, 2000], (1500, 900, 1500, 900), [0, 0, 1500, 900], 1),
        ([0, 0, 400, 10], (500, 500, 500, 500), [0, 0, 400, 10], 3),
        ([5, 5, 5, 9], (100, 100, 100, 100), None, None),
        ([99, 5, 100, 9], (100, 100, 100, 100), None, None),
        ([0, 0, 3, 5], (50, 50, 100, 100), [0, 0, 2, 2], 4),  # halves go to the even number
    ],
)
def test_placed_crops(spark, crop, sizes, want, times):
    at = lineage.placed_crop(F.array(*map(F.lit, crop)), *map(F.lit, sizes))
    row = spark.range(1).select(at.alias("at")).select("at", lineage.enlargement(F.col("at")).alias("n")).first()
    assert row["at"] == want and (want is None or row["n"] == times)


def test_ranked_links(spark):
    found = [
        (1, 0, "Home", None, "/home"),
        (1, 1, "NEMA motor", "x" * 90, "/m"),
        (1, 2, "Drawing", "", "/d.PDF"),
        (1, 3, "motor drawing", None, "/m"),
        (1, 4, "t" * 120 + " motor", None, "/long"),
        (1, 5, None, None, "/spec"),
        (2, 0, "motor", None, "/m"),
        (3, 0, "the and", None, "/z"),
    ]
    d = spark.createDataFrame(found, "page_id int, place int, title string, context string, url string")
    focus = spark.createDataFrame([(1, "The NEMA Motor motor pdf"), (2, None), (3, "the and")], "page_id int, text string")
    got = [tuple(r) for r in links.ranked_links(d, focus, "page_id").orderBy("page_id", "rank").collect()]
    want = [(1, 1, "Drawing", None, "/d.PDF", 5), (1, 2, "motor drawing", None, "/m", 5), (1, 3, "", None, "/spec", 3), (1, 4, "t" * 100, None, "/long", 2)]
    assert got == want
    assert [r["url"] for r in links.ranked_links(d, focus, "page_id", 2).collect()] == ["/d.PDF", "/m"]


def test_ended_lineages_are_written_once(spark, monkeypatch):
    rows = [(i, None if i % 64 == 0 else i - 1, "c") for i in range(256)] + [(1000 + i, None, None) for i in range(500)]
    told, plain = [], lineage.written

    def written(df):
        out = plain(df)
        told.append(out.count())
        return out

    monkeypatch.setattr(lineage, "written", written)
    got = lineage.lineage(spark.createDataFrame(rows, "image_id long, parent_id long, crop string")).collect()
    assert {r["image_id"]: (r["original_id"], r["depth"], len(r["crops"])) for r in got} == {i: (i // 64 * 64, i % 64, i % 64) if i < 1000 else (i, 0, 0) for i, _, _ in rows}
    assert max(told[1:]) < 256 and sum(told) < 5 * len(rows)  # all rows in each of a dozen rounds before
