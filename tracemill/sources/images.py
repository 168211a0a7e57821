"""Sizes of PNG and JPEG images from their headers, without decoding and without reading the pixels.

Where images are files, a task opens each one and reads only the markers up to the frame header, by position; the
listing itself reads no content. Where a table holds their bytes, the same walk goes over the column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What opens a PNG and a JPEG, and the second byte of the markers of frames that are read.
PNG, JPEG, FRAMES = b"\x89PNG\r\n\x1a\n", b"\xff\xd8", (0xC0, 0xC1, 0xC2)
SIZE = "struct<width: long, height: long, problem: string>"
KIND = pa.struct([("width", pa.int64()), ("height", pa.int64()), ("problem", pa.string())])


def _size(read: Callable[[int, int], bytes]) -> dict:
    """The size by `read(at, n)`, which gives n bytes from a place on, or as many as there are."""
    head = read(0, 24)
    if head.startswith(PNG):
        if len(head) < 24:
            return {"problem": "malformed PNG"}
        return {"width": int.from_bytes(head[16:20], "big"), "height": int.from_bytes(head[20:24], "big")}
    if not head.startswith(JPEG):
        return {"problem": "unsupported image format"}
    at = len(JPEG)
    while True:
        # a marker, the length of its segment with these two bytes, and of a frame its precision, height and width
        segment = read(at, 9)
        if len(segment) < 4 or segment[0] != 0xFF:
            return {"problem": "malformed JPEG"}
        if segment[1] in FRAMES:
            if len(segment) < 9:
                return {"problem": "malformed JPEG"}
            return {"width": int.from_bytes(segment[7:9], "big"), "height": int.from_bytes(segment[5:7], "big")}
        length = int.from_bytes(segment[2:4], "big")
        if length < 2:
            return {"problem": "malformed JPEG"}
        at += 2 + length


def _of_file(path: str) -> dict:
    """A file's size; the stores are those of pyarrow (local, s3, gs, hdfs)."""
    uri = "file://" + path[len("file:") :] if path.startswith("file:/") and not path.startswith("file://") else path
    try:
        store, inner = fs.FileSystem.from_uri(uri)
        with store.open_input_file(inner) as f:
            size = f.size()
            return _size(lambda at, n: f.read_at(max(0, min(n, size - at)), at) if at < size else b"")
    except FileNotFoundError:
        return {"problem": "missing"}


def size_of(content: Column) -> Column:
    """(width, height, problem) of a column of bytes; null bytes are "missing"."""

    @F.arrow_udf(SIZE)
    def sizes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            views = (memoryview(c.as_buffer()) if c.is_valid else None for c in b)
            yield pa.array([{"problem": "missing"} if v is None else _size(lambda at, n, v=v: bytes(v[at : at + n])) for v in views], KIND)

    return sizes(content)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files at a path or pattern; no content is read. Spark lists no empty files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def sizes_of_files(found: DataFrame) -> DataFrame:
    """found's rows (with a column path) and (width, height, problem) of each file. Narrow; reads headers only."""

    @F.arrow_udf(SIZE)
    def sizes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([{"problem": "missing"} if p is None else _of_file(p) for p in b.to_pylist()], KIND)

    return found.withColumn("_size", sizes.asNondeterministic()("path")).select("*", "_size.*").drop("_size")
