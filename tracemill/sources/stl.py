"""Binary STL files as facet rows.

A file is an 80-byte header, a count of facets and 50 bytes a facet: the normal, three corners (32-bit floats) and two
bytes more. A file is read whole by one task, which its largest size bounds; facets leave in runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes before the first facet and of a facet, least and most facets of a file.
HEAD, RECORD, FEWEST, MOST = 84, 50, 4, 500_000
RUN = 50_000
FACET = np.dtype([("normal", "<f4", 3), ("corners", "<f4", 9), ("more", "<u2")])
CORNERS = [f"{c}{k}" for k in "123" for c in "xyz"]


def files(spark: SparkSession, path: str) -> DataFrame:
    """(mesh_id, content) of the STL files at a path or pattern, from any store that Spark reads; mesh_id is the path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("mesh_id"), "content")


def count_of(content: Column) -> Column:
    """The facets that the header says, a little-endian number."""
    return F.conv(F.hex(F.reverse(F.substring(content, 81, 4))), 16, 10).cast("long")


def problem(content: Column) -> Column:
    """Why a file can't be read as facets; null if it can."""
    n, size = count_of(content), F.octet_length(content)
    return F.when(content.isNull() | (size < HEAD), "truncated").when(~n.between(FEWEST, MOST) | (size != HEAD + RECORD * n), "not a bounded binary mesh")


def facets(meshes: DataFrame) -> DataFrame:
    """(mesh_id, facet, x1..z3) of the readable meshes (mesh_id, content); a facet of a corner that isn't finite is kept as it is."""
    readable = meshes.where(problem(F.col("content")).isNull()).select("mesh_id", "content")
    kind = meshes.schema["mesh_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, content in enumerate(b.column("content")):
                records = np.frombuffer(content.as_buffer(), FACET, offset=HEAD)
                for at in range(0, len(records), RUN):
                    corners = records["corners"][at : at + RUN].astype(np.float64)
                    n = len(corners)
                    ids = b.column("mesh_id").take(pa.array(np.full(n, k)))
                    columns = [ids, pa.array(np.arange(at, at + n)), *(pa.array(np.ascontiguousarray(c)) for c in corners.T)]
                    yield pa.RecordBatch.from_arrays(columns, names=["mesh_id", "facet", *CORNERS])

    return readable.mapInArrow(run, f"mesh_id {kind}, facet long, " + ", ".join(f"{c} double" for c in CORNERS))


def binary(corners: Column) -> Column:
    """The file of an array of facets, each an array of nine numbers."""

    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out = []
            for mesh in b:
                points = np.array(mesh.as_py() or [], np.float32).reshape(-1, 9)
                records = np.zeros(len(points), FACET)
                records["corners"] = points
                out.append(bytes(80) + len(points).to_bytes(4, "little") + records.tobytes())
            yield pa.array(out, pa.binary())

    return packed(corners)
