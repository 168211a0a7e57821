"""JSON-lines sources and sinks, file types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """SRC-01/19: objects of a JSON-lines file with their place in the file (file, line_no rising within it).

    Blank lines and JSON values other than objects are skipped; a malformed line fails the read, or with
    strict=False is skipped too.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no")).where(F.trim("value") != "")
    parsed = raw.withColumn("_v", F.try_parse_json("value"))
    if strict:
        broken = F.concat(F.lit("malformed line in "), F.col("file"), F.lit(": "), F.left("value", F.lit(80)))
        parsed = parsed.withColumn("_v", F.when(F.col("_v").isNull(), F.raise_error(broken).cast("variant")).otherwise(F.col("_v")))
    objects = parsed.where(F.schema_of_variant("_v").startswith("OBJECT"))
    return objects.select("file", "line_no", F.from_json("value", schema).alias("r")).select("file", "line_no", "r.*")


def one_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-02: a file that holds one object."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def workflows(spark: SparkSession, root: str) -> DataFrame:
    """SRC-03: (software, workflow_id) of each root/software/workflow_id/task_desc.json."""
    files = spark.read.format("binaryFile").load(f"{root}/*/*/task_desc.json").select("path")
    part = lambda k: F.regexp_extract("path", "([^/]+)/([^/]+)/task_desc[.]json$", k)
    return files.select(part(1).alias("software"), part(2).alias("workflow_id"))


def write_splits(d: DataFrame, path: str) -> None:
    """SRC-09/24: rows by split in one pass; the whole is the folder read without a partition filter. Never overwrites."""
    d.write.partitionBy("split").mode("errorifexists").json(path)


def file_kind(content: Column, name: Column) -> Column:
    """SRC-22: kind by first bytes, else by nothing."""
    head = F.decode(F.substring(content, 1, 64), "ISO-8859-1")
    facets = F.conv(F.hex(F.reverse(F.substring(content, 81, 4))), 16, 10).cast("long")
    binary_stl = (F.octet_length(content) >= 84) & (F.octet_length(content) == 84 + 50 * facets)
    return (
        F.when(head.startswith("ISO-10303-21"), "step")
        .when(F.lower(head).rlike("^\\s*(<[?]xml[^>]*>\\s*)?<svg"), "svg")
        .when(head.rlike("^\\s*0\\s+SECTION"), "dxf")
        .when(head.startswith("solid") | F.coalesce(binary_stl, F.lit(False)), "stl")
    )
