"""Small files that are either there whole or not at all, and versions of which exactly one writer gets each."""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import SparkSession

#: Writers of one driver take turns; between drivers the store's rename decides.
_TURN = threading.Lock()


class Taken(Exception):
    """Another writer was first."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_new(spark: SparkSession, path: str, value: dict) -> None:
    """Publishes a JSON object at a path that must not exist yet: written aside, then renamed. Raises Taken."""
    jvm, at, fs = _fs(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, True)
    try:
        out.write(bytearray((json.dumps(value, sort_keys=True) + "\n").encode()))
        out.hsync()
    finally:
        out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    with _TURN:
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(aside, at, how)
        except Exception as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Taken(path) from None
            raise


def names(spark: SparkSession, folder: str) -> list[str]:
    """Published names in a folder, sorted; none if it isn't there."""
    _, at, fs = _fs(spark, folder)
    found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in found if not n.endswith(".tmp") and not n.startswith((".", "_")))


def get(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r["value"] for r in spark.read.text(path).collect()))
