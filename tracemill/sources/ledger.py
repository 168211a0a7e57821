"""Revisions of a table, each committed against the head that its writer had read.

Data go to a folder of their own first; a revision is a small file that names its parent and that folder. Publishing it
under the next number is the commit: of two writers with one parent one gets the number, the other a Conflict and an
orphaned folder that nothing reads. So ids have no gaps, and a writer that dies leaves the head as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.sequences import fold
from tracemill.sources import publish

#: Fixed value: most revisions of a project.
MOST = 9999


class Conflict(Exception):
    """The head is no longer the one that the writer had read."""


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def revisions(self) -> list[dict]:
        """All revisions, first to last."""
        return [publish.get(self.spark, f"{self.path}/revisions/{n}") for n in publish.names(self.spark, f"{self.path}/revisions")]

    def head(self) -> str | None:
        found = publish.names(self.spark, f"{self.path}/revisions")
        return found[-1].removesuffix(".json") if found else None

    def read(self, revision: str | None = None) -> DataFrame:
        """Rows of a revision, the head by default."""
        told = publish.get(self.spark, f"{self.path}/revisions/{revision or self.head()}.json")
        return self.spark.read.schema(told["schema"]).parquet(told["data"])

    def commit(self, rows: DataFrame, expected_head: str | None, name: str = "") -> str:
        """A revision of these rows, if the head still is expected_head."""
        if self.head() != expected_head:
            raise Conflict(f"the head is {self.head()}, not {expected_head}")
        data = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.parquet(data)
        kept = self.spark.read.schema(rows.schema).parquet(data)
        each = F.xxhash64(*(F.col("`" + c.replace("`", "``") + "`") for c in kept.columns))
        told = kept.agg(F.count("*").alias("rows"), F.coalesce(F.sum(each.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")).first()
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return self._append(expected_head, {"name": name, "data": data, "schema": schema, "rows": told["rows"], "digest": told["digest"], "restored_from": None})

    def restore(self, revision: str, expected_head: str | None) -> str:
        """An earlier revision as the newest; its data are shared, not copied."""
        told = publish.get(self.spark, f"{self.path}/revisions/{revision}.json")
        return self._append(expected_head, {k: told[k] for k in ("name", "data", "schema", "rows", "digest")} | {"restored_from": revision})

    def _append(self, parent: str | None, told: dict) -> str:
        number = int(parent[1:]) + 1 if parent else 1
        if number > MOST:
            raise ValueError(f"a ledger holds at most {MOST} revisions")
        revision = f"r{number:04d}"
        if self.head() != parent:
            raise Conflict(f"the head is {self.head()}, not {parent}")
        try:
            publish.put_new(self.spark, f"{self.path}/revisions/{revision}.json", told | {"id": revision, "parent": parent})
        except publish.Taken:
            raise Conflict(f"{revision} was committed by another writer") from None
        return revision


class Commits:
    """(attempt, revision, parent): of one project's attempts in order those whose expected head is the head."""

    def __init__(self):
        self.head = 0

    def take(self, row) -> list[tuple]:
        if (row.expected or 0) != self.head or self.head >= MOST:
            return [(row.attempt, None, None)]
        self.head += 1
        return [(row.attempt, f"r{self.head:04d}", f"r{self.head - 1:04d}" if self.head > 1 else None)]

    def end(self) -> list[tuple]:
        return []


def replayed(attempts: DataFrame) -> DataFrame:
    """(project, attempt, revision, parent) of logged attempts (project, at, attempt, expected): which would have been
    committed, and as what. expected is the number of the head that the writer had read, 0 or null for none."""
    kinds = {f.name: f.dataType.simpleString() for f in attempts.schema}
    d = attempts.select("project", "at", "attempt", "expected")
    return fold(d, ["project"], ["at", "attempt"], Commits, f"project {kinds['project']}, attempt {kinds['attempt']}, revision string, parent string")
