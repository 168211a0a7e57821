"""A build that can be stopped anywhere and started again.

Rows belong to units. A run takes the units that no earlier run has finished, writes their rows to a folder of the run,
checks them, and publishes one manifest for all of them with a single rename. Without the manifest the folder doesn't
count, so a run that dies is as if it hadn't been. Units that failed their check, and those without a manifest, are
done again; finished and skipped ones never are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.sources import publish

MANIFEST = "unit string, status string, reason string, rows long, digest string, run string, number long"
DONE = ("complete", "skipped")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """MANIFEST rows of all published runs."""
    runs = publish.names(spark, f"{root}/runs")
    if not runs:
        return spark.createDataFrame([], MANIFEST)
    told = [publish.get(spark, f"{root}/runs/{r}") for r in runs]
    found = spark.read.schema("unit string, status string, reason string, rows long, digest string, run string").parquet(*(t["manifest"] for t in told))
    return found.withColumn("number", F.element_at(F.map_from_arrays(F.array(*(F.lit(t["run"]) for t in told)), F.array(*(F.lit(t["number"]).cast("long") for t in told))), F.col("run")))


def state(spark: SparkSession, root: str) -> DataFrame:
    """Each unit's row of the newest run that had it."""
    newest = F.max_by(F.struct("status", "reason", "rows", "digest", "run", "number"), "number").alias("_m")
    return manifests(spark, root).groupBy("unit").agg(newest).select("unit", "_m.*")


def run(spark: SparkSession, root: str, rows: DataFrame, unit: str, fault: Column, planned: DataFrame | None = None) -> int:
    """One run over what is left; the number of units it took.

    fault: why a row spoils its unit, or null; the least reason is the unit's. planned: (unit) of units that should have
    rows; those without are skipped. The rows' column `unit` is cast to string in manifests.
    """
    finished = state(spark, root).where(F.col("status").isin(*DONE)).select(F.col("unit").alias("_unit"))
    named = rows.withColumn("_unit", F.col(unit).cast("string")).where("_unit is not null")
    left = named.join(finished, "_unit", "left_anti")
    runs, name = publish.names(spark, f"{root}/runs"), uuid.uuid4().hex
    data, manifest = f"{root}/data/run={name}", f"{root}/manifests/{name}"
    left.withColumn("_fault", fault).write.parquet(data)
    kept = spark.read.parquet(data)
    each = F.xxhash64(*(F.col("`" + c.replace("`", "``") + "`") for c in rows.columns)).cast("decimal(38,0)")
    told = kept.groupBy(F.col("_unit").alias("unit")).agg(F.min("_fault").alias("reason"), F.count("*").alias("rows"), F.sum(each).cast("string").alias("digest"))
    told = told.select("unit", F.when(F.col("reason").isNull(), "complete").otherwise("failed").alias("status"), "reason", "rows", "digest")
    if planned is not None:
        bare = planned.select(F.col("unit").cast("string").alias("unit")).where("unit is not null").distinct()
        absent = bare.join(named.select(F.col("_unit").alias("unit")), "unit", "left_anti").join(finished.withColumnRenamed("_unit", "unit"), "unit", "left_anti")
        told = told.unionByName(absent.select("unit", F.lit("skipped").alias("status"), F.lit("no rows").alias("reason"), F.lit(0).cast("long").alias("rows"), F.lit(None).cast("string").alias("digest")))
    told.withColumn("run", F.lit(name)).write.parquet(manifest)
    number = len(runs) + 1
    publish.put_new(spark, f"{root}/runs/{number:06d}.json", {"run": name, "number": number, "manifest": manifest, "data": data})
    return spark.read.parquet(manifest).count()


def built(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all complete units, each from the run that completed it."""
    runs = [publish.get(spark, f"{root}/runs/{r}") for r in publish.names(spark, f"{root}/runs")]
    if not runs:
        raise ValueError(f"no run is published in {root}")
    complete = state(spark, root).where("status = 'complete'").select(F.col("unit").alias("_unit"), F.col("run").alias("_run"))
    rows = spark.read.option("basePath", f"{root}/data").parquet(*(r["data"] for r in runs)).withColumnRenamed("run", "_run")
    return rows.join(complete, ["_unit", "_run"], "left_semi").drop("_unit", "_run", "_fault")
