"""Splits that no shared artifact crosses.

Workflows that share an artifact are one group (a connected component). Applications take turns, those with the fewest
groups first; each fills its validation and test quotas from its groups in the order of a hash, and no group may leave
training that is the last one of any of its applications.

The turns depend on one another only through groups of several applications, so applications that such groups connect
form a cluster and clusters are folded in parallel. Of an application's own groups only the first in hash order, as many
as its quotas, can be taken: a group of one application is refused only when the application has one left to train on,
and then all later ones are too. The rest never reach the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.operators import graph
from tracemill.operators.sequences import fold
from tracemill.storage import checkpointed

#: Fixed value: share of an application's groups for validation, and for test.
SHARE = 0.1


def artifact_groups(workflows: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(workflow, grp): grp is the least workflow that shared artifacts lead to. workflows: (workflow); artifacts: (workflow, artifact)."""
    shared = artifacts.where("artifact is not null")
    first = shared.groupBy("artifact").agg(F.min("workflow").alias("dst"))
    links = shared.join(first, "artifact").select(F.col("workflow").alias("src"), "dst").where("src <> dst")
    found = graph.connected_components(links)
    return workflows.join(found.withColumnRenamed("node", "workflow"), "workflow", "left").select("workflow", F.coalesce("component", "workflow").alias("grp"))


def quota(n: Column, least: int) -> Column:
    """A tenth, halves to even, one at least, of applications with `least` groups."""
    return F.when(n >= least, F.greatest(F.lit(1), F.bround(SHARE * n).cast("long"))).otherwise(0)


class Turns:
    """(grp, split) of the groups that leave training; rows come application by application, groups in hash order."""

    def __init__(self):
        self.left: dict[str, int] = {}
        self.taken: dict[tuple[str, str], int] = {}
        self.gone: set = set()

    def take(self, row) -> list[tuple]:
        for app, n in zip(row.apps, row.sizes, strict=True):
            self.left.setdefault(app, n)
        held = lambda split: self.taken.get((row.app, split), 0)
        split = "validation" if held("validation") < row.validation else "test" if held("test") < row.test else None
        if split is None or row.grp in self.gone or any(self.left[a] <= 1 for a in row.apps):
            return []
        for app in row.apps:
            self.left[app] -= 1
            self.taken[app, split] = self.taken.get((app, split), 0) + 1
        if len(row.apps) > 1:
            self.gone.add(row.grp)
        return [(row.grp, split)]

    def end(self) -> list[tuple]:
        return []


def guarded_splits(groups: DataFrame, seed: str) -> DataFrame:
    """(grp, split) of each group: train, validation or test. groups: (app, grp), app not null."""
    pairs = groups.where("app is not null and grp is not null").select(F.col("app").cast("string"), "grp").distinct()
    sized = pairs.join(pairs.groupBy("app").agg(F.count("*").alias("n")), "app")
    # the applications of a group, each with its number of groups
    apps = F.sort_array(F.collect_list(F.struct("app", "n")))
    each = checkpointed(sized.groupBy("grp").agg(apps.alias("apps"), F.max("app").alias("last"), F.min("app").alias("first")))
    links = each.where("first <> last").select(F.explode("apps.app").alias("src"), F.col("first").alias("dst")).where("src <> dst").distinct()
    clusters = graph.connected_components(links).select(F.col("node").alias("app"), F.col("component").alias("cluster"))
    rows = each.select("grp", "apps", F.explode("apps").alias("_a")).select("grp", "apps", "_a.*")
    digest = F.sha2(F.concat(F.lit(f"{seed}/"), F.col("grp").cast("string")), 256)
    rows = rows.withColumn("digest", digest).withColumn("validation", quota(F.col("n"), 2)).withColumn("test", quota(F.col("n"), 3))
    alone = F.size("apps") == 1
    rank = F.row_number().over(W.partitionBy("app", alone).orderBy("digest"))
    reached = rows.withColumn("rank", rank).where(~alone | (F.col("rank") <= F.col("validation") + F.col("test")))
    keyed = reached.join(clusters, "app", "left").select(F.coalesce("cluster", "app").alias("cluster"), "n", "app", "digest", "grp", F.col("apps.app").alias("apps"), F.col("apps.n").alias("sizes"), "validation", "test")
    kind = groups.schema["grp"].dataType.simpleString()
    moved = fold(keyed, ["cluster"], ["n", "app", "digest"], Turns, f"cluster string, grp {kind}, split string").select("grp", "split")
    return each.select("grp").join(moved, "grp", "left").select("grp", F.coalesce("split", F.lit("train")).alias("split"))
