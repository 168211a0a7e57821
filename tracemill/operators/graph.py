"""Graph operators: connected components, reachability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.storage import checkpointed, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable over undirected edges.

    Alternating large-star and small-star rounds: each node hands its neighbours to the smallest
    node it knows, so the edge set shrinks to stars in a logarithmic number of rounds. Rounds are
    checkpointed; nothing is collected but a two-number digest of the edge set. Self loops only
    declare a node. Edges with a null end are ignored.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select(F.col("u").alias("node"))
    current = checkpointed(
        pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    digest = None
    for _ in range(max_rounds):
        current = checkpointed(_small_star(_large_star(current)))
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == digest:
            break
        digest = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.distinct().select("node", F.col("node").alias("component"))
    return found.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def depths(nodes: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """(id, depth): longest chain of inputs below each node of a DAG; edges (src, dst): src reads dst.

    Levels are found in turn: edges to the level before are done with, and nodes that have none left are the next level.
    Joins are merges, so that no level passes through the driver.
    """
    src = F.col("src").alias("id")
    ready = checkpointed(nodes.join(edges.select(src).hint("merge"), "id", "left_anti").select("id", F.lit(0).alias("depth")))
    left, levels = written(edges.distinct()), [ready]
    for level in range(1, most + 1):
        if left.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        known = left.join(ready.withColumnRenamed("id", "dst").hint("merge"), "dst", "left")
        open_ = known.groupBy("src").agg(F.count_if(F.col("depth").isNull()).alias("open"))
        ready = checkpointed(open_.where("open = 0").select(src, F.lit(level).alias("depth")))
        if ready.isEmpty():
            raise ValueError("the graph has a cycle or an input that isn't a node")
        levels.append(ready)
        left = written(known.where("depth is null").select("src", "dst"))
    raise ValueError(f"deeper than {most}")


def merkle(nodes: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """(id, signature): SHA-256 of each node's name and its inputs' signatures in sorted order, bottom up.

    nodes: (id, name). Equal signatures mean equal subtrees, whatever the nodes' ids. A level's signatures go once to
    the nodes that read them and wait there for the node's own level; joins are merges, as in depths.
    """
    level = depths(nodes.select("id"), edges, most)
    placed = written(nodes.join(level.hint("merge"), "id"))
    deepest = placed.agg(F.max("depth")).first()[0] or 0
    of = placed.select(F.col("id").alias("dst"), F.col("depth").alias("below"))
    reads = written(edges.distinct().join(of.hint("merge"), "dst").select(F.col("src").alias("id"), "dst", "below"))
    done = [written(placed.where("depth = 0").select("id", F.sha2("name", 256).alias("signature")))]
    told = None
    for k in range(1, deepest + 1):
        mine = placed.where(F.col("depth") == k)
        sent = reads.where(F.col("below") == k - 1).join(done[-1].withColumnRenamed("id", "dst").hint("merge"), "dst").select("id", "signature")
        waiting = sent if told is None else told.unionByName(sent)
        met = written(waiting.join(mine.select("id", "name", F.lit(True).alias("now")).hint("merge"), "id", "left"))
        below = met.where("now").groupBy("id").agg(F.first("name").alias("name"), F.array_join(F.sort_array(F.collect_list("signature")), "").alias("below"))
        done.append(written(below.select("id", F.sha2(F.concat("name", "below"), 256).alias("signature"))))
        told = met.where("now is null").select("id", "signature")
    return reduce(DataFrame.unionByName, done)
