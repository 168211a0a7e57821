"""Polygons, segments and meshes as relations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.operators.graph import connected_components
from tracemill.storage import checkpointed, written

#: Corners of one role that a task compares (fuller cells are split into pairs of blocks), outlines of a bit map, and numbers of a step.
CORNERS, BITS, STEP = 1 << 17, 1024, 1 << 20
#: Share of the largest coordinate within which a bound is left to the corner test; a tenth of it is a side's play.
MARGIN = 1e-12
#: Eighths of a turn that a side points to, by the signs of its run and rise (plus one); -1: it has no length.
COURSE = np.array([[5, 4, 3], [6, -1, 2], [7, 0, 1]])


def signed_areas(points: DataFrame, path: str = "path_id", order: str = "i") -> DataFrame:
    """(path, n, area): shoelace area of each closed path."""
    w = W.partitionBy(path)
    nx, ny = (F.coalesce(F.lead(c).over(w.orderBy(order)), F.min_by(c, order).over(w)) for c in "xy")
    edges = points.select(path, F.col("x"), F.col("y"), nx.alias("nx"), ny.alias("ny"))
    return edges.groupBy(path).agg(F.count("*").alias("n"), (F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("area"))


@dataclass
class Outlines:
    """Outlines of one block: ids, and their corners one after the other."""

    ids: np.ndarray
    n: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def __post_init__(self):
        self.start = np.cumsum(self.n) - self.n
        self.after = np.arange(len(self.x)) + 1
        self.after[self.start + self.n - 1] = self.start

    def bounds(self) -> np.ndarray:
        """Of each outline, how far it reaches to eight sides: along the axes and the diagonals."""
        x, y = self.x, self.y
        return np.stack([np.maximum.reduceat(v, self.start) for v in (x, -x, y, -y, x + y, -x - y, x - y, y - x)])

    def octagons(self, play: float) -> np.ndarray:
        """Whether each is convex and all of its sides run along an axis or a diagonal: its bounds are the outline."""
        dx, dy = self.x[self.after] - self.x, self.y[self.after] - self.y
        run, rise = (np.where(np.abs(d) <= play, 0, np.sign(d)).astype(int) for d in (dx, dy))
        diagonal = (np.abs(dx) == np.abs(dy)) | (np.abs(np.abs(dx) - np.abs(dy)) <= play)
        course = COURSE[run + 1, rise + 1]
        straight = (course >= 0) & (diagonal | (run == 0) | (rise == 0))
        turn = (course[self.after] - course) % 8
        once = ((np.maximum.reduceat(t, self.start) <= 3) & (np.add.reduceat(t, self.start) == 8) for t in (turn, -turn % 8))
        return np.logical_and.reduceat(straight, self.start) & np.logical_or(*once)


def _at_least(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds sorted, and for each place there the bit map of the outlines from it on."""
    m = len(bounds)
    order = np.argsort(bounds, kind="stable")
    place = np.full(-(-m // 64) * 64, -1)
    place[order] = np.arange(m)
    return bounds[order], np.packbits(place >= np.arange(m + 1)[:, None], axis=1).view(np.uint64)


def _corners_within(inner: Outlines, a: np.ndarray, outer: Outlines, b: np.ndarray) -> np.ndarray:
    """Whether outline b of outer holds all corners of outline a of inner, for each pair (even-odd rule)."""
    out, order, at = np.zeros(len(a), bool), np.argsort(outer.n[b], kind="stable"), 0
    while at < len(order):
        take = min(4096, len(order) - at)
        while take > 1 and take * outer.n[b[order[at + take - 1]]] > STEP:
            take //= 2
        pair = order[at : at + take]
        p, q, at = a[pair], b[pair], at + take
        k = np.arange(outer.n[q].max())
        real, side = (k < outer.n[q][:, None])[:, None], outer.start[q][:, None] + np.minimum(k, outer.n[q][:, None] - 1)
        sx, sy, nx, ny = (v[i][:, None] for i in (side, outer.after[side]) for v in (outer.x, outer.y))
        held, most = np.ones(take, bool), inner.n[p].max()
        step = max(1, STEP // (take * len(k)))
        for first in range(0, most, step):
            corner = inner.start[p][:, None] + np.minimum(np.arange(first, min(first + step, most)), inner.n[p][:, None] - 1)
            cx, cy = inner.x[corner][:, :, None], inner.y[corner][:, :, None]
            cut = ((sy > cy) != (ny > cy)) & real & (cx < sx + (cy - sy) * (nx - sx) / (ny - sy))
            held &= (cut.sum(axis=2) % 2 == 1).all(axis=1)
        out[pair] = held
    return out


def _held_by(inner: Outlines, outer: Outlines) -> np.ndarray:
    """Number of outer's outlines that hold each of inner's.

    An outline that holds another reaches further to all sides. Bit maps of the outer outlines that do, one for each side
    and place, are intersected, so pairs cost a bit a side. For octagons (rectangles and diamonds among them) that decides; where
    bounds touch, and for outlines of other forms, the corners do."""
    depth = np.zeros(len(inner.ids), np.int64)
    if not len(inner.ids) or not len(outer.ids):
        return depth
    with np.errstate(invalid="ignore", divide="ignore"):
        largest = max(np.abs(v[np.isfinite(v)]).max(initial=0) for v in (inner.x, inner.y, outer.x, outer.y))
        near, far, decides = inner.bounds(), outer.bounds(), outer.octagons(largest * MARGIN / 10)
        for at in range(0, len(outer.ids), BITS):
            part = slice(at, at + BITS)
            sides = [_at_least(f) for f in far[:, part]]
            flags = np.zeros(-(-len(far[0, part]) // 64) * 64, bool)
            flags[: len(far[0, part])] = decides[part]
            octagons = np.packbits(flags).view(np.uint64)
            for row in range(0, len(depth), 8 * BITS):
                some = slice(row, row + 8 * BITS)
                sure, maybe = octagons, ~np.uint64(0)
                for n, (steps, maps) in zip(near[:, some], sides, strict=True):
                    sure = sure & maps[np.searchsorted(steps, n + largest * MARGIN, "right")]
                    maybe = maybe & maps[np.searchsorted(steps, n - largest * MARGIN, "left")]
                depth[some] += np.bitwise_count(sure).sum(axis=1, dtype=np.int64)
                a, word = np.nonzero(open_ := maybe & ~sure)
                bits = np.unpackbits(open_[a, word].view(np.uint8).reshape(-1, 8), axis=1)
                which, bit = np.nonzero(bits)
                a, b = a[which] + row, word[which] * 64 + bit + at
                box = (inner.ids[a] != outer.ids[b]) & (near[:4, a] <= far[:4, b]).all(axis=0)
                a, b = a[box], b[box]
                depth += np.bincount(a[_corners_within(inner, a, outer, b)], minlength=len(depth))
    return depth


def _depths(table: pa.Table) -> pa.Table:
    """(_id, depth) of one block's inner outlines, so far as outlines of the block hold them."""
    x, y = (table[c].combine_chunks() for c in ("xs", "ys"))
    outer, ids, n = table["outer"].to_numpy(), table["_id"].to_numpy(), x.value_lengths().to_numpy()
    x, y, whose = x.flatten().to_numpy(), y.flatten().to_numpy(), np.repeat(outer, n)
    inner, outer = (Outlines(ids[m], n[m], x[c], y[c]) for m, c in ((~outer, ~whose), (outer, whose)))
    depth = _held_by(inner, outer)
    return pa.table({"_id": inner.ids[depth > 0], "depth": depth[depth > 0]})


def outline_roles(points: DataFrame, cell: float) -> DataFrame:
    """(drawing, path_id, n, area, depth, role) of closed outlines. points: drawing, path_id, i, x, y.

    An outline's depth is the number of outlines of its drawing that hold all of its corners (even-odd rule); odd
    depths are holes. Outlines meet through grid cells: one corner's cell against the cells of the others' boxes. Full cells are
    cut into blocks of CORNERS, and each pair of blocks is counted in one task, where most pairs cost a few bits; no pair
    goes further. Outlines without all of their coordinates hold nothing and are held by nothing.
    """
    path = ["drawing", "path_id"]
    w = W.partitionBy(*path)
    nx, ny = (F.coalesce(F.lead(c).over(w.orderBy("i")), F.min_by(c, "i").over(w)) for c in "xy")
    edges = points.select(*path, "i", "x", "y", nx.alias("nx"), ny.alias("ny"))
    shapes = edges.groupBy(*path).agg(
        F.count("*").alias("n"), (F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("area"), F.count_if(F.isnan("x") | F.isnan("y") | F.col("x").isNull() | F.col("y").isNull()).alias("gaps"),
        F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("corners"),
    )
    shapes = written(shapes.select("*", F.col("corners.x").cast("array<double>").alias("xs"), F.col("corners.y").cast("array<double>").alias("ys"), F.monotonically_increasing_id().alias("_id")).drop("corners"))
    whole = shapes.where("gaps = 0 and drawing is not null and path_id is not null")
    at = lambda c: F.floor(F.col(c) / cell)
    met = ["drawing", "cx", "cy"]
    inner = whole.withColumn("cx", at("x1")).withColumn("cy", at("y1")).select(*met, F.lit(False).alias("outer"), "_id", "n", "xs", "ys")
    outer = whole.where("n > 2").withColumn("cx", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("cy", F.explode(F.sequence(at("y1"), at("y2"))))
    both = inner.union(outer.select(*met, F.lit(True).alias("outer"), "_id", "n", "xs", "ys"))
    blocks = lambda role: F.ceil(F.sum(F.when(role, F.col("n"))) / CORNERS).cast("long")
    sizes = written(both.groupBy(*met).agg(blocks(~F.col("outer")).alias("inners"), blocks(F.col("outer")).alias("outers")).where("inners > 0 and outers > 0"))
    here, there = (F.when(F.col("outer"), F.col(p)).otherwise(F.col(q)) for p, q in (("outers", "inners"), ("inners", "outers")))
    dealt = both.join(sizes, met).withColumn("own", F.pmod(F.xxhash64("_id"), here)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), there - 1)))
    low, high = (F.when(F.col("outer"), F.col(p)).otherwise(F.col(q)) for p, q in (("other", "own"), ("own", "other")))
    key = [*met, "low", "high"]
    placed = dealt.select(*met, low.alias("low"), high.alias("high"), "outer", "_id", "xs", "ys").repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    depth = placed.groupBy(*key).applyInArrow(_depths, "_id long, depth long").groupBy("_id").agg(F.sum("depth").alias("depth"))
    out = shapes.join(depth, "_id", "left").withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))
    return out.select(*path, "n", "area", "depth", F.when(F.col("depth") % 2 == 1, "hole").otherwise("outer").alias("role"))


def crossings(segments: DataFrame, cell: float) -> DataFrame:
    """(a, b): ids of segments that properly cross. segments: id, x1, y1, x2, y2. Segments meet on grid cells."""
    low = lambda p, q: F.floor(F.least(p, q) / cell)
    high = lambda p, q: F.floor(F.greatest(p, q) / cell)
    cells = segments.withColumn("cx", F.explode(F.sequence(low("x1", "x2"), high("x1", "x2")))).withColumn("cy", F.explode(F.sequence(low("y1", "y2"), high("y1", "y2"))))
    a, b = cells.alias("a"), cells.alias("b")
    same = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.id") < F.col("b.id"))

    def side(s: str, p: str, k: str):
        c = lambda n: F.col(f"{s}.{n}")
        return F.signum((c("x2") - c("x1")) * (F.col(f"{p}.y{k}") - c("y1")) - (c("y2") - c("y1")) * (F.col(f"{p}.x{k}") - c("x1")))

    proper = (side("a", "b", "1") * side("a", "b", "2") < 0) & (side("b", "a", "1") * side("b", "a", "2") < 0)
    return a.join(b, same).where(proper).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


#: Share of the volume that meshing may lose, more of it a facet up to a most; millimetres that bounds may
#: differ; volume under which a shell is nothing.
LOST, LOST_A_FACET, MOST_LOST, BOUNDS_OFF, NOTHING = 0.003, 3e-7, 0.03, 0.06, 1e-12


def mesh_audit(facets: DataFrame) -> DataFrame:
    """(mesh_id, facets, degenerate, open_edges, bad_edges, shells, solids, cavities, flat_shells, volume, size_x, size_y,
    size_z, closed) of facets with corners x1..z3.

    Corners with equal coordinates are one vertex. A closed, consistently turned surface uses each undirected edge once
    in each direction. A sliver, two of whose corners are one vertex, closes by its neighbours: it takes part in nothing
    but the counts and the bounds. Shells are facets connected by edges; a shell of positive signed volume is a solid,
    a negative one a cavity. Volumes are measured from the mesh's first corner, which keeps their rounding small.
    """
    # adding zero makes -0.0 and 0.0 one vertex
    flat = facets.select("mesh_id", "facet", *((F.col(f"{c}{k}") + F.lit(0.0)).alias(f"{c}{k}") for k in "123" for c in "xyz"))
    origin = flat.groupBy("mesh_id").agg(F.min_by(F.struct("x1", "y1", "z1"), "facet").alias("o"), *(f(F.greatest(*(F.col(f"{c}{k}") for k in "123")) if f is F.max else F.least(*(F.col(f"{c}{k}") for k in "123"))).alias(f"{n}_{c}") for f, n in ((F.max, "high"), (F.min, "low")) for c in "xyz"))
    corner = lambda k: F.concat_ws(",", *(F.col(f"{c}{k}").cast("string") for c in "xyz"))
    ux, uy, uz, vx, vy, vz = (F.col(f"{c}{k}") - F.col(f"{c}1") for k in "23" for c in "xyz")
    cross = (uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx)
    volume = sum(((F.col(f"{c}1") - F.col(f"o.{c}1")) * n for c, n in zip("xyz", cross, strict=True)), F.lit(0.0)) / 6
    d = flat.join(origin.select("mesh_id", "o"), "mesh_id").select("mesh_id", "facet", *(corner(k).alias(f"c{k}") for k in "123"), volume.alias("volume"), (sum((n * n for n in cross), F.lit(0.0)) == 0).alias("thin"))
    d = checkpointed(d.withColumn("sliver", (F.col("c1") == F.col("c2")) | (F.col("c2") == F.col("c3")) | (F.col("c3") == F.col("c1"))))
    edge = lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), F.when(F.col(p) < F.col(q), 1).otherwise(-1).alias("turn"))
    real = d.where("not sliver")
    edges = real.select("mesh_id", "facet", F.explode(F.array(edge("c1", "c2"), edge("c2", "c3"), edge("c3", "c1"))).alias("e")).select("mesh_id", "facet", "e.*")
    uses = checkpointed(edges.groupBy("mesh_id", "a", "b").agg(F.count("*").alias("n"), F.sum("turn").alias("turn"), F.min("facet").alias("low"), F.max("facet").alias("high")))
    checked = uses.groupBy("mesh_id").agg(F.count_if(F.col("n") == 1).alias("open_edges"), F.count_if((F.col("n") > 2) | ((F.col("n") == 2) & (F.col("turn") != 0))).alias("bad_edges"))
    name = lambda f: F.concat_ws("#", "mesh_id", f)
    # an edge of two facets links them; one of more links all to its first
    two = uses.where("n = 2 and low <> high").select(name("low").alias("src"), name("high").alias("dst"))
    more = edges.join(uses.where("n > 2").select("mesh_id", "a", "b", "low"), ["mesh_id", "a", "b"]).select(name("facet").alias("src"), name("low").alias("dst"))
    found = connected_components(two.union(more)).withColumnRenamed("node", "name")
    placed = real.select("mesh_id", name("facet").alias("name"), "volume").join(found, "name", "left").withColumn("shell", F.coalesce("component", "name"))
    shells = placed.groupBy("mesh_id", "shell").agg(F.sum("volume").alias("v"))
    kinds = shells.groupBy("mesh_id").agg(
        F.count("*").alias("shells"), F.count_if(F.col("v") > 0).alias("solids"), F.count_if(F.col("v") < 0).alias("cavities"), F.count_if(F.abs("v") < NOTHING).alias("flat_shells"), F.sum("v").alias("volume")
    )
    counts = d.groupBy("mesh_id").agg(F.count("*").alias("facets"), F.count_if(F.col("sliver") | F.col("thin")).alias("degenerate"))
    none = F.lit(0).cast("long")
    out = counts.join(checked, "mesh_id", "left").join(kinds, "mesh_id", "left").join(origin, "mesh_id")
    told = out.select(
        "mesh_id", "facets", "degenerate", *(F.coalesce(c, none).alias(c) for c in ("open_edges", "bad_edges", "shells", "solids", "cavities", "flat_shells")),
        F.coalesce("volume", F.lit(0.0)).alias("volume"), *((F.col(f"high_{c}") - F.col(f"low_{c}")).alias(f"size_{c}") for c in "xyz"),
    )
    return told.withColumn("closed", (F.col("open_edges") == 0) & (F.col("bad_edges") == 0) & (F.col("volume") > 0))


def mesh_verdicts(audits: DataFrame, expected: DataFrame) -> DataFrame:
    """(mesh_id, verdict): ok, or the first that is wrong: edges, open, shells, volume, bounds. expected: (mesh_id,
    want_solids, want_volume, want_x, want_y, want_z)."""
    d = audits.join(expected, "mesh_id")
    lost = F.greatest(F.lit(1e-5), F.col("want_volume") * (LOST + F.least(F.lit(MOST_LOST), F.col("facets") * LOST_A_FACET)))
    off = [F.abs(F.col(f"size_{c}") - F.col(f"want_{c}")) > F.greatest(F.lit(BOUNDS_OFF), F.abs(f"want_{c}") * 1e-5) for c in "xyz"]
    verdict = (
        F.when(F.col("bad_edges") > 0, "edges").when(F.col("open_edges") > 0, "open").when((F.col("solids") != F.col("want_solids")) | (F.col("flat_shells") > 0), "shells")
        .when(F.abs(F.col("volume") - F.col("want_volume")) > lost, "volume").when(off[0] | off[1] | off[2], "bounds").otherwise("ok")
    )
    return d.select("mesh_id", verdict.alias("verdict"))
