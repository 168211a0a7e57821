"""Binary STL files written by hand, read back and audited."""

import struct

import pytest
from pyspark.sql import functions as F

from tracemill.operators import geometry
from tracemill.sources import stl


def box(x0, y0, z0, a, b, c, inward=False):
    """Twelve facets of a box."""
    p = [(x0 + a * (k & 1), y0 + b * (k >> 1 & 1), z0 + c * (k >> 2)) for k in range(8)]
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    tris = [t for q in quads for t in ((q[0], q[1], q[2]), (q[0], q[2], q[3]))]
    return [[p[i] for i in (t[::-1] if inward else t)] for t in tris]


def written(path, tris, count=None, more=b""):
    body = b"".join(struct.pack("<12fH", 0, 0, 0, *(v for p in t for v in p), 0) for t in tris)
    path.write_bytes(b"binary mesh".ljust(80) + struct.pack("<I", len(tris) if count is None else count) + body + more)


def test_files(spark, tmp_path):
    one, cavity, two = box(5, 5, 5, 10, 20, 30), box(8, 8, 8, 2, 2, 2, inward=True), box(100, 0, 0, 1, 1, 1)
    meshes = {
        "box": one, "hollow": one + cavity, "pair": one + two, "open": one[:-1], "turned": [one[0][::-1], *one[1:]], "inward": box(0, 0, 0, 1, 1, 1, inward=True),
        "sliver": one + [[one[0][0], one[0][0], one[0][1]]], "zero": box(-0.0, 0.0, -0.0, 2, 2, 2), "doubled": one + one,
    }
    for name, tris in meshes.items():
        written(tmp_path / f"{name}.stl", tris)
    written(tmp_path / "short.stl", one[:3])
    written(tmp_path / "lies.stl", one, count=11)
    written(tmp_path / "tail.stl", one, more=b"x")
    (tmp_path / "stub.stl").write_bytes(b"solid")
    files = stl.files(spark, f"{tmp_path}/*.stl").withColumn("mesh_id", F.regexp_extract("mesh_id", "([a-z]+)[.]stl$", 1))
    bad = {r["mesh_id"]: r["p"] for r in files.select("mesh_id", stl.problem(F.col("content")).alias("p")).collect() if r["p"]}
    assert bad == {"short": "not a bounded binary mesh", "lies": "not a bounded binary mesh", "tail": "not a bounded binary mesh", "stub": "truncated"}
    facets = stl.facets(files)
    assert facets.where("mesh_id = 'box'").count() == 12
    audits = geometry.mesh_audit(facets)
    got = {r["mesh_id"]: r for r in audits.collect()}
    assert set(got) == set(meshes)
    told = {m: (r["open_edges"], r["bad_edges"], r["shells"], r["solids"], r["cavities"], r["degenerate"]) for m, r in got.items()}
    assert told == {
        "box": (0, 0, 1, 1, 0, 0), "hollow": (0, 0, 2, 1, 1, 0), "pair": (0, 0, 2, 2, 0, 0), "open": (3, 0, 1, 1, 0, 0), "turned": (0, 3, 1, 1, 0, 0), "inward": (0, 0, 1, 0, 1, 0),
        "sliver": (0, 0, 1, 1, 0, 1), "zero": (0, 0, 1, 1, 0, 0), "doubled": (0, 18, 1, 1, 0, 0),
    }
    assert got["box"]["volume"] == pytest.approx(6000) and got["hollow"]["volume"] == pytest.approx(5992) and (got["pair"]["size_x"], got["box"]["size_z"]) == (96, 30)
    want = [("box", 1, 6000.0, 10.0, 20.0, 30.0), ("hollow", 1, 5992.0, 10.0, 20.0, 30.0), ("pair", 1, 6001.0, 96.0, 25.0, 35.0), ("open", 1, 6000.0, 10.0, 20.0, 30.0), ("turned", 1, 6000.0, 10.0, 20.0, 30.0), ("inward", 0, -1.0, 1.0, 1.0, 1.0), ("sliver", 1, 6100.0, 10.0, 20.0, 30.0), ("zero", 1, 8.0, 2.0, 2.1, 2.0)]
    expected = spark.createDataFrame(want, "mesh_id string, want_solids long, want_volume double, want_x double, want_y double, want_z double")
    verdicts = {r["mesh_id"]: r["verdict"] for r in geometry.mesh_verdicts(audits, expected).collect()}
    assert verdicts == {"box": "ok", "hollow": "ok", "pair": "shells", "open": "open", "turned": "edges", "inward": "ok", "sliver": "volume", "zero": "bounds"}


def test_round_trip(spark):
    d = spark.createDataFrame([(1, [[float(v) for p in t for v in p] for t in box(0, 0, 0, 1, 2, 3)]), (2, []), (3, None)], "mesh_id long, c array<array<double>>")
    files = d.select("mesh_id", stl.binary(F.col("c")).alias("content"))
    got = stl.facets(files).collect()
    assert len(got) == 12 and {r["mesh_id"] for r in got} == {1} and {r["facet"] for r in got} == set(range(12))
    assert stl.facets(files.limit(0)).count() == 0 and geometry.mesh_audit(stl.facets(files.limit(0))).count() == 0
