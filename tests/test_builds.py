"""Builds that stop anywhere and go on; revisions that one of two writers gets."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from tracemill.sources import build, ledger, publish

NONE = "cast(NULL AS string)"


def rows(spark, n=40):
    return spark.range(n).select((F.col("id") % 5).alias("u"), "id", F.concat(F.lit("v"), "id").alias("v"))


def told(spark, root):
    return {r["unit"]: (r["status"], r["reason"], r["rows"], r["number"]) for r in build.state(spark, root).collect()}


def test_failed_units_are_done_again(spark, tmp_path):
    root, d = str(tmp_path), rows(spark)
    odd = F.when(F.col("id").isin(7, 13), F.concat(F.lit("bad "), "v"))
    planned = spark.createDataFrame([("0",), ("9",), (None,)], "unit string")
    assert build.run(spark, root, d, "u", odd, planned) == 6
    assert told(spark, root) == {**{k: ("complete", None, 8, 1) for k in "014"}, "2": ("failed", "bad v7", 8, 1), "3": ("failed", "bad v13", 8, 1), "9": ("skipped", "no rows", 0, 1)}
    assert build.built(spark, root).count() == 24
    assert build.run(spark, root, d, "u", F.expr(NONE), planned) == 2
    assert told(spark, root) == {**{k: ("complete", None, 8, 1) for k in "014"}, **{k: ("complete", None, 8, 2) for k in "23"}, "9": ("skipped", "no rows", 0, 1)}
    assert sorted(map(tuple, build.built(spark, root).select(d.columns).collect())) == sorted(map(tuple, d.collect()))
    assert build.run(spark, root, d, "u", odd, planned) == 0 and build.built(spark, root).count() == 40


@pytest.mark.parametrize("dies_at", ["rows", "publish"])
def test_a_run_that_dies_hadnt_been(spark, tmp_path, monkeypatch, dies_at):
    root, d = str(tmp_path), rows(spark)
    build.run(spark, root, d.where("u = 1"), "u", F.expr(NONE))
    with pytest.raises(Exception, match="killed"):
        if dies_at == "rows":
            build.run(spark, root, d, "u", F.when(F.col("id") == 33, F.raise_error(F.lit("killed"))).otherwise(F.expr(NONE)))
        else:
            with monkeypatch.context() as m:
                m.setattr(publish, "put_new", lambda *a: (_ for _ in ()).throw(OSError("killed")))
                build.run(spark, root, d, "u", F.expr(NONE))
    assert told(spark, root) == {"1": ("complete", None, 8, 1)} and build.built(spark, root).count() == 8
    assert build.run(spark, root, d, "u", F.expr(NONE)) == 4
    assert sorted(map(tuple, build.built(spark, root).select(d.columns).collect())) == sorted(map(tuple, d.collect()))


def test_nothing_yet(spark, tmp_path):
    assert build.state(spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        build.built(spark, str(tmp_path))
    assert build.run(spark, str(tmp_path), rows(spark).where("false"), "u", F.expr(NONE)) == 0


def test_one_of_two_writers_wins(spark, tmp_path):
    log = ledger.Ledger(spark, str(tmp_path / "log"))
    assert log.head() is None and log.revisions() == []
    assert log.commit(rows(spark, 3), None, "first") == "r0001"
    with pytest.raises(ledger.Conflict):
        log.commit(rows(spark, 9), None)
    won, lost, ready = [], [], threading.Barrier(2)

    def write(n):
        ready.wait()
        try:
            won.append((log.commit(rows(spark, n), "r0001", f"of {n}"), n))
        except ledger.Conflict:
            lost.append(n)

    writers = [threading.Thread(target=write, args=(n,)) for n in (4, 5)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert len(won) == len(lost) == 1 and won[0][0] == log.head() == "r0002"
    assert log.read().count() == won[0][1] and log.read("r0001").count() == 3
    assert log.restore("r0001", "r0002") == "r0003" and log.read().count() == 3
    assert [(r["id"], r["parent"], r["restored_from"], r["rows"]) for r in log.revisions()] == [("r0001", None, None, 3), ("r0002", "r0001", None, won[0][1]), ("r0003", "r0002", "r0001", 3)]
    assert log.revisions()[0]["digest"] == log.revisions()[2]["digest"] != log.revisions()[1]["digest"]


def test_a_writer_that_dies_leaves_the_head(spark, tmp_path, monkeypatch):
    log = ledger.Ledger(spark, str(tmp_path / "log"))
    log.commit(rows(spark, 3), None)
    with monkeypatch.context() as m:
        m.setattr(publish, "put_new", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            log.commit(rows(spark, 4), "r0001")
    assert log.head() == "r0001" and log.commit(rows(spark, 5), "r0001") == "r0002"


def test_published_once(spark, tmp_path):
    path = str(tmp_path / "x.json")
    publish.put_new(spark, path, {"é": [1, None]})
    with pytest.raises(publish.Taken):
        publish.put_new(spark, path, {})
    assert publish.get(spark, path) == {"é": [1, None]} and [n for n in os.listdir(tmp_path) if n.endswith(".tmp")] == []


def test_replayed(spark):
    a = [(1, 1, 10, None), (1, 2, 11, 0), (1, 3, 12, 1), (1, 4, 13, 3), (None, 1, 2**60 + 1, 0), (None, 2, 2**60 + 3, 1)]
    got = ledger.replayed(spark.createDataFrame(a, "project long, at long, attempt long, expected long")).collect()
    assert {(r["project"], r["attempt"]): r["revision"] for r in got} == {(1, 10): "r0001", (1, 11): None, (1, 12): "r0002", (1, 13): None, (None, 2**60 + 1): "r0001", (None, 2**60 + 3): "r0002"}
