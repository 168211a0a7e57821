import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tracemill.functions import keys
from tracemill.operators import graph, sequences
from tracemill.sources import lines


def test_json_lines(spark, tmp_path):
    path = f"{tmp_path}/a.jsonl"
    with open(path, "w") as f:
        f.write('{"a": 1, "b": "é\\n"}\n\n[1, 2]\n"text"\n{"a": 2}\n')
    got = lines.json_lines(spark, path, "a int, b string").orderBy("line_no").collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, "é\n"), (2, None)]
    with open(path, "a") as f:
        f.write('{"a": 3\n')
    assert lines.json_lines(spark, path, "a int", strict=False).count() == 2
    with pytest.raises(Exception, match="malformed line"):
        lines.json_lines(spark, path, "a int").collect()


def test_workflows_and_splits(spark, tmp_path):
    for name in ("x/1", "x/2", "y/1"):
        os.makedirs(f"{tmp_path}/{name}")
        with open(f"{tmp_path}/{name}/task_desc.json", "w") as f:
            json.dump({"task": name}, f, indent=1)
    assert sorted(map(tuple, lines.workflows(spark, str(tmp_path)).collect())) == [("x", "1"), ("x", "2"), ("y", "1")]
    assert lines.one_object(spark, f"{tmp_path}/x/1/task_desc.json", "task string").first()["task"] == "x/1"
    d = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    lines.write_splits(d, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    with pytest.raises(Exception, match="EXISTS|exists"):
        lines.write_splits(d, f"{tmp_path}/out")


def test_file_kinds(spark):
    stl = bytes(80) + (1).to_bytes(4, "little") + bytes(50)
    files = [("a", b"ISO-10303-21;\n"), ("b", b"<?xml version='1.0'?><svg/>"), ("c", b"0\nSECTION\n"), ("d", stl), ("e", stl[:-1]), ("f", b"solid x")]
    d = spark.createDataFrame(files, "name string, content binary")
    assert [r[0] for r in d.select(lines.file_kind(F.col("content"), F.col("name"))).collect()] == ["step", "svg", "dxf", "stl", None, "stl"]


def test_key_names(spark):
    rows = [(13, None, "Enter"), (100, None, "4"), (90, None, "z"), (115, None, "F4"), (None, "\r", "Enter"), (None, "Q", "q"), (None, "%", "%"), (None, "\x1a", "z"), (9999, None, None)]
    d = spark.createDataFrame([(i, c, t) for i, (c, t, _) in enumerate(rows)], "i int, c int, t string")
    assert [r[0] for r in d.orderBy("i").select(keys.key_name(F.col("c"), F.col("t"))).collect()] == [x for _, _, x in rows]


def test_joined_typing(spark):
    rows = [("w", 1, 0.0, "type_text", "4"), ("w", 2, 0.5, "type_text", "0"), ("w", 3, 1.4, "type_text", "x"), ("w", 4, 9.0, "type_text", "y"), ("w", 5, 9.1, "key", ""), ("w", 6, 9.2, "type_text", "z")]
    d = spark.createDataFrame(rows, "workflow string, segment long, t double, kind string, text string")
    got = sequences.fold(d, ["workflow"], ["t", "segment"], sequences.JoinedTyping, "workflow string, segment long, t double, kind string, text string").orderBy("segment").collect()
    assert [(r["segment"], r["text"]) for r in got] == [(1, "40x"), (4, "y"), (5, ""), (6, "z")]


def test_merkle(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    n = spark.createDataFrame([(1, "a"), (2, "b"), (3, "u"), (4, "a"), (5, "u")], "id long, name string")
    e = spark.createDataFrame([(3, 1), (3, 2), (5, 4), (5, 2)], "src long, dst long")
    got = {r["id"]: r["signature"] for r in graph.merkle(n, e).collect()}
    assert got[3] == got[5] == sha("u" + "".join(sorted([sha("a"), sha("b")]))) and got[1] == got[4] == sha("a")


def test_levels_do_not_pass_through_the_driver(spark):
    """Nothing of a graph is broadcast, and a node without a name has no signature."""
    n = spark.createDataFrame([(0, "a"), (1, None), (2, "b"), (3, "c"), (4, "d")], "id long, name string")
    e = spark.createDataFrame([(2, 0), (3, 1), (4, 2), (4, 0)], "src long, dst long")
    sent = []
    bus = graph.written, graph.checkpointed
    seen = lambda keep: lambda d: (sent.append(d._jdf.queryExecution().executedPlan().toString()), keep(d))[1]
    graph.written, graph.checkpointed = map(seen, bus)
    try:
        got = {r["id"]: r["signature"] for r in graph.merkle(n, e).collect()}
    finally:
        graph.written, graph.checkpointed = bus
    assert any("SortMergeJoin" in p for p in sent) and not any("Broadcast" in p for p in sent)
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    two = h("b" + h("a"))
    assert got == {0: h("a"), 1: None, 2: two, 3: h("c"), 4: h("d" + "".join(sorted((two, h("a")))))}
