"""Literal rows with known results."""

import pytest
from pyspark.sql import functions as F

from tracemill.functions import actions as A
from tracemill.functions import claims as C
from tracemill.functions import scalars as S
from tracemill.functions import text as T
from tracemill.operators import geometry, graph, intervals, keyed, sequences, statistics


def one(spark, **columns):
    row = spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()
    return row.asDict()


def test_scalars(spark):
    tokens = lambda w, h: S.image_tokens(F.lit(w), F.lit(h))
    r = one(
        spark, a=tokens(1280, 720), b=tokens(640, 480), c=tokens(3840, 2160), d=tokens(1, 500), grid=S.to_grid(F.lit(0.5)), off=S.to_grid(F.lit(1.5)),
        names=S.modifier_names(F.lit(2 + 8)), mask=S.modifier_mask(F.array(F.lit("shift"), F.lit("alt"))), small=S.whole_delta(F.lit(-0.2)), zero=S.whole_delta(F.lit(0.0)),
        nan=S.finite(F.lit(float("nan"))), unit=S.unit(F.lit(7.0), 5.0), compact=S.compact(F.lit("Ab c-9é")), text=S.text_tokens(F.lit("abcde")),
    )
    assert (r["a"], r["b"], r["d"]) == (880, 300, None) and r["c"] < 1100
    assert (r["grid"], r["off"], r["names"], r["mask"]) == (500, None, ["ctrl", "meta"], 5)
    assert (r["small"], r["zero"], r["nan"], r["unit"], r["compact"], r["text"]) == (-1, 0, None, 1.0, "abc9é", 3)


def test_gestures(spark):
    rows = [("w", 0.0, 0, "move", 9.0, 9.0), ("w", 1.0, 1, "press", 100.0, 50.0), ("w", 1.1, 2, "move", 150.0, 90.0), ("w", 1.15, 3, "move", 205.0, 150.0), ("w", 1.2, 4, "release", 210.0, 155.0)]
    rows += [("w", 2.0, 5, "press", 10.0, 10.0), ("w", 2.1, 6, "move", 11.0, 11.0), ("w", 2.2, 7, "release", 12.0, 10.0), ("w", 3.0, 8, "press", 0.0, 0.0), ("w", 3.1, 9, "move", 50.0, 0.0), ("w", 3.2, 10, "press", 1.0, 1.0)]
    got = sequences.gestures(spark.createDataFrame(rows, "workflow string, t double, line_no long, kind string, x double, y double")).orderBy("t").collect()
    assert [r["type"] for r in got] == ["drag", "click", "drag", "click"]
    assert (got[0]["end_x"], got[0]["end_y"], got[0]["path_points"]) == (210.0, 155.0, 2) and got[0]["duration"] == pytest.approx(0.2)
    assert got[2]["duration"] is None and got[1]["end_x"] is None


def test_typing_islands(spark):
    rows = [("w", t, i, c) for i, (t, c) in enumerate([(1000, "1"), (1700, "2"), (2400, "3"), (3200, "4")])]
    d = sequences.islands(spark.createDataFrame(rows, "w string, t long, i long, c string"), ["w"], "t", "i", F.lit(True), 750)
    got = d.groupBy("_island").agg(F.array_join(F.sort_array(F.collect_list("c")), "").alias("text"), F.max("t").alias("end")).orderBy("_island").collect()
    assert [(r["text"], r["end"]) for r in got] == [("123", 2400), ("4", 3200)]


def test_chunks_and_cycles(spark):
    acts = lambda *ts: F.array(*(F.struct(F.lit(t).alias("t")) for t in ts))
    r = one(spark, a=F.size(sequences.chunk_prefix(acts(0, 1, 5), 9, 1)), b=F.size(sequences.chunk_prefix(acts(0, 1, 2), 2, 1)), c=F.size(sequences.chunk_prefix(acts(3), 2, 1)))
    assert r == {"a": 2, "b": 2, "c": 1}
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate("ababababcc")], "s int, i int, x string")
    got = d.select("i", sequences.repeats_cycle(d, ["s"], ["i"], "x").alias("r")).orderBy("i").collect()
    assert [r["i"] for r in got if r["r"]] == [5, 6, 7]


def test_round_robin(spark):
    d = spark.createDataFrame([("a", "a1"), ("a", "a2"), ("a", "a3"), ("c", "c1")], "g string, n string")
    assert [r["n"] for r in sequences.round_robin(d, "g", ["n"]).orderBy("place").collect()] == ["a1", "c1", "a2", "a3"]


def test_scroll_fold_and_windows(spark):
    d = spark.createDataFrame([("w", t / 10, i, float(x)) for i, (t, x) in enumerate([(0, 4), (1, 4), (2, 4), (3, -1), (9, -1)])], "workflow string, t double, line_no long, delta double")
    got = sequences.fold(d, ["workflow"], ["t"], sequences.ScrollRuns, "workflow string, t double, end_t double, delta double, n long").orderBy("t").collect()
    assert [(r["delta"], r["n"]) for r in got] == [(8.0, 2), (4.0, 1), (-1.0, 1), (-1.0, 1)]
    steps = spark.createDataFrame([("w", i, 900, 10) for i in range(30)], "workflow string, i int, cost long, log_cost long")
    w = sequences.fold(steps, ["workflow"], ["i"], lambda: sequences.Windows(4000, header=600), "workflow string, first_step long, end_step long, history long, omitted long, tokens long").orderBy("first_step").collect()
    assert w[0]["first_step"] == 0 and w[-1]["end_step"] == 30 and all(a["end_step"] == b["first_step"] for a, b in zip(w, w[1:]))
    assert all(r["history"] + r["omitted"] == r["first_step"] and r["tokens"] <= 4000 for r in w)


def test_intervals(spark):
    p = spark.createDataFrame([("w", t) for t in (0, 1, 5, 9, 10)], "w string, t long")
    s = spark.createDataFrame([("w", 1, 1, 10), ("w", 2, 5, 6), ("w", 3, 7, 7)], "w string, id int, a long, b long")
    assert sorted((r["t"], r["id"]) for r in intervals.interval_join(p, s, ["w"], "t", "a", "b", 4).collect()) == [(1, 1), (5, 1), (5, 2), (9, 1)]
    r = spark.createDataFrame([("w", 6, 7)], "w string, a long, b long")
    assert [x["id"] for x in intervals.overlaps(s, r, ["w"], "a", "b", 3).collect()] == [1]
    assert sorted(x["id"] for x in intervals.overlaps(s, r, ["w"], "a", "b", 3, anti=True).collect()) == [2, 3]
    m = intervals.merged(spark.createDataFrame([("w", 1, 3), ("w", 2, 5), ("w", 7, 8)], "w string, a long, b long"), ["w"], "a", "b", 1)
    assert sorted((x["a"], x["b"], x["n"]) for x in m.collect()) == [(1, 5, 2), (7, 8, 1)]


def test_statistics(spark):
    d = spark.createDataFrame([("a", 1.0)] * 3 + [("b", 0.0)], "g string, v double")
    assert {r["scope"]: r["mean"] for r in statistics.with_macro(d, "g", F.col("v")).collect()} == {"group:a": 1.0, "group:b": 0.0, "overall": 0.75, "macro": 0.5}
    r = spark.createDataFrame([(1, i, v) for i, v in enumerate((1.0, 0.0, 0.0, 0.0))], "g int, i int, v double")
    got = r.select("i", statistics.leave_one_out(F.col("v"), "g").alias("a")).orderBy("i").collect()
    assert [x["a"] for x in got] == pytest.approx([1, -1 / 3, -1 / 3, -1 / 3])
    w = {x["g"]: x["n"] * x["weight"] for x in statistics.balanced_weights(spark.createDataFrame([("a",)] * 81 + [("b",)], "g string"), "g", 0.5).collect()}
    assert w["a"] == pytest.approx(0.9) and w["b"] == pytest.approx(0.1)
    q = statistics.nearest_rank(spark.createDataFrame([(1, v) for v in range(6)], "g int, v int"), ["g"], "v", {"p50": 0.5, "p90": 0.9}).first()
    assert (q["p50"], q["p90"]) == (2, 4)


def test_completions_validate(spark):
    good = '{"actions":[{"type":"click","x":500,"y":250,"button":"left"}]}'
    bad = ["nope", "```json\n{}```", '{"actions":[]}', good[:-1] + ',"more":1}', good.replace("500", "1000"), good.replace("500", "1.5"), good.replace("500", "true"), good.replace(',"button":"left"', ""), good.replace('"left"', '"left","modifiers":["hyper"]'), '{"actions":[{"type":"type_text","text":""}]}', '{"actions":[{"type":"scroll","x":1,"y":1,"delta_x":0,"delta_y":0}]}', '{"actions":[{"type":"scroll","x":1,"y":1,"delta_x":11,"delta_y":0}]}', '{"actions":[{"type":"dance"}]}', good.replace('"left"', '"left","clicks":4'), '{"actions":[{"type":"key","key":"Enter"}]}', '{"actions":[{"type":"scroll","x":1,"y":1,"dx":0,"dy":-3}]}']
    fine = [good, good.replace('"left"', '"left","clicks":2,"modifiers":["ctrl"]'), '{"actions":[{"type":"scroll","x":1,"y":1,"delta_x":0,"delta_y":-3},{"type":"key","key":"Enter","modifiers":[]}]}']
    d = spark.createDataFrame([(i, t) for i, t in enumerate(fine + bad)], "i int, t string")
    got = {r["i"]: r["e"] for r in d.select("i", A.errors(F.col("t")).alias("e")).collect()}
    assert [i for i, e in got.items() if not e] == list(range(len(fine))), got


def test_targets_of_neutral_actions(spark):
    """Expected objects are the contract's own examples."""
    schema = "i int, a struct<type:string,x:double,y:double,end_x:double,end_y:double,button:string,delta_x:double,delta_y:double,text:string,key_code:int,modifiers:int,clicks:int,dt:double>"
    names = "type x y end_x end_y button delta_x delta_y text key_code modifiers clicks dt".split()
    cases = [
        (dict(type="click", x=0.5, y=0.5), '{"type":"click","x":500,"y":500,"button":"left"}'),
        (dict(type="drag", x=0.1, y=0.1, end_x=0.2, end_y=0.3, button="left"), '{"type":"drag","x":100,"y":100,"end_x":200,"end_y":300,"button":"left"}'),
        (dict(type="scroll", x=0.5, y=0.5, delta_x=0.0, delta_y=-2.0), '{"type":"scroll","x":500,"y":500,"delta_x":0,"delta_y":-2}'),
        (dict(type="key", key_code=90, text="\x1a", modifiers=2), '{"type":"key","key":"z","modifiers":["ctrl"]}'),
        (dict(type="click", x=0.5, y=0.25, button="Right", modifiers=0, clicks=2), '{"type":"click","x":500,"y":250,"button":"right","modifiers":[],"clicks":2}'),
        (dict(type="key", key_code=16, text="", modifiers=1), A.SKIPPED),
        (dict(type="drag", x=0.1, y=0.1), "conversion_error:coordinates"),
        (dict(type="key", key_code=177, text="", modifiers=0), A.SKIPPED),
        (dict(type="key", key_code=9999, text="\x01\x02", modifiers=0), "conversion_error:unmapped_key"),
        (dict(type="scroll", x=0.5, y=0.5), "conversion_error:zero_scroll"),
    ]
    d = spark.createDataFrame([(i, tuple(a.get(n) for n in names)) for i, (a, _) in enumerate(cases)], schema)
    j = d.select("i", F.get(A.judged(F.array("a")), F.lit(0)).alias("a"))
    got = {r["i"]: r["x"] for r in j.select("i", F.coalesce("a.outcome", A.target(F.col("a"))).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_row_reasons(spark):
    fields = "type string, x double, y double, end_x double, end_y double, button string, delta_x double, delta_y double, text string, key_code int, modifiers int, clicks int, dt double"
    of = lambda **a: tuple(a.get(f.split()[0]) for f in fields.split(", "))
    click, text, drag, shift = of(type="click", x=0.5, y=0.25, dt=0.5), of(type="type_text", text="a", dt=0.9), of(type="drag", x=0.1, y=0.1, end_x=0.5, end_y=0.5, dt=0.5), of(type="key", key_code=16, text="", dt=0.1)
    late = of(type="type_text", text="b", dt=3.0)
    rows = [([click, text, late], "f", None, 2), ([drag], "f", "drag_excluded", 1), ([], "f", "no_actions", 0), ([click], None, "no_image", 1), ([shift], "f", "only_modifier_keys", 0), ([click, of(type="dance")], "f", "conversion_error:type", 1)]
    d = spark.createDataFrame([(i, a, f) for i, (a, f, _, _) in enumerate(rows)], f"i int, a array<struct<{fields.replace(' ', ':').replace(',:', ', ')}>>, f string")
    j = d.select("i", "f", A.judged(F.col("a")).alias("a"))
    got = {r["i"]: (r["why"], r["n"]) for r in j.select("i", A.row_reason(F.col("a"), F.col("f"), most=4).alias("why"), F.size(A.chunk(F.col("a"), most=4)).alias("n")).collect()}
    assert [got[i] for i in range(len(rows))] == [(why, n) for _, _, why, n in rows]


def test_keyed(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "2", 2)], "k string, v string, n int")
    new = spark.createDataFrame([("b", "3", 3), ("c", "4", 4)], "k string, v string, n int")
    assert sorted((r["k"], r["v"], r["n"]) for r in keyed.upsert(old, new, ["k"], "n").collect()) == [("a", "1", 1), ("b", "3", 2), ("c", "4", 4)]
    assert {r["k"]: r["status"] for r in keyed.reconcile(old, new, "k", "v").collect()} == {"a": "lost", "b": "changed", "c": "added"}
    h = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "c string, n int")
    assert sorted(r["n"] for r in keyed.except_latest(h, h.where("n = 1"), "c", "n").collect()) == [1, 2]


def test_graph_and_mesh(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9] + [(50, 50), (60, 61), (61, 60)], "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.connected_components(e).collect()}
    assert got == {**{i: i // 10 * 10 for i in range(40)}, 50: 50, 60: 60, 61: 60}
    n = spark.createDataFrame([(i,) for i in range(5)], "id long")
    d = graph.depths(n, spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 3), (4, 0)], "src long, dst long"))
    assert {r["id"]: r["depth"] for r in d.collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 3}
    with pytest.raises(ValueError):
        graph.depths(n, spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))
    c = {"o": (0, 0, 0), "p": (1, 0, 0), "q": (0, 1, 0), "r": (0, 0, 1)}
    tetra = ["oqp", "opr", "orq", "pqr"]
    meshes = {"good": tetra, "open": tetra[:3], "flipped": [tetra[0][::-1], *tetra[1:]], "inward": [f[::-1] for f in tetra]}
    rows = [(m, i, *(float(v) for k in f for v in c[k])) for m, fs in meshes.items() for i, f in enumerate(fs)]
    schema = "mesh_id string, facet int, " + ", ".join(f"{a}{k} double" for k in "123" for a in "xyz")
    got = {r["mesh_id"]: r for r in geometry.mesh_audit(spark.createDataFrame(rows, schema)).collect()}
    assert {m for m, r in got.items() if r["closed"]} == {"good"} and got["good"]["volume"] == pytest.approx(1 / 6) and got["open"]["open_edges"] == 3


def test_text(spark):
    r = one(spark, key=T.normal_key(F.lit("  A\t b ")), err=T.last_error(F.lit("x\nValueError: a\nKeyError: b\nend")), yes=T.quoted(F.lit("Hello  World"), F.lit("say hello world!")), short=T.quoted(F.lit("abc"), F.lit("abc")), m=C.measurements(F.lit("5 mm and 3.5cm, 7")))
    assert r == {"key": "a b", "err": "KeyError: b", "yes": True, "short": False, "m": ["5 mm", "3.5cm"]}
