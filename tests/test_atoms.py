"""Atomic actions: literal recordings, in a fold and in a stream."""

from pyspark.sql import functions as F

from tracemill.operators import atoms as A
from tracemill.streaming import jobs

NAMES = [f.split()[0] for f in A.EVENT.split(", ")]
SCREEN = {"kind": "screen_config", "screens": 1, "width": 100, "height": 100}
APP = {"kind": "active_app", "app": "SolidWorks 2024"}
SCHEMA = "workflow long, " + A.EVENT


def recording(*events):
    """Rows of one recording: (kind, t, more)."""
    rows = [SCREEN | {"t": 0.0}, APP | {"t": 0.0}] + [{"kind": k, "t": t} | more for k, t, more in events]
    return [{"line": n} | r for n, r in enumerate(rows)]


def frame(spark, recordings):
    rows = [tuple([w, *(r.get(c) for c in NAMES)]) for w, rs in enumerate(recordings) for r in rs]
    d = spark.createDataFrame(rows, SCHEMA)
    return d.withColumn("on_app", A.app_matches(F.col("app"), "solidworks", "SolidWorks"))


def key(c, **more):
    return {"text": c, "key": c, **more}


def mouse(x, y, down, **more):
    return {"x": float(x), "y": float(y), "down": down, **more}


RECORDINGS = [
    recording(("key", 1.0, key("1")), ("key", 1.7, key("2")), ("key", 2.4, key("3")), ("key", 3.2, key("4"))),
    recording(
        ("key", 1.0, key("1")), ("active_app", 1.1, {"app": "Browser"}), ("key", 1.2, key("2")), ("active_app", 1.3, {"app": "SolidWorks"}), ("key", 1.4, key("3")),
        ("privacy_mask_start", 1.5, {}), ("key", 1.6, key("4")), ("privacy_mask_end", 1.7, {}), ("key", 1.8, key("5")),
    ),
    recording(("modifier_change", 0.9, {"modifiers": 2}), ("click", 1.0, mouse(10, 20, True)), ("drag", 1.1, {"x": 40.0, "y": 50.0}), ("click", 1.2, mouse(40, 50, False))),
    recording(*(("click", 1 + 0.05 * n, mouse(10, 10, n % 2 == 0, clicks=n // 2 + 1)) for n in range(8))),
    recording(("click", 1.0, mouse(10, 10, True)), ("scroll", 2.0, {"x": -1.0, "y": 20.0, "delta_y": 1.0})),
    recording(*(("scroll", 1 + 0.1 * n, {"x": 5.0, "y": 5.0, "delta_y": d}) for n, d in enumerate((6.0, 3.0, 2.0, -1.0, -1.0, 11.0, float("nan"))))),
    recording(("click", 1.0, mouse(10, 10, True)), ("key", 1.1, key("a")), ("click", 1.2, mouse(10, 10, False)), ("click", 1.3, mouse(10, 10, True)), ("click", 1.4, mouse(10, 10, False, button="right"))),
    recording(("key", None, key("a")), ("key", float("nan"), key("b")), ("key", -1.0, key("c")), ("key", 1.0, key("d", modifiers=16)), ("key", 1.1, key("e", screen=1)), ("key", 1.2, {"key": "Shift"}), ("key", 1.3, {"key": "Enter", "text": "\r"}), ("key", 1.4, key("f", modifiers=2)), ("key", 1.5, key("G", modifiers=1))),
]


def told(rows):
    """Actions and rejects of each recording in a short form."""
    out = {}
    for r in sorted(rows, key=lambda r: (r["workflow"], r["line"], r["type"] == "reject", str(r["reason"]))):
        short = r["reason"] if r["type"] == "reject" else (r["type"], r["text"] or r["clicks"] or r["delta_y"], round(r["end_t"], 3), r["epoch"], round(r["lower"], 3))
        out.setdefault(r["workflow"], []).append(short)
    return out


WANT = {
    0: [("type_text", "123", 2.4, 1, 0.0), ("type_text", "4", 3.2, 1, 2.4)],
    1: [("type_text", "1", 1.0, 2, 0.0), "off_target_or_unknown_app", ("type_text", "3", 1.4, 5, 1.3), "privacy_or_multiscreen", ("type_text", "5", 1.8, 8, 1.7)],
    2: [("drag", None, 1.2, 2, 0.0)],
    3: [("click", 3, 1.25, 2, 0.0), ("click", 1, 1.35, 2, 1.25)],
    4: ["incomplete_pointer_gesture", "invalid_pointer_coordinates"],
    5: [("scroll", 9.0, 1.1, 2, 0.0), ("scroll", 2.0, 1.2, 2, 1.1), ("scroll", -2.0, 1.4, 2, 1.2), "unsupported_scroll_magnitude", "unsupported_scroll_magnitude"],
    6: ["incomplete_pointer_gesture", ("type_text", "a", 1.1, 3, 1.1), "overlapping_pointer_and_input", "incomplete_pointer_gesture", "changing_pointer_button_or_modifiers"],
    7: ["invalid_timestamp"] * 3 + ["unknown_modifiers", "privacy_or_multiscreen", ("key", "\r", 1.3, 4, 1.1), ("key", "f", 1.4, 4, 1.3), ("type_text", "G", 1.5, 4, 1.4)],
}
WANT[0] = [(a, b, c, 2, e) for a, b, c, _, e in WANT[0]]


def test_fold(spark):
    got = told(A.atoms(frame(spark, RECORDINGS)).collect())
    for w, want in WANT.items():
        assert got.get(w) == want, w
    drag = A.atoms(frame(spark, RECORDINGS)).where("type = 'drag'").first()
    assert (drag["x"], drag["end_y"], drag["modifiers"]) == (0.1, 0.5, 2)


def test_app_matches(spark):
    cases = {"SOLIDWORKS 2024 - [part]": True, "solid": True, "Browser": False, "": False, None: False, "…": False, "Solid Works": True}
    d = spark.createDataFrame([(k,) for k in cases], "n string")
    got = {r["n"]: r["m"] for r in d.select("n", A.app_matches(F.col("n"), "solidworks", "SolidWorks").alias("m")).collect()}
    assert got == cases
    assert d.select(A.app_matches(F.lit("Siemens NX 12"), "nx-cad", "").alias("m")).first()["m"]


def test_stream_equals_fold(spark, tmp_path):
    """Micro-batches cut the recordings anywhere; a closing row or an hour's silence ends them."""
    d = frame(spark, RECORDINGS).withColumn("t", F.when(F.isnan("t") | (F.col("t") < 0), None).otherwise(F.col("t")))
    stamped = d.withColumn("ts", F.timestamp_seconds(F.coalesce("t", F.lit(0.0)) + 1_000_000)).cache()
    last = stamped.groupBy("workflow").agg(F.max("ts").alias("ts"), F.max("t").alias("t"))
    closing = stamped.limit(0).unionByName(last.where("workflow % 2 = 0").select("workflow", "ts", F.lit("closed").alias("kind"), (F.col("t") + 1).alias("t"), F.lit(10**6).cast("long").alias("line")), allowMissingColumns=True)
    later = stamped.where("workflow = 0 and line = 0").withColumn("workflow", F.lit(999).cast("long")).withColumn("ts", F.expr("ts + interval 3 days"))
    steps = [stamped.where("t is null or t < 1.15"), stamped.where("t >= 1.15 and t < 1.45"), stamped.where("t >= 1.45"), closing, later, later.withColumn("ts", F.expr("ts + interval 1 day"))]
    for n, s in enumerate(steps):
        s.repartition(1).write.parquet(str(tmp_path / f"in/step={n}"))
    raw = spark.readStream.schema(stamped.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with jobs.durable_state(spark):
        got = jobs.to_end(jobs.atoms_of(raw.drop("step")))
    want = A.atoms(stamped.drop("ts")).collect()
    assert told(r for r in got.collect() if r["workflow"] != 999) == told(want)
