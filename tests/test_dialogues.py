"""Prompts, sessions, labels and claims on hand-made rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.parity import differs
from tracemill.functions import claims as C
from tracemill.functions import messages as M
from tracemill.operators import grounding, sessions
from tracemill.plans import PLANS, TWINS

TASK = "struct<application:string,task:string,description:string,requirements:array<string>>"


def told(spark, task, column):
    return spark.createDataFrame([(task,)], f"task {TASK}").select(column(F.col("task")).alias("x")).first().x


def test_prompt_leaves_empty_lines_out(spark):
    task = ("Draw", "Bracket", "", ["5 mm", "two holes"])
    assert told(spark, task, lambda t: M.prompt(t, F.lit("open  "))) == f"Application: Draw\nTask: Bracket\nRequirements:\n- 5 mm\n- two holes\nCurrent intent: open\n{M.ASK}"
    assert told(spark, (None, None, None, None), lambda t: M.prompt(t, F.lit(None).cast("string"))) == f"Application: \nCurrent intent:\n{M.ASK}"
    assert told(spark, task, lambda t: M.task_header(t, requirements=False)) == "Application: Draw\nTask: Bracket"
    full = told(spark, ("Draw", "Bracket", None, []), lambda t: M.full_prompt(t, F.lit(""), F.lit("click")))
    assert full == f"Application: Draw\nTask: Bracket\nDescription: \nRequirements:\n\nCurrent intent: click\n{M.ASK_VERIFIED}"


def test_answer_writes_nulls(spark):
    acts = F.array(F.struct(F.lit("é\n\"").alias("text"), F.lit(None).cast("int").alias("x")))
    assert spark.range(1).select(M.answer(F.lit(None).cast("string"), acts).alias("x")).first().x == '{"summary":null,"actions":[{"text":"é\\n\\"","x":null}]}'


def test_markup(spark):
    m = F.array(M.message("system", F.lit(" be brief \n")), M.message("user", F.lit("a"), image=True), M.message("assistant", F.lit("b")), M.message("user", F.lit("c")), M.message("assistant", F.lit(" d ")))
    r = spark.range(1).select(M.rendered(m).alias("whole"), M.rendered(m, think=False).alias("plain"), M.rendered(m, answered=False).alias("ask"), M.rendered(F.slice(m, 1, 2), answered=False).alias("none")).first()
    start = f"<|im_start|>system\nbe brief<|im_end|>\n<|im_start|>user\n{M.IMAGE}a<|im_end|>\n"
    middle = "<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n<|im_start|>assistant\n"
    assert r.whole == start + middle + M.THINK + "d<|im_end|>"
    assert r.plain == start + middle + "d<|im_end|>"
    assert r.ask == start + middle + M.THINK
    assert r.none == start
    with pytest.raises(Exception, match="unexpected role"):
        spark.range(1).select(M.rendered(F.array(M.message("tool", F.lit("x"))))).collect()


def plain_labels(ids, header, think, end):
    """Token by token."""
    out, i = [-100] * len(ids), 0
    while i < len(ids):
        if ids[i : i + len(header)] != header:
            i += 1
            continue
        at = i + len(header)
        at += len(think) if ids[at : at + len(think)] == think else 0
        stop = next((k for k in range(at, len(ids)) if ids[k] == end), None)
        if stop is None:
            break
        out[at : stop + 1] = ids[at : stop + 1]
        i = stop + 1
    return out


def test_labels_as_token_by_token(spark):
    rng = random.Random(5)
    header, think, end = [1, 12], [3], 5
    rows = [[rng.choice([1, 12, 2, 3, 5, 55, 112]) for _ in range(rng.randrange(60))] for _ in range(300)] + [[], [5], header, header + [5], header + think + [5, 5], header * 3 + [7, 5, 7]]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, ids array<int>")
    got = {r.id: r.l for r in d.select("id", M.labels(F.col("ids"), header, think, end).alias("l")).collect()}
    assert all(got[i] == plain_labels(r, header, think, end) for i, r in enumerate(rows))
    bare = {r.id: r.l for r in d.select("id", M.labels(F.col("ids"), header, [], end).alias("l")).collect()}
    assert all(bare[i] == plain_labels(r, header, [], end) for i, r in enumerate(rows))


def test_sessions_tell_what_came_before(spark):
    rows = [("w", i, f"go {i}", "x" * 50) for i in range(6)] + [("v", 0, None, None)]
    d = spark.createDataFrame(rows, "workflow string, step long, intent string, completion string")
    got = {(r.workflow, r.first_step): r for r in sessions.windowed(d, 400, header=10).collect()}
    assert got["v", 0].end_step == 1 and got["v", 0].lines == []
    firsts = sorted(f for w, f in got if w == "w")
    assert firsts[0] == 0 and len(firsts) > 1
    for f in firsts:
        r = got["w", f]
        assert [s.number for s in r.steps] == list(range(f + 1, r.end_step + 1))
        assert r.lines == [f"{i + 1}. go {i} -> {'x' * 50}" for i in range(r.omitted, f)]
    task = F.struct(F.lit("Draw").alias("application"), *(F.lit(None).cast("string").alias(n) for n in ("task", "description")), F.lit(None).cast("array<string>").alias("requirements"))
    m = sessions.windowed(d, 400, header=10).select("workflow", "first_step", M.session_messages("S", task, F.col("steps"), F.col("lines"), F.lit(2)).alias("m"), M.session_messages("S", task, F.col("steps"), F.array().cast("array<string>"), F.lit(0)).alias("n"))
    r = m.where("workflow = 'v'").first()
    assert [x.role for x in r.m] == ["system", "user", "assistant"]
    assert r.m[1].content[1].text == f"Application: Draw\n\nEarlier steps:\n(2 earlier steps omitted)\n\nStep 1\nCurrent intent: \n{M.ASK}"
    assert r.n[1].content[1].text == f"Application: Draw\n\nEarlier steps: (none)\n\nStep 1\nCurrent intent: \n{M.ASK}"
    assert sessions.windowed(d, 400, header=10, min_steps=2).where("workflow = 'v'").count() == 0
    assert sessions.windowed(d.limit(0), 400).count() == 0


def test_measurements(spark):
    cases = {"Ø 5 mm, v1.5mm 2,5cm": ["Ø 5 mm", "2,5cm"], "3 in or 4 inches": ["3 in"], 'a 7" disc at 30°': ['7"', "30°"], "x5 mm": [], "5 ± 1": ["5 ±"], "9 MM": ["9 MM"]}
    d = spark.createDataFrame([(k,) for k in cases], "t string").select("t", C.measurements(F.col("t")).alias("m"))
    assert {r.t: r.m for r in d.collect()} == cases


def test_claims(spark):
    cases = {
        "The datasheet gives 20 mm.": ["20 mm"],
        "I assume the datasheet gives 20 mm.": [],
        "Is 20 mm official? Measured 3,50 kg; depth 8 mm.": ["3,50 kg"],
        "The lid is 20 mm.": [],
        "Found 5 mm and 5 mm and 50 mm, 7 mmx.": ["5 mm", "50 mm"],
        "Official: 1.5 V and 0 A\nverified 9 inches": ["1.5 V", "0 A", "9 inches"],
    }
    d = spark.createDataFrame([(k,) for k in cases], "t string").select("t", C.claimed(F.col("t"))["shown"].alias("m"))
    assert {r.t: r.m for r in d.collect()} == cases
    n = spark.range(1).select(C.numbers(F.lit("10, 1 and 2,50 or 0 and 3.0")).alias("n"), C.claims_evidence(F.lit("per the Specs")).alias("c")).first()
    assert n.n == ["1", "2.5", "0", "3"] and n.c


def test_unsupported(spark):
    replies = spark.createDataFrame([("a", 1, "Found 5 mm and 7,0 cm."), ("a", 2, "Found 5 mm."), ("b", 3, "Found 5 mm."), ("b", 4, None), (None, 5, "Found 5 mm.")], "k string, id int, text string")
    notes = spark.createDataFrame([("a", "spacing 5"), ("a", "spacing 5"), ("c", "7"), (None, "5"), ("b", None)], "k string, text string")
    got = {r.id: r for r in grounding.unsupported(replies, notes, ["k"], "id").collect()}
    assert {i: r.measurements for i, r in got.items()} == {1: ["7,0 cm"], 3: ["5 mm"], 5: ["5 mm"]}
    assert got[3].caveat == C.CAVEAT + "5 mm" + C.CAVEAT_END
    assert grounding.unsupported(replies.limit(0), notes, ["k"], "id").count() == 0


@pytest.mark.parametrize(("name", "shape"), [("txt_measurements", ("documents", "doc_id", "text")), ("txt_page_measurements", ("pages", "page_id", "html"))])
def test_measurement_twins_on_odd_texts(spark, tmp_path, name, shape):
    t, key, text = shape
    odd = ["5°5°", "5 mm5 mm,5 mm", "5 mm\n5 mm", "٥ mm", "5\xa0mm", "5\x0bmm", "5 iné", "5 in_ 5 deǵ", "²5 mm", "́5 mm", "5 ın", "‍5 mm", "‿5 mm", "Ø 5 MM Ø5mm", 'x5" .5" 7"', "", None]
    spark.createDataFrame(list(enumerate(odd)), f"{key} long, {text} string").coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    for mode in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", mode)
        try:
            assert differs(spark, con, str(tmp_path), PLANS[name], TWINS[name]) == ""
        finally:
            spark.conf.set("spark.sql.ansi.enabled", ansi)
