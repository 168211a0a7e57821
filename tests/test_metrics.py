"""Scores of predicted completions on hand-made rows."""

import math

import pytest

from tracemill.operators import metrics


def test_scores_and_summary(spark):
    click = '{"actions":[{"type":"click","x":0,"y":999,"button":"left"}]}'
    key = '{"actions":[{"type":"key","key":"n","modifiers":["ctrl","shift"]}]}'
    text = '{"actions":[{"type":"type_text","text":"a"}]}'
    two = '{"actions":[{"type":"type_text","text":"a"},{"type":"key","key":"n","modifiers":[]}]}'
    rows = [
        ("a", click, click),
        ("a", '{"actions":[{"y":0,"x":999,"button":"left","type":"click"}]}', click),
        ("a", '{"actions":[{"key":"n","type":"key","modifiers":["shift","ctrl"]}]}', key),
        ("a", text, key),
        ("b", '{"actions":[{"type":"type_text","text":"b"}]}', text),
        ("b", text, two),
        ("b", "nonsense", text),
        ("b", '{"actions":[]}', click),
        ("b", None, click),
        (None, click, click),
    ]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, app string, predicted string, target string")
    s = metrics.scored(d, "predicted", "target")
    got = {r.id: r.score for r in s.collect()}
    assert got[0].exact_ok and got[0].coord_error_px == 0 and got[0].key_ok is None
    assert got[1].type_ok and not got[1].exact_ok and got[1].coord_error_px == pytest.approx(math.hypot(1920, 1080)) and got[1].coord_error_norm == pytest.approx(math.sqrt(2))
    assert got[2].key_ok and not got[2].exact_ok  # the order of held keys tells apart only the exact match
    assert got[3].key_ok is False and not got[3].type_ok and got[3].length_ok
    assert got[4].text_ok is False and got[4].type_ok and got[4].sequence_types_ok
    assert got[5].text_ok and got[5].type_ok and not got[5].sequence_types_ok and not got[5].length_ok
    assert not got[6].json_ok and got[6].text_ok is None and got[6].target_type == "type_text"
    assert got[7].json_ok and not got[7].schema_ok and got[7].coord_error_px is None
    assert not got[8].json_ok and not got[8].exact_ok
    m = {(r.scope, r.app): r for r in metrics.summary(s, "app").collect()}
    assert set(m) == {("group", "a"), ("group", "b"), ("group", None), ("overall", None), ("macro", None)}
    a, b, every, macro = m["group", "a"], m["group", "b"], m["overall", None], m["macro", None]
    assert (a["count"], a.json_parse_rate, a.exact_match, a.key_count, a.key_accuracy, a.coord_count) == (4, 1.0, 0.25, 2, 0.5, 2)
    assert a.coord_error_px_median == pytest.approx(math.hypot(1920, 1080) / 2) and a.within_8 == 0.5
    assert (b.json_parse_rate, b.schema_valid_rate, b.type_text_count, b.coord_count, b.coord_error_px_mean) == (0.6, 0.4, 2, 0, None)
    assert every["count"] == 10 and every.coord_error_px_median == 0
    assert macro.json_parse_rate == pytest.approx((1 + 0.6 + 1) / 3) and macro["count"] is None and macro.coord_error_px_median == pytest.approx(math.hypot(1920, 1080) / 4)
    types = {(r.app, r.target_type): r.n for r in metrics.target_types(s, "app").collect()}
    assert types["a", "click"] == 2 and types["b", "type_text"] == 3
    wide = metrics.scored(d.where("id = 1"), "predicted", "target", *(d.id * 0 + v for v in (0, 540))).first().score
    assert wide.coord_error_px == pytest.approx(math.hypot(1920, 540))


def test_empty(spark):
    d = spark.createDataFrame([], "app string, predicted string, target string")
    assert metrics.summary(metrics.scored(d, "predicted", "target"), "app").count() == 0


def test_rows_are_scored_once(spark):
    """Rates and medians read scores that were written; neither parses completions again."""
    d = spark.createDataFrame([("a", '{"actions":[]}', '{"actions":[]}')], "app string, predicted string, target string")
    scored = metrics.scored(d, "predicted", "target")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")
    assert "parsejson" in plan(scored) and "parsejson" not in plan(metrics.summary(scored, "app"))
