"""Target actions: conversion of neutral actions, canonical text, strict validation on VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions import keys as K
from tracemill.functions import scalars as S

#: Required and optional keys of each action type, buttons, keys that only modify.
KEYS = {
    "click": (("x", "y", "button"), ("modifiers", "clicks")),
    "drag": (("x", "y", "end_x", "end_y", "button"), ("modifiers",)),
    "scroll": (("x", "y", "delta_x", "delta_y"), ("modifiers",)),
    "type_text": (("text",), ()),
    "key": (("key", "modifiers"), ()),
}
BUTTONS = ("left", "middle", "right")
ONLY_MODIFY = ("Shift", "Control", "Alt", "Meta", "CapsLock", "NumLock", "ScrollLock")
GRID_KEYS = ("x", "y", "end_x", "end_y")
DELTAS = ("delta_x", "delta_y")
MOST_TICKS, MOST_CLICKS = 10, 3
#: What a neutral action without content gives; it is left out of a row's targets.
SKIPPED = "skipped"
ERROR = "conversion_error"


def judged(actions: Column, platform: Column | None = None) -> Column:
    """Neutral actions with two more fields, name (of the key) and outcome.

    action: struct of type, x, y, end_x, end_y, button, delta_x, delta_y, text, key_code, modifiers (a mask), clicks, dt.
    """
    named = F.transform(actions, lambda a: a.withField("name", K.key_name(a["key_code"], a["text"], platform)))
    return F.transform(named, lambda a: a.withField("outcome", _outcome(a)))


def _outcome(action: Column) -> Column:
    """Null for an action with a target form, SKIPPED for one without content, else ERROR and why."""
    kind, zero = action["type"], F.lit(0.0)
    outside = lambda n: ~F.coalesce(action[n].between(0, 1), F.lit(False))
    start, end = outside("x") | outside("y"), outside("end_x") | outside("end_y")
    odd_button = ~F.lower(F.coalesce(F.nullif(action["button"], F.lit("")), F.lit("left"))).isin(*BUTTONS)
    deltas = [F.coalesce(action[d].cast("double"), zero) for d in DELTAS]
    silent = F.coalesce(action["text"], F.lit("")) == ""
    name = action["name"]
    no_name = F.when(silent, SKIPPED).otherwise(f"{ERROR}:unmapped_key")
    cases = (
        (kind.isNull() | ~kind.isin(*KEYS), F.lit(f"{ERROR}:type")),
        ((kind == "scroll") & (deltas[0] == 0) & (deltas[1] == 0), F.lit(f"{ERROR}:zero_scroll")),
        (kind.isin("click", "drag", "scroll") & start | (kind == "drag") & end, F.lit(f"{ERROR}:coordinates")),
        (kind.isin("click", "drag") & odd_button, F.lit(f"{ERROR}:button")),
        ((kind == "scroll") & (S.finite(deltas[0]).isNull() | S.finite(deltas[1]).isNull()), F.lit(f"{ERROR}:scroll")),
        ((kind == "type_text") & silent, F.lit(f"{ERROR}:text")),
        ((kind == "key") & name.isNull(), no_name),
        ((kind == "key") & name.isin(*ONLY_MODIFY), F.lit(SKIPPED)),
    )
    out = F.lit(None).cast("string")
    for holds, reason in reversed(cases):
        out = F.when(holds, reason).otherwise(out)
    return out


def row_reason(actions: Column, image: Column, most: int = 1, gap: float = 1.0, drags: Column | bool = False) -> Column:
    """Why a row of judged actions gives no target, null if it does: no actions, no image, the first error,
    nothing but skipped actions, a drag in the chunk where `drags` doesn't let it in."""
    error = F.get(F.filter(actions["outcome"], lambda o: o.startswith(ERROR)), F.lit(0))
    kept = chunk(actions, most, gap)
    return (
        F.when(F.coalesce(F.size(actions), F.lit(0)) <= 0, "no_actions")
        .when(F.coalesce(image, F.lit("")) == "", "no_image")
        .when(error.isNotNull(), error)
        .when(F.size(kept) <= 0, "only_modifier_keys")
        .when(F.array_contains(kept["type"], "drag") & ~(drags if isinstance(drags, Column) else F.lit(drags)), "drag_excluded")
    )


def chunk(actions: Column, most: int = 1, gap: float = 1.0) -> Column:
    """The leading judged actions with a target form, at most `most`, none later than `gap` seconds (field dt) after the one before."""
    told = F.filter(actions, lambda a: a["outcome"].isNull())
    late = F.transform(told["dt"], lambda t, i: (i > 0) & (t - F.get(told["dt"], i - 1) > gap))
    stop = F.array_position(late, F.lit(True))
    size = F.when(stop > 0, stop - 1).otherwise(F.size(told))
    return F.slice(told, 1, F.greatest(F.least(size.cast("int"), F.lit(most)), F.lit(0)))


def target(action: Column) -> Column:
    """Canonical JSON of one judged action with a target form: keys in fixed order, grid coordinates; a key always lists its
    modifiers, a pointer action if its mask is known, a click its count if that is known."""
    g = lambda n: S.to_grid(action[n]).alias(n)
    kind = action["type"]
    head = kind.alias("type")
    button = F.lower(F.coalesce(F.nullif(action["button"], F.lit("")), F.lit("left"))).alias("button")
    mask = S.modifier_names(action["modifiers"])
    held = F.when(action["modifiers"].isNotNull(), mask).alias("modifiers")  # to_json leaves nulls out
    ticks = [F.coalesce(S.whole_delta(action[d]), F.lit(0)).alias(d) for d in DELTAS]
    forms = {
        "click": (g("x"), g("y"), button, held, action["clicks"].alias("clicks")),
        "drag": (g("x"), g("y"), g("end_x"), g("end_y"), button, held),
        "scroll": (g("x"), g("y"), *ticks, held),
        "type_text": (action["text"].alias("text"),),
        "key": (action["name"].alias("key"), F.coalesce(held, F.array().cast("array<string>")).alias("modifiers")),
    }
    return F.coalesce(*(F.when(kind == name, F.to_json(F.struct(head, *fields))) for name, fields in forms.items()))


def completion(targets: Column) -> Column:
    """{"actions":[...]} of an array of canonical actions."""
    return F.concat(F.lit('{"actions":['), F.array_join(targets, ","), F.lit("]}"))


def errors(text: Column) -> Column:
    """Errors of a completion, none if it is valid: strict JSON, exactly the key `actions`, each action's
    keys, whole numbers in range (no booleans, no fractions), known names, a scroll that moves.

    Each action is first read into typed fields (null where a field has another type), then compared.
    """
    v = F.try_parse_json(F.trim(text))
    top = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    only = F.coalesce((F.size(top) == 1) & (F.get(top, F.lit(0)) == "actions"), F.lit(False))
    items = F.try_variant_get(v, "$.actions", "array<variant>")
    each = F.flatten(F.transform(F.transform(items, typed), _item_errors))
    return (
        F.when(v.isNull(), F.array(F.lit("not_json")))
        .when(~only, F.array(F.lit("keys")))
        .when(items.isNull() | (F.size(items) == 0), F.array(F.lit("empty")))
        .otherwise(each)
    )


def typed(item: Column) -> Column:
    """An action's fields, null where one is missing or has another type, and the names that it has."""
    at = lambda key, kind: F.try_variant_get(item, f"$.{key}", kind)
    shape = lambda key: F.schema_of_variant(at(key, "variant"))
    whole = lambda key: F.when(shape(key) == "BIGINT", at(key, "bigint")).alias(key)
    words = lambda key: F.when(shape(key) == "STRING", at(key, "string")).alias(key)
    names = F.when(shape("modifiers").startswith("ARRAY<"), at("modifiers", "array<string>")).alias("modifiers")
    found = F.map_keys(F.try_variant_get(item, "$", "map<string,variant>")).alias("found")
    return F.struct(found, *map(words, ("type", "button", "text", "key")), *map(whole, (*GRID_KEYS, *DELTAS, "clicks")), names)


def _item_errors(a: Column) -> Column:
    has = lambda key: F.array_contains(a["found"], key)
    fails = lambda test: ~F.coalesce(test, F.lit(False))
    known = lambda names: F.array(*map(F.lit, names))
    wrong = [F.when((a["type"] == kind) & ((F.size(F.array_except(known(needed), a["found"])) > 0) | (F.size(F.array_except(a["found"], known(("type", *needed, *more)))) > 0)), f"{kind}_keys") for kind, (needed, more) in KEYS.items()]
    checks = [
        *(F.when(has(c) & fails(a[c].between(0, S.GRID)), c) for c in GRID_KEYS),
        F.when(has("button") & fails(a["button"].isin(*BUTTONS)), "button"),
        F.when(has("clicks") & fails(a["clicks"].between(1, MOST_CLICKS)), "clicks"),
        F.when(has("modifiers") & fails(F.forall(a["modifiers"], lambda m: F.coalesce(m.isin(*(n for n, _ in S.MODIFIERS)), F.lit(False)))), "modifiers"),
        *(F.when(has(d) & fails(F.abs(a[d]) <= MOST_TICKS), d) for d in DELTAS),
        F.when((a["delta_x"] == 0) & (a["delta_y"] == 0), "zero_scroll"),
        F.when((a["type"] == "type_text") & fails(a["text"] != ""), "text"),
        F.when((a["type"] == "key") & fails(a["key"] != ""), "key"),
    ]
    shape = F.coalesce(F.when(fails(a["type"].isin(*KEYS)), "type"), *wrong)
    return F.when(shape.isNotNull(), F.array(shape)).otherwise(F.array_compact(F.array(*checks)))
