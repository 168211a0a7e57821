"""Atomic actions of recorded input: clicks, drags, scrolls and typing, each within one epoch.

One automaton a recorded stream. Events that change what an action would mean (screen, application, window, privacy) and
every rejected input open a new epoch and raise a barrier; a pointer gesture that is open then is lost. Within an epoch
near inputs grow into one action. What is rejected is a row too, so reports are aggregations.

The automaton's state is plain values: `fold` keeps it while a sorted partition passes, a stream keeps it as JSON.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.sequences import fold

#: Names that applications go by, letters and digits only.
ALIASES = {
    "autocad": ["autocad"], "catia": ["catia"], "nx-cad": ["siemensnx", "nxcad", "nx"], "p-d5": ["d5render", "d5"], "revit-architecture": ["revit"],
    "revit-structure": ["revit"], "sketchup": ["sketchup"], "solidworks": ["solidworks"], "staad-pro": ["staadpro", "staad"], "vray": ["vray"],
}
#: Seconds between inputs of one action, share of the screen that is one place, most lines of one scroll,
#: clicks of one action, pixels from which a gesture is a drag, bits of known modifiers.
TYPING_GAP, SCROLL_GAP, CLICK_GAP, SAME_PLACE, MOST_LINES, MOST_CLICKS, DRAG_PIXELS, KNOWN, SHIFT = 0.75, 0.15, 0.5, 0.002, 10, 3, 4.0, 15, 1
#: Keys that only modify others.
MODIFIER_KEYS = {"Shift", "Control", "Alt", "Meta", "CapsLock", "NumLock", "ScrollLock"}

#: What an event may say; a column that is missing says nothing.
EVENT = "t double, line long, kind string, app string, on_app boolean, screens int, width int, height int, screen int, modifiers int, x double, y double, button string, down boolean, clicks int, key string, text string, delta_x double, delta_y double"
ATOM = "line long, type string, reason string, t double, end_t double, lower double, epoch long, x double, y double, end_x double, end_y double, button string, modifiers int, clicks int, key string, text string, delta_x double, delta_y double, inputs long"
FIELDS = [f.split()[0] for f in ATOM.split(", ")]


def compact(name: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def app_matches(name: Column, software: str, application: str) -> Column:
    """Whether a window's application is the one recorded: an alias in the name or the name in an alias. Null is no match."""
    own, said = compact(F.lit(application)), compact(F.coalesce(name, F.lit("")))
    found = [(said != "") & (a != "") & (said.contains(a) | a.contains(said)) for a in [*map(F.lit, ALIASES.get(software, [])), own]]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


@dataclass
class Standing:
    """What earlier events of a stream mean for the next one."""

    app: str | None = None
    on_app: bool = False
    held: int = 0
    masked: bool = False
    width: int = 1920
    height: int = 1080
    screens: int = 1
    epoch: int = 0
    barrier: float = 0.0
    ended: float = 0.0
    #: The gesture that waits for its release, and the last action, which may still grow.
    press: dict | None = None
    last: dict | None = None


class Atoms:
    """ATOM rows of one stream's EVENT rows in order: actions when they can't grow any more, rejects at once."""

    def __init__(self, standing: dict | None = None):
        self.at = Standing(**(standing or {}))

    def state(self) -> dict:
        return asdict(self.at)

    def take(self, row) -> list[tuple]:
        if row.t is None or not math.isfinite(row.t) or row.t < 0:
            return [self._row(type="reject", reason="invalid_timestamp", line=row.line)]
        if row.kind in self.CONTEXT:
            return self._cut(row.t) if self.CONTEXT[row.kind](self, row) else []
        if row.kind not in self.INPUTS:
            return []
        why = self._barred(row)
        return self._refused(row, why) if why else self.INPUTS[row.kind](self, row)

    def end(self) -> list[tuple]:
        left = [self._row(**self.at.last)] if self.at.last else []
        if self.at.press:
            left.append(self._lost())
        self.at.last = self.at.press = None
        return left

    # what may change without an input; true if the next action is of a new epoch

    def _screen(self, row) -> bool:
        if not row.screens:
            return False
        a, now = self.at, (row.width or self.at.width, row.height or self.at.height, row.screens)
        changed = now != (a.width, a.height, a.screens)
        a.width, a.height, a.screens = now
        return changed

    def _app(self, row) -> bool:
        changed = row.app != self.at.app
        self.at.app, self.at.on_app = row.app, bool(row.on_app)
        return changed

    def _mask(self, row) -> bool:
        self.at.masked = row.kind == "privacy_mask_start"
        return True

    def _modifiers(self, row) -> bool:
        self.at.held = row.modifiers or 0
        return False

    CONTEXT = {
        "screen_config": _screen, "active_app": _app, "privacy_mask_start": _mask, "privacy_mask_end": _mask, "modifier_change": _modifiers,
        **dict.fromkeys(("window_title_changed", "window_moved", "window_resized", "input_source_change"), lambda self, row: True),
    }

    # inputs

    def _barred(self, row) -> str | None:
        """Why an input can't be part of an action whatever came before it in its epoch."""
        a = self.at
        if a.masked or a.screens != 1 or row.screen:
            return "privacy_or_multiscreen"
        here = a.on_app if row.app is None else row.on_app
        if not here or (a.app and not a.on_app):
            return "off_target_or_unknown_app"
        if self._held(row) & ~KNOWN:
            return "unknown_modifiers"
        if row.kind != "key" and not (self._inside(row.x, a.width) and self._inside(row.y, a.height)):
            return "invalid_pointer_coordinates"
        return None

    @staticmethod
    def _inside(v: float | None, size: int) -> bool:
        return v is not None and 0 <= v < size

    def _held(self, row) -> int:
        return self.at.held if row.modifiers is None else row.modifiers

    def _click(self, row) -> list[tuple]:
        a, press = self.at, self.at.press
        here = {"x": row.x / a.width, "y": row.y / a.height}
        button, held = row.button or "left", self._held(row)
        if row.down is None or row.down:
            out = self._cut(row.t) if press else []
            a.press = {"line": row.line, "t": row.t, "epoch": a.epoch, "button": button, "modifiers": held, "count": row.clicks or 1, **here}
            return out
        if not press:
            return []
        if (button, held) != (press["button"], press["modifiers"]):
            return self._refused(row, "changing_pointer_button_or_modifiers")
        a.press = None
        far = math.hypot((here["x"] - press["x"]) * a.width, (here["y"] - press["y"]) * a.height) >= DRAG_PIXELS
        more = {"type": "drag", "end_x": here["x"], "end_y": here["y"]} if far else {"type": "click", "clicks": 1}
        return self._acted(press | more | {"end_t": row.t})

    def _move(self, row) -> list[tuple]:
        return []  # only where a gesture ends tells a drag

    def _key(self, row) -> list[tuple]:
        if row.down is False:
            return []
        out, text = self._overlap(row), row.text or ""
        if row.key in MODIFIER_KEYS:
            return out
        typed = text and text.isprintable() and not self._held(row) & ~SHIFT
        return out + self._acted(self._input(row, "type_text" if typed else "key") | {"text": text, "key": None if typed else row.key})

    def _scroll(self, row) -> list[tuple]:
        out = self._overlap(row)
        delta = [0.0 if d is None else d for d in (row.delta_x, row.delta_y)]
        if not all(abs(d) <= MOST_LINES for d in delta):
            return out + self._refused(row, "unsupported_scroll_magnitude")
        a = self.at
        return out + self._acted(self._input(row, "scroll") | {"x": row.x / a.width, "y": row.y / a.height, "delta_x": delta[0], "delta_y": delta[1]})

    INPUTS = {"click": _click, "drag": _move, "key": _key, "scroll": _scroll}

    # what becomes of them

    def _input(self, row, kind: str) -> dict:
        return {"type": kind, "line": row.line, "t": row.t, "end_t": row.t, "epoch": self.at.epoch, "modifiers": self._held(row)}

    def _overlap(self, row) -> list[tuple]:
        if not self.at.press:
            return []
        return self._refused(row, "overlapping_pointer_and_input")

    def _refused(self, row, why: str) -> list[tuple]:
        return [self._row(type="reject", reason=why, line=row.line, t=row.t, epoch=self.at.epoch), *self._cut(row.t)]

    def _cut(self, t: float) -> list[tuple]:
        """The epoch ends here."""
        a = self.at
        lost = [self._lost()] if a.press else []
        a.epoch, a.barrier, a.press = a.epoch + 1, max(a.barrier, t), None
        return lost

    def _lost(self) -> tuple:
        p = self.at.press
        return self._row(type="reject", reason="incomplete_pointer_gesture", line=p["line"], t=p["t"], epoch=p["epoch"])

    def _acted(self, action: dict) -> list[tuple]:
        a, last = self.at, self.at.last
        size = [a.width, a.height]
        action |= {"lower": max(a.ended, a.barrier), "inputs": 1, "size": size}
        a.ended = max(a.ended, action["end_t"])
        if last and all(last[k] == action[k] for k in ("type", "epoch", "modifiers", "size")):
            grown = self.GROWTH.get(action["type"], lambda *_: None)(last, action, action["t"] - last["end_t"])
            if grown:
                last |= grown | {"end_t": action["end_t"], "inputs": last["inputs"] + 1}
                return []
        a.last = action
        return [self._row(**last)] if last else []

    @staticmethod
    def _typed_on(last: dict, new: dict, gap: float) -> dict | None:
        return {"text": last["text"] + new["text"]} if 0 <= gap <= TYPING_GAP else None

    @staticmethod
    def _near(last: dict, new: dict) -> bool:
        return max(abs(last["x"] - new["x"]), abs(last["y"] - new["y"])) < SAME_PLACE

    @staticmethod
    def _scrolled_on(last: dict, new: dict, gap: float) -> dict | None:
        both = {k: (last[k], new[k]) for k in ("delta_x", "delta_y")}
        goes = 0 <= gap <= SCROLL_GAP and Atoms._near(last, new) and all(p * q >= 0 and abs(p + q) <= MOST_LINES for p, q in both.values())
        return {k: p + q for k, (p, q) in both.items()} if goes else None

    @staticmethod
    def _clicked_again(last: dict, new: dict, gap: float) -> dict | None:
        goes = 0 <= gap <= CLICK_GAP and new["count"] == last["clicks"] + 1 <= MOST_CLICKS and new["button"] == last["button"] and Atoms._near(last, new)
        return {"clicks": new["count"]} if goes else None

    GROWTH = {"type_text": _typed_on, "scroll": _scrolled_on, "click": _clicked_again}

    @staticmethod
    def _row(**told) -> tuple:
        return tuple(told.get(f) for f in FIELDS)


def as_events(d: DataFrame, by: str) -> DataFrame:
    """by and the EVENT columns; those that d lacks are null."""
    return d.select(by, *((F.col(c) if c in d.columns else F.lit(None)).cast(k).alias(c) for c, k in (f.split() for f in EVENT.split(", "))))


def atoms(d: DataFrame, by: str = "workflow") -> DataFrame:
    """(by, ATOM): actions and rejects of each stream, in the order (t, line). An event without a time is rejected."""
    kind = d.schema[by].dataType.simpleString()
    return fold(as_events(d, by), [by], ["t", "line"], Atoms, f"{by} {kind}, {ATOM}")
