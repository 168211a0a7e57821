"""Names of keys."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Key codes of the Windows platform.
WINDOWS = {
    8: "Backspace", 9: "Tab", 13: "Enter", 16: "Shift", 17: "Control", 18: "Alt", 19: "Pause", 20: "CapsLock", 27: "Escape", 32: "Space",
    33: "PageUp", 34: "PageDown", 35: "End", 36: "Home", 37: "ArrowLeft", 38: "ArrowUp", 39: "ArrowRight", 40: "ArrowDown", 44: "PrintScreen",
    45: "Insert", 46: "Delete", 91: "Meta", 92: "Meta", 93: "ContextMenu", 106: "*", 107: "+", 109: "-", 110: ".", 111: "/", 144: "NumLock",
    145: "ScrollLock", 186: ";", 187: "=", 188: ",", 189: "-", 190: ".", 191: "/", 192: "`", 219: "[", 220: "\\", 221: "]", 222: "'",
}
#: Key codes of the Mac platform.
MAC = {
    36: "Enter", 48: "Tab", 49: "Space", 51: "Backspace", 53: "Escape", 55: "Meta", 56: "Shift", 57: "CapsLock", 58: "Alt", 59: "Control",
    65: ".", 67: "*", 69: "+", 75: "/", 76: "Enter", 78: "-", 96: "F5", 97: "F6", 98: "F7", 99: "F3", 100: "F8", 101: "F9", 103: "F11",
    109: "F10", 111: "F12", 115: "Home", 116: "PageUp", 117: "Delete", 118: "F4", 119: "End", 120: "F2", 121: "PageDown", 122: "F1",
    123: "ArrowLeft", 124: "ArrowRight", 125: "ArrowDown", 126: "ArrowUp",
    0: "a", 11: "b", 8: "c", 2: "d", 14: "e", 3: "f", 5: "g", 4: "h", 34: "i", 38: "j", 40: "k", 37: "l", 46: "m", 45: "n", 31: "o", 35: "p",
    12: "q", 15: "r", 1: "s", 17: "t", 32: "u", 9: "v", 13: "w", 7: "x", 16: "y", 6: "z",
    29: "0", 18: "1", 19: "2", 20: "3", 21: "4", 23: "5", 22: "6", 26: "7", 28: "8", 25: "9",
    82: "0", 83: "1", 84: "2", 85: "3", 86: "4", 87: "5", 88: "6", 89: "7", 91: "8", 92: "9",
}
#: Control characters with a name.
CONTROL = {"\r": "Enter", "\n": "Enter", "\t": "Tab", "\x1b": "Escape", "\x08": "Backspace", "\x7f": "Delete"}


def windows_table() -> dict[int, str]:
    """Digits, number pad, letters and function keys follow from their codes."""
    digits = {first + d: str(d) for first in (48, 96) for d in range(10)}
    return WINDOWS | digits | {65 + k: chr(97 + k) for k in range(26)} | {112 + k: f"F{k + 1}" for k in range(12)}


def _named(table: dict, key: Column) -> Column:
    """The key's name in a table, which is one constant of the plan."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")[key.cast("string")]


def key_name(code: Column, characters: Column, platform: Column | None = None) -> Column:
    """Name by the platform's code (mac, else windows), else by control character, else the printable character,
    else the letter of a control code."""
    by_code = _named(windows_table(), code)
    if platform is not None:
        by_code = F.when(F.lower(platform) == "mac", _named(MAC, code)).otherwise(by_code)
    by_control = _named(CONTROL, characters)
    single = F.char_length(characters) == 1
    plain = F.when(single & characters.rlike("^[^\\p{C}\\p{Z}]$"), F.when(characters.rlike("^\\p{L}$"), F.lower(characters)).otherwise(characters))
    letter = F.when(single & (F.ascii(characters) < 32), F.char(F.ascii(characters) + 96))
    return F.coalesce(by_code, by_control, plain, letter)


def sql_map(pairs: dict) -> str:
    """The pairs as a map literal of DuckDB."""
    lit = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in pairs.items()) + "}"
