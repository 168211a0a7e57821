"""Scalar rules of traces as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 999
#: Bits of the modifier mask, in the order in which names are listed.
MODIFIERS = (("ctrl", 2), ("shift", 1), ("alt", 4), ("meta", 8))
#: Side of an image token in pixels, least and most pixels of a resized image.
TOKEN_SIDE, MIN_PIXELS, MAX_PIXELS = 32, 65_536, 1_048_576


def finite(v: Column) -> Column:
    """v, or null where it is NaN or infinite."""
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def unit(v: Column, extent: Column | float) -> Column:
    """Share of an extent, held to [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / extent))


def to_grid(share: Column) -> Column:
    """Grid coordinate 0..999 of a share, ties to even; null outside [0, 1]."""
    return F.when(share.between(0, 1), F.bround(share * GRID).cast("int"))


def from_grid(grid: Column, extent: Column | float) -> Column:
    return grid / F.lit(float(GRID)) * extent


def whole_delta(v: Column) -> Column:
    """Nearest whole number away from zero at least 1; zero stays zero."""
    return (F.signum(v) * F.greatest(F.lit(1.0), F.bround(F.abs(v)))).cast("int")


def compact(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(text, "[^\\p{L}\\p{N}]", ""))


def hash_share(key: Column) -> Column:
    """Number in [0, 1) from the first 32 bits of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def split_of(key: Column, train: float = 0.8, validation: float = 0.1) -> Column:
    share = hash_share(key)
    return F.when(share < train, "train").when(share < train + validation, "validation").otherwise("test")


def modifier_names(mask: Column) -> Column:
    return F.filter(F.array(*(F.when(mask.bitwiseAND(bit) != 0, F.lit(name)) for name, bit in MODIFIERS)), lambda x: x.isNotNull())


def modifier_mask(names: Column) -> Column:
    return F.aggregate(names, F.lit(0), lambda a, n: a + F.coalesce(*(F.when(n == name, F.lit(bit)) for name, bit in MODIFIERS), F.lit(0)))


def text_tokens(text: Column) -> Column:
    """Estimated tokens: 2.5 characters each, plus one."""
    return (F.floor(F.char_length(text) / 2.5) + 1).cast("long")


def image_tokens(width: Column, height: Column) -> Column:
    """Tokens of an image resized to whole token sides within the pixel bounds; null beyond aspect 200."""
    w, h, side = width.cast("double"), height.cast("double"), float(TOKEN_SIDE)
    near = [F.greatest(F.lit(side), F.bround(x / side) * side) for x in (h, w)]
    shrink, grow = F.sqrt(h * w / MAX_PIXELS), F.sqrt(MIN_PIXELS / (h * w))
    small = [F.greatest(F.lit(side), F.floor(x / shrink / side) * side) for x in (h, w)]
    large = [F.ceil(x * grow / side) * side for x in (h, w)]
    pixels = near[0] * near[1]
    fit = [F.when(pixels > MAX_PIXELS, s).when(pixels < MIN_PIXELS, b).otherwise(n) for n, s, b in zip(near, small, large, strict=True)]
    tokens = (fit[0] / side * (fit[1] / side)).cast("long")
    return F.when(F.greatest(h, w) / F.least(h, w) <= 200, tokens)
