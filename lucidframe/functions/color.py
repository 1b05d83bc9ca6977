"""Pixel and colour arithmetic as Column builders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FLOAT_MAX = 3.4028234663852886e38


def clip(v: Column, lo: float = -FLOAT_MAX, hi: float = FLOAT_MAX) -> Column:
    """NaN becomes the upper bound, as it sorts above everything."""
    kind = "float"
    return F.greatest(F.lit(lo).cast(kind), F.least(F.lit(hi).cast(kind), v))


def to_u8(v: Column) -> Column:
    """Truncates 255 v and clamps; NaN becomes 0."""
    scaled = F.least(F.greatest(v.cast("double") * 255, F.lit(-1.0)), F.lit(256.0))
    return F.when(F.isnan(v), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), scaled.cast("int")))).cast("int")


def tonemap_u8(v: Column, scale: float = 1.0, gamma: float = 2.2) -> Column:
    """A scaled value under gamma as a byte; what has no real power becomes 0."""
    scaled = v.cast("double") * scale
    return F.when(scaled < 0, 0).otherwise(to_u8(F.pow(F.greatest(scaled, F.lit(0.0)), F.lit(1 / gamma))))


def from_u8(b: Column) -> Column:
    return b / F.lit(255.0)


def display(v: Column, scale: float = 1.0, gamma: float = 2.2) -> Column:
    return F.pow(v.cast("double") * scale, F.lit(1 / gamma))


def rgbm_decode(v: Column, m: Column) -> Column:
    """A channel and its multiplier to a linear value."""
    x = v * m * 16
    return x * x


def rgbm_encode(r: Column, g: Column, b: Column) -> list[Column]:
    """Squares, a common multiplier in steps of 1/255, and the channels divided by it, saturated."""
    squares = [x * x / 16 for x in (r, g, b)]
    m = F.ceil(F.least(F.greatest(*squares, F.lit(1.0 / 16)), F.lit(1.0)) * 255) / F.lit(255.0)
    return [F.least(F.greatest(x / m, F.lit(0.0)), F.lit(1.0)) for x in squares] + [m]


def normalize(x: Column, y: Column, z: Column) -> list[Column]:
    """Unit vectors; nearly empty ones stay as they are."""
    d = x * x + y * y + z * z
    return [F.when(d > 1e-6, v / F.sqrt(d)).otherwise(v) for v in (x, y, z)]


def normal_color(r: Column, g: Column, b: Column, strength: float = 1.0) -> list[Column]:
    """Displacements to normals, stored in 0..1."""
    return [v * 0.5 + 0.5 for v in normalize(r * strength, g * strength, b * strength + 1)]


def unpremultiply(v: Column, alpha: Column, scale: float = 1.0) -> Column:
    """Colour by alpha; without alpha the colour counts as it is."""
    return F.when(alpha != 0, v * scale / alpha).otherwise(v * scale)
