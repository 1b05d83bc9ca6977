"""Half precision: exact widening, and narrowing that rounds the magnitude up at the first dropped bit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def widen(bits: np.ndarray) -> np.ndarray:
    """float32 of 16-bit patterns; NaN payloads move up by 13 bits."""
    h = np.asarray(bits).astype(np.uint32)
    sign, rest = (h & 0x8000) << 16, h & 0x7FFF
    special = rest >= 0x7C00
    out = np.asarray(h, np.uint16).view(np.float16).astype(np.float32).view(np.uint32)
    return np.where(special, sign | 0x7F800000 | ((rest & 0x3FF) << 13), out).astype(np.uint32).view(np.float32)


def narrow(values: np.ndarray) -> np.ndarray:
    """16-bit patterns of float32 values: ties go away from zero, small subnormals to signed zero, NaN is quiet."""
    f = np.ascontiguousarray(values, np.float32).view(np.uint32)
    sign = ((f >> 16) & 0x8000).astype(np.int64)
    power = ((f >> 23) & 0xFF).astype(np.int64)
    fraction = (f & 0x7FFFFF).astype(np.int64)
    target = power - 112
    normal = (target << 10) + (fraction >> 13) + ((fraction >> 12) & 1)
    down = np.clip(14 - target, 1, 40)
    full = fraction | 0x800000
    subnormal = np.where(down <= 24, (full >> down) + ((full >> (down - 1)) & 1), 0)
    out = np.select([power == 0, (power == 255) & (fraction != 0), target >= 31, target <= 0], [0, 0x7E00, 0x7C00, subnormal], normal)
    return (sign | out).astype(np.uint16)


@F.pandas_udf(T.IntegerType())
def _narrow_udf(v: pd.Series) -> pd.Series:
    return pd.Series(narrow(v.to_numpy(np.float32)).astype(np.int32))


@F.pandas_udf(T.FloatType())
def _widen_udf(b: pd.Series) -> pd.Series:
    return pd.Series(widen(b.to_numpy(np.int64).astype(np.uint16)))


def half_bits(value: Column) -> Column:
    """Bit pattern of the half nearest to a float, as an int; null stays null."""
    return F.when(value.isNotNull(), _narrow_udf(F.coalesce(value.cast("float"), F.lit(0.0).cast("float"))))


def half_value(bits: Column, payloads: bool = False) -> Column:
    """The float of a bit pattern, by built-in expressions; ``payloads`` keeps those of NaN, which needs Python."""
    if payloads:
        return F.when(bits.isNotNull(), _widen_udf(F.coalesce(bits.cast("int"), F.lit(0))))
    return half_value_expr(bits)


def half_value_expr(bits: Column) -> Column:
    """The same widening of finite patterns with built-in expressions only (no NaN payloads)."""
    power, fraction = F.shiftright(bits, 10).bitwiseAND(31), bits.bitwiseAND(1023)
    sign = F.when(bits.bitwiseAND(32768) != 0, -1.0).otherwise(1.0)
    small = fraction * F.lit(2.0**-24)
    normal = (1 + fraction * F.lit(2.0**-10)) * F.pow(F.lit(2.0), power - 15)
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return (sign * F.when(power == 0, small).when(power == 31, special).otherwise(normal)).cast("float")
