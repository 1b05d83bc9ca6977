"""A two-dimensional Haar transform on 16-bit integers, level by level in whole-array steps.

Planes with values below 2**14 use plain signed means and differences; others work modulo 2**16.
"""

from __future__ import annotations

import numpy as np

Pair = tuple[np.ndarray, np.ndarray]


def _signed(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint16).view(np.int16).astype(np.int64)


def _mean_small(a: np.ndarray, b: np.ndarray) -> Pair:
    a, b = _signed(a), _signed(b)
    return ((a + b) >> 1) & 0xFFFF, (a - b) & 0xFFFF


def _back_small(m: np.ndarray, d: np.ndarray) -> Pair:
    m, d = _signed(m), _signed(d)
    a = m + (d & 1) + (d >> 1)
    return a & 0xFFFF, (a - d) & 0xFFFF


def _mean_full(a: np.ndarray, b: np.ndarray) -> Pair:
    a, b = (a.astype(np.int64) + 0x8000) & 0xFFFF, b.astype(np.int64)
    d = a - b
    m = (a + b) >> 1
    return np.where(d < 0, (m + 0x8000) & 0xFFFF, m), d & 0xFFFF


def _back_full(m: np.ndarray, d: np.ndarray) -> Pair:
    m, d = m.astype(np.int64), d.astype(np.int64)
    b = (m - (d >> 1)) & 0xFFFF
    return (d + b - 0x8000) & 0xFFFF, b


def _cells(plane: np.ndarray, p: int) -> tuple[tuple[slice, slice], ...]:
    """Corners of the squares of a level, and of what an odd column or line leaves."""
    h, w = plane.shape
    ys, xs = (h - 2 * p) // (2 * p) + 1 if h >= 2 * p else 0, (w - 2 * p) // (2 * p) + 1 if w >= 2 * p else 0
    y, x = slice(0, ys * 2 * p, 2 * p), slice(0, xs * 2 * p, 2 * p)
    y1, x1 = slice(p, ys * 2 * p, 2 * p), slice(p, xs * 2 * p, 2 * p)
    lone_x, lone_y = slice(xs * 2 * p, xs * 2 * p + 1), slice(ys * 2 * p, ys * 2 * p + 1)
    return (y, x), (y, x1), (y1, x), (y1, x1), (y, lone_x), (y1, lone_x), (lone_y, x), (lone_y, x1)


def encode(plane: np.ndarray, largest: int) -> np.ndarray:
    """Coefficients of a (lines, columns) plane of unsigned 16-bit values."""
    v = plane.astype(np.int64)
    mean = _mean_small if largest < 1 << 14 else _mean_full
    p = 1
    while 2 * p <= min(v.shape):
        c00, c01, c10, c11, r0, r1, l0, l1 = _cells(v, p)
        a, b = mean(v[c00], v[c01])
        c, d = mean(v[c10], v[c11])
        v[c00], v[c10] = mean(a, c)
        v[c01], v[c11] = mean(b, d)
        if v.shape[1] & p:
            v[r0], v[r1] = mean(v[r0], v[r1])
        if v.shape[0] & p:
            v[l0], v[l1] = mean(v[l0], v[l1])
        p *= 2
    return v.astype(np.uint16)


def decode(plane: np.ndarray, largest: int) -> np.ndarray:
    v = plane.astype(np.int64)
    back = _back_small if largest < 1 << 14 else _back_full
    p = 1
    while 2 * p <= min(v.shape):
        p *= 2
    p //= 2
    while p >= 1:
        c00, c01, c10, c11, r0, r1, l0, l1 = _cells(v, p)
        a, c = back(v[c00], v[c10])
        b, d = back(v[c01], v[c11])
        v[c00], v[c01] = back(a, b)
        v[c10], v[c11] = back(c, d)
        if v.shape[1] & p:
            v[r0], v[r1] = back(v[r0], v[r1])
        if v.shape[0] & p:
            v[l0], v[l1] = back(v[l0], v[l1])
        p //= 2
    return v.astype(np.uint16)
