"""64-bit hashes of many byte runs at once, and a table keyed by such hashes, in whole-array steps.

A run's hash is a polynomial in an odd number modulo 2**64 with random digits per byte, so that prefix sums give the
hash of any run, then mixed.  Two different runs agree with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

_rng = np.random.default_rng(20240131)
DIGITS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = np.uint64(0x9E3779B97F4A7C15)
ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole number; one to one."""
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for i, odd in enumerate((ODD, ODD_INVERSE)):
            steps = np.full(n, odd, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts[i]:ends[i]]; every run has a byte at least."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(DIGITS[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class HashTable:
    """Numbers 0, 1, 2 ... of 64-bit keys, by open addressing."""

    def __init__(self, most: int):
        bits = max(4, (4 * most - 1).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = np.zeros(most, np.uint64)
        self.size, self.most = 0, most

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is missing."""
        found = np.full(len(keys), -1, np.int32)
        at, left = keys & self.mask, np.arange(len(keys))
        while len(left):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.keys[np.maximum(slot, 0)] == keys[left])
            found[left[hit]] = slot[hit]
            on = (slot >= 0) & ~hit
            left, at = left[on], (at[on] + np.uint64(1)) & self.mask
        return found

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers for distinct new keys; the caller sees to it that they fit."""
        numbers = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self.keys[numbers] = keys
        self.size += len(keys)
        at, left = keys & self.mask, numbers
        while len(left):
            empty = self.slots[at] < 0
            self.slots[at[empty]] = left[empty]
            on = self.slots[at] != left
            left, at = left[on], (at[on] + np.uint64(1)) & self.mask
        return numbers


#: Bits of a key filter: per key, and at least and at most (2 MB); beyond, more keys pass, and none is lost.
FILTER_BITS_PER_KEY, LEAST_BITS, MOST_BITS = 8, 1 << 12, 1 << 24


def key_filter(keys: DataFrame, *columns: str, most: int = MOST_BITS) -> Callable[..., Column]:
    """Whether keys may be among those of ``keys``: a bit table that grows with their number up to ``most`` bits.

    It is a literal of the plan.  A key of ``keys`` always passes; others pass as often as the table is filled.
    """
    n = keys.count()
    bits = min(most, max(LEAST_BITS, 1 << (FILTER_BITS_PER_KEY * n).bit_length()))
    slot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(bits))
    rows = keys.select(slot(*columns).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    held = F.split(F.lit(",".join(map(str, words.tolist()))), ",").cast("array<bigint>")

    def test(*c: Column) -> Column:
        at = slot(*c)
        return F.getbit(F.get(held, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1

    return test
