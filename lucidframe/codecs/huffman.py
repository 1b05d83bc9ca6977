"""Canonical Huffman coding of 16-bit symbols with a pseudo-symbol for runs.

Codes are handled as bit arrays: encoding lays the bits of all symbols out in one step; decoding looks up the code that
would begin at every bit of a stretch, in whole-array steps, and then only follows the codes from one to the next.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

from lucidframe.codecs.blocks import CorruptBlock

#: Fixed values of the format: longest code; 6-bit lengths 59..62 are short runs of unused symbols, 63 a long one.
LONGEST = 58
SHORT_ZEROS, LONG_ZEROS, SHORTEST_LONG = 59, 63, 6
MOST_LONG = 255 + SHORTEST_LONG
ALPHABET = (1 << 16) + 1
TABLE_BITS = 14
#: Bits of data whose codes are looked up at once.
STRETCH = 1 << 17


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of an optimal prefix code."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    heap = [(n, s, s) for s, n in counts.items()]
    heapq.heapify(heap)
    parent: dict[int, int] = {}
    new = ALPHABET
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[2]] = parent[b[2]] = new
        heapq.heappush(heap, (a[0] + b[0], new, new))
        new += 1
    depth = {new - 1: 0}
    for node in range(new - 2, ALPHABET - 1, -1):
        depth[node] = depth[parent[node]] + 1
    out = {s: depth[parent[s]] + 1 for s in counts}
    if max(out.values()) > LONGEST:
        raise ValueError("a code is too long for the format")
    return out


def canonical(lengths: dict[int, int]) -> dict[int, int]:
    """Codes by length: longer ones have smaller values, equal ones follow the symbols."""
    per = [0] * (LONGEST + 1)
    for n in lengths.values():
        per[n] += 1
    first, code = [0] * (LONGEST + 1), 0
    for n in range(LONGEST, 0, -1):
        first[n] = code
        code = (code + per[n]) >> 1
    out = {}
    for s in sorted(lengths):
        out[s] = first[lengths[s]]
        first[lengths[s]] += 1
    return out


def _lay_bits(values: np.ndarray, sizes: np.ndarray) -> tuple[bytes, int]:
    """Values of given bit sizes one after another, high bits first."""
    total = int(sizes.sum())
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    bits = (np.repeat(values.astype(np.uint64), sizes) >> (np.repeat(sizes, sizes) - 1 - place).astype(np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8)).tobytes(), total


def pack_lengths(lengths: dict[int, int], low: int, high: int) -> bytes:
    values, sizes, s = [], [], low
    while s <= high:
        n = lengths.get(s, 0)
        if n == 0:
            run = 1
            while s + run <= high and run < MOST_LONG and not lengths.get(s + run):
                run += 1
            if run >= SHORTEST_LONG:
                values += [LONG_ZEROS, run - SHORTEST_LONG]
                sizes += [6, 8]
            elif run >= 2:
                values.append(SHORT_ZEROS + run - 2)
                sizes.append(6)
            else:
                values.append(0)
                sizes.append(6)
            s += run
        else:
            values.append(n)
            sizes.append(6)
            s += 1
    return _lay_bits(np.array(values, np.uint64), np.array(sizes, np.int64))[0]


def unpack_lengths(data: bytes, low: int, high: int) -> dict[int, int]:
    bits, total = int.from_bytes(data, "big"), 8 * len(data)
    at, s, out = 0, low, {}

    def take(n: int) -> int:
        nonlocal at
        at += n
        if at > total:
            raise CorruptBlock("the table of code lengths is cut short")
        return (bits >> (total - at)) & ((1 << n) - 1)

    while s <= high:
        n = take(6)
        if n == LONG_ZEROS:
            s += take(8) + SHORTEST_LONG
        elif n >= SHORT_ZEROS:
            s += n - SHORT_ZEROS + 2
        else:
            if n:
                out[s] = n
            s += 1
    if s > high + 1:
        raise CorruptBlock("the table of code lengths is too long")
    return out


def encode(symbols: np.ndarray) -> bytes:
    """A block: smallest symbol, run symbol, bytes of the table, bits of the data, 0, table, data."""
    if not len(symbols):
        return b""
    kinds, counts = np.unique(symbols, return_counts=True)
    low, run = int(kinds[0]), int(kinds[-1]) + 1
    lengths = code_lengths({**dict(zip(kinds.tolist(), counts.tolist())), run: 1})
    codes = canonical(lengths)
    table = pack_lengths(lengths, low, run)
    first = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
    size = np.diff(np.append(first, len(symbols)))
    pieces = -(-size // 256)  # a piece is a symbol and up to 255 repeats
    symbol = np.repeat(symbols[first].astype(np.int64), pieces)
    repeats = np.full(len(symbol), 255)
    repeats[np.cumsum(pieces) - 1] = (size - 1) % 256
    own = np.array([lengths[s] for s in kinds.tolist()])[np.searchsorted(kinds, symbol)]
    code = np.array([codes[s] for s in kinds.tolist()], np.uint64)[np.searchsorted(kinds, symbol)]
    short = own + lengths[run] + 8 < own * repeats  # a symbol, the run symbol and a count
    times = np.where(short, 3, repeats + 1)
    begin = np.cumsum(times) - times
    values, sizes = np.repeat(code, times), np.repeat(own, times)
    at = begin[short]
    values[at + 1], sizes[at + 1] = codes[run], lengths[run]
    values[at + 2], sizes[at + 2] = repeats[short], 8
    data, bits = _lay_bits(values, sizes)
    return struct.pack("<iiiii", low, run, len(table), bits, 0) + table + data


def decode(block: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint16)
    if n == 0:
        return out
    if len(block) < 20:
        raise CorruptBlock("a Huffman block is too short")
    low, run, table_size, n_bits, _ = struct.unpack_from("<iiiii", block)
    if not (0 <= low <= run < ALPHABET and 0 <= table_size <= len(block) - 20 and 0 <= n_bits <= 8 * (len(block) - 20 - table_size)):
        raise CorruptBlock("a damaged Huffman header")
    found = unpack_lengths(block[20 : 20 + table_size], low, run)
    given = np.array(sorted(found), np.int64)
    sizes = np.array([found[s] for s in given.tolist()], np.int64)
    per = np.bincount(sizes, minlength=LONGEST + 1)
    first, code = np.zeros(LONGEST + 1, np.uint64), 0
    for size in range(LONGEST, 0, -1):
        first[size] = code
        if code + int(per[size]) > 1 << size:
            raise CorruptBlock("code lengths that no code has")
        code = (code + int(per[size])) >> 1
    order = np.lexsort((given, sizes))  # by length, then by symbol
    begin = np.cumsum(per) - per
    codes = np.zeros(len(given), np.uint64)
    codes[order] = first[sizes[order]] + (np.arange(len(given)) - begin[sizes[order]]).astype(np.uint64)
    table, table_size_of = np.full(1 << TABLE_BITS, -1, np.int32), np.zeros(1 << TABLE_BITS, np.int64)
    short = sizes <= TABLE_BITS
    spare = TABLE_BITS - sizes[short]
    many = 1 << spare
    at = np.repeat((codes[short] << spare.astype(np.uint64)).astype(np.int64), many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    table[at], table_size_of[at] = np.repeat(given[short], many), np.repeat(sizes[short], many)
    by_length, longer = given[order], [n for n in range(TABLE_BITS + 1, LONGEST + 1) if per[n]]

    data = np.frombuffer(block[20 + table_size :] + bytes(32), np.uint8).astype(np.uint64)
    place, filled, last, pieces = 0, 0, -1, []
    while place < n_bits:
        # the 64 bits from every bit of this stretch, and of what a run's count may need beyond it
        a, b = place >> 3, min((place + STRETCH >> 3) + 9, len(data) - 9)
        words = np.zeros(b - a, np.uint64)
        for i in range(8):
            words |= data[a + i : b + i] << np.uint64(56 - 8 * i)
        shift = np.arange(8, dtype=np.uint64)
        window = ((words[:, None] << shift) | (data[a + 8 : b + 8, None] >> (np.uint64(8) - shift))).ravel()
        end = min(place + STRETCH, n_bits) - 8 * a
        here = window[:end]
        index = (here >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        symbol, size = table[index], table_size_of[index]
        if longer and (lost := np.flatnonzero(symbol < 0)).size:
            for n_long in longer:
                value = here[lost] >> np.uint64(64 - n_long)
                hit = (value >= first[n_long]) & (value < first[n_long] + np.uint64(per[n_long]))
                symbol[lost[hit]] = by_length[begin[n_long] + (value[hit] - first[n_long]).astype(np.int64)]
                size[lost[hit]] = n_long
                lost = lost[~hit]
        steps = (size + 8 * (symbol == run)).tolist()
        met, p = [], place - 8 * a
        while p < end:
            met.append(p)
            step = steps[p]
            if not step:
                raise CorruptBlock("bits that no code has")
            p += step
        place = p + 8 * a
        met = np.array(met)
        own = symbol[met]
        repeats = np.ones(len(met), np.int64)
        runs = own == run
        repeats[runs] = (window[met[runs] + size[met[runs]]] >> np.uint64(56)).astype(np.int64)
        before = np.maximum.accumulate(np.where(runs, -1, np.arange(len(met))))
        if last < 0 and len(met) and runs[0]:
            raise CorruptBlock("a run without a symbol")
        own = np.where(before >= 0, own[np.maximum(before, 0)], last)
        last = int(own[-1])
        filled += int(repeats.sum())
        if filled > n:
            raise CorruptBlock("more symbols than the block has")
        pieces.append(np.repeat(own, repeats).astype(np.uint16))
    if place != n_bits or filled != n:
        raise CorruptBlock(f"{filled} symbols in a block of {n}")
    return np.concatenate([out[:0], *pieces])
