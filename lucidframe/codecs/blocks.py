"""Byte transforms in front of the entropy coders, and the run-length and DEFLATE block codecs.

Every codec keeps a block as it is when coding does not make it smaller; readers see that from the equal size.
"""

from __future__ import annotations

import zlib

import numpy as np


class CorruptBlock(ValueError):
    """A block that cannot be decoded."""


def scatter(data: bytes) -> np.ndarray:
    """Even bytes, then odd bytes, as differences moved by 128."""
    b = np.frombuffer(data, np.uint8)
    halves = np.concatenate((b[::2], b[1::2]))
    out = halves.copy()
    out[1:] = halves[1:] - halves[:-1] + np.uint8(128)
    return out


def gather(data: np.ndarray) -> bytes:
    """Undoes ``scatter``."""
    steps = data.astype(np.int64)
    steps[1:] -= 128
    halves = (np.cumsum(steps) & 255).astype(np.uint8)
    out = np.empty_like(halves)
    n = (len(halves) + 1) // 2
    out[::2], out[1::2] = halves[:n], halves[n:]
    return out.tobytes()


MIN_RUN, MAX_RUN = 3, 127


def rle_pack(data: bytes) -> bytes:
    """Runs of 3 to 128 bytes as (length - 1, byte); up to 127 others behind their negative number."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return b""
    first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    size = np.diff(np.append(first, len(b)))
    out = bytearray()
    plain = 0  # where bytes wait that are in no run
    for a, n in zip(first[size >= MIN_RUN].tolist(), size[size >= MIN_RUN].tolist()):
        _literals(out, data, plain, a)
        end = a + n
        while end - a >= MIN_RUN:
            step = min(MAX_RUN + 1, end - a)
            out += bytes((step - 1, data[a]))
            a += step
        plain = a
    _literals(out, data, plain, len(data))
    return bytes(out)


def _literals(out: bytearray, data: bytes, a: int, b: int) -> None:
    for i in range(a, b, MAX_RUN):
        part = data[i : min(b, i + MAX_RUN)]
        out.append(256 - len(part))
        out += part


def rle_unpack(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n >= 128:
            n = 256 - n
            part = data[i + 1 : i + 1 + n]
            i += 1 + n
        else:
            if i + 1 >= len(data):
                raise CorruptBlock("a run without its byte")
            n += 1
            part = data[i + 1 : i + 2] * n
            i += 2
        if len(part) < n or len(out) + n > size:
            raise CorruptBlock("runs beyond the block")
        out += part
    if len(out) != size:
        raise CorruptBlock("too few bytes in a block of runs")
    return bytes(out)


def rle_encode(data: bytes) -> bytes:
    packed = rle_pack(scatter(data).tobytes())
    return packed if len(packed) < len(data) else data


def rle_decode(data: bytes, size: int) -> bytes:
    if len(data) == size:
        return data
    if len(data) <= 2:
        raise CorruptBlock("a block of runs is too short")
    return gather(np.frombuffer(rle_unpack(data, size), np.uint8))


def zip_encode(data: bytes, level: int = 6) -> bytes:
    packed = zlib.compress(scatter(data).tobytes(), level)
    return packed if len(packed) < len(data) else data


def zip_decode(data: bytes, size: int) -> bytes:
    if len(data) == size:
        return data
    try:
        plain = zlib.decompress(data)
    except zlib.error as e:
        raise CorruptBlock(str(e)) from e
    if len(plain) != size:
        raise CorruptBlock(f"{len(plain)} bytes in a block of {size}")
    return gather(np.frombuffer(plain, np.uint8))
