"""Wavelet blocks: values compacted by a bitmap, transformed plane by plane, and Huffman coded."""

from __future__ import annotations

import struct

import numpy as np

from lucidframe.codecs import huffman, wavelet
from lucidframe.codecs.blocks import CorruptBlock

BITMAP = 8192


def _planes(words: np.ndarray, lines: int, width: int, sizes: list[int]) -> list[np.ndarray]:
    """(lines, width, words of a sample) of each channel, out of interleaved lines."""
    row = words.reshape(lines, width * sum(sizes))
    cuts = np.cumsum([width * s for s in sizes])[:-1]
    return [p.reshape(lines, width, s) for p, s in zip(np.split(row, cuts, axis=1), sizes)]


def encode(data: bytes, lines: int, width: int, sizes: list[int]) -> bytes:
    """``sizes``: 16-bit words of a sample, 1 for halves and 2 for others."""
    return encode_planes(data, _planes(np.frombuffer(data, "<u2"), lines, width, sizes))


def encode_planes(data: bytes, planes: list[np.ndarray]) -> bytes:
    """``planes``: (lines, width, words of a sample) of each channel, which may differ in size; ``data`` are the same
    words as they are stored without coding."""
    words = np.frombuffer(data, "<u2")
    kinds = np.unique(words)
    used = kinds[kinds != 0]
    bits = np.zeros(BITMAP * 8, np.uint8)
    bits[used] = 1
    bitmap = np.packbits(bits, bitorder="little")
    values = np.concatenate(([0], used))
    largest = len(values) - 1
    filled = np.flatnonzero(bitmap)
    low, high = (int(filled[0]), int(filled[-1])) if len(filled) else (BITMAP - 1, 0)
    coded = []
    for plane in planes:
        if plane.size:
            plane = np.searchsorted(values, plane).astype(np.uint16)
            c = np.stack([wavelet.encode(plane[:, :, j], largest) for j in range(plane.shape[2])], axis=2)
            coded.append(c.ravel())
    body = huffman.encode(np.concatenate(coded)) if coded else b""
    out = struct.pack("<HH", low, high) + (bitmap[low : high + 1].tobytes() if low <= high else b"") + struct.pack("<i", len(body)) + body
    return out if len(out) < len(data) else data


def decode(block: bytes, size: int, lines: int, width: int, sizes: list[int]) -> bytes:
    if len(block) == size:
        return block
    return np.concatenate([p.reshape(lines, -1) for p in decode_planes(block, [(lines, width, s) for s in sizes])], axis=1).astype("<u2").tobytes()


def decode_planes(block: bytes, shapes: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """The words of each channel, whose (lines, width, words of a sample) may differ."""
    if len(block) < 8:
        raise CorruptBlock("a wavelet block is too short")
    low, high = struct.unpack_from("<HH", block)
    bitmap, at = np.zeros(BITMAP, np.uint8), 4
    if high >= BITMAP:
        raise CorruptBlock("a bitmap that is too long")
    if low <= high:
        n = high - low + 1
        part = np.frombuffer(block[at : at + n], np.uint8)
        if len(part) < n:
            raise CorruptBlock("a bitmap is cut short")
        bitmap[low : high + 1] = part
        at += n
    bits = np.unpackbits(bitmap, bitorder="little")
    bits[0] = 1
    values = np.flatnonzero(bits).astype(np.uint16)
    largest = len(values) - 1
    lut = np.zeros(1 << 16, np.uint16)
    lut[: len(values)] = values
    if at + 4 > len(block):
        raise CorruptBlock("a wavelet block without its length")
    (length,) = struct.unpack_from("<i", block, at)
    if length < 0 or at + 4 + length > len(block):
        raise CorruptBlock("a wavelet block is cut short")
    words = huffman.decode(block[at + 4 : at + 4 + length], sum(a * b * s for a, b, s in shapes))
    planes, a = [], 0
    for lines, width, s in shapes:
        n = lines * width * s
        c = words[a : a + n].reshape(lines, width, s)
        planes.append(lut[np.stack([wavelet.decode(c[:, :, j], largest) for j in range(s)], axis=2)] if n else c)
        a += n
    return planes
