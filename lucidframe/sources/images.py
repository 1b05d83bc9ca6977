"""Low-range and other image files: RGBE, PNG, TGA, PNM, PSD, PIC and 32-bit float TIFF, as functions on bytes and arrays.

``read_files`` takes whole folders; JPEG, BMP and GIF go through Spark's own image reader.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lucidframe.sources.exr.frames import each_file, narrow


def write_rgbe(rgb: np.ndarray) -> bytes:
    """(lines, columns, 3) floats with a shared exponent, stored flat."""
    top = rgb.max(axis=2)
    mantissa, power = np.frexp(np.where(top > 1e-32, top, 1.0))
    scale = mantissa * 256.0 / np.where(top > 1e-32, top, 1.0)
    out = np.zeros((*rgb.shape[:2], 4), np.uint8)
    live = top > 1e-32
    out[live, :3] = np.clip(np.maximum(rgb, 0) * scale[:, :, None], 0, 255).astype(np.uint8)[live]
    out[live, 3] = np.clip(power + 128, 0, 255)[live]
    head = f"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y {rgb.shape[0]} +X {rgb.shape[1]}\n"
    return head.encode() + out.tobytes()


def read_rgbe(data: bytes) -> np.ndarray:
    """Flat or run-length coded scanlines to (lines, columns, 3) float32."""
    if not data.startswith((b"#?RADIANCE", b"#?RGBE")):
        raise ValueError("no RGBE file")
    at = data.index(b"\n\n") + 2
    end = data.index(b"\n", at)
    words = data[at:end].split()
    if words[0] != b"-Y" or words[2] != b"+X":
        raise ValueError("an orientation that is not supported")
    h, w, at = int(words[1]), int(words[3]), end + 1
    out = np.zeros((h, w, 4), np.uint8)
    for y in range(h):
        if 8 <= w < 32768 and data[at : at + 2] == b"\2\2" and data[at + 2] << 8 | data[at + 3] == w:
            at += 4
            for k in range(4):
                x = 0
                while x < w:
                    n = data[at]
                    if n > 128:
                        out[y, x : x + n - 128, k] = data[at + 1]
                        x, at = x + n - 128, at + 2
                    else:
                        if n == 0:
                            raise ValueError("an empty run")
                        out[y, x : x + n, k] = np.frombuffer(data, np.uint8, n, at + 1)
                        x, at = x + n, at + 1 + n
        else:
            out[y] = np.frombuffer(data, np.uint8, 4 * w, at).reshape(w, 4)
            at += 4 * w
    scale = np.ldexp(1.0, out[:, :, 3].astype(np.int32) - 136)
    return np.where(out[:, :, 3:] > 0, out[:, :, :3] * scale[:, :, None], 0).astype(np.float32)


def write_png(pixels: np.ndarray) -> bytes:
    """(lines, columns, 1, 3 or 4) bytes."""
    h, w, n = pixels.shape
    kind = {1: 0, 3: 2, 4: 6}[n]
    lines = np.concatenate((np.zeros((h, 1), np.uint8), pixels.reshape(h, w * n)), axis=1).tobytes()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """8-bit, not interlaced, gray, RGB or RGBA."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, body = 8, b""
    w = h = kind = 0
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        name, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size
        if name == b"IHDR":
            w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", part)
            if depth != 8 or interlaced or kind not in (0, 2, 6):
                raise ValueError("a PNG that is not supported")
        elif name == b"IDAT":
            body += part
    n = {0: 1, 2: 3, 6: 4}[kind]
    table = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.int64)
    for y in range(h):
        line, above = table[y, 1:].astype(np.int64), out[y - 1] if y else np.zeros(w * n, np.int64)
        how = table[y, 0]
        if how == 0:
            out[y] = line
        elif how == 2:
            out[y] = (line + above) & 255
        elif how == 1:
            out[y] = (np.cumsum(line.reshape(w, n), axis=0) & 255).ravel()
        else:
            for i in range(w * n):
                a, b, c = out[y, i - n] if i >= n else 0, above[i], above[i - n] if i >= n else 0
                if how == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out[y, i] = (line[i] + guess) & 255
    return out.astype(np.uint8).reshape(h, w, n)


def write_float_tiff(pixels: np.ndarray) -> bytes:
    """(lines, columns, components) float32: one uncompressed contiguous strip, little endian."""
    h, w, n = pixels.shape
    body = pixels.astype("<f4").tobytes()
    extra = b"".join(struct.pack("<H", v) for v in [32] * n + [3] * n)
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, n, 8 + len(body)), (259, 3, 1, 1), (262, 3, 1, 2 if n >= 3 else 1), (273, 4, 1, 8), (277, 3, 1, n), (278, 4, 1, h), (279, 4, 1, len(body)), (284, 3, 1, 1), (339, 3, n, 8 + len(body) + 2 * n)]
    if n > 3:
        tags.insert(10, (338, 3, 1, 2))
    entries = b""
    for tag, kind, count, value in tags:
        if kind == 3 and count in (1, 2) and tag in (258, 339):
            value = (32 if tag == 258 else 3) * (1 if count == 1 else 65537)
        entries += struct.pack("<HHII", tag, kind, count, value)
    return b"II*\0" + struct.pack("<I", 8 + len(body) + len(extra)) + body + extra + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)


def read_float_tiff(data: bytes) -> np.ndarray:
    """What ``write_float_tiff`` writes."""
    if data[:4] != b"II*\0":
        raise ValueError("no little-endian TIFF file")
    (at,) = struct.unpack_from("<I", data, 4)
    (count,) = struct.unpack_from("<H", data, at)
    tags = {}
    for i in range(count):
        tag, _, _, value = struct.unpack_from("<HHII", data, at + 2 + 12 * i)
        tags[tag] = value
    return np.frombuffer(data, "<f4", tags[279] // 4, tags[273]).reshape(tags[257], tags[256], tags[277] & 0xFFFF).copy()


# RGBM ---------------------------------------------------------------------------------------------------------------


def write_rgbm_png(rgb: np.ndarray) -> bytes:
    """Linear (lines, columns, 3) values as a PNG of colours and, as alpha, their common multiplier in steps of 1/255."""
    squares = np.square(np.maximum(rgb.astype(np.float64), 0)) / 16
    m = np.ceil(np.clip(squares.max(axis=2, keepdims=True), 1 / 16, 1) * 255)
    colours = np.clip(squares / (m / 255), 0, 1)
    return write_png(np.concatenate((np.floor(colours * 255 + 0.5), m), axis=2).astype(np.uint8))


def read_rgbm_png(data: bytes) -> np.ndarray:
    """Linear values back, to the steps that eight bits leave."""
    v = read_png(data).astype(np.float64) / 255
    return np.sqrt(v[:, :, :3] * v[:, :, 3:] * 16)


# TGA, PNM, PSD, PIC --------------------------------------------------------------------------------------------------------


def read_tga(data: bytes) -> np.ndarray:
    """8-bit gray, 24- and 32-bit colours, plain or in runs, from the top or from the bottom."""
    if len(data) < 18:
        raise ValueError("a TGA that is too short")
    skip, mapped, kind = data[0], data[1], data[2]
    w, h, depth, flags = *struct.unpack_from("<HH", data, 12), data[16], data[17]
    n = depth // 8
    if mapped or kind not in (2, 3, 10, 11) or depth not in (8, 24, 32) or not w or not h:
        raise ValueError("a TGA that is not supported")
    at, size = 18 + skip, w * h * n
    if kind < 8:
        body = data[at : at + size]
    else:
        parts, have = [], 0
        while have < size:
            if at >= len(data):
                raise ValueError("a TGA that is cut short")
            count = (data[at] & 127) + 1
            if data[at] & 128:
                part = data[at + 1 : at + 1 + n] * count
                at += 1 + n
            else:
                part = data[at + 1 : at + 1 + n * count]
                at += 1 + n * count
            parts.append(part)
            have += len(part)
            if not part:
                raise ValueError("a TGA that is cut short")
        body = b"".join(parts)[:size]
    if len(body) < size:
        raise ValueError("a TGA that is cut short")
    out = np.frombuffer(body, np.uint8).reshape(h, w, n)
    if n > 1:
        out = out[:, :, [2, 1, 0, 3][:n]]
    return np.ascontiguousarray(out if flags & 0x20 else out[::-1])


def read_pnm(data: bytes) -> np.ndarray:
    """Binary gray (P5) and colours (P6) of up to 8 bits, scaled to 255."""
    if data[:2] not in (b"P5", b"P6"):
        raise ValueError("no binary PNM file")
    numbers, at = [], 2
    while len(numbers) < 3:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == ord("#")):
            at = data.index(b"\n", at) + 1 if data[at] == ord("#") else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a PNM header without its numbers")
        numbers.append(int(data[at:end]))
        at = end
    w, h, most = numbers
    n = 1 if data[:2] == b"P5" else 3
    body = data[at + 1 : at + 1 + w * h * n]
    if not 0 < most < 256 or len(body) < w * h * n:
        raise ValueError("a PNM that is not supported or cut short")
    out = np.frombuffer(body, np.uint8).reshape(h, w, n)
    return out.copy() if most == 255 else (out.astype(np.int64) * 255 // most).astype(np.uint8)


def read_psd(data: bytes) -> np.ndarray:
    """The merged image of an 8-bit RGB or gray file, plain or in runs."""
    if data[:6] != b"8BPS\0\1" or len(data) < 26:
        raise ValueError("no PSD file")
    n, h, w, depth, mode = struct.unpack_from(">HIIHH", data, 12)
    if depth != 8 or mode not in (1, 3):
        raise ValueError("a PSD that is not supported")
    at = 26
    for _ in range(3):  # colour table, resources, layers
        (size,) = struct.unpack_from(">I", data, at)
        at += 4 + size
    (packed,) = struct.unpack_from(">H", data, at)
    at, size = at + 2, w * h
    if packed == 0:
        planes = np.frombuffer(data, np.uint8, n * size, at)
    elif packed == 1:
        at += 2 * h * n
        out = bytearray()
        while len(out) < n * size:
            if at >= len(data):
                raise ValueError("a PSD that is cut short")
            k = data[at]
            if k < 128:
                out += data[at + 1 : at + 2 + k]
                at += 2 + k
            else:
                if k > 128:
                    out += data[at + 1 : at + 2] * (257 - k)
                at += 1 if k == 128 else 2
        planes = np.frombuffer(bytes(out[: n * size]), np.uint8)
    else:
        raise ValueError("a PSD that is not supported")
    keep = min(n, 4 if mode == 3 else 1)
    return np.ascontiguousarray(planes.reshape(n, h, w)[:keep].transpose(1, 2, 0))


#: First bytes, and the bits of the channels.
PIC_MAGIC, PIC_BITS = b"\x53\x80\xf6\x34", {"R": 0x80, "G": 0x40, "B": 0x20, "A": 0x10}


def read_pic(data: bytes) -> np.ndarray:
    """8-bit colours in packets of channels, each line plain, in runs or in runs and stretches; alpha if a packet has it."""
    if len(data) < 104 or not data.startswith(PIC_MAGIC) or data[88:92] != b"PICT":
        raise ValueError("no PIC file")
    w, h = struct.unpack_from(">HH", data, 92)
    packets, at, more = [], 104, 1
    while more:
        more, depth, kind, mask = struct.unpack_from("4B", data, at)
        if depth != 8 or kind > 2 or len(packets) == 8:
            raise ValueError("a PIC that is not supported")
        packets.append((kind, [k for k, bit in enumerate(PIC_BITS.values()) if mask & bit]))
        at += 4

    def line_of(kind: int, n: int, at: int) -> tuple[bytes, int]:
        line, size = bytearray(), w * n
        while len(line) < size:
            count, repeated = w, False
            if kind:
                count, repeated, at = data[at], kind == 1, at + 1
                if kind == 2 and count == 128:
                    count, repeated, at = int.from_bytes(data[at : at + 2], "big"), True, at + 2
                elif kind == 2:
                    repeated = count > 128
                    count = count - 127 if repeated else count + 1
            took = data[at : at + (n if repeated else n * count)]
            if not took or len(took) < (n if repeated else n * count):
                raise ValueError("a PIC that is cut short")
            line += took * count if repeated else took
            at += len(took)
        return bytes(line[:size]), at

    out = np.full((h, w, 4), 255, np.uint8)
    for y in range(h):
        for kind, places in packets:
            line, at = line_of(kind, len(places), at)
            out[y][:, places] = np.frombuffer(line, np.uint8).reshape(w, len(places))
    alpha = any(3 in places for _, places in packets)
    return out if alpha else np.ascontiguousarray(out[:, :, :3])


#: First bytes and readers; TGA has none and is told by its name.
READERS = ((b"\x89PNG", read_png), (b"P5", read_pnm), (b"P6", read_pnm), (b"8BPS", read_psd), (PIC_MAGIC, read_pic))
PIXELS = "path string, error string, height int, width int, components int, pixels binary"


def decode_image(path: str, data: bytes) -> np.ndarray:
    for magic, read in READERS:
        if data.startswith(magic):
            return read(data)
    if path.lower().endswith(".tga"):
        return read_tga(data)
    raise ValueError("an image of a kind that is not supported")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, error, height, width, components, pixels) of a folder's 8-bit images, pixels as interleaved lines of gray,
    RGB or RGBA.  A file that cannot be read has its error and nothing else."""
    native = "*.{jpg,jpeg,bmp,gif,JPG,JPEG,BMP,GIF}"
    own = "*.{png,tga,ppm,pgm,pnm,psd,pic,PNG,TGA,PPM,PGM,PNM,PSD,PIC}"
    kinds = pa.schema([("path", pa.string()), ("error", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("components", pa.int32()), ("pixels", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, content in each_file(batches):
            try:
                image = decode_image(name, content)
                row = {"path": name, "height": image.shape[0], "width": image.shape[1], "components": image.shape[2], "pixels": image.tobytes()}
            except (ValueError, struct.error, IndexError, zlib.error) as e:
                row = {"path": name, "error": str(e)}
            yield pa.RecordBatch.from_pylist([row], schema=kinds)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # Spark's reader has blue first
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if r["components"] is None or r["components"] < 0:
                    row = {"path": r["path"], "error": "an image that cannot be decoded"}
                else:
                    image = np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], r["components"])
                    row = r | {"pixels": np.ascontiguousarray(image[:, :, [2, 1, 0, 3][: r["components"]]] if r["components"] > 1 else image).tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=kinds)

    files = lambda kind, pattern: spark.read.format(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    mine = narrow(files("binaryFile", own).load(path)).mapInArrow(scan, PIXELS)
    image = files("image", native).load(path).select(F.col("image.origin").alias("path"), F.lit(None).cast("string").alias("error"), "image.height", "image.width", F.col("image.nChannels").alias("components"), F.col("image.data").alias("pixels"))
    return mine.unionByName(image.mapInArrow(turn, PIXELS))
