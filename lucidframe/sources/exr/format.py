"""Headers, chunk tables and chunks of image files, as plain functions on bytes and arrays."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np

from lucidframe.codecs import blocks, piz
from lucidframe.functions import half

#: Fixed values of the format.
MAGIC, VERSION = b"\x76\x2f\x31\x01", 2
TILED, LONG_NAMES, NON_IMAGE, MULTIPART = 0x2, 0x4, 0x8, 0x10
UINT, HALF, FLOAT = 0, 1, 2
NONE, RLE, ZIPS, ZIP, PIZ = 0, 1, 2, 3, 4
UNSUPPORTED = {5: "PXR24", 6: "B44", 7: "B44A", 8: "DWAA", 9: "DWAB", 128: "ZFP"}
LINES = {NONE: 1, RLE: 1, ZIPS: 1, ZIP: 16, PIZ: 32}
DTYPES = {UINT: np.dtype("<u4"), HALF: np.dtype("<u2"), FLOAT: np.dtype("<f4")}
REQUIRED = ("channels", "compression", "dataWindow", "displayWindow", "lineOrder", "pixelAspectRatio", "screenWindowCenter", "screenWindowWidth")
MAX_SIDE, MAX_SAMPLES, MAX_ATTRIBUTES = 1024 * 8192, 0x4000000000, 1024
#: Status numbers.
OK, BAD_MAGIC, BAD_VERSION, BAD_ARGUMENT, BAD_DATA, BAD_FILE, BAD_PARAMETER, CANNOT_OPEN, BAD_FORMAT, BAD_HEADER, BAD_FEATURE, CANNOT_WRITE, CANNOT_SERIALIZE, NO_LAYER, TOO_LARGE = range(0, -15, -1)


class ImageError(ValueError):
    def __init__(self, status: int, text: str):
        super().__init__(f"{text} ({status})")
        self.status = status


@dataclass(frozen=True)
class Channel:
    name: str
    pixel_type: int = FLOAT
    x_sampling: int = 1
    y_sampling: int = 1
    p_linear: int = 0


@dataclass
class Part:
    channels: list[Channel]
    width: int
    height: int
    compression: int = ZIP
    name: str = ""
    type: str = ""
    line_order: int = 0
    tile: tuple[int, int] | None = None
    level_mode: int = 0
    round_up: int = 0
    chunk_count: int = 0
    data_window: tuple[int, int, int, int] | None = None
    display_window: tuple[int, int, int, int] | None = None
    pixel_aspect_ratio: float = 1.0
    screen_window_center: tuple[float, float] = (0.0, 0.0)
    screen_window_width: float = 1.0
    attributes: dict[str, tuple[str, bytes]] = field(default_factory=dict)

    @property
    def deep(self) -> bool:
        return self.type.startswith("deep")

    def levels(self) -> list[tuple[int, int, int, int]]:
        """(level_x, level_y, width, height) in file order."""
        if self.tile is None or self.level_mode == 0:
            return [(0, 0, self.width, self.height)]
        if self.level_mode == 1:
            return [(i, i, level_size(self.width, i, self.round_up), level_size(self.height, i, self.round_up)) for i in range(round_log2(max(self.width, self.height), self.round_up) + 1)]
        nx, ny = (round_log2(n, self.round_up) + 1 for n in (self.width, self.height))
        return [(x, y, level_size(self.width, x, self.round_up), level_size(self.height, y, self.round_up)) for y in range(ny) for x in range(nx)]

    def tile_list(self) -> list[tuple[int, int, int, int]]:
        """(level_x, level_y, tile_x, tile_y) of every chunk in the order of the table."""
        tw, th = self.tile
        return [(lx, ly, x, y) for lx, ly, w, h in self.levels() for y in range(-(-h // th)) for x in range(-(-w // tw))]

    def n_chunks(self) -> int:
        if self.tile is not None:
            return len(self.tile_list())
        return self.chunk_count if self.chunk_count > 0 else -(-self.height // LINES[self.compression])

    def pixel_bytes(self) -> int:
        return sum(DTYPES[c.pixel_type].itemsize for c in self.channels)

    @property
    def subsampled(self) -> bool:
        return any((c.x_sampling, c.y_sampling) != (1, 1) for c in self.channels)


def round_log2(n: int, up: int) -> int:
    return 0 if n <= 1 else (n - 1).bit_length() if up else n.bit_length() - 1


def level_size(top: int, level: int, up: int) -> int:
    return max(1, (top + ((1 << level) - 1 if up else 0)) >> level)


# reading ------------------------------------------------------------------------------------------------------------


def parse_version(data: bytes | None) -> dict[str, int | bool]:
    if data is None:
        raise ImageError(BAD_ARGUMENT, "no bytes")
    if len(data) < 8:
        raise ImageError(BAD_DATA, "too few bytes for a version")
    if data[:4] != MAGIC:
        raise ImageError(BAD_MAGIC, "another kind of file")
    if data[4] != VERSION:
        raise ImageError(BAD_VERSION, f"version {data[4]}")
    flags = data[5]
    return {"version": VERSION, "tiled": bool(flags & TILED), "long_name": bool(flags & LONG_NAMES), "non_image": bool(flags & NON_IMAGE), "multipart": bool(flags & MULTIPART)}


def _text(data: bytes, at: int) -> tuple[str, int]:
    end = data.find(b"\0", at)
    if end < 0 or end - at > 255:
        raise ImageError(BAD_DATA, "a name without an end")
    return data[at:end].decode("utf-8", "replace"), end + 1


def _attributes(data: bytes, at: int) -> tuple[list[tuple[str, str, bytes]], int]:
    out: list[tuple[str, str, bytes]] = []
    while True:
        if at >= len(data):
            raise ImageError(BAD_DATA, "a header without an end")
        if data[at] == 0:
            return out, at + 1
        if len(out) >= MAX_ATTRIBUTES:
            raise ImageError(BAD_HEADER, "too many attributes")
        name, at = _text(data, at)
        kind, at = _text(data, at)
        if at + 4 > len(data):
            raise ImageError(BAD_DATA, "an attribute is cut short")
        (size,) = struct.unpack_from("<i", data, at)
        at += 4
        if size < 0 or at + size > len(data) or (size == 0 and kind != "string"):
            raise ImageError(BAD_DATA, f"attribute {name} has a bad size")
        out.append((name, kind, data[at : at + size] or b"\0"))
        at += size


def _channels(value: bytes) -> list[Channel]:
    out, at = [], 0
    while at < len(value) and value[at]:
        name, at = _text(value, at)
        if at + 16 > len(value):
            raise ImageError(BAD_DATA, "a channel is cut short")
        kind, linear, xs, ys = struct.unpack_from("<iB3xii", value, at)
        at += 16
        if kind not in DTYPES:
            raise ImageError(BAD_FORMAT, f"pixel type {kind}")
        out.append(Channel(name, kind, xs, ys, linear))
    return out


def _part(found: list[tuple[str, str, bytes]], tiled: bool, multipart: bool, deep: bool) -> Part:
    given = {n: v for n, _, v in found}
    missing = [n for n in REQUIRED if n not in given]
    if multipart or deep:
        missing += [n for n in ("name", "type") if n not in given]
    if multipart and "chunkCount" not in given:
        missing.append("chunkCount")
    if missing:
        raise ImageError(BAD_HEADER, f"missing: {', '.join(missing)}")

    def numbers(name: str, shape: str) -> tuple:
        if len(given[name]) < struct.calcsize(shape):
            raise ImageError(BAD_DATA, f"attribute {name} is cut short")
        return struct.unpack_from(shape, given[name])

    window, display = numbers("dataWindow", "<4i"), numbers("displayWindow", "<4i")
    if window[2] < window[0] or window[3] < window[1]:
        raise ImageError(BAD_DATA, "an empty data window")
    width, height = window[2] - window[0] + 1, window[3] - window[1] + 1
    if max(width, height) > MAX_SIDE:
        raise ImageError(BAD_DATA, "an image that is too large")
    (compression,) = numbers("compression", "<B")
    if compression not in LINES:
        raise ImageError(BAD_FORMAT, f"compression {UNSUPPORTED.get(compression, compression)}")
    channels = _channels(given["channels"])
    if not channels:
        raise ImageError(BAD_HEADER, "no channel")
    if any(min(c.x_sampling, c.y_sampling) < 1 or window[0] % c.x_sampling or window[1] % c.y_sampling for c in channels):
        raise ImageError(BAD_DATA, "samplings that do not fit the data window")
    if width * height * len(channels) >= MAX_SAMPLES:
        raise ImageError(BAD_DATA, "too many samples")
    text = lambda n: given[n].split(b"\0")[0].decode("utf-8", "replace") if n in given else ""
    kind = text("type")
    if not multipart and kind in ("scanlineimage", "tiledimage", "deeptile") and tiled != (kind != "scanlineimage"):
        raise ImageError(BAD_HEADER, f"the flag of tiles does not go with the type {kind}")
    tile, mode, up = None, 0, 0
    if tiled or kind in ("tiledimage", "deeptile"):
        if "tiles" not in given:
            raise ImageError(BAD_HEADER, "tiles without sizes")
        tx, ty, byte = numbers("tiles", "<iiB")
        if tx < 1 or ty < 1 or max(tx, ty) > MAX_SIDE or byte & 3 == 3:
            raise ImageError(BAD_DATA, "bad tile sizes")
        tile, mode, up = (tx, ty), byte & 3, byte >> 4 & 1
    if tile and any((c.x_sampling, c.y_sampling) != (1, 1) for c in channels):
        raise ImageError(BAD_FEATURE, "tiles of subsampled channels")
    known = {*REQUIRED, "name", "type", "chunkCount", "tiles"}
    custom = {n: (k, v) for n, k, v in found if n not in known}
    return Part(
        channels, width, height, compression, text("name"), kind, numbers("lineOrder", "<B")[0], tile, mode, up, max(0, numbers("chunkCount", "<i")[0]) if "chunkCount" in given else 0, window, display,
        numbers("pixelAspectRatio", "<f")[0], numbers("screenWindowCenter", "<ff"), numbers("screenWindowWidth", "<f")[0], custom,
    )


def parse_headers(data: bytes) -> tuple[dict, list[Part], int]:
    """Version flags, parts, and where the chunk tables begin."""
    version = parse_version(data)
    at, parts = 8, []
    while True:
        if version["multipart"] and at < len(data) and data[at] == 0:
            if not parts:
                raise ImageError(BAD_HEADER, "no part")
            return version, parts, at + 1
        found, at = _attributes(data, at)
        parts.append(_part(found, bool(version["tiled"]) and not version["multipart"], bool(version["multipart"]), bool(version["non_image"])))
        if not version["multipart"]:
            return version, parts, at


@dataclass(frozen=True)
class Chunk:
    part_id: int
    index: int
    level_x: int
    level_y: int
    tile_x: int
    tile_y: int
    y: int
    data: bytes


def chunk_tables(data: bytes, parts: list[Part], at: int, multipart: bool, size: int | None = None, fetch: Callable[[int, int], bytes] | None = None) -> tuple[list[list[int]], int]:
    """Offsets of each part; a single part's damaged table is rebuilt by walking its chunks.

    ``data`` may be the beginning of a file of ``size`` bytes, of which ``fetch(offset, n)`` reads any others.
    """
    tables = []
    for p in parts:
        n = p.n_chunks()
        if at + 8 * n > len(data):
            raise ImageError(BAD_DATA, "a chunk table is cut short")
        tables.append(list(struct.unpack_from(f"<{n}q", data, at)))
        at += 8 * n
    size = len(data) if size is None else size
    for p, t in zip(parts, tables):
        if any(o <= 0 or o >= size for o in t):
            if multipart or p.deep:
                raise ImageError(BAD_DATA, "a damaged chunk table")
            t[:] = _walk(fetch or (lambda o, n: data[o : o + n]), size, p, at, len(t))
    return tables, at


def _walk(fetch: Callable[[int, int], bytes], length: int, part: Part, at: int, n: int) -> list[int]:
    head = 20 if part.tile else 8
    found: dict[tuple, int] = {}
    while at + head <= length and len(found) < n:
        if part.tile:
            tx, ty, lx, ly, size = struct.unpack("<5i", fetch(at, head))
            key = (lx, ly, tx, ty)
        else:
            y, size = struct.unpack("<ii", fetch(at, head))
            key = ((y - part.data_window[1]) // LINES[part.compression],)
        if size < 0:
            break
        found[key] = at
        at += head + size
    keys = part.tile_list() if part.tile else [(i,) for i in range(n)]
    if any(k not in found for k in keys):
        raise ImageError(BAD_DATA, "chunks are missing")
    return [found[k] for k in keys]


def read_chunks(data: bytes, part_id: int | None = None) -> Iterator[tuple[Part, Chunk]]:
    version, parts, at = parse_headers(data)
    tables, _ = chunk_tables(data, parts, at, bool(version["multipart"]))
    for k, (p, table) in enumerate(zip(parts, tables)):
        if part_id is not None and k != part_id:
            continue
        tiles = p.tile_list() if p.tile else None
        for i, o in enumerate(table):
            yield p, parse_chunk(memoryview(data)[o:], p, k, bool(version["multipart"]), i, tiles)


def parse_chunk(data: bytes | memoryview, p: Part, part_id: int, multipart: bool, index: int = 0, tiles: list | None = None) -> Chunk:
    """The chunk that begins at the first byte; lines count from the data window."""
    o = 0
    try:
        if multipart:
            if struct.unpack_from("<i", data, 0)[0] != part_id:
                raise ImageError(BAD_DATA, "a chunk of another part")
            o = 4
        if p.tile is not None:
            tx, ty, lx, ly, size = struct.unpack_from("<5i", data, o)
            if (lx, ly, tx, ty) not in (tiles[index : index + 1] if tiles else []) and (lx, ly, tx, ty) not in (tiles or p.tile_list()):
                raise ImageError(BAD_DATA, "a tile beyond the image")
            chunk = Chunk(part_id, index, lx, ly, tx, ty, 0, bytes(data[o + 20 : o + 20 + max(size, 0)]))
        else:
            y, size = struct.unpack_from("<ii", data, o)
            if not 0 <= y - p.data_window[1] < p.height:
                raise ImageError(BAD_DATA, "a block beyond the image")
            chunk = Chunk(part_id, index, 0, 0, 0, 0, y - p.data_window[1], bytes(data[o + 8 : o + 8 + max(size, 0)]))
    except struct.error as e:
        raise ImageError(BAD_DATA, "a chunk is cut short") from e
    if size < 0 or len(chunk.data) < size:
        raise ImageError(BAD_DATA, "a chunk is cut short")
    return chunk


def chunk_shape(part: Part, c: Chunk) -> tuple[int, int, int, int]:
    """x, y, columns and lines of a chunk in its level."""
    if part.tile is None:
        return 0, c.y, part.width, min(LINES[part.compression], part.height - c.y)
    tw, th = part.tile
    w, h = (level_size(n, k, part.round_up) for n, k in ((part.width, c.level_x), (part.height, c.level_y)))
    return c.tile_x * tw, c.tile_y * th, min(tw, w - c.tile_x * tw), min(th, h - c.tile_y * th)


def sampled(ch: Channel, y: int, w: int, lines: int) -> tuple[int, int]:
    """Stored lines and columns of a channel in a block that begins at line y of the window; it starts on a sample."""
    return -(-(y + lines) // ch.y_sampling) - -(-y // ch.y_sampling), -(-w // ch.x_sampling)


def decode_stored(part: Part, c: Chunk) -> dict[str, np.ndarray]:
    """What a chunk stores: planes by channel in their stored type (halves as bits), subsampled ones smaller."""
    _, y, w, lines = chunk_shape(part, c)
    shapes = [sampled(ch, y, w, lines) for ch in part.channels]
    size = sum(a * b * DTYPES[ch.pixel_type].itemsize for (a, b), ch in zip(shapes, part.channels))
    words = [DTYPES[ch.pixel_type].itemsize // 2 for ch in part.channels]
    try:
        if part.compression == NONE or len(c.data) == size:
            raw = c.data
        elif part.compression == RLE:
            raw = blocks.rle_decode(c.data, size)
        elif part.compression in (ZIP, ZIPS):
            raw = blocks.zip_decode(c.data, size)
        elif part.subsampled:
            planes = piz.decode_planes(c.data, [(a, b, n) for (a, b), n in zip(shapes, words)])
            return {ch.name: np.ascontiguousarray(p.reshape(a, -1)).view(DTYPES[ch.pixel_type]) for ch, p, (a, _) in zip(part.channels, planes, shapes)}
        else:
            raw = piz.decode(c.data, size, lines, w, words)
    except (blocks.CorruptBlock, ValueError, IndexError) as e:
        raise ImageError(BAD_DATA, str(e)) from e
    if len(raw) != size:
        raise ImageError(BAD_DATA, "a chunk of another size")
    out, at = {}, 0
    if not part.subsampled:
        table = np.frombuffer(raw, np.uint8).reshape(lines, w * part.pixel_bytes())
        for ch in part.channels:
            n = w * DTYPES[ch.pixel_type].itemsize
            out[ch.name] = np.ascontiguousarray(table[:, at : at + n]).view(DTYPES[ch.pixel_type])
            at += n
        return out
    rows: dict[str, list[bytes]] = {ch.name: [] for ch in part.channels}
    for line in range(y, y + lines):  # lines have the channels that are sampled there, one after another
        for ch, (_, n) in zip(part.channels, shapes):
            if line % ch.y_sampling == 0:
                n *= DTYPES[ch.pixel_type].itemsize
                rows[ch.name].append(raw[at : at + n])
                at += n
    return {ch.name: np.frombuffer(b"".join(rows[ch.name]), DTYPES[ch.pixel_type]).reshape(shape) for ch, shape in zip(part.channels, shapes)}


def decode_chunk(part: Part, c: Chunk) -> dict[str, tuple[int, np.ndarray]]:
    """By channel the first line, and lines of the chunk's full width.

    A sample of a subsampled channel stands for the pixels up to the next one, to the right and below; a block without a
    sampled line of a channel has no lines of it, as an earlier block has given them.
    """
    _, y, w, lines = chunk_shape(part, c)
    out = {}
    for ch, plane in zip(part.channels, decode_stored(part, c).values()):
        first = -(-y // ch.y_sampling) * ch.y_sampling
        if (ch.x_sampling, ch.y_sampling) != (1, 1):
            most = min(part.height - first, len(plane) * ch.y_sampling)
            plane = plane[np.arange(max(0, most)) // ch.y_sampling][:, np.arange(w) // ch.x_sampling]
        out[ch.name] = first, plane
    return out


def as_numbers(plane: np.ndarray, pixel_type: int) -> np.ndarray:
    """Stored samples as doubles, which hold all three types exactly."""
    return (half.widen(plane) if pixel_type == HALF else plane).astype(np.float64)


def decode_planes(data: bytes, part_id: int = 0) -> dict[tuple[int, int], dict[str, np.ndarray]]:
    """All levels of a part; rows go by the line number of their block, and by line order."""
    out: dict[tuple[int, int], dict[str, np.ndarray]] = {}
    part = None
    for part, c in read_chunks(data, part_id):
        if part.deep:
            raise ImageError(BAD_FEATURE, "a deep part")
        w, h = (level_size(n, k, part.round_up) for n, k in ((part.width, c.level_x), (part.height, c.level_y)))
        level = out.setdefault((c.level_x, c.level_y), {ch.name: np.zeros((h, w), DTYPES[ch.pixel_type]) for ch in part.channels})
        x, _, n, _ = chunk_shape(part, c)
        for name, (y, plane) in decode_chunk(part, c).items():
            level[name][y : y + len(plane), x : x + n] = plane
    return out


# writing ------------------------------------------------------------------------------------------------------------


def to_stored(values: np.ndarray, pixel_type: int) -> np.ndarray:
    if pixel_type == HALF:
        return half.narrow(values)
    return values.astype(DTYPES[pixel_type])


def _attribute(name: str, kind: str, value: bytes) -> bytes:
    return name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<i", len(value)) + value


def header_bytes(p: Part, multipart: bool, sort: bool = True) -> bytes:
    """A part's header; windows begin at the origin and line order is increasing."""
    listed = sorted(p.channels, key=lambda c: c.name.encode()) if sort else p.channels
    channels = b"".join(c.name.encode()[:255] + b"\0" + struct.pack("<iB3xii", c.pixel_type, 0, c.x_sampling, c.y_sampling) for c in listed) + b"\0"
    box = struct.pack("<4i", 0, 0, p.width - 1, p.height - 1)
    out = [("channels", "chlist", channels), ("compression", "compression", bytes([p.compression])), ("dataWindow", "box2i", box), ("displayWindow", "box2i", box), ("lineOrder", "lineOrder", b"\0"), ("pixelAspectRatio", "float", struct.pack("<f", 1)), ("screenWindowCenter", "v2f", struct.pack("<ff", 0, 0)), ("screenWindowWidth", "float", struct.pack("<f", 1))]
    if p.tile:
        out.append(("tiles", "tiledesc", struct.pack("<iiB", *p.tile, p.level_mode | p.round_up << 4)))
    if multipart or p.deep:
        kind = p.type if p.deep else "tiledimage" if p.tile else "scanlineimage"
        out += [("name", "string", p.name.encode()[:255]), ("type", "string", kind.encode()), ("chunkCount", "int", struct.pack("<i", p.n_chunks()))]
    out += [(n, k, v) for n, (k, v) in p.attributes.items()]
    return b"".join(_attribute(*a) for a in out) + b"\0"


def encode_chunk(part: Part, planes: dict[str, np.ndarray], lines: int, width: int, y: int = 0) -> bytes:
    """A chunk's bytes; the planes are in stored types and full width.  Line y is the first one."""
    listed = sorted(part.channels, key=lambda c: c.name.encode())
    words = [DTYPES[c.pixel_type].itemsize // 2 for c in listed]
    if part.subsampled:
        stored = [np.ascontiguousarray(planes[c.name][-y % c.y_sampling :: c.y_sampling, :: c.x_sampling]) for c in listed]
        raw = b"".join(p[line // c.y_sampling - -(-y // c.y_sampling)].tobytes() for line in range(y, y + lines) for c, p in zip(listed, stored) if line % c.y_sampling == 0)
        if part.compression == PIZ:
            return piz.encode_planes(raw, [p.view("<u2").reshape(*p.shape, n) for p, n in zip(stored, words)])
    else:
        raw = np.concatenate([np.ascontiguousarray(planes[c.name]).view(np.uint8).reshape(lines, -1) for c in listed], axis=1).tobytes()
    if part.compression == NONE:
        return raw
    if part.compression == RLE:
        return blocks.rle_encode(raw)
    if part.compression in (ZIP, ZIPS):
        return blocks.zip_encode(raw)
    return piz.encode(raw, lines, width, words)


Levels = dict[tuple[int, int], dict[str, np.ndarray]]


def encode_file(parts: Sequence[tuple[Part, Levels]]) -> bytes:
    """A file of one or more parts, each with the planes (stored types) of all its levels."""
    if not parts:
        raise ImageError(BAD_ARGUMENT, "no part")
    multipart = len(parts) > 1
    chunks: list[list[bytes]] = []
    for k, (p, levels) in enumerate(parts):
        if p.compression not in LINES:
            raise ImageError(BAD_FORMAT, f"compression {p.compression}")
        if p.tile and [(x, y) for x, y, _, _ in p.levels()] != list(levels):
            raise ImageError(BAD_ARGUMENT, "levels are missing or out of order")
        own = []
        for c in chunk_list(p):
            x, y, w, h = chunk_shape(p, c)
            data = encode_chunk(p, {n: v[y : y + h, x : x + w] for n, v in levels[c.level_x, c.level_y].items()}, h, w, y)
            own.append(chunk_head(p, c, k if multipart else None, len(data)) + data)
        chunks.append(own)
    return join_file([p for p, _ in parts], chunks)


def chunk_list(p: Part) -> list[Chunk]:
    """The chunks of a part to write, without their data."""
    if p.tile:
        return [Chunk(0, i, *t, 0, b"") for i, t in enumerate(p.tile_list())]
    return [Chunk(0, i, 0, 0, 0, 0, y, b"") for i, y in enumerate(range(0, p.height, LINES[p.compression]))]


def chunk_head(p: Part, c: Chunk, part_id: int | None, size: int) -> bytes:
    lead = b"" if part_id is None else struct.pack("<i", part_id)
    return lead + (struct.pack("<5i", c.tile_x, c.tile_y, c.level_x, c.level_y, size) if p.tile else struct.pack("<ii", c.y, size))


def join_file(parts: Sequence[Part], chunks: Sequence[Sequence[bytes]]) -> bytes:
    """A file out of its parts' headers and of their written chunks, in order."""
    multipart = len(parts) > 1
    names = [p.name for p in parts]
    if multipart and (not all(names) or len(set(names)) < len(names)):
        raise ImageError(BAD_ARGUMENT, "parts need names of their own")
    flags = MULTIPART if multipart else TILED if parts[0].tile else 0
    if any(len(c.name.encode()) > 31 for p in parts for c in p.channels) or any(len(n.encode()) > 31 for n in names):
        flags |= LONG_NAMES
    headers = b"".join(header_bytes(p, multipart) for p in parts) + (b"\0" if multipart else b"")
    at = 8 + len(headers) + 8 * sum(map(len, chunks))
    offsets = []
    for own in chunks:
        for c in own:
            offsets.append(at)
            at += len(c)
    return MAGIC + bytes([VERSION, flags, 0, 0]) + headers + struct.pack(f"<{len(offsets)}q", *offsets) + b"".join(c for own in chunks for c in own)


def encode_rgba(values: np.ndarray, use_half: bool) -> bytes:
    """Interleaved (lines, columns, 1, 3 or 4 components): small images are stored plainly, one component is alpha."""
    h, w, n = values.shape
    if n not in (1, 3, 4):
        raise ImageError(BAD_ARGUMENT, f"{n} components")
    names = ["A"] if n == 1 else list("RGBA"[:n])
    kind = HALF if use_half else FLOAT
    part = Part([Channel(c, kind) for c in names], w, h, NONE if w < 16 and h < 16 else ZIP)
    return encode_file([(part, {(0, 0): {c: to_stored(values[:, :, i].astype(np.float32), kind) for i, c in enumerate(names)}})])


# deep images --------------------------------------------------------------------------------------------------------


def decode_deep(data: bytes) -> tuple[Part, list[tuple[int, np.ndarray, dict[str, np.ndarray]]]]:
    """Lines of (y, inclusive running counts, samples by channel as float32)."""
    version, parts, at = parse_headers(data)
    if not version["non_image"] or version["multipart"] or version["tiled"] or parts[0].tile:
        raise ImageError(BAD_FEATURE, "no single deep scanline part")
    p = parts[0]
    tables, _ = chunk_tables(data, [p], at, False)
    out = []
    for o in tables[0]:
        try:
            y, packed, stored, full = struct.unpack_from("<iqqq", data, o)
        except struct.error as e:
            raise ImageError(BAD_DATA, "a deep line is cut short") from e
        o += 28
        if min(packed, stored, full) < 0 or o + packed + stored > len(data):
            raise ImageError(BAD_DATA, "a deep line is cut short")
        try:
            ends = np.frombuffer(_inflate(data[o : o + packed], 4 * p.width, p.compression), "<i4").astype(np.int64)
            body = _inflate(data[o + packed : o + packed + stored], full, p.compression)
        except blocks.CorruptBlock as e:
            raise ImageError(BAD_DATA, str(e)) from e
        n = int(ends[-1])
        if (np.diff(ends, prepend=0) < 0).any() or n * p.pixel_bytes() != full:
            raise ImageError(BAD_DATA, "sample counts that do not fit")
        samples, a = {}, 0
        for c in p.channels:
            k = DTYPES[c.pixel_type]
            samples[c.name] = as_numbers(np.frombuffer(body, k, n, a), c.pixel_type).astype(np.float32)
            a += n * k.itemsize
        out.append((y - p.data_window[1], ends, samples))
    return p, out


def _inflate(data: bytes, size: int, compression: int) -> bytes:
    if size == 0:
        return b""
    if compression == NONE:
        return data
    if compression in (ZIPS, ZIP):
        return blocks.zip_decode(data, size)
    if compression == RLE:
        return blocks.rle_decode(data, size)
    raise blocks.CorruptBlock("a codec that deep lines do not have")


def encode_deep(part: Part, lines: Sequence[tuple[np.ndarray, dict[str, np.ndarray]]]) -> bytes:
    """A deep scanline file from (samples of each pixel, values by channel) of every line."""
    listed = sorted(part.channels, key=lambda c: c.name.encode())
    part = Part(listed, part.width, part.height, part.compression, part.name or "deep", "deepscanline")
    part.chunk_count = part.height
    pack = {NONE: lambda b: b, RLE: blocks.rle_encode, ZIPS: blocks.zip_encode}[part.compression]
    head = MAGIC + bytes([VERSION, NON_IMAGE, 0, 0]) + header_bytes(part, False)
    chunks = []
    for y, (counts, samples) in enumerate(lines):
        ends = np.cumsum(counts).astype("<i4").tobytes()
        body = b"".join(to_stored(np.asarray(samples[c.name], np.float32), c.pixel_type).tobytes() for c in listed)
        a, b = pack(ends), pack(body) if body else b""
        chunks.append(struct.pack("<iqqq", y, len(a), len(b), len(body)) + a + b)
    at = len(head) + 8 * len(chunks)
    offsets = []
    for c in chunks:
        offsets.append(at)
        at += len(c)
    return head + struct.pack(f"<{len(offsets)}q", *offsets) + b"".join(chunks)
