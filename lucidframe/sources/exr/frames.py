"""Image files as DataFrames, and back.

Files come in through Spark's binary files, so any store that Spark reads will do and ``path`` filters prune files.
Headers, chunks and pixels are made by tasks.  ``spread`` deals a file's chunks out before they are decoded: worth its
shuffle of compressed bytes where files are few and large.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lucidframe.functions.layers import layer_of, name_in_layer
from lucidframe.functions.levels import level_size
from lucidframe.operators.grid import long_to_rgba
from lucidframe.session import bounded_batches
from lucidframe.sources.exr import format as f

PARTS = (
    "path string, part_id int, status int, error string, name string, type string, compression int, line_order int, tiled boolean, tile_size_x int, tile_size_y int, tile_level_mode int, tile_rounding_mode int, chunk_count int, "
    "data_window struct<min_x:int,min_y:int,max_x:int,max_y:int>, display_window struct<min_x:int,min_y:int,max_x:int,max_y:int>, pixel_aspect_ratio float, screen_window_center array<float>, screen_window_width float, "
    "channels array<struct<name:string,pixel_type:int,x_sampling:int,y_sampling:int,p_linear:int>>, attributes map<string,struct<type:string,value:binary,size:int>>"
)
CHUNKS = "path string, part_id int, chunk int, level_x int, level_y int, tile_x int, tile_y int, y int, header binary, data binary"
ROWS = "path string, part_id int, level_x int, level_y int, y int, x int, channel string, pixel_type int, values array<double>"
_LIST = pa.list_(pa.float64())
#: Bytes of files or chunks that a worker gets at once; a larger one goes alone.
BATCH_BYTES = 4 << 20


def narrow(df: DataFrame) -> DataFrame:
    """Path and content alone, in batches of bounded size."""
    return bounded_batches(df, None, BATCH_BYTES).select("path", "content")


def each_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Paths and contents, one file at a time: a list of a batch's contents would hold all its bytes again."""
    for batch in batches:
        for i, path in enumerate(batch.column(0).to_pylist()):
            yield path, batch.column(1)[i].as_py()


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def version_flags(df: DataFrame, content: str = "content") -> DataFrame:
    """Status and flags of each file from its first bytes, in built-in expressions."""
    head = F.col(content)
    byte = lambda i: F.conv(F.hex(F.substring(head, i, 1)), 16, 10).cast("int")
    status = F.when(head.isNull(), f.BAD_ARGUMENT).when(F.octet_length(head) < 8, f.BAD_DATA).when(F.hex(F.substring(head, 1, 4)) != f.MAGIC.hex().upper(), f.BAD_MAGIC).when(byte(5) != f.VERSION, f.BAD_VERSION).otherwise(f.OK)
    flag = lambda bit: F.when(F.col("status") == 0, byte(6).bitwiseAND(bit) != 0)
    return df.withColumn("status", status).withColumns({"tiled": flag(f.TILED), "long_name": flag(f.LONG_NAMES), "non_image": flag(f.NON_IMAGE), "multipart": flag(f.MULTIPART)})


def version_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) with the first eight bytes of each file alone, read by range; content is null where a file cannot
    be opened.  Spark lists no empty files.  For stores that Arrow reads; ``files`` serves any other."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        for batch in batches:
            heads = []
            for name in batch.column(0).to_pylist():
                try:
                    fs, place = pyarrow.fs.FileSystem.from_uri(name)
                    with fs.open_input_file(place) as file:
                        heads.append(file.read_at(8, 0))
                except OSError:
                    heads.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.binary())], ["path", "content"])

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")  # contents are not read
    return listed.mapInArrow(scan, "path string, content binary")


def file_versions(spark: SparkSession, path: str) -> DataFrame:
    """``version_flags`` of files by their first bytes, with the status numbers of files: short, or not to be opened."""
    found = version_flags(version_ranges(spark, path))
    status = F.when(F.col("content").isNull(), f.CANNOT_OPEN).when(F.octet_length("content") < 8, f.BAD_FILE).otherwise(F.col("status"))
    return found.withColumn("status", status).drop("content")


def is_image(content: Column) -> Column:
    """Whether bytes begin like a file of this format."""
    return F.coalesce((F.octet_length(content) >= 8) & (F.hex(F.substring(content, 1, 5)) == (f.MAGIC + bytes([f.VERSION])).hex().upper()), F.lit(False))


def _box(w):
    return None if w is None else dict(zip(("min_x", "min_y", "max_x", "max_y"), w))


def parts(df: DataFrame) -> DataFrame:
    """One row per part of (path, content) rows; a file that cannot be parsed has one row with its status."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in each_file([batch]):
                try:
                    _, found, _ = f.parse_headers(content)
                except f.ImageError as e:
                    rows.append({"path": path, "status": e.status, "error": str(e)})
                    continue
                for k, p in enumerate(found):
                    tile = p.tile or (None, None)
                    rows.append({
                        "path": path, "part_id": k, "status": 0, "name": p.name, "type": p.type, "compression": p.compression, "line_order": p.line_order, "tiled": p.tile is not None, "tile_size_x": tile[0], "tile_size_y": tile[1], "tile_level_mode": p.level_mode, "tile_rounding_mode": p.round_up, "chunk_count": p.n_chunks(),
                        "data_window": _box(p.data_window), "display_window": _box(p.display_window), "pixel_aspect_ratio": p.pixel_aspect_ratio, "screen_window_center": list(p.screen_window_center), "screen_window_width": p.screen_window_width,
                        "channels": [c.__dict__ for c in p.channels], "attributes": [(n, {"type": t, "value": v, "size": len(v)}) for n, (t, v) in p.attributes.items()],
                    })
            yield pa.RecordBatch.from_pylist(rows, schema=_parts_schema())

    return narrow(df).mapInArrow(scan, PARTS)


def _parts_schema() -> pa.Schema:
    box = pa.struct([(n, pa.int32()) for n in ("min_x", "min_y", "max_x", "max_y")])
    channel = pa.struct([("name", pa.string()), *[(n, pa.int32()) for n in ("pixel_type", "x_sampling", "y_sampling", "p_linear")]])
    attribute = pa.struct([("type", pa.string()), ("value", pa.binary()), ("size", pa.int32())])
    i, s = pa.int32(), pa.string()
    return pa.schema([
        ("path", s), ("part_id", i), ("status", i), ("error", s), ("name", s), ("type", s), ("compression", i), ("line_order", i), ("tiled", pa.bool_()), ("tile_size_x", i), ("tile_size_y", i), ("tile_level_mode", i), ("tile_rounding_mode", i), ("chunk_count", i),
        ("data_window", box), ("display_window", box), ("pixel_aspect_ratio", pa.float32()), ("screen_window_center", pa.list_(pa.float32())), ("screen_window_width", pa.float32()), ("channels", pa.list_(channel)), ("attributes", pa.map_(s, attribute)),
    ])


def channels(df: DataFrame) -> DataFrame:
    """One row per channel of parsed parts."""
    return df.where("status = 0").select("path", "part_id", F.posexplode("channels").alias("position", "c")).select("path", "part_id", "position", "c.*")


def layers(df: DataFrame) -> DataFrame:
    """Distinct layers of each part, with the first channel that has each."""
    return channels(df).withColumn("layer", layer_of(F.col("name"))).where("layer is not null").groupBy("path", "part_id", "layer").agg(F.min("position").alias("first_position"))


def chunks(df: DataFrame) -> DataFrame:
    """Independently decodable blocks, each with its part's header."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in each_file(batches):
            heads: dict[int, bytes] = {}
            rows: list[tuple] = []
            size = 0
            for p, c in f.read_chunks(content):
                heads.setdefault(c.part_id, f.header_bytes(p, True, sort=False))
                rows.append((path, c.part_id, c.index, c.level_x, c.level_y, c.tile_x, c.tile_y, c.y, heads[c.part_id], c.data))
                size += len(c.data)
                if size > BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        i = pa.int32()
        kinds = (pa.string(), i, i, i, i, i, i, i, pa.binary(), pa.binary())
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return narrow(df).mapInArrow(scan, CHUNKS)


def _chunk_of(r: dict) -> tuple[f.Part, f.Chunk]:
    """Part and chunk of a row of CHUNKS."""
    found, _ = f._attributes(r["header"], 0)
    part = f._part(found, any(n == "tiles" for n, _, _ in found), False, False)
    return part, f.Chunk(r["part_id"], r["chunk"], r["level_x"], r["level_y"], r["tile_x"], r["tile_y"], r["y"], r["data"])


def output_type(stored: int, requested: int | None) -> int:
    """The type that a channel is read as: its own, or float for a half; nothing else is converted."""
    if requested is None or requested == stored or (stored, requested) == (f.HALF, f.FLOAT):
        return stored if requested is None else requested
    raise f.ImageError(f.BAD_ARGUMENT, f"a channel of type {stored} cannot be read as {requested}")


def rows(df: DataFrame, names: Sequence[str] | None = None, spread: bool = False, requested: Mapping[str, int] | None = None) -> DataFrame:
    """Decoded lines of chunks: one row per line and channel, values packed.  Only ``names`` are unpacked if given.

    ``requested`` has the types that channels are read as, see ``output_type``; ``pixel_type`` tells them.  Values are
    doubles, which hold all three types exactly; ``typed`` gives a type's own column.
    """
    wanted = set(names) if names is not None else None
    types = dict(requested or {})
    if spread:
        df = df.repartition("path", "part_id", "chunk")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one chunk at a time
                r = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}
                yield _decoded(r["path"], *_chunk_of(r), wanted, types)

    return bounded_batches(df, None, BATCH_BYTES).mapInArrow(scan, ROWS)


def file_rows(df: DataFrame, names: Sequence[str] | None = None, requested: Mapping[str, int] | None = None) -> DataFrame:
    """``rows`` of the chunks of (path, content) files, each decoded by the worker that cuts it out of its file.

    Every Python step of a stage has a worker of its own on each core, so two steps would hold a second one there.
    """
    wanted = set(names) if names is not None else None
    types = dict(requested or {})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in each_file(batches):
            for part, c in f.read_chunks(content):
                yield _decoded(path, part, c, wanted, types)

    return narrow(df).mapInArrow(scan, ROWS)


def _decoded(path: str, part: f.Part, c: f.Chunk, wanted: set[str] | None, types: Mapping[str, int]) -> pa.RecordBatch:
    """A chunk's lines as a batch of ROWS."""
    x, _, _, _ = f.chunk_shape(part, c)
    out = []
    planes = f.decode_chunk(part, c)
    for ch in part.channels:
        if wanted is None or ch.name in wanted:
            y, plane = planes[ch.name]
            kind, numbers = output_type(ch.pixel_type, types.get(ch.name)), f.as_numbers(plane, ch.pixel_type)
            out += [(path, c.part_id, c.level_x, c.level_y, y + j, x, ch.name, kind, line) for j, line in enumerate(numbers)]
    i = pa.int32()
    kinds = (pa.string(), i, i, i, i, i, pa.string(), i, _LIST)
    return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], [n.split()[0] for n in ROWS.split(", ")])


def typed(samples: DataFrame, pixel_type: int, value: str = "value") -> DataFrame:
    """Samples of one pixel type with a column of that type: long for unsigned 32-bit numbers, float for the others."""
    return samples.withColumn(value, F.col(value).cast("long" if pixel_type == f.UINT else "float"))


def select_rgba(names: Sequence[str], layer: str | None) -> dict[str, str]:
    """Which channels are R, G, B and A of a layer, from its first four channels; one channel alone is all of them.

    A layer that is absent is an error, and so is one of several channels that lacks R, G or B.
    """
    inside = [(n, own) for n in names if (own := name_in_layer(n, layer)) is not None]
    if not inside:
        raise f.ImageError(f.NO_LAYER, f"no layer {layer}" if layer else "no channel outside of layers")
    if len(inside) == 1:
        return dict.fromkeys("RGBA", inside[0][0])
    picked = {own: n for n, own in inside[:4] if own in ("R", "G", "B", "A")}
    if missing := [c for c in "RGB" if c not in picked]:
        raise f.ImageError(f.BAD_DATA, f"channel {missing[0]} not found")
    return picked


RGBA_ROWS = "path string, status int, error string, y int, x int, pixels array<struct<R:float,G:float,B:float,A:float>>"


def layer_rows(df: DataFrame, layer: str | None = None) -> DataFrame:
    """Lines of (path, content) files as packed RGBA pixels of a layer, each chunk by itself, so nothing is shuffled.

    A file that cannot be read so has one row with its status: an absent layer, a missing channel, several parts, deep
    pixels, or damage.
    """
    kind = pa.list_(pa.struct([(c, pa.float32()) for c in "RGBA"]))
    names = [c.split()[0] for c in RGBA_ROWS.split(", ")[:5]] + ["pixels"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), kind)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in each_file(batches):
            try:
                version, found, _ = f.parse_headers(content)
                if version["multipart"] or version["non_image"]:
                    raise f.ImageError(f.BAD_DATA, "several parts or deep pixels")
                picked = select_rgba([c.name for c in found[0].channels], layer)
                stored = {c.name: c.pixel_type for c in found[0].channels}
                for part, c in f.read_chunks(content):
                    if c.level_x or c.level_y:
                        continue
                    x, y, w, lines = f.chunk_shape(part, c)
                    planes = f.decode_chunk(part, c)
                    made = {k: f.as_numbers(planes[n][1], stored[n]).astype(np.float32) for k, n in picked.items()}
                    made.setdefault("A", np.ones((lines, w), np.float32))
                    if any(m.shape != (lines, w) for m in made.values()):
                        raise f.ImageError(f.BAD_FEATURE, "subsampled channels of a layer")
                    flat = pa.StructArray.from_arrays([pa.array(made[k].ravel()) for k in "RGBA"], list("RGBA"))
                    packed = pa.ListArray.from_arrays(pa.array(np.arange(lines + 1, dtype=np.int32) * w), flat)
                    i32 = lambda v, n=lines: pa.array(np.full(n, v, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * lines), i32(0), pa.nulls(lines, pa.string()), pa.array(np.arange(y, y + lines, dtype=np.int32)), i32(x), packed.cast(kind)], names)
            except f.ImageError as e:
                yield batch_of([(path, e.status, str(e), None, None, None)])

    return narrow(df).mapInArrow(scan, RGBA_ROWS)


def load_rgba(df: DataFrame, layer: str | None = None) -> DataFrame:
    """Wide pixels (path, status, y, x, R, G, B, A) of a layer of single-part files; see ``layer_rows``."""
    lines = layer_rows(df, layer)
    each = lines.select("path", "status", "y", "x", F.posexplode_outer("pixels").alias("i", "p"))
    return each.select("path", "status", "y", (F.col("x") + F.col("i")).alias("x"), "p.*")


def pixels(packed: DataFrame) -> DataFrame:
    """One row per sample."""
    return packed.select("path", "part_id", "level_x", "level_y", "y", "channel", "x", F.posexplode("values").alias("i", "value")).select("path", "part_id", "level_x", "level_y", "y", (F.col("x") + F.col("i")).alias("x"), "channel", "value")


def read(spark: SparkSession, path: str, mode: str = "pixels", names: Sequence[str] | None = None, spread: bool = False, layer: str | None = None, requested: Mapping[str, int] | None = None) -> DataFrame:
    """``mode``: version, head (the same by range), parts, channels, layers, chunks, rows, pixels, rgba, layer (RGBA of ``layer``) or deep."""
    found = files(spark, path)
    if mode == "head":
        return file_versions(spark, path)
    if mode == "layer":
        return load_rgba(found, layer)
    if mode == "version":
        return version_flags(found).drop("content")
    if mode in ("parts", "channels", "layers"):
        return {"parts": lambda p: p, "channels": channels, "layers": layers}[mode](parts(found))
    if mode == "deep":
        return deep(found)
    if mode == "chunks":
        return chunks(found).drop("header")
    types = requested if mode != "rgba" else None
    lines = rows(chunks(found), names, True, types) if spread else file_rows(found, names, types)
    if mode == "rgba":
        return rgba(pixels(lines).where("level_x = 0 and level_y = 0"))
    return lines if mode == "rows" else pixels(lines)


def rgba(samples: DataFrame) -> DataFrame:
    """Wide pixels of the first level: alpha defaults to 1, a single channel fills all four."""
    return long_to_rgba(samples, ["path", "part_id", "y", "x"])


def deep(df: DataFrame) -> DataFrame:
    """Deep pixels: (path, y, x, samples), each sample a map of its channels."""
    schema = "path string, y int, x int, samples array<map<string,float>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.map_(pa.string(), pa.float32()))
        for path, content in each_file(batches):
            _, lines = f.decode_deep(content)
            for y, ends, samples in lines:
                starts = np.concatenate(([0], ends[:-1]))
                values = [[[(n, float(v[i])) for n, v in samples.items()] for i in range(a, b)] for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([y] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(values, kind)], ["path", "y", "x", "samples"])

    return narrow(df).mapInArrow(scan, schema)


def _placed(group: pa.Table, part: f.Part, width: int, height: int, x0: int = 0, y0: int = 0) -> dict[str, np.ndarray]:
    """Planes of a part's channels in stored types from long samples; missing ones are 0."""
    y, x, v = (group[c].to_numpy() for c in ("y", "x", "value"))
    if len(y) and not (0 <= y.min() - y0 and y.max() - y0 < height and 0 <= x.min() - x0 and x.max() - x0 < width):
        raise f.ImageError(f.BAD_ARGUMENT, "a sample outside of its level")
    name = group["channel"].combine_chunks().dictionary_encode()
    code, listed = name.indices.to_numpy(), name.dictionary.to_pylist()
    planes = {}
    for c in part.channels:
        plane = np.zeros((height, width), np.float64)
        if c.name in listed:
            at = code == listed.index(c.name)
            plane[y[at] - y0, x[at] - x0] = v[at]
        planes[c.name] = f.to_stored(plane.astype(np.float32) if c.pixel_type != f.UINT else plane, c.pixel_type)
    return planes


_SAMPLES = ("path", "part_id int", "level_x int", "level_y int", "y int", "x int", "channel", "value double")


def _long(samples: DataFrame) -> DataFrame:
    for level in ("level_x", "level_y"):
        if level not in samples.columns:
            samples = samples.withColumn(level, F.lit(0))
    return samples.select(*[F.col(c.split()[0]).cast(c.split()[1]) if " " in c else c for c in _SAMPLES])


def encode(
    samples: DataFrame,
    compression: int = f.ZIP,
    pixel_type: int | Mapping[str, int] = f.FLOAT,
    tile: tuple[int, int] | None = None,
    spread: bool = False,
    level_mode: int = 0,
    round_up: int = 0,
    attributes: Mapping[str, tuple[str, bytes]] | None = None,
) -> DataFrame:
    """Files (path, content) from long samples (path, part_id, y, x, channel, value).

    Missing samples are 0.  With several part ids, a file has as many parts, named after them.  ``pixel_type`` is that of
    all channels, or has those of some, the others being floats.  Tiled files have more levels with ``level_mode``, whose
    samples are told by the columns level_x and level_y; the first level gives the size.  ``attributes`` (type, value) go
    into every header.  One task makes a file; with ``spread``, for large ones, the chunks are made by tasks of their own
    and only their bytes meet in one.
    """
    given = dict(attributes or {})

    def part_of(k: int, w: int | None, h: int | None, names: list[str]) -> f.Part:
        if w is None or h is None:
            raise f.ImageError(f.BAD_ARGUMENT, "a part without samples of its first level")
        kinds = pixel_type if isinstance(pixel_type, Mapping) else dict.fromkeys(names, pixel_type)
        return f.Part([f.Channel(c, kinds.get(c, f.FLOAT)) for c in names], w, h, compression, f"part{k}", tile=tile, level_mode=level_mode, round_up=round_up, attributes=given)

    if spread:
        return _encode_spread(_long(samples), compression, tile, round_up, part_of)

    def make(key: tuple, group: pa.Table) -> pa.Table:
        made = []
        for k in sorted(set(group["part_id"].to_pylist())):
            own = group.filter(pa.compute.equal(group["part_id"], k))
            level = np.stack([own[c].to_numpy() for c in ("level_x", "level_y")])
            first = own.filter(pa.array((level == 0).all(axis=0)))
            w, h = (None if m is None else m + 1 for m in (pa.compute.max(first[c]).as_py() for c in ("x", "y")))
            part = part_of(k, w, h, sorted(pa.compute.unique(own["channel"]).to_pylist()))
            if {*zip(*level.tolist())} - {(x, y) for x, y, _, _ in part.levels()}:
                raise f.ImageError(f.BAD_ARGUMENT, "a sample of a level that its part does not have")
            made.append((part, {(x, y): _placed(own.filter(pa.array((level[0] == x) & (level[1] == y))), part, w, h) for x, y, w, h in part.levels()}))
        return pa.table({"path": [key[0].as_py()], "content": pa.array([f.encode_file(made)], pa.binary())})

    return _long(samples).groupBy("path").applyInArrow(make, "path string, content binary")


def _encode_spread(samples: DataFrame, compression: int, tile: tuple[int, int] | None, round_up: int, part_of: Callable[[int, int | None, int | None, list[str]], f.Part]) -> DataFrame:
    """Chunks by (path, part, level, chunk), then files by path; a chunk without samples is made with its file."""
    top = lambda c: F.max(F.when((F.col("level_x") == 0) & (F.col("level_y") == 0), F.col(c) + 1))
    shapes = samples.groupBy("path", "part_id").agg(top("x").alias("w"), top("y").alias("h"), F.sort_array(F.collect_set("channel")).alias("names"))
    if tile:
        across = F.ceil(level_size(F.col("w"), F.col("level_x"), F.lit(round_up)) / tile[0]).cast("int")
        chunk = F.floor(F.col("y") / tile[1]).cast("int") * across + F.floor(F.col("x") / tile[0]).cast("int")
    else:
        chunk = F.floor(F.col("y") / f.LINES[compression]).cast("int")
    placed = samples.join(shapes, ["path", "part_id"]).withColumn("chunk", F.coalesce(chunk, F.lit(0)))

    def numbered(part: f.Part) -> dict[tuple[int, int, int], f.Chunk]:
        """Chunks by level and number in it."""
        out: dict[tuple[int, int, int], f.Chunk] = {}
        level, n = None, 0
        for c in f.chunk_list(part):
            n = n + 1 if (c.level_x, c.level_y) == level else 0
            level = c.level_x, c.level_y
            out[*level, n] = c
        return out

    def one(key: tuple, group: pa.Table) -> pa.Table:
        first = group.slice(0, 1).to_pylist()[0]
        part = part_of(*(first[c] for c in ("part_id", "w", "h", "names")))
        found = numbered(part).get(tuple(first[c] for c in ("level_x", "level_y", "chunk")))
        if found is None:
            raise f.ImageError(f.BAD_ARGUMENT, "a sample outside of its part")
        x, y, w, h = f.chunk_shape(part, found)
        data = f.encode_chunk(part, _placed(group, part, w, h, x, y), h, w, y)
        kinds = {"path": pa.string(), "part_id": pa.int32(), "w": pa.int32(), "h": pa.int32(), "names": pa.list_(pa.string()), "level_x": pa.int32(), "level_y": pa.int32(), "chunk": pa.int32()}
        return pa.table({c: pa.array([first[c]], t) for c, t in kinds.items()} | {"data": pa.array([data], pa.binary())})

    coded = placed.groupBy("path", "part_id", "level_x", "level_y", "chunk").applyInArrow(one, "path string, part_id int, w int, h int, names array<string>, level_x int, level_y int, chunk int, data binary")

    def whole(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        ids = sorted({r["part_id"] for r in rows})
        parts, chunks = [], []
        for place, k in enumerate(ids):
            own = {(r["level_x"], r["level_y"], r["chunk"]): r for r in rows if r["part_id"] == k}
            first = next(iter(own.values()))
            part, written = part_of(k, first["w"], first["h"], first["names"]), []
            for at, c in numbered(part).items():
                _, y, w, h = f.chunk_shape(part, c)
                data = own[at]["data"] if at in own else f.encode_chunk(part, {n.name: np.zeros((h, w), f.DTYPES[n.pixel_type]) for n in part.channels}, h, w, y)
                written.append(f.chunk_head(part, c, place if len(ids) > 1 else None, len(data)) + data)
            parts.append(part)
            chunks.append(written)
        return pa.table({"path": [rows[0]["path"]], "content": pa.array([f.join_file(parts, chunks)], pa.binary())})

    return coded.groupBy("path").applyInArrow(whole, "path string, content binary")


def encode_rgba(pixels: DataFrame, use_half: bool = False, channels: Sequence[str] = ("R", "G", "B", "A")) -> DataFrame:
    """The simple save: files (path, content) from wide pixels (path, y, x, channels) of one, three or four components."""
    names = list(channels)

    def make(key: tuple, group: pa.Table) -> pa.Table:
        y, x = (group[c].to_numpy() for c in ("y", "x"))
        values = np.zeros((int(y.max()) + 1, int(x.max()) + 1, len(names)), np.float32)
        for i, c in enumerate(names):
            values[y, x, i] = group[c].to_numpy()
        return pa.table({"path": [key[0].as_py()], "content": pa.array([f.encode_rgba(values, use_half)], pa.binary())})

    if len(names) not in (1, 3, 4):
        raise f.ImageError(f.BAD_ARGUMENT, f"{len(names)} components")
    return pixels.select("path", F.col("y").cast("int"), F.col("x").cast("int"), *[F.col(c).cast("float") for c in names]).groupBy("path").applyInArrow(make, "path string, content binary")


def relative_name(path: str) -> str:
    """Where a file goes below a folder: its path without scheme and host, so that equal names in different folders stay apart."""
    name = path.split("://", 1)[-1] if "://" in path else path.removeprefix("file:")
    steps = [x for x in name.split("/") if x not in ("", ".")]
    if not steps or ".." in steps:
        raise f.ImageError(f.CANNOT_WRITE, f"no name for a file: {path}")
    return "/".join(steps)


def write_file(folder: str, path: str, content: bytes) -> str:
    """Writes a file below a folder in one step; gives its place in the store."""
    import uuid

    import pyarrow.fs

    fs, root = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    name = f"{root}/{relative_name(path)}"
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(content)
    fs.move(part, name)
    return name


def save_files(df: DataFrame, folder: str) -> DataFrame:
    """Writes each (path, content) row below a folder that all executors reach; gives (path, bytes written).

    A file keeps the folders of its path, see ``relative_name``.  It appears under its name when it is whole, so a task
    that runs again does no harm.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in each_file(batches):
            yield pa.RecordBatch.from_arrays([pa.array([write_file(folder, path, content)]), pa.array([len(content)], pa.int64())], ["path", "size"])

    return narrow(df).mapInArrow(write, "path string, size long")


def is_complete(content: bytes) -> bool:
    try:
        for p, c in f.read_chunks(content):
            f.decode_chunk(p, c)
    except (f.ImageError, struct.error):
        return False
    return True
