"""Image files: round trips over codecs, types, tiles and levels; damage; the data source and streams."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidframe.sources import images
from lucidframe.sources.exr import datasource, format as f, frames


def planes(part, r):
    return {(lx, ly): {c.name: (r.normal(size=(b, a)).astype("<f4") if c.pixel_type == f.FLOAT else r.integers(0, 2000, (b, a)).astype(f.DTYPES[c.pixel_type])) for c in part.channels} for lx, ly, a, b in part.levels()}


def same(a, b):
    return list(a) == list(b) and all((a[k][c] == b[k][c]).all() for k in a for c in a[k])


@pytest.mark.parametrize("compression", range(5))
@pytest.mark.parametrize(("tile", "mode", "up"), [(None, 0, 0), ((16, 16), 0, 0), ((8, 8), 1, 0), ((8, 16), 1, 1), ((8, 8), 2, 0), ((16, 8), 2, 1)])
def test_round_trip(compression, tile, mode, up):
    part = f.Part([f.Channel("B", f.UINT), f.Channel("A", f.HALF), f.Channel("R", f.FLOAT)], 37, 21, compression, tile=tile, level_mode=mode, round_up=up)
    levels = planes(part, np.random.default_rng(1))
    data = f.encode_file([(part, levels)])
    assert same(f.decode_planes(data), levels)
    _, _, at = f.parse_headers(data)
    assert same(f.decode_planes(data[:at] + b"\0" * 8 + data[at + 8 :]), levels)  # a damaged table is rebuilt


def test_parts_and_names():
    r = np.random.default_rng(2)
    a, b = f.Part([f.Channel("R")], 10, 5, f.PIZ, name="a"), f.Part([f.Channel("Z", f.UINT)], 40, 33, f.ZIP, name="b", tile=(16, 16))
    la, lb = planes(a, r), planes(b, r)
    data = f.encode_file([(a, la), (b, lb)])
    assert same(f.decode_planes(data, 0), la) and same(f.decode_planes(data, 1), lb)
    with pytest.raises(f.ImageError):
        f.encode_file([(a, la), (a, la)])
    _, _, at = f.parse_headers(data)
    with pytest.raises(f.ImageError):  # several parts: no rebuilding
        f.decode_planes(data[:at] + b"\0" * 8 + data[at + 8 :])


def test_raw_fallback_and_zeros():
    part = f.Part([f.Channel(c) for c in "BGR"], 1, 1, f.ZIP)
    levels = planes(part, np.random.default_rng(3))
    assert same(f.decode_planes(f.encode_file([(part, levels)])), levels)
    zeros = f.Part([f.Channel("Y", f.HALF)], 32, 32, f.PIZ)
    assert not f.decode_planes(f.encode_file([(zeros, {(0, 0): {"Y": np.zeros((32, 32), "<u2")}})]))[0, 0]["Y"].any()
    ramp = np.zeros((35, 1), np.float32)
    ramp[-1] = 1
    line = f.Part([f.Channel("Y")], 1, 35, f.PIZ)
    assert (f.decode_planes(f.encode_file([(line, {(0, 0): {"Y": ramp}})]))[0, 0]["Y"] == ramp).all()


def test_simple_save():
    v = np.random.default_rng(4).random((20, 20, 4)).astype(np.float32)
    _, parts, _ = f.parse_headers(f.encode_rgba(v, False))
    assert parts[0].compression == f.ZIP and [c.name for c in parts[0].channels] == list("ABGR")
    _, parts, _ = f.parse_headers(f.encode_rgba(v[:4, :4, :1], True))
    assert parts[0].compression == f.NONE and parts[0].channels == [f.Channel("A", f.HALF)]
    with pytest.raises(f.ImageError):
        f.encode_rgba(v[:, :, :2], False)


@pytest.mark.parametrize(("data", "status"), [(None, -3), (b"", -4), (b"\x76\x2f\x31\x01", -4), (b"12345678", -1), (f.MAGIC + b"\3\0\0\0", -2), (f.MAGIC + b"\2\0\0\0\0", -9)])
def test_status(data, status):
    with pytest.raises(f.ImageError) as e:
        f.parse_headers(data)
    assert e.value.status == status


def deep_file():
    r = np.random.default_rng(5)
    part = f.Part([f.Channel("Z"), f.Channel("A", f.HALF)], 8, 4, f.ZIPS)
    lines = []
    for _ in range(4):
        n = r.integers(0, 6, 8)
        lines.append((n, {"Z": r.normal(size=n.sum()).astype("f4"), "A": r.integers(0, 9, n.sum()).astype("f4")}))
    return lines, f.encode_deep(part, lines)


def test_deep():
    lines, data = deep_file()
    _, got = f.decode_deep(data)
    for (n, s), (_, ends, t) in zip(lines, got):
        assert (np.cumsum(n) == ends).all() and (s["Z"] == t["Z"]).all() and (s["A"] == t["A"]).all()


def test_damage_is_an_image_error():
    part = f.Part([f.Channel("R")], 40, 33, f.PIZ)
    whole = f.encode_file([(part, planes(part, np.random.default_rng(6)))])
    for data, read in ((whole, f.decode_planes), (deep_file()[1], f.decode_deep)):
        for cut in range(0, len(data), 13):
            with pytest.raises(f.ImageError):
                read(data[:cut])
        for i in range(0, len(data), 17):
            bad = bytearray(data)
            bad[i] ^= 0xFF
            try:
                read(bytes(bad))
            except f.ImageError:
                pass


def test_frames(spark, tmp_path):
    samples = [("a.exr", p, y, x, c, float(y * 10 + x + p)) for p in (0, 1) for y in range(20) for x in range(7) for c in ("L.R", "L.G", "Z")]
    files = frames.encode(spark.createDataFrame(samples, "path string, part_id int, y int, x int, channel string, value double"), f.PIZ)
    assert frames.save_files(files, str(tmp_path)).count() == 1
    got = {(r.part_id, r.y, r.x, r.channel): r.value for r in frames.read(spark, str(tmp_path)).collect()}
    assert got == {s[1:5]: s[5] for s in samples}
    assert [r.layer for r in frames.read(spark, str(tmp_path), "layers").collect()] == ["L", "L"]
    assert frames.read(spark, str(tmp_path), "rows", names=["Z"], spread=True).select("channel").distinct().collect()[0].channel == "Z"
    datasource.register(spark)
    source = spark.read.format("exr").option("channels", "Z").load(str(tmp_path))
    few = spark.read.format("exr").option("channels", "Z").option("part_id", "1").option("y", "5:6").load(str(tmp_path)).where("y >= 5 and y < 7")
    assert few.count() == 14 and few.agg(F.min("y")).first()[0] == 5
    assert source.count() == 2 * 20 * 7


def source_values(path):
    reader = datasource.ExrReader({"path": str(path)})
    batches = [b.to_pydict() for group in reader.partitions() for b in reader.read(group)]
    return {(p, c, y, x): v for b in batches for p, c, y, x, v in zip(b["part_id"], b["channel"], b["y"], b["x"], b["value"])}


@pytest.mark.parametrize("tile", [None, (16, 16)])
def test_source_of_files_beyond_the_first_read(tmp_path, monkeypatch, tile):
    """Files of more than 64 first reads, of one part and of two, and one part with a damaged table."""
    monkeypatch.setattr(datasource, "HEAD", 256)
    r = np.random.default_rng(8)
    a, b = (f.Part([f.Channel("R")], 70, 90, f.ZIPS, name=n, tile=tile) for n in "ab")
    la, lb = planes(a, r), planes(b, r)
    one, two = f.encode_file([(a, la)]), f.encode_file([(a, la), (b, lb)])
    assert len(one) > 64 * 256
    _, _, at = f.parse_headers(one)
    want = {(k, "R", y, x): float(v) for k, levels in enumerate((la, lb)) for (y, x), v in np.ndenumerate(levels[0, 0]["R"])}
    first = {k: v for k, v in want.items() if k[0] == 0}
    small = f.encode_file([(f.Part([f.Channel("R")], 20, 90, f.ZIPS, tile=tile), {(0, 0): {"R": la[0, 0]["R"][:, :20]}})])  # below the 64 first reads
    _, _, at_small = f.parse_headers(small)
    assert len(small) < 64 * 256
    cases = {"one": (one, first), "two": (two, want), "rebuilt": (one[:at] + b"\0" * 8 + one[at + 8 :], first), "small": (small[:at_small] + b"\0" * 8 + small[at_small + 8 :], {k: v for k, v in first.items() if k[3] < 20})}
    for name, (data, values) in cases.items():
        (tmp_path / f"{name}.exr").write_bytes(data)
        assert source_values(tmp_path / f"{name}.exr") == values, name


def test_source_reads_flat_parts_beside_deep_ones(tmp_path):
    r = np.random.default_rng(9)
    flat, deep = f.Part([f.Channel("R")], 9, 7, f.ZIPS, name="flat"), f.Part([f.Channel("Z")], 9, 7, f.ZIPS, name="deep", type="deepscanline")
    flat_levels = planes(flat, r)
    data = bytearray(f.encode_file([(deep, planes(deep, r)), (flat, flat_levels)]))
    data[5] |= f.NON_IMAGE
    (tmp_path / "a.exr").write_bytes(data)
    (tmp_path / "b.exr").write_bytes(deep_file()[1])
    assert source_values(tmp_path) == {(1, "R", y, x): float(v) for (y, x), v in np.ndenumerate(flat_levels[0, 0]["R"])}


def test_other_images():
    r = np.random.default_rng(7)
    for n in (1, 3, 4):
        x = r.integers(0, 256, (5, 7, n)).astype(np.uint8)
        assert (images.read_png(images.write_png(x)) == x).all()
    for n in (1, 2, 3, 4):
        t = r.normal(size=(3, 4, n)).astype("f4")
        assert (images.read_float_tiff(images.write_float_tiff(t)) == t).all()
    g = np.abs(r.normal(size=(6, 9, 3))).astype("f4")
    once = images.read_rgbe(images.write_rgbe(g))
    assert np.abs(once - g).max() <= g.max() / 100 and (images.read_rgbe(images.write_rgbe(once)) == once).all()
    runs = b"#?RADIANCE\n\n-Y 1 +X 8\n" + b"\2\2\0\x08" + b"".join(bytes([128 + 8, v]) for v in (128, 64, 32, 129))
    assert np.allclose(images.read_rgbe(runs)[0, 0], [1, 0.5, 0.25])
    assert struct.unpack("<I", images.write_float_tiff(t)[4:8])[0] > 8


# subsampled channels, layers, requested types, writing ----------------------------------------------------------------


@pytest.mark.parametrize("compression", range(5))
@pytest.mark.parametrize(("x", "y", "height"), [(2, 2, 37), (4, 1, 20), (1, 3, 70)])
def test_subsampled_channels(tmp_path, compression, x, y, height):
    """Luminance and chroma: a sample stands for the pixels up to the next one."""
    r = np.random.default_rng(11)
    part = f.Part([f.Channel("BY", f.HALF, x, y), f.Channel("RY", f.FLOAT, x, y), f.Channel("Y", f.HALF)], 23, height, compression)
    levels = {(0, 0): {"BY": r.integers(0, 900, (height, 23)).astype("<u2"), "RY": r.normal(size=(height, 23)).astype("<f4"), "Y": np.cumsum(r.integers(0, 3, (height, 23)), axis=1).astype("<u2")}}
    data = f.encode_file([(part, levels)])
    _, parts, _ = f.parse_headers(data)
    assert [(c.x_sampling, c.y_sampling) for c in parts[0].channels] == [(x, y), (x, y), (1, 1)]
    got = f.decode_planes(data)[0, 0]
    at = np.ix_(np.arange(height) // y * y, np.arange(23) // x * x)
    for name in ("BY", "RY"):
        assert (got[name] == levels[0, 0][name][at]).all(), name
    assert (got["Y"] == levels[0, 0]["Y"]).all()
    (tmp_path / "a.exr").write_bytes(data)
    values = source_values(tmp_path)
    assert len(values) == 3 * 23 * height and values[0, "RY", height - 1, 22] == got["RY"][-1, -1]


def test_headers_that_do_not_go_together():
    part = f.Part([f.Channel("Y")], 8, 8, f.ZIP, name="a", type="x")
    whole = f.encode_file([(part, {(0, 0): {"Y": np.zeros((8, 8), "<f4")}})])
    for attributes, status in (({"type": ("string", b"tiledimage")}, f.BAD_HEADER), ({"type": ("string", b"scanlineimage")}, f.OK), ({"type": ("string", b"deeptile")}, f.BAD_HEADER), ({"type": ("string", b"other")}, f.OK)):
        data = f.MAGIC + bytes([2, 0, 0, 0]) + f.header_bytes(f.Part(part.channels, 8, 8, attributes=attributes), False)
        if status:
            with pytest.raises(f.ImageError) as e:
                f.parse_headers(data)
            assert e.value.status == status
        else:
            f.parse_headers(data)
    odd = f.header_bytes(f.Part([f.Channel("Y", f.HALF, 0, 1)], 8, 8), False)
    with pytest.raises(f.ImageError):
        f.parse_headers(f.MAGIC + bytes([2, 0, 0, 0]) + odd)
    many = f.Part(part.channels, 8, 8, attributes={f"a{i}": ("int", b"\1\0\0\0") for i in range(300)})
    _, parts, _ = f.parse_headers(f.encode_file([(many, {(0, 0): {"Y": np.zeros((8, 8), "<f4")}})]))
    assert len(parts[0].attributes) == 300 and whole


def test_layers_on_load(spark):
    names = ["A", "L1.A", "L1.B", "L1.G", "L1.R", "L2.Y", "L3.R", "L3.X", "many.A", "many.B", "many.C", "many.D", "many.R"]
    r = np.random.default_rng(12)
    levels = {(0, 0): {n: r.normal(size=(20, 9)).astype("<f4") for n in names}}
    files = {"tiled": f.Part([f.Channel(n) for n in names], 9, 20, f.ZIP, tile=(4, 8)), "lines": f.Part([f.Channel(n) for n in names], 9, 20, f.PIZ)}
    rows = [(n, f.encode_file([(p, levels)])) for n, p in files.items()]
    two = f.Part([f.Channel("Y")], 2, 2, f.ZIP, name="x")
    rows += [("bad", b"nothing else"), ("two", f.encode_file([(two, {(0, 0): {"Y": np.zeros((2, 2), "<f4")}}), (f.Part(two.channels, 2, 2, f.ZIP, name="y"), {(0, 0): {"Y": np.zeros((2, 2), "<f4")}})]))]
    df = spark.createDataFrame(rows, "path string, content binary")
    for layer, want in (("L1", {c: f"L1.{c}" for c in "RGBA"}), ("L2", dict.fromkeys("RGBA", "L2.Y")), (None, dict.fromkeys("RGBA", "A"))):
        got = {(x.path, x.y, x.x): x for x in frames.load_rgba(df, layer).collect()}
        assert got["bad", None, None].status == f.BAD_MAGIC and got["two", None, None].status == f.BAD_DATA
        for path in files:
            assert all(got[path, y, x][c] == levels[0, 0][n][y, x] for y in range(20) for x in range(9) for c, n in want.items())
        assert len(got) == 2 * 180 + 2
    for layer, status in (("absent", f.NO_LAYER), ("L3", f.BAD_DATA), ("many", f.BAD_DATA)):  # R of "many" is its fifth channel
        assert {x.status for x in frames.load_rgba(df, layer).where("path in ('tiled', 'lines')").collect()} == {status}
    opaque = f.encode_file([(f.Part([f.Channel(c) for c in "BGR"], 3, 2, f.ZIP), {(0, 0): {c: np.ones((2, 3), "<f4") for c in "BGR"}})])
    assert {x.A for x in frames.load_rgba(spark.createDataFrame([("o", opaque)], "path string, content binary")).collect()} == {1.0}


def test_requested_types(spark):
    part = f.Part([f.Channel("H", f.HALF), f.Channel("U", f.UINT)], 3, 2, f.ZIP)
    data = f.encode_file([(part, {(0, 0): {"H": np.full((2, 3), 0x3C00, "<u2"), "U": np.full((2, 3), 4_000_000_000, "<u4")}})])
    blocks = frames.chunks(spark.createDataFrame([("a", data)], "path string, content binary"))
    assert {(x.channel, x.pixel_type) for x in frames.rows(blocks, requested={"H": f.FLOAT}).collect()} == {("H", f.FLOAT), ("U", f.UINT)}
    exact = frames.typed(frames.pixels(frames.rows(blocks, ["U"])), f.UINT)
    assert dict(exact.dtypes)["value"] == "bigint" and exact.first().value == 4_000_000_000
    for types in ({"U": f.FLOAT}, {"H": f.UINT}):
        with pytest.raises(Exception, match="cannot be read as"):
            frames.rows(blocks, requested=types).collect()


@pytest.mark.parametrize("tile", [None, (5, 4)])
def test_encode_by_chunks(spark, tile):
    samples = [(path, p, y, x, c, float(y * 10 + x + p)) for path in ("a", "b") for p in (0, 1) for y in range(40) for x in range(7 + p) for c in ("R", "G") if not 8 <= y < 32 or (p, path) != (0, "a") or y == 31]
    df = spark.createDataFrame(samples, "path string, part_id int, y int, x int, channel string, value double").repartition(3)
    for compression in (f.ZIP, f.PIZ, f.NONE):
        one, many = ({r.path: bytes(r.content) for r in frames.encode(df, compression, f.HALF, tile, spread=s).collect()} for s in (False, True))
        assert one == many and set(one) == {"a", "b"}


@pytest.mark.parametrize("mode,up", [(1, 0), (1, 1), (2, 0), (2, 1)])
def test_encode_levels_types_and_attributes(spark, mode, up):
    shape = f.Part([], 11, 5, tile=(4, 3), level_mode=mode, round_up=up)
    samples = [("a", 0, lx, ly, y, x, c, float(200 * lx + 40 * ly + 10 * y + x)) for lx, ly, w, h in shape.levels() for y in range(h) for x in range(w) for c in ("H", "U", "F") if c != "F" or lx != 1]
    df = spark.createDataFrame(samples, "path string, part_id int, level_x int, level_y int, y int, x int, channel string, value double").repartition(3)
    options = {"compression": f.ZIP, "pixel_type": {"H": f.HALF, "U": f.UINT}, "tile": (4, 3), "level_mode": mode, "round_up": up, "attributes": {"owner": ("string", b"me")}}
    one, many = (frames.encode(df, spread=s, **options) for s in (False, True))
    data = bytes(one.first().content)
    assert data == bytes(many.first().content)
    _, parts, _ = f.parse_headers(data)
    assert {c.name: c.pixel_type for c in parts[0].channels} == {"F": f.FLOAT, "H": f.HALF, "U": f.UINT} and parts[0].attributes["owner"] == ("string", b"me")
    got = {(r.level_x, r.level_y, r.y, r.x, r.channel): r.value for r in frames.pixels(frames.rows(frames.chunks(one))).collect()}
    wanted = {(lx, ly, y, x, c): 0.0 for lx, ly, w, h in shape.levels() for y in range(h) for x in range(w) for c in ("H", "U", "F")} | {(s[2], s[3], s[4], s[5], s[6]): s[7] for s in samples}
    assert got == wanted
    for bad in (("a", 0, 9, 9, 0, 0, "H", 1.0), ("a", 0, 1, 1, 4, 0, "H", 1.0)):
        for s in (False, True):
            with pytest.raises(Exception, match="a sample o"):
                frames.encode(df.unionAll(spark.createDataFrame([bad], df.schema)), spread=s, **options).collect()
    with pytest.raises(Exception, match="without samples of its first level"):
        frames.encode(df.where("level_x > 0"), **options).collect()


def test_simple_save_of_tables(spark):
    pixels = spark.createDataFrame([("p", y, x, y / 8, x / 8, 0.5, 1.0) for y in range(20) for x in range(5)], "path string, y int, x int, R double, G double, B double, A double")
    for channels, use_half in (("RGBA", True), ("RGB", False), ("A", False)):
        files = frames.encode_rgba(pixels, use_half, channels)
        _, parts, _ = f.parse_headers(bytes(files.first().content))
        assert [c.name for c in parts[0].channels] == sorted(channels) and {c.pixel_type for c in parts[0].channels} == {f.HALF if use_half else f.FLOAT}
        assert frames.load_rgba(files).count() == 100
    with pytest.raises(f.ImageError):
        frames.encode_rgba(pixels, False, "RG")


def test_files_keep_their_folders(spark, tmp_path):
    samples = [(p, 0, 0, 0, "Y", float(i)) for i, p in enumerate(("a/x.exr", "b/x.exr", "x.exr"))]
    files = frames.encode(spark.createDataFrame(samples, "path string, part_id int, y int, x int, channel string, value double"))
    assert frames.save_files(files, str(tmp_path / "saved")).count() == 3
    datasource.register(spark)
    files.write.format("exr").mode("append").save(str(tmp_path / "written"))
    files.where("path = 'x.exr'").write.format("exr").mode("overwrite").save(str(tmp_path / "again"))
    files.where("path = 'a/x.exr'").write.format("exr").mode("overwrite").save(str(tmp_path / "again"))
    got = {n: sorted((r.path.removeprefix(str(tmp_path)), r.value) for r in spark.read.format("exr").load(str(tmp_path / n)).collect()) for n in ("saved", "written", "again")}
    assert got["saved"] == [(f"/saved/{p}", float(i)) for i, p in enumerate(("a/x.exr", "b/x.exr", "x.exr"))]
    assert [v for _, v in got["written"]] == [0.0, 1.0, 2.0] and got["again"] == [("/again/a/x.exr", 0.0)]
    assert not [d for d in (tmp_path / "written").iterdir() if d.name.startswith("_")]
    with pytest.raises(Exception, match="two files"):
        files.unionAll(files).write.format("exr").mode("append").save(str(tmp_path / "twice"))
    for bad in ("../x.exr", "", "a/../../x"):
        with pytest.raises(f.ImageError):
            frames.relative_name(bad)


def test_rgbm_png():
    rgb = np.random.default_rng(13).random((6, 5, 3)) * 3
    data = images.write_rgbm_png(rgb)
    raw = images.read_png(data)
    assert raw.shape == (6, 5, 4) and (raw[:, :, 3] >= 16).all()
    assert np.abs(np.square(images.read_rgbm_png(data)) - np.square(rgb)).max() <= 16 / 255
    assert images.read_png(images.write_rgbm_png(np.array([[[2.0, 4.0, 0.0]]]))).tolist() == [[[64, 255, 0, 255]]]


def test_image_folders(spark, tmp_path):
    """TGA, PNM, PSD and PIC by bytes written by hand, PNG by the own writer, BMP and JPEG by Java's writers."""
    rgb = np.random.default_rng(14).integers(0, 256, (4, 5, 3)).astype(np.uint8)
    head = lambda kind, depth, flags: bytes([0, 0, kind, *[0] * 9]) + struct.pack("<HHBB", 5, 4, depth, flags)
    pic = lambda *packets: b"\x53\x80\xf6\x34" + bytes(84) + b"PICT" + struct.pack(">HHfHH", 5, 4, 1, 3, 0) + b"".join(bytes([k + 1 < len(packets), 8, *p]) for k, p in enumerate(packets))
    files = {
        "plain.tga": head(2, 24, 0x20) + rgb[:, :, ::-1].tobytes(),
        "below.tga": head(2, 24, 0) + rgb[::-1, :, ::-1].tobytes(),
        "runs.tga": head(10, 24, 0x20) + bytes([128 | 19]) + bytes([3, 2, 1]),
        "c.ppm": b"P6 # colours\n5 4\n255\n" + rgb.tobytes(),
        "g.pgm": b"P5 5 4 15\n" + (rgb[:, :, 0] // 17).tobytes(),
        "a.psd": b"8BPS\0\1" + bytes(6) + struct.pack(">HIIHH", 3, 4, 5, 8, 3) + bytes(12) + b"\0\0" + rgb.transpose(2, 0, 1).tobytes(),
        "b.psd": b"8BPS\0\1" + bytes(6) + struct.pack(">HIIHH", 3, 4, 5, 8, 3) + bytes(12) + b"\0\1" + bytes(24) + bytes([256 - 19, 1, 256 - 19, 2, 256 - 19, 3]),
        "plain.pic": pic((0, 0xE0)) + rgb.tobytes(),
        "pure.pic": pic((1, 0xE0)) + bytes([2, 1, 2, 3, 3, 4, 5, 6]) * 4,
        "mixed.pic": pic((2, 0xE0), (2, 0x10)) + (bytes([129, 1, 2, 3, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12]) + bytes([128, 0, 5, 77])) * 4,
        "d.png": images.write_png(rgb),
        "bad.pic": pic((1, 0xE0)) + bytes([2, 1]),
        "bad.png": b"\x89PNG\r\n\x1a\nxx",
        "bad.tga": b"short",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    jvm = spark.sparkContext._jvm
    canvas = jvm.java.awt.image.BufferedImage(5, 4, 1)
    for y in range(4):
        for x in range(5):
            canvas.setRGB(x, y, int(rgb[y, x, 0]) << 16 | int(rgb[y, x, 1]) << 8 | int(rgb[y, x, 2]))
    for kind in ("bmp", "jpg"):
        assert jvm.javax.imageio.ImageIO.write(canvas, kind, jvm.java.io.File(str(tmp_path / f"e.{kind}")))
    (tmp_path / "bad.jpg").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[1]: r for r in images.read_files(spark, str(tmp_path)).collect()}
    assert set(got) == {*files, "e.bmp", "e.jpg", "bad.jpg"}
    assert {n for n, r in got.items() if r.error} == {"bad.pic", "bad.png", "bad.tga", "bad.jpg"}
    value = lambda n: np.frombuffer(got[n].pixels, np.uint8).reshape(got[n].height, got[n].width, got[n].components)
    for name in ("plain.tga", "below.tga", "c.ppm", "a.psd", "plain.pic", "d.png", "e.bmp"):
        assert (value(name) == rgb).all(), name
    assert (value("runs.tga") == [1, 2, 3]).all() and (value("b.psd") == [1, 2, 3]).all() and (value("g.pgm")[:, :, 0] == rgb[:, :, 0] // 17 * 17).all()
    assert value("e.jpg").shape == (4, 5, 3)
    assert value("pure.pic")[3].tolist() == [[1, 2, 3]] * 2 + [[4, 5, 6]] * 3
    assert value("mixed.pic")[3].tolist() == [[1, 2, 3, 77]] * 2 + [[4, 5, 6, 77], [7, 8, 9, 77], [10, 11, 12, 77]]


def test_first_bytes_by_range(spark, tmp_path):
    part = f.Part([f.Channel("Y")], 4, 4, f.ZIP, tile=(2, 2))
    whole = f.encode_file([(part, planes(part, np.random.default_rng(15)))])
    for name, data in (("good", whole), ("short", whole[:6]), ("other", b"something else")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in frames.read(spark, str(tmp_path), "head").collect()}
    assert {n: r.status for n, r in got.items()} == {"good": f.OK, "short": f.BAD_FILE, "other": f.BAD_MAGIC} and got["good"].tiled


def test_source_in_stretches(tmp_path, monkeypatch):
    """Each chunk is read by the task of the stretch that it begins in."""
    monkeypatch.setattr(datasource, "GROUP_BYTES", 500)
    r = np.random.default_rng(16)
    a = f.Part([f.Channel("R")], 30, 90, f.ZIPS, name="a")
    levels = planes(a, r)
    (tmp_path / "a.exr").write_bytes(f.encode_file([(a, levels)]))
    assert len(datasource.ExrReader({"path": str(tmp_path)}).partitions()) > 10
    assert source_values(tmp_path) == {(0, "R", y, x): float(v) for (y, x), v in np.ndenumerate(levels[0, 0]["R"])}


def test_drained_stream_is_whole_and_stays_in_the_store(spark, tmp_path):
    """Each batch gives its own rows once, in files; nothing is kept by the driver."""
    from lucidframe.streaming.images import drain, stream_rows

    (tmp_path / "in").mkdir()
    assert drain(stream_rows(spark, str(tmp_path / "in"))).count() == 0
    want = {}
    for k in range(5):
        values = np.random.default_rng(k).normal(size=(20, 3)).astype("<f4")
        part = f.Part([f.Channel("R")], 3, 20, f.ZIP)
        (tmp_path / "in" / f"{k}.exr").write_bytes(f.encode_file([(part, {(0, 0): {"R": values}})]))
        want |= {(f"{k}.exr", y): v for y, v in enumerate(values.tolist())}
    table = drain(stream_rows(spark, str(tmp_path / "in"), files_per_batch=2))
    got = [((r.path.rsplit("/", 1)[1], r.y), r["values"]) for r in table.collect()]
    assert len(got) == len(want) and dict(got) == want
    assert len(table.inputFiles()) >= 3  # of three batches


def test_saving_and_streaming_send_the_driver_no_rows(spark, monkeypatch):
    """Queries that save files or run streams get neither the files' names nor a sink's table into the driver."""
    from pyspark.sql import DataFrame

    from lucidframe.plans import registry

    def refuse(self, *args):
        raise AssertionError("rows come to the driver")

    kind = type(spark.range(1))
    for where in {DataFrame, kind}:
        for name in ("collect", "toPandas", "toArrow", "toLocalIterator"):
            monkeypatch.setattr(where, name, refuse)
    made = {name: registry.QUERIES[name](spark, "/root/testdata/sf0.001") for name in ("exr_stream", "exr_first_bytes", "image_folder")}
    assert all(df.inputFiles() for df in made.values())  # a memory sink's table has none


def test_files_come_to_workers_in_bounded_batches(spark):
    """One worker a core reads and decodes the files that another makes, and gets a few MB of them at once."""
    import pyarrow as pa

    from lucidframe.plans import registry

    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], "10000")
        spark.conf.set(keys[1], "64m")
        made = registry.QUERIES["exr_mipmap_files"](spark, "/root/testdata/sf0.001")
        assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

        large = spark.range(0, 12, 1, 1).select(F.encode(F.repeat(F.lit("x"), 1 << 20), "UTF-8").alias("content"))
        got = [r.n for r in large.mapInArrow(sizes, "n long").collect()]
        assert sum(got) >= 12 << 20 and max(got) <= 5 << 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rows_of_files_are_the_rows_of_their_chunks(spark):
    parts = [f.Part([f.Channel("R", f.HALF), f.Channel("Z")], 37, 21, f.PIZ, name, tile=tile, level_mode=1) for name, tile in (("a", (8, 16)), ("b", (16, 8)))]
    one = spark.createDataFrame([("many", f.encode_file([(p, planes(p, np.random.default_rng(k))) for k, p in enumerate(parts)])), ("one", f.encode_file([(parts[0], planes(parts[0], np.random.default_rng(5)))]))], "path string, content binary")
    for given in ({}, {"names": ["Z"]}, {"requested": {"R": f.FLOAT}}):
        got, want = (sorted(map(tuple, df.collect()), key=repr) for df in (frames.file_rows(one, **given), frames.rows(frames.chunks(one), **given)))
        assert want and repr(got) == repr(want)
