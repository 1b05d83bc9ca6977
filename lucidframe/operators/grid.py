"""Operators on pixel grids.

A plane is a table (image columns..., y, x, v); wide pixels have R, G, B, A.  Windows are always partitioned by row or
by column of an image, never global, so a corpus of images spreads over its rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def deinterleave(packed: DataFrame, values: str, channels: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows of interleaved arrays to wide pixels: x and one column per channel; no shuffle."""
    n = len(channels)
    pixels = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / n).cast("int") - 1), lambda i: F.struct(i.alias("x"), *[F.get(F.col(values), i * n + k).alias(c) for k, c in enumerate(channels)]))
    return packed.where(F.size(values) >= n).select(*keys, F.explode(pixels).alias("p")).select(*keys, "p.*")


def interleave(pixels: DataFrame, channels: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Wide pixels to one array a row, in order of x."""
    row = F.array_sort(F.collect_list(F.struct("x", F.array(*channels).alias("v"))))
    return pixels.groupBy(*keys).agg(F.flatten(F.transform(row, lambda s: s["v"])).alias("values"))


def long_to_rgba(pixels: DataFrame, keys: Sequence[str], channel: str = "channel", value: str = "value") -> DataFrame:
    """Long pixels to R, G, B, A: alpha defaults to 1, a single channel fills all four."""
    pick = lambda c: F.max(F.when(F.col(channel) == c, F.col(value)))
    wide = pixels.groupBy(*keys).agg(*[pick(c).alias(c) for c in "RGBA"], F.max(value).alias("only"), F.count("*").alias("n"))
    gray = F.col("n") == 1
    return wide.select(*keys, *[F.when(gray, F.col("only")).otherwise(F.col(c)).alias(c) for c in "RGB"], F.when(gray, F.col("only")).otherwise(F.coalesce("A", F.lit(1.0).cast("float"))).alias("A"))


def fan_out(values: Column, n: int) -> list[Column]:
    """n output channels; those beyond the last input channel repeat it."""
    return [F.get(values, F.least(F.lit(c), F.size(values) - 1)) for c in range(n)]


def inspect(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """One pixel, the place clamped into the image; the bounds reach the scan as filters."""
    return pixels.where((F.col("x") == max(0, min(x, width - 1))) & (F.col("y") == max(0, min(y, height - 1))))


def file_row(line: Column, line_order: Column, height: Column) -> Column:
    """The row a stored line belongs to."""
    return F.when(line_order == 0, line).otherwise(height - 1 - line)


def detile(tiles: DataFrame, tile_w: int, tile_h: int, width: int | Column, height: int | Column) -> DataFrame:
    """Tile-relative pixels to the plane, what lies beyond the data window dropped; sizes may differ by image, as columns."""
    placed = tiles.withColumn("x", F.col("tile_x") * tile_w + F.col("i")).withColumn("y", F.col("tile_y") * tile_h + F.col("j"))
    return placed.where((F.col("x") < width) & (F.col("y") < height)).drop("tile_x", "tile_y", "i", "j")


def gradient(plane: DataFrame, value: str = "v", image: Sequence[str] = ()) -> DataFrame:
    """Forward differences along x and y; the edge counts as its own neighbour."""
    right = F.lead(value).over(Window.partitionBy(*image, "y").orderBy("x"))
    below = F.lead(value).over(Window.partitionBy(*image, "x").orderBy("y"))
    return plane.withColumn("dx", F.coalesce(right, F.col(value)) - F.col(value)).withColumn("dy", F.coalesce(below, F.col(value)) - F.col(value))


def gradient_rows(packed: DataFrame, values: str = "values", image: Sequence[str] = ()) -> DataFrame:
    """The same differences from packed rows (image..., y, values): a row meets the one below it in an equi-join, so any
    number of rows spreads; gives (image..., y, x, v, dx, dy)."""
    below = packed.select(*image, (F.col("y") - 1).alias("y"), F.col(values).alias("_below"))
    both = packed.select(*image, "y", F.col(values).alias("_own")).join(below, [*image, "y"], "left")
    own, under = F.col("_own"), F.col("_below")
    each = F.transform(own, lambda v, i: F.struct(i.alias("x"), v.alias("v"), (F.coalesce(F.get(own, i + 1), v) - v).alias("dx"), (F.coalesce(F.get(under, i), v) - v).alias("dy")))
    return both.select(*image, "y", F.explode(each).alias("p")).select(*image, "y", "p.*")


def drop_alpha(pixels: DataFrame, keys: Sequence[str] = ("y", "x")) -> DataFrame:
    return pixels.select(*keys, "R", "G", "B")


def constant_image(spark: SparkSession, value: float, width: int = 512, height: int = 512) -> DataFrame:
    at = spark.range(width * height)
    return at.select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"), *[F.lit(value).cast("float").alias(c) for c in "RGB"])


def channel_range(pixels: DataFrame, channels: Sequence[str]) -> DataFrame:
    return pixels.agg(*[f(c).alias(f"{c}_{n}") for c in channels for n, f in (("min", F.min), ("max", F.max))])


# resampling ---------------------------------------------------------------------------------------------------------


def _catmull_rom(t: float) -> float:
    t = abs(t)
    return 1 - t * t * (2.5 - 1.5 * t) if t < 1 else 2 - t * (4 + t * (0.5 * t - 2.5)) if t < 2 else 0.0


def _mitchell(t: float) -> float:
    t = abs(t)
    return (16 + t * t * (21 * t - 36)) / 18 if t < 1 else (32 + t * (-60 + t * (36 - 7 * t))) / 18 if t < 2 else 0.0


def axis_weights(size: int, target: int) -> list[tuple[int, int, float]]:
    """(output, input, weight) along one axis: Catmull-Rom to enlarge, Mitchell to reduce, edges clamped, sums 1."""
    ratio = target / size
    kernel, reach = (_catmull_rom, 2.0) if ratio > 1 else (_mitchell, 2.0 / ratio)
    out = []
    for o in range(target):
        centre = (o + 0.5) / ratio
        found: dict[int, float] = {}
        for i in range(math.floor(centre - reach), math.ceil(centre + reach) + 1):
            w = kernel((i + 0.5 - centre) * min(1.0, ratio))
            if w:
                j = min(size - 1, max(0, i))
                found[j] = found.get(j, 0.0) + w
        total = sum(found.values())
        out += [(o, i, w / total) for i, w in sorted(found.items())]
    return out


def resize(plane: DataFrame, width: int, height: int, to_width: int, to_height: int, value: str = "v", image: Sequence[str] = ()) -> DataFrame:
    """Separable resampling: each axis is a join with its weight table, bounded by the image's side, and a sum."""
    spark = plane.sparkSession
    wx = spark.createDataFrame(axis_weights(width, to_width), "xo int, x int, wx double")
    wy = spark.createDataFrame(axis_weights(height, to_height), "yo int, y int, wy double")
    across = plane.join(F.broadcast(wx), "x").groupBy(*image, "y", F.col("xo").alias("x")).agg(F.sum(F.col(value) * F.col("wx")).alias("v"))
    return across.join(F.broadcast(wy), "y").groupBy(*image, F.col("yo").alias("y"), "x").agg(F.sum(F.col("v") * F.col("wy")).alias(value))


# cube maps ----------------------------------------------------------------------------------------------------------


def cube_face(x: Column, y: Column, z: Column) -> list[Column]:
    """face, u, v of a direction.  Faces: +x, -x, +y, -y, +z, -z; on ties the later face wins."""
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    # (face, chosen if, major axis, u, v), the last that fits counts
    cases = [
        (0, (x > 0) & (ax >= ay) & (ax >= az), ax, -z, y),
        (1, (x <= 0) & (ax >= ay) & (ax >= az), ax, z, y),
        (2, (y > 0) & (ay >= ax) & (ay >= az), ay, x, -z),
        (3, (y <= 0) & (ay >= ax) & (ay >= az), ay, x, z),
        (4, (z > 0) & (az >= ax) & (az >= ay), az, x, y),
        (5, (z <= 0) & (az >= ax) & (az >= ay), az, -x, y),
    ]
    face, u, v = F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(None).cast("double")
    for number, fits, major, uc, vc in cases:
        half = lambda c, m=major: F.when(m != 0, (c / m + 1) * 0.5).otherwise(F.lit(0.5))
        face, u, v = F.when(fits, number).otherwise(face), F.when(fits, half(uc)).otherwise(u), F.when(fits, half(vc)).otherwise(v)
    return [face, u, v]


def longlat_directions(spark: SparkSession, width: int, height: int, turn: float = 0.0) -> DataFrame:
    """Pixels of a latitude-longitude image and the directions through their centres; ``turn`` in degrees.

    Pi is that of double precision, which moves directions by less than 1e-6 against a shorter one.
    """
    at = spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    phi = (F.col("x") + 0.5) / width * 2 * math.pi + math.radians(turn)
    theta = (F.col("y") + 0.5) / height * math.pi
    return at.select("x", "y", (F.sin(theta) * F.cos(phi)).alias("nx"), F.cos(theta).alias("ny"), (-F.sin(theta) * F.sin(phi)).alias("nz"))


def sample_faces(directions: DataFrame, faces: DataFrame, size: int, channels: Sequence[str] = ("R", "G", "B"), image: Sequence[str] = ()) -> DataFrame:
    """Bilinear samples of cube faces (image columns..., face, y, x, channels): four taps, each an equi-join with the faces.

    u and v are taken modulo 1, so an edge at exactly 1 is the first texel.  The directions go for all images; a pixel that lacks a tap, where a face has no such pixel, is left out.
    """
    face, u, v = cube_face(F.col("nx"), F.col("ny"), F.col("nz"))
    at = directions.select("x", "y", face.alias("face"), u.alias("u"), (1 - v).alias("v"))
    fx, fy = (F.col("u") - F.floor("u")) * (size - 1), (F.col("v") - F.floor("v")) * (size - 1)
    at = at.select("x", "y", "face", fx.alias("fx"), fy.alias("fy")).withColumn("x0", F.floor("fx").cast("int")).withColumn("y0", F.floor("fy").cast("int"))
    dx, dy = F.col("fx") - F.col("x0"), F.col("fy") - F.col("y0")
    x1, y1 = F.least(F.col("x0") + 1, F.lit(size - 1)), F.least(F.col("y0") + 1, F.lit(size - 1))
    taps = F.array(*[F.struct(px.alias("fx"), py.alias("fy"), w.alias("w"), F.lit(1 << k).alias("tap")) for k, (px, py, w) in enumerate(((F.col("x0"), F.col("y0"), (1 - dx) * (1 - dy)), (x1, F.col("y0"), dx * (1 - dy)), (F.col("x0"), y1, (1 - dx) * dy), (x1, y1, dx * dy)))])
    spread = at.select("x", "y", "face", F.explode(taps).alias("t")).select("x", "y", "face", F.col("t.fx").alias("fx"), F.col("t.fy").alias("fy"), F.col("t.w").alias("w"), F.col("t.tap").alias("tap"))
    source = faces.select(*image, "face", F.col("x").alias("fx"), F.col("y").alias("fy"), *channels)
    met = source.join(F.broadcast(spread), ["face", "fx", "fy"])  # bounded by the pixels of one image
    return met.groupBy(*image, "x", "y").agg(F.bit_or("tap").alias("taps"), *[F.sum(F.col(c) * F.col("w")).alias(c) for c in channels]).where("taps = 15").drop("taps")
