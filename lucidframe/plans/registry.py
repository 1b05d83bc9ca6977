"""All registered queries of the image engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lucidframe.codecs import blocks, piz
from lucidframe.functions import color, half, layers, levels
from lucidframe.operators import bytes as by, deep, grid, parts
from lucidframe.plans.bindings import SQL_BYTES, SQL_DEEP, SQL_NAMES, SQL_PLANE, SQL_RGBA, SQL_SIZES, names, packed, plane, rgba, sizes, table
from lucidframe.sources import images
from lucidframe.sources.exr import format as exr, frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# pixels -------------------------------------------------------------------------------------------------------------


@query("SELECT min(w) AS v_min, max(w) AS v_max, count(*) AS n FROM (SELECT greatest(CAST(-0.25 AS FLOAT), least(CAST(0.25 AS FLOAT), v)) AS w FROM (SELECT unnest(embedding) AS v FROM embeddings))")
def clip_stats(spark, d):
    clipped = plane(spark, d).select(color.clip(F.col("v"), -0.25, 0.25).alias("v"))
    return clipped.agg(F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.count("*").alias("n"))


@query(f"WITH {SQL_PLANE} SELECT y, x, greatest(CAST(-0.2 AS FLOAT), least(CAST(0.3 AS FLOAT), v)) AS v FROM plane")
def clip_pixels(spark, d):
    return plane(spark, d).select("y", "x", color.clip(F.col("v"), -0.2, 0.3).alias("v"))


@query(f"WITH {SQL_RGBA} SELECT min(R) AS R_min, max(R) AS R_max, min(G) AS G_min, max(G) AS G_max, min(B) AS B_min, max(B) AS B_max FROM rgba")
def channel_range(spark, d):
    return grid.channel_range(rgba(spark, d), "RGB")


@query(f"WITH {SQL_RGBA} SELECT * FROM rgba")
def rgba_deinterleave(spark, d):
    return rgba(spark, d)


@query(f"WITH {SQL_PLANE} SELECT y, x, v FROM plane WHERE x < (SELECT len(any_value(embedding)) // 4 * 4 FROM embeddings)")
def rgba_interleave(spark, d):
    return grid.interleave(rgba(spark, d), list("RGBA"), ["y"]).select("y", F.posexplode("values").alias("x", "v"))


@query(f"WITH {SQL_RGBA} SELECT y, x, R, G, B FROM rgba")
def rgb_drop_alpha(spark, d):
    return grid.drop_alpha(rgba(spark, d))


@query(f"WITH {SQL_PLANE} SELECT y, x, v AS R, v AS G, v AS B, v AS A FROM plane")
def gray_to_rgba(spark, d):
    return grid.long_to_rgba(plane(spark, d).select("y", "x", F.lit("Y").alias("channel"), F.col("v").alias("value")), ["y", "x"])


@query(f"WITH {SQL_RGBA} SELECT y, x, R, G, B, CASE WHEN y % 2 = 0 THEN A ELSE CAST(1 AS FLOAT) END AS A FROM rgba")
def alpha_default(spark, d):
    long = rgba(spark, d).select("y", "x", F.expr("stack(4, 'R', R, 'G', G, 'B', B, 'A', A) as (channel, value)"))
    return grid.long_to_rgba(long.where("channel <> 'A' or y % 2 = 0"), ["y", "x"])


@query(f"WITH {SQL_RGBA} SELECT y, x, R AS c0, G AS c1, B AS c2, A AS c3, A AS c4, A AS c5 FROM rgba")
def channel_fanout(spark, d):
    wide = rgba(spark, d).withColumn("all", F.array(*"RGBA"))
    return wide.select("y", "x", *[c.alias(f"c{i}") for i, c in enumerate(grid.fan_out(F.col("all"), 6))])


@query(f"WITH {SQL_RGBA} SELECT * FROM rgba WHERE y = 0 AND x = 15")
def inspect_pixel(spark, d):
    return grid.inspect(rgba(spark, d), 99, -5, 16, 500)


@query(f"WITH {SQL_PLANE} SELECT x, v, y % 2 AS line_order, CASE WHEN y % 2 = 0 THEN y % 64 ELSE 63 - y % 64 END AS y FROM plane")
def line_order_rows(spark, d):
    order = F.col("y") % 2
    return plane(spark, d).select("x", "v", order.alias("line_order"), grid.file_row(F.col("y") % 64, order, F.lit(64)).alias("y"))


@query(f"WITH {SQL_PLANE} SELECT y, x, CASE WHEN v < 0 THEN 0 ELSE CAST(least(255, floor(255 * pow(CAST(v AS DOUBLE) * 1.5, 1 / 2.2))) AS INTEGER) END AS u8 FROM plane")
def tonemap_u8(spark, d):
    return plane(spark, d).select("y", "x", color.tonemap_u8(F.col("v"), 1.5).alias("u8"))


@query(f"WITH {SQL_PLANE} SELECT y, x, CAST(greatest(0, least(255, trunc(255 * CAST(v AS DOUBLE)))) AS INTEGER) AS u8 FROM plane")
def linear_u8(spark, d):
    return plane(spark, d).select("y", "x", color.to_u8(F.col("v")).alias("u8"))


@query("SELECT p_partkey, CAST(p_partkey % 256 AS DOUBLE) / 255.0 AS v FROM part")
def unit_from_u8(spark, d):
    return table(spark, d, "part").select("p_partkey", color.from_u8((F.col("p_partkey") % 256).cast("double")).alias("v"))


@query(f"WITH {SQL_RGBA} SELECT y, x, round(pow(abs(CAST(R AS DOUBLE)) * 2, 1 / 2.2), 9) AS R, round(pow(abs(CAST(G AS DOUBLE)) * 2, 1 / 2.2), 9) AS G, round(pow(abs(CAST(B AS DOUBLE)) * 2, 1 / 2.2), 9) AS B, 1 AS A FROM rgba")
def display_transform(spark, d):
    return rgba(spark, d).select("y", "x", *[F.round(color.display(F.abs(c), 2.0), 9).alias(c) for c in "RGB"], F.lit(1).alias("A"))


@query(f"""WITH {SQL_RGBA}, s AS (SELECT y, x, CAST(R AS DOUBLE) * CAST(R AS DOUBLE) / 16 AS r, CAST(G AS DOUBLE) * CAST(G AS DOUBLE) / 16 AS g, CAST(B AS DOUBLE) * CAST(B AS DOUBLE) / 16 AS b FROM rgba),
m AS (SELECT *, ceil(least(greatest(r, g, b, 0.0625::DOUBLE), 1::DOUBLE) * 255) / 255::DOUBLE AS m FROM s)
SELECT y, x, round(least(r / m, 1), 9) AS R, round(least(g / m, 1), 9) AS G, round(least(b / m, 1), 9) AS B, round(m, 9) AS M FROM m""")
def rgbm_encode(spark, d):
    values = color.rgbm_encode(*[F.col(c).cast("double") for c in "RGB"])
    return rgba(spark, d).select("y", "x", *[F.round(v, 9).alias(c) for v, c in zip(values, "RGBM")])


@query(f"WITH {SQL_RGBA}, t AS (SELECT y, x, CAST(R AS DOUBLE) * CAST(A AS DOUBLE) * 16 AS r, CAST(G AS DOUBLE) * CAST(A AS DOUBLE) * 16 AS g, CAST(B AS DOUBLE) * CAST(A AS DOUBLE) * 16 AS b FROM rgba) SELECT y, x, round(r * r, 9) AS R, round(g * g, 9) AS G, round(b * b, 9) AS B FROM t")
def rgbm_decode(spark, d):
    return rgba(spark, d).select("y", "x", *[F.round(color.rgbm_decode(F.col(c).cast("double"), F.col("A").cast("double")), 9).alias(c) for c in "RGB"])


@query(f"""WITH {SQL_RGBA}, s AS (SELECT y, x, CAST(R AS DOUBLE) * 4 AS a, CAST(G AS DOUBLE) * 4 AS b, CAST(B AS DOUBLE) * 4 + 1 AS c FROM rgba), q AS (SELECT *, a * a + b * b + c * c AS d FROM s)
SELECT y, x, round(CASE WHEN d > 1e-6 THEN a / sqrt(d) ELSE a END * 0.5 + 0.5, 9) AS R, round(CASE WHEN d > 1e-6 THEN b / sqrt(d) ELSE b END * 0.5 + 0.5, 9) AS G, round(CASE WHEN d > 1e-6 THEN c / sqrt(d) ELSE c END * 0.5 + 0.5, 9) AS B FROM q""")
def normal_map(spark, d):
    values = color.normal_color(*[F.col(c).cast("double") for c in "RGB"], 4.0)
    return rgba(spark, d).select("y", "x", *[F.round(v, 9).alias(c) for v, c in zip(values, "RGB")])


@query(f"WITH {SQL_PLANE}, p AS (SELECT y, x, CAST(v AS DOUBLE) AS v FROM plane) SELECT y, x, coalesce(lead(v) OVER (PARTITION BY y ORDER BY x), v) - v AS dx, coalesce(lead(v) OVER (PARTITION BY x ORDER BY y), v) - v AS dy FROM p")
def gradient_map(spark, d):
    return grid.gradient_rows(packed(spark, d).select("y", F.col("embedding").cast("array<double>").alias("values"))).select("y", "x", "dx", "dy")


@query(f"WITH {SQL_PLANE}, p AS (SELECT y // 64 AS image, CAST(y % 64 AS INTEGER) AS y, x, CAST(v AS DOUBLE) AS v FROM plane) SELECT image, y, x, coalesce(lead(v) OVER (PARTITION BY image, y ORDER BY x), v) - v AS dx, coalesce(lead(v) OVER (PARTITION BY image, x ORDER BY y), v) - v AS dy FROM p")
def gradient_images(spark, d):
    """Long planes of many images, by windows along the lines and the columns of each."""
    p = plane(spark, d).select(F.floor(F.col("y") / 64).alias("image"), (F.col("y") % 64).cast("int").alias("y"), "x", F.col("v").cast("double").alias("v"))
    return grid.gradient(p, image=["image"]).select("image", "y", "x", "dx", "dy")


@query(f"WITH {SQL_PLANE} SELECT y, x, v FROM plane WHERE y < 100 AND x < 50")
def tiled_to_scanline(spark, d):
    tiles = plane(spark, d).where("y < 112").select(F.floor(F.col("x") / 16).cast("int").alias("tile_x"), F.floor(F.col("y") / 16).alias("tile_y"), (F.col("x") % 16).alias("i"), (F.col("y") % 16).alias("j"), "v")
    return grid.detile(tiles, 16, 16, 50, 100).select("y", "x", "v")


@query(f"WITH {SQL_PLANE} SELECT y // 64 AS image, CAST(y % 64 AS INTEGER) AS y, x, v FROM plane")
def tiled_to_scanline_images(spark, d):
    """The whole plane as images of 64 lines at most, out of tiles of 24 by 24 whose edges are padded beyond the image."""
    rows = packed(spark, d).select(F.floor(F.col("y") / 64).alias("image"), (F.col("y") % 64).cast("int").alias("y"), "embedding", F.size("embedding").alias("width"))
    height = rows.groupBy("image").agg((F.max("y") + 1).alias("height"), F.max("width").alias("width"))
    up = lambda c: (F.ceil(F.col(c) / 24) * 24).cast("int")
    below = height.where(up("height") > F.col("height")).select("image", F.explode(F.sequence("height", up("height") - 1)).alias("y"), F.array().cast("array<float>").alias("embedding"), "width")
    padded = rows.unionByName(below).join(height.select("image", "height"), "image").select("image", "y", "width", "height", F.posexplode(F.concat("embedding", F.array_repeat(F.lit(-1.0).cast("float"), up("width") - F.size("embedding")))).alias("x", "v"))
    tiles = padded.select("image", "width", "height", *[F.floor(F.col(c) / 24).cast("int").alias(f"tile_{c}") for c in "xy"], (F.col("x") % 24).alias("i"), (F.col("y") % 24).alias("j"), "v")
    return grid.detile(tiles, 24, 24, F.col("width"), F.col("height")).select("image", "y", "x", "v")


@query("SELECT CAST(i % 512 AS INTEGER) AS x, CAST(i // 512 AS INTEGER) AS y, CAST(10 AS FLOAT) AS R, CAST(10 AS FLOAT) AS G, CAST(10 AS FLOAT) AS B FROM range(512 * 512) t(i)")
def constant_image(spark, d):
    return grid.constant_image(spark, 10.0)


def _weights_sql(size: int, to: int, out: str, at: str) -> str:
    return ", ".join(f"({o}, {i}, CAST({w!r} AS DOUBLE))" for o, i, w in grid.axis_weights(size, to))


@query(f"""WITH {SQL_PLANE}, wx(xo, xi, wx) AS (VALUES {_weights_sql(64, 40, "xo", "x")}), wy(yo, yi, wy) AS (VALUES {_weights_sql(64, 100, "yo", "y")}),
p AS (SELECT y // 64 AS image, CAST(y % 64 AS INTEGER) AS y, x, CAST(v AS DOUBLE) AS v FROM plane), a AS (SELECT image, y, xo AS x, sum(v * wx) AS v FROM p JOIN wx ON xi = x GROUP BY ALL)
SELECT image, yo AS y, x, round(sum(v * wy), 6) + 0.0 AS v FROM a JOIN wy ON yi = y GROUP BY image, yo, x""")
def resize_plane(spark, d):
    p = plane(spark, d).select(F.floor(F.col("y") / 64).alias("image"), (F.col("y") % 64).cast("int").alias("y"), "x", F.col("v").cast("double").alias("v"))
    return grid.resize(p, 64, 64, 40, 100, image=["image"]).select("image", "y", "x", (F.round("v", 6) + 0.0).alias("v"))


@query(f"""WITH {SQL_RGBA}, n AS (SELECT y, x, CAST(R AS DOUBLE) AS a, CAST(G AS DOUBLE) AS b, CAST(B AS DOUBLE) AS c FROM rgba),
f AS (SELECT *, CASE WHEN c <= 0 AND abs(c) >= abs(a) AND abs(c) >= abs(b) THEN 5 WHEN c > 0 AND abs(c) >= abs(a) AND abs(c) >= abs(b) THEN 4 WHEN b <= 0 AND abs(b) >= abs(a) AND abs(b) >= abs(c) THEN 3
  WHEN b > 0 AND abs(b) >= abs(a) AND abs(b) >= abs(c) THEN 2 WHEN a <= 0 AND abs(a) >= abs(b) AND abs(a) >= abs(c) THEN 1 ELSE 0 END AS face FROM n),
g AS (SELECT *, CASE face WHEN 0 THEN -c WHEN 1 THEN c WHEN 5 THEN -a ELSE a END AS uc, CASE face WHEN 2 THEN -c WHEN 3 THEN c ELSE b END AS vc, CASE WHEN face < 2 THEN abs(a) WHEN face < 4 THEN abs(b) ELSE abs(c) END AS m FROM f)
SELECT y, x, face, round(CASE WHEN m <> 0 THEN (uc / m + 1) * 0.5 ELSE 0.5 END, 9) AS u, round(CASE WHEN m <> 0 THEN (vc / m + 1) * 0.5 ELSE 0.5 END, 9) AS v FROM g""")
def cube_face_uv(spark, d):
    face, u, v = grid.cube_face(*[F.col(c).cast("double") for c in "RGB"])
    return rgba(spark, d).select("y", "x", face.alias("face"), F.round(u, 9).alias("u"), F.round(v, 9).alias("v"))


@query(f"""WITH {SQL_RGBA}, faces AS (SELECT y // 96 AS image, CAST(y % 96 // 16 AS INTEGER) AS face, CAST(y % 16 AS INTEGER) AS py, x AS px, CAST(R AS DOUBLE) AS R, CAST(G AS DOUBLE) AS G, CAST(B AS DOUBLE) AS B FROM rgba),
o AS (SELECT CAST(i % 64 AS INTEGER) AS x, CAST(i // 64 AS INTEGER) AS y, (i % 64 + 0.5::DOUBLE) / 64 * 2 * pi() + radians(30) AS p, (i // 64 + 0.5::DOUBLE) / 32 * pi() AS t FROM range(2048) r(i)),
n AS (SELECT x, y, sin(t) * cos(p) AS a, cos(t) AS b, -sin(t) * sin(p) AS c FROM o),
f AS (SELECT *, CASE WHEN c <= 0 AND abs(c) >= abs(a) AND abs(c) >= abs(b) THEN 5 WHEN c > 0 AND abs(c) >= abs(a) AND abs(c) >= abs(b) THEN 4 WHEN b <= 0 AND abs(b) >= abs(a) AND abs(b) >= abs(c) THEN 3
  WHEN b > 0 AND abs(b) >= abs(a) AND abs(b) >= abs(c) THEN 2 WHEN a <= 0 AND abs(a) >= abs(b) AND abs(a) >= abs(c) THEN 1 ELSE 0 END AS face FROM n),
g AS (SELECT x, y, face, CASE face WHEN 0 THEN -c WHEN 1 THEN c WHEN 5 THEN -a ELSE a END AS uc, CASE face WHEN 2 THEN -c WHEN 3 THEN c ELSE b END AS vc, CASE WHEN face < 2 THEN abs(a) WHEN face < 4 THEN abs(b) ELSE abs(c) END AS m FROM f),
h AS (SELECT x, y, face, (uc / m + 1) * 0.5 AS u, 1 - (vc / m + 1) * 0.5 AS v FROM g), k AS (SELECT x, y, face, (u - floor(u)) * 15 AS fx, (v - floor(v)) * 15 AS fy FROM h),
taps AS (SELECT x, y, face, CAST(least(15, floor(fx) + i) AS INTEGER) AS px, CAST(least(15, floor(fy) + j) AS INTEGER) AS py, CASE i WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END * CASE j WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END AS w FROM k, range(2) s(i), range(2) r(j))
SELECT image, y, x, round(sum(R * w), 6) + 0.0 AS R, round(sum(G * w), 6) + 0.0 AS G, round(sum(B * w), 6) + 0.0 AS B FROM taps JOIN faces USING (face, px, py) GROUP BY image, y, x HAVING count(*) = 4""")
def cube_to_longlat(spark, d):
    """Each 96 rows of the plane, six faces of 16 by 16 pixels, as a latitude-longitude image; of a last, shorter cube the
    pixels that it covers."""
    at = (F.col("y") % 96).cast("int")
    faces = rgba(spark, d).select(F.floor(F.col("y") / 96).alias("image"), F.floor(at / 16).cast("int").alias("face"), (at % 16).alias("y"), "x", *[F.col(c).cast("double") for c in "RGB"])
    seen = grid.sample_faces(grid.longlat_directions(spark, 64, 32, 30.0), faces, 16, image=["image"])
    return seen.select("image", "y", "x", *[(F.round(c, 6) + 0.0).alias(c) for c in "RGB"])


# half precision -----------------------------------------------------------------------------------------------------

_BITS = f"""WITH {SQL_PLANE}, b AS (SELECT y, x, CAST(CAST(v AS FLOAT) AS BIT)::INTEGER::BIGINT & 4294967295 AS f FROM plane),
e AS (SELECT y, x, (f >> 16) & 32768 AS s, (f >> 23) & 255 AS p, f & 8388607 AS m FROM b),
h AS (SELECT y, x, s | CASE WHEN p = 0 THEN 0 WHEN p = 255 AND m <> 0 THEN 32256 WHEN p - 112 >= 31 THEN 31744
  WHEN p - 112 <= 0 THEN CASE WHEN 126 - p <= 24 THEN ((m | 8388608) >> (126 - p)::INTEGER) + (((m | 8388608) >> (125 - p)::INTEGER) & 1) ELSE 0 END
  ELSE ((p - 112) << 10) + (m >> 13) + ((m >> 12) & 1) END AS bits FROM e)"""
_WIDE = "CAST(CASE WHEN bits & 32768 <> 0 THEN -1 ELSE 1 END * CASE WHEN (bits >> 10) & 31 = 0 THEN (bits & 1023) * pow(2::DOUBLE, -24) ELSE (1 + (bits & 1023) * pow(2::DOUBLE, -10)) * pow(2::DOUBLE, ((bits >> 10) & 31) - 15) END AS FLOAT)"


@query(_BITS + " SELECT y, x, CAST(bits AS INTEGER) AS bits FROM h")
def half_bits(spark, d):
    return plane(spark, d).select("y", "x", half.half_bits(F.col("v")).alias("bits"))


@query(_BITS + f" SELECT y, x, {_WIDE} AS v FROM h")
def half_roundtrip(spark, d):
    return plane(spark, d).select("y", "x", half.half_value(half.half_bits(F.col("v"))).alias("v"))


@query(f"WITH h AS (SELECT i AS bits FROM range(65536) t(i) WHERE (i >> 10) & 31 < 31) SELECT bits, {_WIDE} + CAST(0 AS FLOAT) AS v FROM h")
def half_widen(spark, d):
    every = spark.range(65536).select(F.col("id").alias("bits")).where("(shiftright(id, 10) & 31) < 31")
    return every.select("bits", (half.half_value_expr(F.col("bits")) + F.lit(0.0).cast("float")).alias("v"))


# levels, tiles, blocks ----------------------------------------------------------------------------------------------

_FLOOR = "CASE WHEN {0} <= 1 THEN 0 ELSE length(ltrim(bin({0}), '0')) - 1 END"
_CEIL = "(" + _FLOOR + " + CASE WHEN {0} > 1 AND bit_count(CAST({0} AS BIGINT)) > 1 THEN 1 ELSE 0 END)"
_ROUND = "CASE WHEN up = 0 THEN " + _FLOOR + " ELSE " + _CEIL + " END"
_SIZE = "greatest(1, {0} // (1 << {1}) + CASE WHEN up = 1 AND {0} % (1 << {1}) <> 0 THEN 1 ELSE 0 END)"


@query(f"WITH {SQL_SIZES} SELECT p_partkey, CAST({_FLOOR.format('w')} AS INTEGER) AS floor_w, CAST({_CEIL.format('w')} AS INTEGER) AS ceil_w, CAST({_ROUND.format('h')} AS INTEGER) AS round_h FROM sizes")
def log2_sizes(spark, d):
    return sizes(spark, d).select("p_partkey", levels.floor_log2(F.col("w")).alias("floor_w"), levels.ceil_log2(F.col("w")).alias("ceil_w"), levels.round_log2(F.col("h"), F.col("up")).alias("round_h"))


def _level_columns():
    w, h, mode, up = (F.col(c) for c in ("w", "h", "mode", "up"))
    return levels.num_x_levels(w, h, mode, up), levels.num_y_levels(w, h, mode, up)


_LEVELS = f"lv AS (SELECT *, CAST(CASE mode WHEN 0 THEN 1 WHEN 1 THEN {_ROUND.format('greatest(w, h)')} + 1 ELSE {_ROUND.format('w')} + 1 END AS INTEGER) AS nx, CAST(CASE mode WHEN 0 THEN 1 WHEN 1 THEN {_ROUND.format('greatest(w, h)')} + 1 ELSE {_ROUND.format('h')} + 1 END AS INTEGER) AS ny FROM sizes)"


@query(f"WITH {SQL_SIZES}, {_LEVELS} SELECT p_partkey, mode, nx, ny FROM lv")
def level_counts(spark, d):
    nx, ny = _level_columns()
    return sizes(spark, d).select("p_partkey", "mode", nx.alias("nx"), ny.alias("ny"))


@query(f"WITH {SQL_SIZES}, {_LEVELS}, e AS (SELECT *, CAST(unnest(range(0, nx)) AS INTEGER) AS level FROM lv) SELECT p_partkey, level, CAST({_SIZE.format('w', 'level')} AS INTEGER) AS size, CAST(ceil({_SIZE.format('w', 'level')} / t) AS INTEGER) AS tiles FROM e")
def tile_counts(spark, d):
    nx, _ = _level_columns()
    s = sizes(spark, d).withColumn("nx", nx)
    counts = levels.tile_counts(F.col("w"), F.col("t"), F.col("nx"), F.col("up"))
    return s.select("p_partkey", "w", "up", F.posexplode(counts).alias("level", "tiles")).select("p_partkey", "level", levels.level_size(F.col("w"), F.col("level"), F.col("up")).alias("size"), "tiles")


@query(f"WITH {SQL_SIZES}, e AS (SELECT *, CAST(unnest(range(0, CAST(ceil(w / t) AS INTEGER))) AS INTEGER) AS i FROM sizes) SELECT p_partkey, i, CAST(least(t, w - t * i) AS INTEGER) AS width FROM e")
def tile_sizes(spark, d):
    s = sizes(spark, d).select("*", F.explode(F.sequence(F.lit(0), levels.tiles_along(F.col("w"), F.col("t")) - 1)).alias("i"))
    return s.select("p_partkey", "i", levels.tile_size_at(F.col("w"), F.col("t"), F.col("i")).alias("width"))


@query(f"WITH {SQL_SIZES}, {_LEVELS}, e AS (SELECT *, unnest(range(0, nx)) AS lx FROM lv), g AS (SELECT *, unnest(range(0, ny)) AS ly FROM e) SELECT p_partkey, CAST(lx AS INTEGER) AS lx, CAST(ly AS INTEGER) AS ly, CAST(CASE mode WHEN 0 THEN 0 WHEN 1 THEN lx ELSE lx + ly * nx END AS INTEGER) AS i FROM g WHERE mode <> 1 OR lx = ly")
def level_indexes(spark, d):
    nx, ny = _level_columns()
    s = sizes(spark, d).withColumn("nx", nx).withColumn("ny", ny)
    e = s.select("*", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("lx")).select("*", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("ly")).where("mode <> 1 or lx = ly")
    return e.select("p_partkey", "lx", "ly", levels.level_index(F.col("lx"), F.col("ly"), F.col("mode"), F.col("nx")).alias("i"))


@query(f"""WITH {SQL_SIZES}, {_LEVELS}, c AS (SELECT *, CAST(p_partkey % 9 - 1 AS INTEGER) AS tx, CAST(p_partkey % 4 AS INTEGER) AS ty, CAST(p_partkey % 5 AS INTEGER) AS lx, CAST(p_partkey % 10 // 2 AS INTEGER) AS ly FROM lv)
SELECT p_partkey, coalesce(tx >= 0 AND CASE mode WHEN 0 THEN lx = 0 AND ly = 0 WHEN 1 THEN lx = ly AND lx < nx AND ly < ny ELSE lx < nx AND ly < ny END
  AND CASE WHEN lx < nx THEN tx < ceil({_SIZE.format('w', 'lx')} / t) ELSE false END AND CASE WHEN ly < ny THEN ty < ceil({_SIZE.format('h', 'ly')} / t) ELSE false END, false) AS valid FROM c""")
def valid_tiles(spark, d):
    nx, ny = _level_columns()
    s = sizes(spark, d).withColumn("nx", nx).withColumn("ny", ny)
    s = s.withColumn("xc", levels.tile_counts(F.col("w"), F.col("t"), F.col("nx"), F.col("up"))).withColumn("yc", levels.tile_counts(F.col("h"), F.col("t"), F.col("ny"), F.col("up")))
    k = F.col("p_partkey")
    at = [(k % 9 - 1).cast("int"), (k % 4).cast("int"), (k % 5).cast("int"), F.floor(k % 10 / 2).cast("int")]
    return s.select("p_partkey", levels.valid_tile(*at, F.col("mode"), F.col("nx"), F.col("ny"), F.col("xc"), F.col("yc")).alias("valid"))


@query(f"WITH {SQL_SIZES} SELECT p_partkey, mode | (up << 4) AS byte, (mode | (up << 4)) & 3 AS mode_again, ((mode | (up << 4)) >> 4) & 1 AS up_again FROM sizes")
def tile_mode_bytes(spark, d):
    s = sizes(spark, d).select("p_partkey", F.expr("mode | shiftleft(up, 4)").alias("byte"))
    mode, up = levels.tile_mode(F.col("byte"))
    return s.select("p_partkey", "byte", mode.alias("mode_again"), up.alias("up_again"))


@query(f"WITH {SQL_SIZES}, {_LEVELS}, e AS (SELECT *, unnest(range(0, nx)) AS lx FROM lv), g AS (SELECT *, unnest(range(0, ny)) AS ly FROM e) SELECT p_partkey, CAST(sum(ceil({_SIZE.format('w', 'lx')} / t) * ceil({_SIZE.format('h', 'ly')} / t)) AS BIGINT) AS blocks FROM g WHERE mode <> 1 OR lx = ly GROUP BY p_partkey")
def tile_block_sums(spark, d):
    nx, ny = _level_columns()
    s = sizes(spark, d).withColumn("nx", nx).withColumn("ny", ny)
    x, y = (levels.tile_counts(F.col(side), F.col("t"), F.col(n), F.col("up")) for side, n in (("w", "nx"), ("h", "ny")))
    return s.select("p_partkey", levels.tile_blocks(x, y, F.col("mode")).alias("blocks"))


@query(f"WITH {SQL_SIZES} SELECT p_partkey, CAST(p_partkey % CAST(ceil(w / t) AS INTEGER) AS INTEGER) AS tile_x, CAST(p_partkey // CAST(ceil(w / t) AS INTEGER) AS INTEGER) AS tile_y FROM sizes")
def tile_places(spark, d):
    x, y = parts.tile_place(F.col("p_partkey"), levels.tiles_along(F.col("w"), F.col("t")))
    return sizes(spark, d).select("p_partkey", x.alias("tile_x"), y.alias("tile_y"))


_COMPRESSION = "CAST(p_partkey % 5 AS INTEGER)"
_LINES = "CASE p_partkey % 5 WHEN 3 THEN 16 WHEN 4 THEN 32 ELSE 1 END"


@query(f"WITH {SQL_SIZES} SELECT p_partkey, {_LINES} AS lines, CAST(ceil(h / {_LINES}) AS INTEGER) AS blocks FROM sizes")
def scanline_blocks(spark, d):
    c = (F.col("p_partkey") % 5).cast("int")
    return sizes(spark, d).select("p_partkey", levels.block_lines(c).alias("lines"), levels.block_count(F.col("h"), c, F.lit(0)).alias("blocks"))


@query("SELECT o_custkey, o_orderkey, 313 + coalesce(sum(CAST(floor(o_totalprice) AS BIGINT) + 4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_offset FROM orders")
def chunk_offsets(spark, d):
    o = table(spark, d, "orders")
    return by.running_offsets(o, ["o_custkey"], "o_orderkey", F.floor("o_totalprice") + 4, F.lit(313)).select("o_custkey", "o_orderkey", "chunk_offset")


@query("SELECT o_custkey, bool_or(CAST(floor(o_totalprice) AS BIGINT) - 5000 <= 0) AS damaged, bit_or(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END) AS flags FROM orders GROUP BY o_custkey")
def offset_checks(spark, d):
    flag = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(4)
    return table(spark, d, "orders").groupBy("o_custkey").agg(parts.any_damaged(F.floor("o_totalprice") - 5000).alias("damaged"), parts.error_flags(flag).alias("flags"))


# channel names ------------------------------------------------------------------------------------------------------


@query(f"WITH {SQL_NAMES} SELECT layer, min(p_partkey) AS first_position FROM (SELECT p_partkey, nullif(regexp_extract(name, '^(.+)[.]([^.]+)$', 1), '') AS layer FROM names) WHERE layer IS NOT NULL GROUP BY layer")
def layer_list(spark, d):
    return layers.list_layers(names(spark, d), "name", "p_partkey")


@query(f"""WITH {SQL_NAMES} SELECT p_partkey, CASE WHEN starts_with(name, p_brand || '.') THEN substr(name, length(p_brand) + 2) WHEN contains(name, p_brand || '.') THEN name END AS in_brand,
CASE WHEN NOT contains(name, '.') THEN name WHEN regexp_matches(name, '^[.][^.]*$') THEN substr(name, 2) END AS in_default FROM names""")
def layer_channels(spark, d):
    n = names(spark, d)
    return n.select("p_partkey", layers.in_layer(F.col("name"), F.col("p_brand")).alias("in_brand"), layers.in_layer(F.col("name"), F.lit("")).alias("in_default"))


@query(f"WITH {SQL_NAMES} SELECT p_partkey, CASE WHEN contains(name, '.') THEN regexp_extract(name, '[^.]*$') ELSE '' END AS extension, left(name, 6) AS short FROM names")
def file_names(spark, d):
    return names(spark, d).select("p_partkey", layers.file_extension(F.col("name")).alias("extension"), layers.short_name(F.col("name"), 6).alias("short"))


@query("SELECT p_brand, p_partkey, CASE p_partkey % 3 WHEN 1 THEN 2 ELSE 4 END AS size, coalesce(sum(CASE p_partkey % 3 WHEN 1 THEN 2 ELSE 4 END) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_offset FROM part")
def channel_layout(spark, d):
    size = F.when(F.col("p_partkey") % 3 == 1, 2).otherwise(4)
    return by.running_offsets(table(spark, d, "part").withColumn("size", size), ["p_brand"], "p_partkey", F.col("size"), F.lit(0)).select("p_brand", "p_partkey", "size", "chunk_offset")


@query("SELECT p_brand, count(DISTINCT p_name) = count(*) AS names_differ, CAST(sum(p_size) AS BIGINT) AS header_bytes, count(DISTINCT (p_size % 4, p_size % 3)) AS n_levels FROM part GROUP BY p_brand")
def part_checks(spark, d):
    p = table(spark, d, "part")
    return p.groupBy("p_brand").agg(parts.names_differ(F.col("p_name")).alias("names_differ"), parts.header_bytes(F.col("p_size")).alias("header_bytes"), parts.level_count(F.col("p_size") % 4, F.col("p_size") % 3).alias("n_levels"))


# bytes --------------------------------------------------------------------------------------------------------------


def _docs(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("data"))


def _sums(b: np.ndarray) -> tuple[int, int, int]:
    """Number, sum and weighted sum of bytes."""
    v = b.astype(np.int64)
    return len(v), int(v.sum()), int((v * (np.arange(len(v)) % 9973 + 1)).sum())


@query(f"WITH {SQL_BYTES} SELECT b, count(*) AS n FROM bytes GROUP BY b")
def symbol_histogram(spark, d):
    return by.symbol_counts(_docs(spark, d), "data")


@query(f"WITH {SQL_PLANE} SELECT DISTINCT CAST(floor(abs(v) * 60000) AS BIGINT) AS v FROM plane WHERE floor(abs(v) * 60000) BETWEEN 1 AND 65535")
def value_bitmap(spark, d):
    values = plane(spark, d).select(F.floor(F.abs(F.col("v").cast("float")) * F.lit(60000).cast("float")).alias("v")).where("v <= 65535")
    maps = by.value_bitmap(values)
    bit = F.expr("filter(transform(sequence(0, 32767), i -> if((conv(substring(hex(bitmap), 2 * (i div 8) + 1, 2), 16, 10) & shiftleft(1, i % 8)) <> 0, (bucket - 1) * 32768 + i + 1, cast(null as bigint))), v -> v is not null)")
    return maps.select(F.explode(bit).alias("v"))


@query(f"""WITH {SQL_BYTES}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM bytes), s AS (SELECT doc_id, b, CASE WHEN i % 2 = 0 THEN i // 2 ELSE (n + 1) // 2 + i // 2 END AS j FROM n),
p AS (SELECT doc_id, j, coalesce((b - lag(b) OVER (PARTITION BY doc_id ORDER BY j) + 128 + 256) % 256, b) AS d FROM s)
SELECT doc_id, count(*) AS n, CAST(sum(d) AS BIGINT) AS total, CAST(sum(CAST(d AS BIGINT) * (j % 9973 + 1)) AS BIGINT) AS weighted FROM p GROUP BY doc_id""")
def predictor_encode(spark, d):
    return by.over_bytes(_docs(spark, d), "doc_id", F.col("data"), "n long, total long, weighted long", lambda b: _sums(by.differences(by.split_halves(b))))


@query(f"WITH {SQL_BYTES} SELECT doc_id, count(*) AS n, CAST(sum(b) AS BIGINT) AS total, CAST(sum(CAST(b AS BIGINT) * (i % 9973 + 1)) AS BIGINT) AS weighted FROM bytes GROUP BY doc_id")
def predictor_decode(spark, d):
    return by.over_bytes(_docs(spark, d), "doc_id", F.col("data"), "n long, total long, weighted long", lambda b: _sums(by.sums(by.differences(b))))


@query(f"""WITH {SQL_BYTES}, o AS (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY doc_id ORDER BY i) = b THEN 0 ELSE 1 END AS opens FROM bytes),
r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM o), g AS (SELECT doc_id, run, count(*) AS n, min(i) AS first FROM r GROUP BY doc_id, run)
SELECT doc_id, count(*) AS n_runs, max(n) AS longest, CAST(sum(first) AS BIGINT) AS firsts FROM g GROUP BY doc_id""")
def rle_runs(spark, d):
    def summary(b: np.ndarray) -> tuple[int, int, int]:
        first, _, n = by.runs(b)
        return len(n), int(n.max()), int(first.sum())

    return by.over_bytes(_docs(spark, d), "doc_id", F.col("data"), "n_runs long, longest long, firsts long", summary)


def _round_trip(spark, d, there: Callable[[bytes], bytes], back: Callable[[bytes, int], bytes]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([back(there(x), len(x)) for x in data], pa.binary())], ["doc_id", "data"])

    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    decoded = docs.mapInArrow(scan, "doc_id long, data binary")
    return decoded.select("doc_id", F.octet_length("data").cast("long").alias("n"), F.md5("data").alias("digest"))


_SAME = "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n, md5(text) AS digest FROM documents WHERE text IS NOT NULL"


@query(_SAME)
def rle_roundtrip(spark, d):
    return _round_trip(spark, d, blocks.rle_encode, blocks.rle_decode)


@query(_SAME)
def zip_roundtrip(spark, d):
    return _round_trip(spark, d, blocks.zip_encode, blocks.zip_decode)


def _piz_there(x: bytes) -> bytes:
    even = x + b"\0" * (len(x) % 2)
    return piz.encode(even, 1, len(even) // 2, [1]) if even else b""


def _piz_back(x: bytes, n: int) -> bytes:
    size = n + n % 2
    return piz.decode(x, size, 1, size // 2, [1])[:n] if n else b""


@query(_SAME)
def piz_roundtrip(spark, d):
    return _round_trip(spark, d, _piz_there, _piz_back)


# deep images --------------------------------------------------------------------------------------------------------


def _deep(spark, d):
    pixels = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 100).alias("line"), (F.col("o_orderkey") % 100).alias("x"))
    return deep.sample_counts(pixels, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query(f"WITH {SQL_DEEP} SELECT line, x, n FROM deep")
def deep_counts(spark, d):
    return _deep(spark, d).select("line", "x", "n")


@query(f"WITH {SQL_DEEP} SELECT line, x, CAST(sum(n) OVER (PARTITION BY line ORDER BY x) AS BIGINT) AS sample_end, n AS n_again FROM deep")
def deep_offsets(spark, d):
    return deep.counts_from_offsets(deep.cumulative_offsets(_deep(spark, d), ["line"]), ["line"]).select("line", "x", "sample_end", "n_again")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_discount <> 0 THEN l_extendedprice * 0.5::DOUBLE / l_discount ELSE l_extendedprice * 0.5::DOUBLE END AS straight FROM lineitem")
def deep_unpremultiply(spark, d):
    return deep.unpremultiplied(table(spark, d, "lineitem"), "l_extendedprice", "l_discount", 0.5).select("l_orderkey", "l_linenumber", "l_extendedprice", "straight")


@query("SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity) - 1 AS INTEGER) AS s, l_linenumber, l_extendedprice FROM lineitem")
def deep_samples(spark, d):
    packed_samples = deep.implode(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_extendedprice", "l_quantity"])
    return deep.explode(packed_samples, ["l_orderkey"]).select("l_orderkey", "s", "l_linenumber", "l_extendedprice")


# files --------------------------------------------------------------------------------------------------------------


def _files(spark, d, compression: int, pixel_type: int = exr.FLOAT, tile=None, parts: int = 1) -> DataFrame:
    """A file of 64 lines for each 64 vectors, channels R, G, B, A."""
    y = F.col("y")
    where = [F.concat(F.lit("image"), F.floor(y / 64).cast("string")).alias("path"), (F.col("x") % parts).alias("part_id"), (y % 64).alias("y"), F.floor(F.col("x") / parts).alias("x")]
    long = rgba(spark, d).select(*where, F.expr("stack(4, 'R', R, 'G', G, 'B', B, 'A', A) as (channel, value)"))
    return frames.encode(long, compression, pixel_type, tile)


_LONG = "long AS (SELECT 'image' || CAST(y // 64 AS VARCHAR) AS path, CAST(y % 64 AS INTEGER) AS y, x, unnest(['R', 'G', 'B', 'A']) AS channel, CAST(unnest([R, G, B, A]) AS DOUBLE) AS value FROM rgba)"


def _samples(files: DataFrame) -> DataFrame:
    return frames.pixels(frames.file_rows(files)).select("path", "y", "x", "channel", "value")


def _file_query(name: str, compression: int, tile=None):
    def run(spark, d):
        return _samples(_files(spark, d, compression, tile=tile))

    run.__name__ = name
    query(f"WITH {SQL_RGBA}, {_LONG} SELECT * FROM long")(run)


for _name, _number in (("none", exr.NONE), ("rle", exr.RLE), ("zips", exr.ZIPS), ("zip", exr.ZIP), ("piz", exr.PIZ)):
    _file_query(f"exr_scanline_{_name}", _number)
_file_query("exr_tiled_zip", exr.ZIP, (10, 24))
_file_query("exr_tiled_piz", exr.PIZ, (16, 16))


@query(_BITS + f", w AS (SELECT y, x, CAST({_WIDE} AS DOUBLE) AS v FROM h) SELECT 'image' || CAST(y // 64 AS VARCHAR) AS path, CAST(y % 64 AS INTEGER) AS y, CAST(x // 4 AS INTEGER) AS x, (['R', 'G', 'B', 'A'])[x % 4 + 1] AS channel, v AS value FROM w")
def exr_half_file(spark, d):
    return _samples(_files(spark, d, exr.PIZ, exr.HALF))


@query(f"WITH {SQL_RGBA}, {_LONG} SELECT path, CAST(x % 2 AS INTEGER) AS part_id, y, CAST(x // 2 AS INTEGER) AS x, channel, value FROM long")
def exr_multipart(spark, d):
    return frames.pixels(frames.file_rows(_files(spark, d, exr.ZIP, parts=2))).select("path", "part_id", "y", "x", "channel", "value")


@query(f"WITH {SQL_RGBA} SELECT 'image' || CAST(y // 64 AS VARCHAR) AS path, CAST(y % 64 AS INTEGER) AS y, x, CAST(R AS DOUBLE) AS R, CAST(G AS DOUBLE) AS G, CAST(B AS DOUBLE) AS B, CAST(A AS DOUBLE) AS A FROM rgba")
def exr_rgba(spark, d):
    return frames.rgba(frames.pixels(frames.file_rows(_files(spark, d, exr.ZIP)))).drop("part_id")


def _layered(spark, d) -> DataFrame:
    """A file for each 64 vectors, the four channels in the layer ``beauty`` and R again, as Z, without a layer."""
    long = rgba(spark, d).select(F.concat(F.lit("image"), F.floor(F.col("y") / 64).cast("string")).alias("path"), F.lit(0).alias("part_id"), (F.col("y") % 64).alias("y"), "x", F.expr("stack(5, 'beauty.R', R, 'beauty.G', G, 'beauty.B', B, 'beauty.A', A, 'Z', R) as (channel, value)"))
    return frames.encode(long, exr.ZIP, tile=(6, 20))


_IMAGE = "'image' || CAST(y // 64 AS VARCHAR) AS path, CAST(y % 64 AS INTEGER) AS y, x"


@query(f"WITH {SQL_RGBA} SELECT {_IMAGE}, 0 AS status, R, G, B, A FROM rgba")
def exr_layer_rgba(spark, d):
    return frames.load_rgba(_layered(spark, d), "beauty")


@query(f"WITH {SQL_RGBA} SELECT {_IMAGE}, 0 AS status, R, R AS G, R AS B, R AS A FROM rgba")
def exr_layer_single(spark, d):
    """Outside of layers there is one channel, which fills all four."""
    return frames.load_rgba(_layered(spark, d))


@query("SELECT DISTINCT 'image' || CAST(vec_id // 64 AS VARCHAR) AS path, -13 AS status FROM embeddings")
def exr_layer_absent(spark, d):
    return frames.load_rgba(_layered(spark, d), "depth").select("path", "status")


@query(f"WITH {SQL_RGBA} SELECT p.path, p.y, p.x, p.L, c.C FROM (SELECT {_IMAGE}, y AS row, CAST(R AS DOUBLE) AS L FROM rgba) p JOIN (SELECT y AS row, x AS col, CAST(G AS DOUBLE) AS C FROM rgba) c ON c.row = p.row // 2 * 2 AND c.col = p.x // 4 * 4")
def exr_subsampled(spark, d):
    """Files of a full channel and one that has each fourth column of each second line; it comes back on all pixels."""

    def make(key: tuple, group: pa.Table) -> pa.Table:
        y, x = group["y"].to_numpy(), group["x"].to_numpy()
        planes = {}
        for name, source in (("L", "R"), ("C", "G")):
            planes[name] = np.zeros((int(y.max()) + 1, int(x.max()) + 1), np.float32)
            planes[name][y, x] = group[source].to_numpy()
        part = exr.Part([exr.Channel("C", exr.FLOAT, 4, 2), exr.Channel("L")], planes["L"].shape[1], planes["L"].shape[0], exr.PIZ)
        return pa.table({"path": [key[0].as_py()], "content": pa.array([exr.encode_file([(part, {(0, 0): planes})])], pa.binary())})

    wide = rgba(spark, d).select(F.concat(F.lit("image"), F.floor(F.col("y") / 64).cast("string")).alias("path"), (F.col("y") % 64).cast("int").alias("y"), "x", "R", "G")
    samples = frames.pixels(frames.file_rows(wide.groupBy("path").applyInArrow(make, "path string, content binary")))
    return samples.groupBy("path", "y", "x").agg(F.max(F.when(F.col("channel") == "L", F.col("value"))).alias("L"), F.max(F.when(F.col("channel") == "C", F.col("value"))).alias("C"))


@query(f"WITH {SQL_RGBA} SELECT {_IMAGE}, 0 AS status, R, G, B, A FROM rgba")
def exr_simple_save(spark, d):
    """The simple save of wide pixels, loaded again."""
    wide = rgba(spark, d).select(F.concat(F.lit("image"), F.floor(F.col("y") / 64).cast("string")).alias("path"), (F.col("y") % 64).alias("y"), "x", *"RGBA")
    return frames.load_rgba(frames.encode_rgba(wide))


@query(f"WITH {SQL_RGBA}, {_LONG} SELECT * FROM long")
def exr_chunk_parallel(spark, d):
    """Files whose chunks are made, and read, by tasks of their own."""
    y = F.col("y")
    long = rgba(spark, d).select(F.concat(F.lit("image"), F.floor(y / 64).cast("string")).alias("path"), F.lit(0).alias("part_id"), (y % 64).alias("y"), "x", F.expr("stack(4, 'R', R, 'G', G, 'B', B, 'A', A) as (channel, value)"))
    return frames.pixels(frames.rows(frames.chunks(frames.encode(long, exr.PIZ, spread=True)), spread=True)).select("path", "y", "x", "channel", "value")


_MIPS = "mips AS (SELECT k, unnest(range(0, CAST(floor(log2(greatest(16, n))) AS INTEGER) + 1)) AS l, n FROM (SELECT y // 64 AS k, max(y % 64) + 1 AS n FROM rgba GROUP BY k)), level AS (SELECT k, l, CAST((y % 64) >> l AS INTEGER) AS y, CAST(x >> l AS INTEGER) AS x, R FROM mips JOIN rgba ON rgba.y // 64 = k WHERE (y % 64) % (1 << l) = 0 AND x % (1 << l) = 0 AND (y % 64) >> l < greatest(1, n >> l) AND x >> l < greatest(1, 16 >> l))"


@query(f"WITH {SQL_RGBA}, {_MIPS} SELECT 'image' || CAST(k AS VARCHAR) AS path, CAST(l AS INTEGER) AS level_x, CAST(l AS INTEGER) AS level_y, y, x, unnest(['R', 'column', 'mark']) AS channel, unnest([CAST(R AS DOUBLE), x, 4000000000 + y]) AS value, unnest([2, 1, 0]) AS pixel_type FROM level")
def exr_mipmap_files(spark, d):
    """Tiled files with all levels of a channel, each the first of 2 x 2 pixels, and channels of the other pixel types."""
    y, x, l = (F.col(c) for c in ("y", "x", "l"))
    wide = rgba(spark, d).select(F.floor(y / 64).alias("k"), (y % 64).cast("int").alias("y"), "x", "R")
    heights = wide.groupBy("k").agg((F.max("y") + 1).alias("n"))
    mips = heights.select("k", "n", F.explode(F.sequence(F.lit(0), levels.floor_log2(F.greatest(F.lit(16), F.col("n"))))).alias("l"))
    first = F.expr("y % shiftleft(1, l) = 0 and x % shiftleft(1, l) = 0 and shiftright(y, l) < greatest(1, shiftright(n, l)) and shiftright(x, l) < greatest(1, shiftright(16, l))")
    level = wide.join(mips, "k").where(first).select(F.concat(F.lit("image"), F.col("k").cast("string")).alias("path"), F.lit(0).alias("part_id"), l.alias("level_x"), l.alias("level_y"), F.expr("shiftright(y, l)").alias("y"), F.expr("shiftright(x, l)").alias("x"), "R")
    long = level.select("path", "part_id", "level_x", "level_y", "y", "x", F.expr("stack(3, 'R', double(R), 'column', double(x), 'mark', 4000000000D + y) as (channel, value)"))
    files = frames.encode(long, exr.PIZ, {"column": exr.HALF, "mark": exr.UINT}, (6, 20), level_mode=1)
    lines = frames.file_rows(files)
    return lines.select("path", "level_x", "level_y", "y", "x", "channel", "pixel_type", F.posexplode("values").alias("i", "value")).select("path", "level_x", "level_y", "y", (x + F.col("i")).alias("x"), "channel", "value", "pixel_type")


@query("""WITH n AS (SELECT vec_id // 64 AS k, count(*) AS n FROM embeddings GROUP BY k) SELECT 'image' || CAST(k AS VARCHAR) AS path, 0 AS part_id, 0 AS status, 3 AS compression, CAST(n AS INTEGER) AS height, 16 AS width, 4 AS n_channels, CAST(ceil(n / 16) AS INTEGER) AS chunk_count FROM n""")
def exr_headers(spark, d):
    p = frames.parts(_files(spark, d, exr.ZIP))
    return p.select("path", "part_id", "status", "compression", (F.col("data_window.max_y") + 1).alias("height"), (F.col("data_window.max_x") + 1).alias("width"), F.size("channels").alias("n_channels"), "chunk_count")


@query("SELECT 'image' || CAST(vec_id // 64 AS VARCHAR) AS path, 0 AS status, false AS tiled, false AS long_name, false AS non_image, false AS multipart, true AS is_image FROM embeddings GROUP BY vec_id // 64")
def exr_version_flags(spark, d):
    found = frames.version_flags(_files(spark, d, exr.NONE))
    return found.select("path", "status", "tiled", "long_name", "non_image", "multipart", frames.is_image(F.col("content")).alias("is_image"))


@query("SELECT doc_id, CASE WHEN strlen(text) < 8 THEN -4 ELSE -1 END AS status FROM documents WHERE text IS NOT NULL")
def exr_foreign_files(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return frames.version_flags(docs).select("doc_id", "status")


@query(f"WITH {SQL_NAMES}, c AS (SELECT 'p' || CAST(p_partkey // 6 AS VARCHAR) AS path, name FROM names GROUP BY ALL), o AS (SELECT path, name, CAST(row_number() OVER (PARTITION BY path ORDER BY encode(name)) - 1 AS INTEGER) AS position FROM c) SELECT path, nullif(regexp_extract(name, '^(.+)[.]([^.]+)$', 1), '') AS layer, min(position) AS first_position FROM o WHERE nullif(regexp_extract(name, '^(.+)[.]([^.]+)$', 1), '') IS NOT NULL GROUP BY ALL")
def exr_layers(spark, d):
    long = names(spark, d).select(F.concat(F.lit("p"), F.floor(F.col("p_partkey") / 6).cast("string")).alias("path"), F.lit(0).alias("part_id"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.col("name").alias("channel"), F.lit(1.0).alias("value"))
    return frames.layers(frames.parts(frames.encode(long))).select("path", "layer", "first_position")


@query("SELECT CAST(o_orderkey // 100 AS INTEGER) AS image, CAST(o_orderkey % 100 AS INTEGER) AS x, count(l_orderkey) AS n, coalesce(round(sum(CAST(CAST(l_quantity AS FLOAT) AS DOUBLE)), 3), 0) AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def exr_deep_files(spark, d):
    """Deep files of one line for each 100 orders, samples from their items; written, read and summed."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("float")).alias("q"))
    pixels = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.floor(F.col("o_orderkey") / 100).cast("int").alias("image"), (F.col("o_orderkey") % 100).cast("int").alias("x"), "q")

    def make(key: tuple, group: pa.Table) -> pa.Table:
        by_x = dict(zip(group["x"].to_pylist(), group["q"].to_pylist()))
        values = [by_x.get(x) or [] for x in range(100)]
        flat = np.array([v for q in values for v in q], np.float32)
        data = exr.encode_deep(exr.Part([exr.Channel("Z")], 100, 1, exr.ZIPS), [(np.array([len(q) for q in values]), {"Z": flat})])
        return pa.table({"path": [str(key[0].as_py())], "content": pa.array([data], pa.binary())})

    read = frames.deep(pixels.groupBy("image").applyInArrow(make, "path string, content binary"))
    sums = read.select(F.col("path").cast("int").alias("image"), "x", F.size("samples").cast("long").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, s: a + s["Z"].cast("double")), 3).alias("quantity"))
    return sums.join(pixels.select("image", "x"), ["image", "x"], "left_semi")


@query(f"WITH {SQL_PLANE} SELECT y, x, CAST(greatest(0, least(255, trunc(255 * CAST(v AS DOUBLE)))) AS INTEGER) AS u8 FROM plane")
def png_roundtrip(spark, d):
    """Lines of gray pixels as PNG files and back."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [images.read_png(images.write_png(np.array(v, np.uint8).reshape(1, -1, 1))).ravel().tolist() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.list_(pa.int32()))], ["y", "u8"])

    lines = packed(spark, d).select("y", F.transform("embedding", color.to_u8).alias("u8")).mapInArrow(scan, "y long, u8 array<int>")
    return lines.select("y", F.posexplode("u8").alias("x", "u8"))


@query(f"""WITH {SQL_RGBA}, s AS (SELECT y, x, pow(greatest(CAST(R AS DOUBLE), 0) * 4, 2) / 16 AS r, pow(greatest(CAST(G AS DOUBLE), 0) * 4, 2) / 16 AS g, pow(greatest(CAST(B AS DOUBLE), 0) * 4, 2) / 16 AS b FROM rgba),
m AS (SELECT *, ceil(least(greatest(r, g, b, 0.0625::DOUBLE), 1::DOUBLE) * 255) AS m FROM s)
SELECT y, x, CAST(floor(least(r / (m / 255), 1) * 255 + 0.5) AS INTEGER) AS R, CAST(floor(least(g / (m / 255), 1) * 255 + 0.5) AS INTEGER) AS G, CAST(floor(least(b / (m / 255), 1) * 255 + 0.5) AS INTEGER) AS B, CAST(m AS INTEGER) AS M FROM m""")
def rgbm_png(spark, d):
    """Lines of linear colours as RGBM PNG files, and the bytes in them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [images.read_png(images.write_rgbm_png(np.array(v, np.float64)[: len(v) // 4 * 4].reshape(1, -1, 4)[:, :, :3] * 4)).ravel().tolist() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.list_(pa.int32()))], ["y", "rgbm"])

    return grid.deinterleave(packed(spark, d).mapInArrow(scan, "y long, rgbm array<int>"), "rgbm", list("RGBM"), ["y"])


@query(f"WITH {SQL_RGBA} SELECT y, x, R, G, B, A FROM rgba")
def tiff_roundtrip(spark, d):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [images.read_float_tiff(images.write_float_tiff(np.array(v, np.float32)[: len(v) // 4 * 4].reshape(1, -1, 4))).ravel().tolist() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.list_(pa.float32()))], ["y", "embedding"])

    return grid.deinterleave(packed(spark, d).mapInArrow(scan, "y long, embedding array<float>"), "embedding", list("RGBA"), ["y"])


@query(f"""WITH {SQL_RGBA}, a AS (SELECT y, x, CAST(abs(R) AS DOUBLE) AS r, CAST(abs(G) AS DOUBLE) AS g, CAST(abs(B) AS DOUBLE) AS b FROM rgba), m AS (SELECT *, greatest(r, g, b) AS m FROM a),
e AS (SELECT *, CASE WHEN m > 1e-32 THEN floor(log2(m)) + 1 ELSE 0 END AS e FROM m)
SELECT y, x, CAST(CASE WHEN m > 1e-32 THEN floor(r * pow(2::DOUBLE, 8 - e)) * pow(2::DOUBLE, e - 8) ELSE 0 END AS FLOAT) AS R, CAST(CASE WHEN m > 1e-32 THEN floor(g * pow(2::DOUBLE, 8 - e)) * pow(2::DOUBLE, e - 8) ELSE 0 END AS FLOAT) AS G, CAST(CASE WHEN m > 1e-32 THEN floor(b * pow(2::DOUBLE, 8 - e)) * pow(2::DOUBLE, e - 8) ELSE 0 END AS FLOAT) AS B FROM e""")
def rgbe_roundtrip(spark, d):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for v in batch.column(1).to_pylist():
                rgb = np.abs(np.array(v, np.float64)[: len(v) // 4 * 4].reshape(1, -1, 4)[:, :, :3])
                lines.append(images.read_rgbe(images.write_rgbe(rgb)).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.list_(pa.float32()))], ["y", "rgb"])

    return grid.deinterleave(packed(spark, d).mapInArrow(scan, "y long, rgb array<float>"), "rgb", list("RGB"), ["y"])


def _below_shared(spark) -> str:
    """A new folder below the shared one, of this session."""
    from lucidframe.session import own_folder

    return own_folder(spark)


def _save(made: DataFrame, folder: str) -> None:
    """Saves files; what executors have written is not sent to the driver."""
    frames.save_files(made, folder).write.format("noop").mode("overwrite").save()


@query(f"WITH {SQL_RGBA}, {_LONG} SELECT path || '.exr' AS name, y, x, channel, value FROM long WHERE channel IN ('G', 'A')")
def exr_source_roundtrip(spark, d):
    """Files written and two of their channels read through the data source, below the shared folder."""
    from lucidframe.sources.exr import datasource

    datasource.register(spark)
    folder = _below_shared(spark).removeprefix("file:")
    folder = "/" + folder.lstrip("/") if folder.startswith("//") else folder
    _files(spark, d, exr.ZIP).write.format("exr").mode("append").save(folder)
    read = spark.read.format("exr").option("channels", "G,A").load(folder)
    return read.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "y", "x", "channel", "value")


@query("SELECT DISTINCT 'image' || CAST(vec_id // 64 AS VARCHAR) || CASE vec_id // 64 % 3 WHEN 1 THEN '.cut' WHEN 2 THEN '.odd' ELSE '' END AS name, CASE vec_id // 64 % 3 WHEN 1 THEN -5 WHEN 2 THEN -1 ELSE 0 END AS status FROM embeddings")
def exr_first_bytes(spark, d):
    """Sound, short and foreign files, told apart by their first eight bytes alone."""
    kind = F.regexp_extract("path", "([0-9]+)$", 1).cast("int") % 3
    made = _files(spark, d, exr.NONE).select(
        F.concat("path", F.when(kind == 1, ".cut").when(kind == 2, ".odd").otherwise("")).alias("path"),
        F.when(kind == 1, F.substring("content", 1, 7)).when(kind == 2, F.concat(F.lit(b"0123"), F.col("content"))).otherwise(F.col("content")).alias("content"),
    )
    folder = _below_shared(spark)
    _save(made, folder)
    return frames.read(spark, folder, "head").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "status")


@query(f"WITH {SQL_RGBA} SELECT 'image' || CAST(y // 64 AS VARCHAR) AS path, channel, CASE channel WHEN 'R' THEN 2 WHEN 'G' THEN 2 ELSE 1 END AS pixel_type, count(*) AS n FROM (SELECT y, unnest(['R', 'G', 'B', 'A']) AS channel FROM rgba) GROUP BY ALL")
def exr_requested_types(spark, d):
    """Halves of which two channels are read as floats."""
    lines = frames.file_rows(_files(spark, d, exr.ZIP, exr.HALF), requested={"R": exr.FLOAT, "G": exr.FLOAT})
    return lines.groupBy("path", "channel", "pixel_type").agg(F.sum(F.size("values")).alias("n"))


@query(f"WITH {SQL_PLANE}, u AS (SELECT y, x, CAST(greatest(0, least(255, trunc(255 * CAST(v AS DOUBLE)))) AS INTEGER) AS u8 FROM plane) SELECT 'line' || CAST(y AS VARCHAR) || '.png' AS name, 1 AS height, CAST(count(*) AS INTEGER) AS width, 1 AS components, CAST(sum(u8) AS BIGINT) AS total FROM u GROUP BY y")
def image_folder(spark, d):
    """A PNG file of each vector, in a folder that is read as images."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [images.write_png(np.array(v, np.uint8).reshape(1, -1, 1)) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["path", "content"])

    folder = _below_shared(spark)
    _save(packed(spark, d).select(F.concat(F.lit("line"), F.col("y").cast("string"), F.lit(".png")).alias("path"), F.transform("embedding", color.to_u8).alias("u8")).mapInArrow(scan, "path string, content binary"), folder)
    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length("pixels")), lambda i: F.conv(F.hex(F.substring(F.col("pixels"), i, F.lit(1))), 16, 10).cast("long"))
    return images.read_files(spark, folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "height", "width", "components", F.aggregate(bytes_, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query(f"WITH {SQL_RGBA} SELECT 'image' || CAST(y // 64 AS VARCHAR) AS name, count(*) * 4 AS n, round(sum(CAST(R AS DOUBLE) + CAST(G AS DOUBLE) + CAST(B AS DOUBLE) + CAST(A AS DOUBLE)), 4) + 0.0 AS total FROM rgba GROUP BY y // 64")
def exr_stream(spark, d):
    """Files written below the shared folder, read as a stream of packed lines and summed by file."""
    from lucidframe.session import delete_path
    from lucidframe.streaming.images import drain, stream_rows

    folder = _below_shared(spark)
    _save(_files(spark, d, exr.ZIP), folder)
    line = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    lines = drain(stream_rows(spark, folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.size("values").alias("n"), line.alias("total")))
    delete_path(spark, folder)
    return lines.groupBy("name").agg(F.sum("n").alias("n"), (F.round(F.sum("total"), 4) + 0.0).alias("total"))
