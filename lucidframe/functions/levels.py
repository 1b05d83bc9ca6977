"""Resolution levels, tiles and blocks as Column builders; all in integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ONE_LEVEL, MIPMAP, RIPMAP = 0, 1, 2
#: Scanlines of a block by compression number (none, rle, zips, zip, piz) and of the optional floating codec.
BLOCK_LINES = {0: 1, 1: 1, 2: 1, 3: 16, 4: 32, 128: 16}


def floor_log2(x: Column) -> Column:
    """0 up to 1; exact, from the number of binary digits."""
    return F.when(x <= 1, 0).otherwise(F.length(F.bin(x.cast("long"))) - 1).cast("int")


def ceil_log2(x: Column) -> Column:
    return (floor_log2(x) + F.when((x > 1) & (F.bit_count(x.cast("long")) > 1), 1).otherwise(0)).cast("int")


def round_log2(x: Column, up: Column) -> Column:
    return F.when(up == 0, floor_log2(x)).otherwise(ceil_log2(x))


def num_x_levels(width: Column, height: Column, mode: Column, up: Column) -> Column:
    return F.when(mode == ONE_LEVEL, 1).when(mode == MIPMAP, round_log2(F.greatest(width, height), up) + 1).when(mode == RIPMAP, round_log2(width, up) + 1).otherwise(-1).cast("int")


def num_y_levels(width: Column, height: Column, mode: Column, up: Column) -> Column:
    return F.when(mode == ONE_LEVEL, 1).when(mode == MIPMAP, round_log2(F.greatest(width, height), up) + 1).when(mode == RIPMAP, round_log2(height, up) + 1).otherwise(-1).cast("int")


def level_size(top: Column, level: Column, up: Column) -> Column:
    """Pixels along one side of a level; -1 for a negative level."""
    scale = F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2.0), F.greatest(level, F.lit(0))).cast("int")
    size = F.floor(top / scale).cast("int") + F.when((up == 1) & (top % scale != 0), 1).otherwise(0)
    return F.when(level < 0, -1).otherwise(F.greatest(F.lit(1), size)).cast("int")


def level_index(lx: Column, ly: Column, mode: Column, nx: Column) -> Column:
    return F.when(mode == ONE_LEVEL, 0).when(mode == MIPMAP, lx).when(mode == RIPMAP, lx + ly * nx).otherwise(-1).cast("int")


def tiles_along(size: Column, tile: Column) -> Column:
    return F.ceil(size / tile).cast("int")


def tile_counts(top: Column, tile: Column, levels: Column, up: Column) -> Column:
    """Tiles along one side, an entry for each level."""
    return F.transform(F.sequence(F.lit(0), levels - 1), lambda i: tiles_along(level_size(top, i, up), tile))


def tile_blocks(x_counts: Column, y_counts: Column, mode: Column) -> Column:
    """Tiles of all levels, from the tiles along each side by level."""
    whole = lambda counts: F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n)
    along = whole(F.zip_with(x_counts, y_counts, lambda a, b: a.cast("long") * b))
    return F.when(mode == RIPMAP, whole(x_counts) * whole(y_counts)).otherwise(along)


def tile_size_at(size: Column, tile: Column, index: Column) -> Column:
    """What is left of a tile at the right or lower edge."""
    return F.least(tile, size - tile * index).cast("int")


def valid_tile(tx: Column, ty: Column, lx: Column, ly: Column, mode: Column, nx: Column, ny: Column, x_counts: Column, y_counts: Column) -> Column:
    """Whether coordinates name a tile: level by mode, tile by the counts of the level."""
    level = F.when(mode == ONE_LEVEL, (lx == 0) & (ly == 0)).when(mode == MIPMAP, (lx == ly) & (lx < nx) & (ly < ny)).when(mode == RIPMAP, (lx < nx) & (ly < ny)).otherwise(F.lit(False))
    inside = (tx < F.get(x_counts, F.greatest(lx, F.lit(0)).cast("int"))) & (ty < F.get(y_counts, F.greatest(ly, F.lit(0)).cast("int")))
    return F.coalesce((tx >= 0) & (ty >= 0) & (lx >= 0) & (ly >= 0) & level & inside, F.lit(False))


def block_lines(compression: Column) -> Column:
    out = F.lit(None).cast("int")
    for number, lines in BLOCK_LINES.items():
        out = F.when(compression == number, lines).otherwise(out)
    return out


def block_count(height: Column, compression: Column, declared: Column | None = None) -> Column:
    """Blocks of a part; a declared positive chunk count wins."""
    counted = F.ceil(height / block_lines(compression)).cast("int")
    return counted if declared is None else F.when(declared > 0, declared).otherwise(counted)


def tile_mode(byte: Column) -> tuple[Column, Column]:
    """(level mode, rounding) of the packed mode byte."""
    return byte.bitwiseAND(3), F.shiftright(byte, 4).bitwiseAND(1)


def tile_mode_byte(mode: Column, up: Column) -> Column:
    return mode.bitwiseOR(F.shiftleft(up, 4))
