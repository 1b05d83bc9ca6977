"""Checks and sums over the parts and chunks of a file, as aggregate Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def names_differ(name: Column) -> Column:
    """Whether the parts of a file have names of their own."""
    return F.countDistinct(name) == F.count(F.lit(1))


def header_bytes(size: Column) -> Column:
    return F.sum(size)


def level_count(level_x: Column, level_y: Column) -> Column:
    return F.countDistinct(level_x, level_y)


def any_damaged(offset: Column) -> Column:
    """Whether a chunk table has an offset that no chunk has."""
    return F.bool_or(offset <= 0)


def error_flags(flag: Column) -> Column:
    """All errors met in the chunks of a part."""
    return F.bit_or(flag)


def tile_place(index: Column, across: Column) -> tuple[Column, Column]:
    """Column and row of a tile from its place in the order of tiles."""
    return F.pmod(index, across).cast("int"), F.floor(index / across).cast("int")
