"""Layers are prefixes of channel names, up to the last dot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LAYER = r"^(.+)[.]([^.]+)$"


def layer_of(name: Column) -> Column:
    """The layer, or null: a dot at either end names none."""
    return F.nullif(F.regexp_extract(name, LAYER, 1), F.lit(""))


def list_layers(channels: DataFrame, name: str = "name", position: str = "position") -> DataFrame:
    """Distinct layers, with where each comes up first."""
    return channels.select(layer_of(F.col(name)).alias("layer"), position).where("layer is not null").groupBy("layer").agg(F.min(position).alias("first_position"))


def in_layer(name: Column, layer: Column) -> Column:
    """The channel's name within a layer, null if it is not in it.

    Without a layer: names without a dot, and names that start with their only leading dot, which goes.  With a layer:
    names that contain it with a dot; the prefix goes where it leads, else the whole name stays.
    """
    dotted = F.concat(layer, F.lit("."))
    last = F.length(name) - F.length(F.substring_index(name, ".", -1))  # place of the last dot, 0 if there is none
    bare = F.when(F.instr(name, ".") == 0, name).when(last == 1, F.substring(name, 2, 1 << 20))
    named = F.when(F.startswith(name, dotted), F.substring(name, F.length(dotted) + 1, F.lit(1 << 20))).when(F.contains(name, dotted), name)
    return F.when(F.coalesce(layer, F.lit("")) == "", bare).otherwise(named)


def name_in_layer(name: str, layer: str | None) -> str | None:
    """What ``in_layer`` gives, for one name."""
    if not layer:
        return name if "." not in name else name[1:] if name.rfind(".") == 0 else None
    dotted = f"{layer}."
    return name[len(dotted) :] if name.startswith(dotted) else name if dotted in name else None


def file_extension(path: Column) -> Column:
    """What follows the last dot, or nothing."""
    return F.when(F.instr(path, ".") > 0, F.substring_index(path, ".", -1)).otherwise("")


def short_name(name: Column, most: int = 255) -> Column:
    """The first bytes of a name."""
    return F.decode(F.substring(F.encode(name, "UTF-8"), 1, most), "UTF-8")
