"""Tile, chip and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: three digit groups of a tile id.
TILE_PATTERN = r"[0-9]{1,2}-[0-9]{3,4}-[0-9]{2,4}"


def normalize_tile_id(tile: Column) -> Column:
    return F.translate(tile, "/", "-")


def resolve_tile_id(path: Column) -> Column:
    """The first tile id in a path; NULL if there is none."""
    return F.nullif(F.regexp_extract(path, TILE_PATTERN, 0), F.lit(""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def sanitize_name(path: Column) -> Column:
    """Drop what the annotation provider put after ``_png``; the result names the GeoTIFF."""
    return F.concat(base_name(F.substring_index(path, "_png", 1)), F.lit(".tif"))


def chip_id(tile: Column, row: Column, col: Column) -> Column:
    return F.concat_ws("_", F.replace(tile, F.lit(".stack"), F.lit("")), row.cast("string"), col.cast("string"))
