"""Whole workflows: parse tiles to stacks, stacks to chips, annotations to a dataset."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import sanitize_name
from ..functions.numeric import db_to_linear
from ..operators.chips import background_filter, cells_of_chips, chip_blocks, limit_chips, thin_chips
from ..operators.grid import on_tile, with_shape
from ..operators.labels import class_counts, class_mapping, drop_invalid_class, reindex_class_table, reindex_classes, restrict_to_split
from ..operators.points import crop_to_grids, dedupe_points, grid_idw, point_density
from ..operators.raster import (
    fill_all_voids, mosaic, percentile_clip, preserve_total, replace_null, resample_bilinear, resample_nearest, slope,
    snap_bounds, stack_bands,
)
from ..operators.splits import random_split, stratified_split
from ..operators.stats import band_ranges, class_weights
from ..operators.surfaces import height_above_roof, mask_to_surfaces, surface_bounds
from ..schema import BANDS, BLOCK_SIZE, RGB
from ..session import cut_lineage

Stage = Callable[[DataFrame], DataFrame]


def run_stages(df: DataFrame, stages: Stage | Iterable[Stage] | None) -> DataFrame:
    """Apply stages in order; None means no work."""
    if stages is None:
        return df
    for stage in [stages] if callable(stages) else stages:
        df = df.transform(stage)
    return df


@dataclass(frozen=True)
class TileBands:
    """Layers of the same tiles on their own grids."""

    rgb: DataFrame
    reflectance: DataFrame
    slope: DataFrame
    ndrm: DataFrame
    density: DataFrame


def image_grids(surfaces: DataFrame, res: float) -> DataFrame:
    """Target grid per tile: bounds of its surfaces, moved outward to the image resolution."""
    return snap_bounds(surface_bounds(surfaces, ["tile_id"]), res)


def parse_images(images: DataFrame, grids: DataFrame) -> DataFrame:
    """Merge source images onto the tile grids."""
    return mosaic(images, grids, RGB)


def clean_points(points: DataFrame, grids: DataFrame, scale: float, offset: float = 0.0) -> DataFrame:
    """Crop to the tiles and drop the copies that overlapping sheets bring."""
    return dedupe_points(crop_to_grids(points, grids, scale, offset), ["tile_id"])


def parse_points(
    points: DataFrame, surfaces: DataFrame, grids: DataFrame, coarser: int = 3, fill: bool = True
) -> dict[str, DataFrame]:
    """Reflectance, elevation, slope, height above roof and density of cleaned points.

    The grids are three times coarser than the image, density has one-metre cells. Elevation and
    reflectance come from one pass over the points; with ``fill`` their voids are filled.
    """
    coarse = grids.withColumn("res", F.col("res") * coarser)
    gridded = grid_idw(points, coarse, ["z", "reflectance"])
    if fill:
        # Read once per band and filling pass, so it is stored once in the shared folder.
        gridded = cut_lineage(gridded)
    complete = lambda band: fill_all_voids(gridded, band) if fill else gridded.select("tile_id", "row_no", "col_no", band)
    elevation = complete("z")
    reflectance = complete("reflectance").withColumn("reflectance", db_to_linear(F.col("reflectance")))
    return {
        "reflectance": reflectance,
        "elevation": elevation,
        "slope": slope(on_tile(elevation, coarse.select("tile_id", "res")), "z", "res"),
        "ndrm": height_above_roof(elevation, surfaces, coarse),
        "density": point_density(points, grids.withColumn("res", F.lit(1.0))),
    }


def _shapes(source: DataFrame, target: DataFrame) -> DataFrame:
    s = with_shape(source).select("tile_id", F.col("n_rows").alias("src_rows"), F.col("n_cols").alias("src_cols"))
    t = with_shape(target).select("tile_id", F.col("n_rows").alias("dst_rows"), F.col("n_cols").alias("dst_cols"))
    return s.join(t, "tile_id")


def build_stack(rgb: DataFrame, layers: dict[str, DataFrame], grids: DataFrame, coarser: int = 3) -> DataFrame:
    """The seven-band stack on the image grid.

    Reflectance, slope and height are resampled bilinearly, height is clipped to percentiles 2-98;
    density is resampled to the nearest cell, keeps its total, and is clipped at percentile 98.
    """
    shapes = _shapes(grids.withColumn("res", F.col("res") * coarser), grids)
    fine = {band: resample_bilinear(layers[band], shapes, band) for band in ("reflectance", "slope", "ndrm")}
    fine["ndrm"] = percentile_clip(fine["ndrm"], "ndrm", 0.02, 0.98)
    dense = resample_nearest(layers["density"], _shapes(grids.withColumn("res", F.lit(1.0)), grids), "density")
    dense = percentile_clip(preserve_total(dense, layers["density"], "density"), "density", high=0.98)
    return stack_bands([(rgb, RGB), *[(fine[b], b) for b in ("reflectance", "slope", "ndrm")], (dense, "density")])


def cut_chips(
    stack: DataFrame, surfaces: DataFrame, grids: DataFrame, cutoff: float, seed=0, size: int = BLOCK_SIZE,
    bands: Sequence[str] = BANDS, limit: int | None = None,
) -> DataFrame:
    """Accepted chips as cells with ``chip_id``; masked cells are 0. With ``limit``, only the first so many in scan order.

    Blocks are chosen from the grid shapes first, so only their cells are read and masked.
    """
    blocks = thin_chips(chip_blocks(with_shape(grids), size), seed)
    cells = cells_of_chips(stack, blocks, size)
    masked = mask_to_surfaces(cells.withColumn("_valid", F.lit(1)), surfaces, grids, [*bands, "_valid"])
    accepted = replace_null(background_filter(masked, "_valid", cutoff).drop("_valid"), bands)
    if limit is None:
        return accepted
    key = ["tile_id", "brow", "bcol"]
    return accepted.join(limit_chips(accepted.select(*key).distinct(), limit), key, "left_semi")


def remask(masks: DataFrame, surfaces: DataFrame, grids: DataFrame, size: int = BLOCK_SIZE) -> DataFrame:
    """Masks ``image, row_no, col_no, class_id`` of chips with class 0 outside the surfaces of their tile.

    The place of a chip in its tile is read from its name (``chip_id``, with or without an extension). An image whose name holds none, or
    whose tile has no grid, raises.
    """
    part = lambda k: F.regexp_extract("image", r"^(.*)_(\d+)_(\d+)(\.[^_]*)?$", k)
    named = masks.select("image", "row_no", "col_no", "class_id", part(1).alias("tile_id"), part(2).alias("_brow"), part(3).alias("_bcol"))
    wrong = F.raise_error(F.concat(F.lit("no chip: "), "image")).cast("int")
    at = lambda cell, block: (F.col(cell) + F.when(F.col("tile_id") != "", F.col(block).cast("int")).otherwise(wrong) * size).cast("int")
    keep = named.withColumns({"_row": F.col("row_no"), "_col": F.col("col_no"), "row_no": at("row_no", "_brow"), "col_no": at("col_no", "_bcol")})
    known = keep.join(grids.select("tile_id", F.lit(True).alias("_grid")).distinct(), "tile_id", "left")
    # A condition on the rows, since values outside the surfaces are never looked at.
    known = known.where(F.when(F.col("_grid"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no grid: "), "tile_id")).cast("boolean")))
    masked = mask_to_surfaces(known.drop("_grid", "_brow", "_bcol"), surfaces, grids, ["class_id"])
    return masked.select("image", F.col("_row").alias("row_no"), F.col("_col").alias("col_no"), F.coalesce("class_id", F.lit(0)).cast("int").alias("class_id"))


@dataclass(frozen=True)
class Annotations:
    """Result of :func:`import_annotations`."""

    masks: DataFrame
    counts: DataFrame
    classes: DataFrame
    splits: DataFrame
    scales: DataFrame
    weights: DataFrame


def import_annotations(
    masks: DataFrame,
    images: DataFrame,
    classes: DataFrame,
    splitting: str = "stratified",
    weighting: str = "custom",
    lengths: Sequence[float] = (0.70, 0.15, 0.15),
    seed=0,
    sanitize: Callable[[Column], Column] = sanitize_name,
    surfaces: DataFrame | None = None,
    grids: DataFrame | None = None,
    chip_size: int = BLOCK_SIZE,
    **options,
) -> Annotations:
    """Masks ``image, row_no, col_no, class_id`` to dataset tables.

    ``sanitize`` maps provider file names to image names. With ``surfaces`` and ``grids``, everything outside the surfaces becomes
    background first (:func:`remask`, chips of ``chip_size``); without them the masks have to be masked already. Masks are rewritten once,
    with the new ids.
    """
    if (surfaces is None) != (grids is None):
        raise ValueError("give surfaces and grids, or none of them")
    masks = masks.withColumn("image", sanitize(F.col("image")))
    if surfaces is not None:
        masks = remask(masks, surfaces, grids, chip_size)
    named = drop_invalid_class(masks, classes)
    counts = class_counts(named)
    mapping = class_mapping(counts)
    new_counts = reindex_classes(counts, mapping)
    if splitting == "random":
        splits = random_split(counts.select("image"), lengths, seed)
    elif splitting == "stratified":
        splits = stratified_split(new_counts, lengths, seed=seed, **options)
    else:
        raise ValueError(f"unknown splitting method: {splitting}")
    # Every class is listed, so that one without training pixels is noticed.
    listed = mapping.select(F.col("new_id").alias("class_id"), F.lit(0).cast("bigint").alias("n"))
    training = restrict_to_split(new_counts, splits, "training").unionByName(listed, allowMissingColumns=True)
    return Annotations(
        masks=reindex_classes(named, mapping),
        counts=new_counts,
        classes=reindex_class_table(classes, mapping),
        splits=splits,
        scales=band_ranges(restrict_to_split(images, splits, "training")),
        weights=class_weights(training, weighting),
    )
