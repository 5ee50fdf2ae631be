"""Scoring tiles in overlapping windows, and generalising maps to surfaces."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import argmax
from ..schema import CELL_KEY
from .features import append_lab
from .grid import on_tile
from .stats import minmax_scale
from .surfaces import covered_cells, mask_to_surfaces


def tile_windows(cells: DataFrame, shapes: DataFrame, crop: int = 512, stride: int = 256) -> DataFrame:
    """Copy each cell into the windows that cover it, as ``wrow, wcol``.

    Windows start at multiples of ``stride`` until the raster is covered; rim windows are smaller.
    ``shapes`` has ``tile_id, n_rows, n_cols``.
    """
    if not 0 < stride <= crop:
        raise ValueError("stride must be positive and at most the window size")

    def covering(index: str, extent: str):
        last = F.ceil(F.greatest(F.col(extent) - crop, F.lit(0)) / stride)
        low = F.greatest(F.floor((F.col(index) - crop) / stride) + 1, F.lit(0))
        high = F.least(F.floor(F.col(index) / stride), last)
        return F.explode(F.sequence(low.cast("int"), high.cast("int")))

    rows = on_tile(cells, shapes.select("tile_id", "n_rows", "n_cols"))
    return rows.withColumn("wrow", covering("row_no", "n_rows")).withColumn(
        "wcol", covering("col_no", "n_cols")
    ).drop("n_rows", "n_cols")


def score_windows(windows: DataFrame, predict: Callable[[pd.DataFrame], "pd.Series"], bands: Sequence[str]) -> DataFrame:
    """Class probabilities of every cell in every window.

    ``predict`` gets one window as a frame (``row_no, col_no`` and bands, in scan order) and returns
    one probability list per row. A window is bounded by the crop size; model state should live in
    the function as a small object or be loaded lazily on the executor.
    """
    kept = windows.select("wrow", "wcol", *CELL_KEY, *bands)
    key_type = windows.schema["tile_id"].dataType.simpleString()

    def score(window: pd.DataFrame) -> pd.DataFrame:
        window = window.sort_values(["row_no", "col_no"], kind="stable").reset_index(drop=True)
        out = window[CELL_KEY].copy()
        out["probs"] = list(predict(window))
        return out

    # Scoring costs far more than its bytes suggest, so small shuffle outputs must not be merged.
    tasks = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = kept.repartition(tasks, "tile_id", "wrow", "wcol")
    return spread.groupBy("tile_id", "wrow", "wcol").applyInPandas(
        score, f"tile_id {key_type}, row_no int, col_no int, probs array<double>"
    )


def blend_windows(scores: DataFrame, classes: int) -> DataFrame:
    """Mean probabilities of each cell over its windows, class by class; partial sums are combined
    before the shuffle."""
    means = [F.avg(F.col("probs")[c]).alias(f"_{c}") for c in range(classes)]
    blended = scores.groupBy(*CELL_KEY).agg(*means)
    return blended.select(*CELL_KEY, F.array(*[F.col(f"_{c}") for c in range(classes)]).alias("probs"))


def classify_tile(
    stack: DataFrame,
    surfaces: DataFrame,
    grids: DataFrame,
    shapes: DataFrame,
    scales: DataFrame,
    predict: Callable,
    bands: Sequence[str],
    classes: int,
    crop: int = 512,
    stride: int = 256,
) -> DataFrame:
    """Material map ``tile_id, row_no, col_no, class_id``: mask, scale, add Lab, score, blend, mask."""
    masked = mask_to_surfaces(stack, surfaces, grids, list(bands), fill=0)
    scaled = append_lab(minmax_scale(masked, scales, bands))
    inputs = [*bands, "lab_l", "lab_a", "lab_b"]
    scores = score_windows(tile_windows(scaled, shapes, crop, stride), predict, inputs)
    labels = blend_windows(scores, classes).select(*CELL_KEY, argmax(F.col("probs")).alias("class_id"))
    return mask_to_surfaces(labels, surfaces, grids, ["class_id"], fill=0)


def require_stacks(tiles: DataFrame, stacks: DataFrame) -> DataFrame:
    """Pass tiles through, and raise on the first one that has no stack."""
    have = stacks.select("tile_id").distinct().withColumn("_have", F.lit(True))
    stop = F.raise_error(F.concat(F.lit("no raster stack for tile "), F.col("tile_id").cast("string")))
    return (
        tiles.join(have, "tile_id", "left")
        .withColumn("tile_id", F.when(F.col("_have"), F.col("tile_id")).otherwise(stop.cast(tiles.schema["tile_id"].dataType)))
        .drop("_have")
    )


def majority_of_zones(cells: DataFrame, zones: DataFrame, keep_background: bool = True) -> DataFrame:
    """Give every cell of a zone the zone's most frequent class; the lowest class wins ties.

    ``zones`` maps cells to ``zone``; cells outside keep their class. With ``keep_background`` cells
    of class 0 neither vote nor change. Votes are counted before the shuffle; only one winner per
    zone goes back to the cells.
    """
    zoned = cells.join(zones.select(*CELL_KEY, "zone"), CELL_KEY, "left")
    votes = zoned.where("zone is not null and class_id is not null")
    if keep_background:
        votes = votes.where("class_id <> 0")
    counts = votes.groupBy("tile_id", "zone", "class_id").agg(F.count("*").alias("n"))
    order = W.partitionBy("tile_id", "zone").orderBy(F.desc("n"), "class_id")
    winners = (
        counts.withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
        .select("tile_id", "zone", F.col("class_id").alias("_winner"))
    )
    # Cells outside all zones would share one NULL key; spread them over keys that match nothing.
    spread = F.coalesce(F.col("zone"), -1 - F.pmod(F.hash("row_no", "col_no"), F.lit(4096)).cast("bigint"))
    joined = zoned.withColumn("zone", spread).join(winners, ["tile_id", "zone"], "left")
    takes = F.col("_winner").isNotNull()
    if keep_background:
        takes = takes & (F.col("class_id") != 0)
    return joined.select(*CELL_KEY, F.when(takes, F.col("_winner")).otherwise(F.col("class_id")).alias("class_id"))


def zonal_majority(
    cells: DataFrame, surfaces: DataFrame, grids: DataFrame, keep_background: bool = True
) -> DataFrame:
    """:func:`majority_of_zones` with one zone per surface; the later surface wins an overlap."""
    covered = covered_cells(surfaces, grids, "surface_id")
    zones = covered.groupBy(*CELL_KEY).agg(F.max("surface_id").alias("zone"))
    return majority_of_zones(cells, zones, keep_background)
