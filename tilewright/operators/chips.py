"""Chips: square blocks of a stack, their thinning, filtering and augmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit
from ..functions.naming import chip_id
from ..schema import BLOCK_SIZE
from .grid import on_tile
from .rank import bucketed_rank


def block_cells(cells: DataFrame, shapes: DataFrame, size: int = BLOCK_SIZE, full_only: bool = False) -> DataFrame:
    """Add ``brow, bcol`` and drop cells of blocks that are not square (right and lower rims).

    ``shapes`` has ``tile_id, n_rows, n_cols``. Square rim blocks stay unless ``full_only``.
    """
    keyed = _with_blocks(cells, size)
    return _square(on_tile(keyed, shapes.select("tile_id", "n_rows", "n_cols")), size, full_only).drop("n_rows", "n_cols")


def chip_blocks(shapes: DataFrame, size: int = BLOCK_SIZE, full_only: bool = False) -> DataFrame:
    """All square blocks of each tile from its shape alone, with their ``chip_id``."""
    last = lambda n: F.floor((F.col(n) - 1) / size).cast("int")
    rows = shapes.select(
        "tile_id", "n_rows", "n_cols", F.explode(F.sequence(F.lit(0), last("n_rows"))).alias("brow")
    )
    blocks = rows.withColumn("bcol", F.explode(F.sequence(F.lit(0), last("n_cols"))))
    blocks = _square(blocks, size, full_only).drop("n_rows", "n_cols")
    return blocks.withColumn("chip_id", chip_id(F.col("tile_id").cast("string"), F.col("brow"), F.col("bcol")))


def _with_blocks(cells: DataFrame, size: int) -> DataFrame:
    return cells.withColumns(
        {"brow": F.floor(F.col("row_no") / size).cast("int"), "bcol": F.floor(F.col("col_no") / size).cast("int")}
    )


def _square(blocks: DataFrame, size: int, full_only: bool) -> DataFrame:
    edge = lambda n, b: F.least(F.lit(size), F.col(n) - F.col(b) * size)
    height, width = edge("n_rows", "brow"), edge("n_cols", "bcol")
    kept = blocks.where(height == width)
    return kept.where(height == size) if full_only else kept


def thin_chips(blocks: DataFrame, seed, p: float = 0.5, run: int = 3) -> DataFrame:
    """Keep a block with probability ``p``, in scan order; after ``run`` kept ones drop the next.

    Draw and counter restart in every tile, so all tiles share one pattern, as the fixed seed per
    tile implies. Positions are ranked per block row, so a huge tile is not one task.
    """
    drawn = blocks.where(hash_unit(seed, F.col("brow"), F.col("bcol")) < p)
    ranked = bucketed_rank(drawn, "brow", ["bcol"], ["tile_id"], "_pos")
    return ranked.where((F.col("_pos") + 1) % (run + 1) != 0).drop("_pos")


def background_share(cells: DataFrame, band: str) -> DataFrame:
    """Cells and masked (NULL) cells of each chip."""
    return cells.groupBy("tile_id", "brow", "bcol").agg(
        F.count("*").alias("n_cells"), F.count_if(F.col(band).isNull()).alias("n_background")
    )


def background_filter(cells: DataFrame, band: str, cutoff: float) -> DataFrame:
    """Drop chips with more than ``cutoff`` masked cells (fraction, strict).

    A chip is a bounded window (one block), so counting and filtering share one shuffle.
    """
    chip = W.partitionBy("tile_id", "brow", "bcol")
    return (
        cells.withColumns(
            {"_bg": F.sum(F.col(band).isNull().cast("int")).over(chip), "_n": F.count(F.lit(1)).over(chip)}
        )
        .where(F.col("_bg") <= F.col("_n") * cutoff)
        .drop("_bg", "_n")
    )


def limit_chips(chips: DataFrame, limit: int, order: Sequence[str] = ("tile_id", "brow", "bcol")) -> DataFrame:
    """The first ``limit`` accepted chips in scan order: the requested sample size."""
    return chips.orderBy(*order).limit(limit)


def cells_of_chips(cells: DataFrame, chips: DataFrame, size: int = BLOCK_SIZE) -> DataFrame:
    """The cells of chosen chips only."""
    keyed = _with_blocks(cells, size)
    return keyed.join(chips.select("tile_id", "brow", "bcol", "chip_id"), ["tile_id", "brow", "bcol"])


def augment_dihedral(cells: DataFrame, image: str, size: int, seed) -> DataFrame:
    """Flip each square image left-right and top-down, then turn it by 90 degrees up to three times;
    every step has probability one half, drawn per image. Only positions change, so images and
    masks in one table move together."""
    coin = lambda step: hash_unit(f"{seed}{step}", F.col(image)) < 0.5
    last = size - 1
    col = F.when(coin("h"), last - F.col("col_no")).otherwise(F.col("col_no"))
    row = F.when(coin("v"), last - F.col("row_no")).otherwise(F.col("row_no"))
    turns = coin("r1").cast("int") + coin("r2").cast("int") + coin("r3").cast("int")
    moved = cells.withColumns({"_r": row, "_c": col, "_t": turns})
    turned = lambda r0, r1, r2, r3: (
        F.when(F.col("_t") == 1, r1).when(F.col("_t") == 2, r2).when(F.col("_t") == 3, r3).otherwise(r0).cast("int")
    )
    r, c = F.col("_r"), F.col("_c")
    return moved.withColumns(
        {"row_no": turned(r, last - c, last - r, c), "col_no": turned(c, r, last - c, last - r)}
    ).drop("_r", "_c", "_t")
