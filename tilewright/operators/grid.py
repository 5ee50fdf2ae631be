"""Raster geometry: shapes, cell centres, and exchange of neighbouring cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLOCK_SIZE
from .joins import checked_broadcast


def with_shape(grids: DataFrame) -> DataFrame:
    """``n_rows, n_cols`` of each grid: extent over resolution, rounded up."""
    size = lambda a, b: F.ceil((F.col(b) - F.col(a)) / F.col("res")).cast("int")
    return grids.withColumns({"n_rows": size("ymin", "ymax"), "n_cols": size("xmin", "xmax")})


def on_tile(df: DataFrame, per_tile: DataFrame) -> DataFrame:
    """Attach one-row-per-tile facts.

    Tiles are skewed keys, so ``df`` should not be shuffled by them: the facts are sent to every task after a check of
    their bytes (see ``checked_broadcast``). Facts beyond that bound join as adaptive execution finds best.
    """
    return df.join(checked_broadcast(per_tile), "tile_id")


def center_x(col: Column) -> Column:
    return F.col("xmin") + (col + 0.5) * F.col("res")


def center_y(row: Column) -> Column:
    return F.col("ymax") - (row + 0.5) * F.col("res")


def empty_cells(shapes: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Every cell of every grid with ``n_rows, n_cols``. Rows are spread before they are widened,
    so one large grid is generated by many tasks."""
    keep = list(keep)
    rows = shapes.select(
        "tile_id", "n_cols", *keep, F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row_no")
    )
    return rows.repartition("tile_id", "row_no").select(
        "tile_id", "row_no", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col_no"), *keep
    )


def cell_centers(grids: DataFrame) -> DataFrame:
    """World coordinates ``x, y`` of all cell centres, row 0 at the top."""
    cells = empty_cells(with_shape(grids), ["xmin", "ymax", "res"])
    return cells.select(
        "tile_id", "row_no", "col_no", center_x(F.col("col_no")).alias("x"), center_y(F.col("row_no")).alias("y")
    )


def halo_blocks(cells: DataFrame, halo: int, block: int = BLOCK_SIZE) -> DataFrame:
    """Cut rasters into blocks and copy a border of ``halo`` cells from the neighbours.

    Adds ``brow, bcol`` and ``owned`` (false for copies) and hash-partitions by block. Windows
    that start with ``tile_id, brow, bcol`` then run without a further shuffle, on groups whose
    size is fixed by ``block`` and not by the raster.
    """
    def blocks(index: Column) -> Column:
        return F.sequence(
            F.greatest(F.floor((index - halo) / block), F.lit(0)).cast("int"),
            F.floor((index + halo) / block).cast("int"),
        )

    out = cells.withColumn("brow", F.explode(blocks(F.col("row_no")))).withColumn(
        "bcol", F.explode(blocks(F.col("col_no")))
    )
    own = (F.floor(F.col("row_no") / block) == F.col("brow")) & (F.floor(F.col("col_no") / block) == F.col("bcol"))
    return out.withColumn("owned", own).repartition("tile_id", "brow", "bcol")
