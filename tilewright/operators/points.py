"""Point clouds: crop, merge, de-duplicate, and grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import record_coordinate, scale_coordinate, truncate
from .grid import center_x, center_y, empty_cells, on_tile, with_shape


def scale_coords(points: DataFrame, scale: float, offset: float = 0.0) -> DataFrame:
    """World coordinates ``x, y, z`` from the integer record."""
    return points.withColumns(
        {world: scale_coordinate(F.col(record), scale, offset) for world, record in zip("xyz", ("xi", "yi", "zi"))}
    )


def crop_points(points: DataFrame, bbox: Sequence[float], scale: float, offset: float = 0.0) -> DataFrame:
    """Points in a box, borders included, compared in integer record space.

    The limits are truncated toward zero. They are literals, so the filter reaches a Parquet scan.
    """
    xmin, ymin, xmax, ymax = (int((v - offset) / scale) for v in bbox)
    return points.where(F.col("xi").between(xmin, xmax) & F.col("yi").between(ymin, ymax))


def crop_to_grids(points: DataFrame, grids: DataFrame, scale: float, offset: float = 0.0) -> DataFrame:
    """:func:`crop_points` for many tiles at once, each with its own bounds."""
    limit = lambda name: truncate((F.col(f"_{name}") - offset) / scale)
    box = grids.select("tile_id", *[F.col(c).alias(f"_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    inside = F.col("xi").between(limit("xmin"), limit("xmax")) & F.col("yi").between(limit("ymin"), limit("ymax"))
    return on_tile(points, box).where(inside).select(*points.columns)


def bounds(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bounding box of points, per group or overall."""
    return df.groupBy(*by).agg(
        F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax")
    )


def dedupe_points(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The highest point at each integer position; the highest index wins equal heights.

    The rank filter is applied to every input partition before the shuffle, so a position that
    holds a large share of all points sends one row per partition.
    """
    order = W.partitionBy(*by, "xi", "yi").orderBy(F.desc("zi"), F.desc("idx"))
    return points.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def merge_points(
    clouds: Sequence[tuple[DataFrame, float, float]],
    crop: Sequence[float] | None = None,
    dedupe: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Crop each ``(cloud, scale, offset)``, re-express it in the first one's record space, append."""
    _, scale0, offset0 = clouds[0]
    parts = []
    for cloud, scale, offset in clouds:
        part = crop_points(cloud, crop, scale, offset) if crop is not None else cloud
        if (scale, offset) != (scale0, offset0):
            part = part.withColumns(
                {
                    c: record_coordinate(scale_coordinate(F.col(c), scale, offset), scale0, offset0)
                    for c in ("xi", "yi", "zi")
                }
            )
        parts.append(part)
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return dedupe_points(merged, by) if dedupe else merged


def _with_cells(points: DataFrame, grids: DataFrame, edge: str = "closed") -> DataFrame:
    """Give each point the cells it belongs to.

    ``closed``: distance to the centre at most half a cell along both axes, so a point on a shared
    edge is in each touching cell. ``half_open``: exactly one cell. Nothing is shuffled here as
    long as the grid table is under the broadcast threshold.
    """
    if edge not in ("closed", "half_open"):
        raise ValueError(f"unknown edge rule: {edge}")
    shapes = with_shape(grids).select("tile_id", "xmin", "ymax", "res", "n_rows", "n_cols")
    rows = on_tile(points, shapes)
    first_col = F.floor((F.col("x") - F.col("xmin")) / F.col("res")).cast("int")
    first_row = F.floor((F.col("ymax") - F.col("y")) / F.col("res")).cast("int")
    if edge == "closed":
        # The neighbours matter for points on an edge only; the distance test decides.
        around = lambda first: F.explode(F.array(first - 1, first, first + 1))
    else:
        around = lambda first: first
    near = lambda a, b: F.abs(a - b) <= F.col("res") / 2 if edge == "closed" else F.lit(True)
    rows = rows.withColumn("col_no", around(first_col)).where(
        F.col("col_no").between(0, F.col("n_cols") - 1) & near(F.col("x"), center_x(F.col("col_no")))
    )
    return rows.withColumn("row_no", around(first_row)).where(
        F.col("row_no").between(0, F.col("n_rows") - 1) & near(F.col("y"), center_y(F.col("row_no")))
    )


def point_density(points: DataFrame, grids: DataFrame, edge: str = "closed") -> DataFrame:
    """Number of points per cell, 0 for empty cells.

    Hits and empty cells are counted together, so there is one shuffle of partial counts and no join.
    """
    hits = _with_cells(points, grids, edge).select("tile_id", "row_no", "col_no", F.lit(1).alias("hit"))
    blank = empty_cells(with_shape(grids)).withColumn("hit", F.lit(0))
    return hits.unionByName(blank).groupBy("tile_id", "row_no", "col_no").agg(F.sum("hit").alias("density"))


def global_density(points: DataFrame, grids: DataFrame) -> DataFrame:
    """Points per unit of area of each whole tile."""
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    counts = points.groupBy("tile_id").agg(F.count("*").alias("n"))
    return grids.join(counts, "tile_id", "left").select(
        "tile_id", (F.coalesce("n", F.lit(0)) / area).alias("density")
    )


def grid_idw(
    points: DataFrame, grids: DataFrame, fields: Sequence[str], power: float = 2.0, edge: str = "closed",
    count: str | None = None,
) -> DataFrame:
    """Inverse-distance weighted fields at the cell centres; NULL where a cell holds no point.

    A point exactly at the centre gives the cell its value (lowest index first). All fields are
    gridded in one aggregate of sums, which combine before the shuffle even in a hot cell. ``count``
    names a column for the number of points, so that density on the same grid needs no second pass.
    """
    rows = _with_cells(points, grids, edge)
    distance = F.hypot(F.col("x") - center_x(F.col("col_no")), F.col("y") - center_y(F.col("row_no")))
    rows = rows.withColumn("_d", distance).select(
        "tile_id", "row_no", "col_no", *fields,
        F.when(F.col("_d") > 0, F.pow("_d", F.lit(-power))).alias("_w"),
        F.when(F.col("_d") == 0, F.col("idx")).alias("_exact"),
    )
    blank = empty_cells(with_shape(grids))
    rows = rows.unionByName(blank, allowMissingColumns=True)
    parts = []
    for f in fields:
        parts += [
            F.sum(F.col("_w") * F.col(f)).alias(f"_s_{f}"),
            F.sum(F.when(F.col(f).isNotNull(), F.col("_w"))).alias(f"_w_{f}"),
            F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("_exact"))).alias(f"_e_{f}"),
        ]
    if count is not None:
        parts.append(F.count(F.coalesce("_w", F.col("_exact").cast("double"))).alias(count))
    summed = rows.groupBy("tile_id", "row_no", "col_no").agg(*parts)
    return summed.select(
        "tile_id", "row_no", "col_no", *([count] if count is not None else []),
        *[F.coalesce(F.col(f"_e_{f}"), F.col(f"_s_{f}") / F.col(f"_w_{f}")).alias(f) for f in fields],
    )
