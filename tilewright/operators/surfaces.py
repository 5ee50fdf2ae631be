"""Building surfaces and sheets: checks, matching, and rasterising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import area, clipped_area, edges, point_in_edges, ring_bounds
from ..schema import CELL_KEY, MAX_TILE_AREA
from .grid import center_x, center_y, empty_cells, on_tile, with_shape
from .joins import bin_of, binned_join, explode_level_box, level_of_box, levels_in, put_in_levels


def with_ring_bounds(surfaces: DataFrame) -> DataFrame:
    return surfaces.withColumns(ring_bounds(F.col("ring")))


def surface_bounds(surfaces: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bounding box over rings, per group or overall."""
    return with_ring_bounds(surfaces).groupBy(*by).agg(
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")
    )


def flag_invalid_rings(surfaces: DataFrame, mode: str = "keep") -> DataFrame:
    """``reason`` per ring: too_short, open, flat or NULL. ``drop`` removes bad rings, ``fail``
    raises on the first one met."""
    ring = F.col("ring")
    reason = (
        F.when(ring.isNull() | (F.size(ring) < 4), "too_short")
        .when(F.element_at(ring, 1) != F.element_at(ring, -1), "open")
        .when(area(ring) == 0, "flat")
    )
    flagged = surfaces.withColumn("reason", reason)
    if mode == "keep":
        return flagged
    if mode == "drop":
        return flagged.where("reason is null").drop("reason")
    if mode == "fail":
        stop = F.raise_error(F.concat(F.lit("invalid ring: "), F.col("reason")))
        return flagged.withColumn("reason", F.when(F.col("reason").isNotNull(), stop.cast("string")))
    raise ValueError(f"unknown mode: {mode}")


def dissolve(surfaces: DataFrame, by: Sequence[str] | None, order: str, carry: Sequence[str]) -> DataFrame:
    """Group rings into features: each ring keeps its row, and takes the other columns' values from
    its group (the first one known, by ``order``). Without ``by`` the whole table is one feature.

    Features stay lists of rings in long form. All uses ask whether a centre lies in any part, so
    no boundary has to be merged, and no group is ever collected.
    """
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    if not by:
        values = [F.min_by(c, known(c)).alias(c) for c in carry]
        one = surfaces.agg(*values).select(F.struct(*carry).alias("s")).scalar() if carry else F.lit(None)
        return surfaces.withColumn("_all", one).select(*[c for c in surfaces.columns if c not in carry], *[F.col("_all")[c].alias(c) for c in carry])
    first = surfaces.groupBy(*by).agg(*[F.min_by(c, known(c)).alias(c) for c in carry])
    return surfaces.drop(*carry).join(first, list(by))


def filter_tile_area(tiles: DataFrame, max_area: float = MAX_TILE_AREA) -> DataFrame:
    return tiles.where(area(F.col("ring")) <= max_area)


def clip_surfaces(surfaces: DataFrame, grids: DataFrame) -> DataFrame:
    """Surfaces whose bounding box meets their tile's raster."""
    g = grids.select("tile_id", *[F.col(c).alias(f"_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    meets = (
        (F.col("xmin") <= F.col("_xmax")) & (F.col("xmax") >= F.col("_xmin"))
        & (F.col("ymin") <= F.col("_ymax")) & (F.col("ymax") >= F.col("_ymin"))
    )
    names = ["xmin", "ymin", "xmax", "ymax"]
    added = [c for c in names if c not in surfaces.columns]
    return (
        on_tile(with_ring_bounds(surfaces), g).where(meets).drop(*added, *[f"_{c}" for c in names])
    )


def points_in_polygons(points: DataFrame, polygons: DataFrame, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of points and the rings that hold them; columns of both sides, ``by`` and the ring once.

    ``width`` is the edge of the smallest matching bins, about the size of a typical polygon. Larger polygons lie in larger
    bins, of the level of their own size, and points are looked up on every level that occurs; so a polygon takes a few
    rows, be it as large as a country.
    """
    box = [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    bounded = with_ring_bounds(polygons).withColumn("_sides", edges(F.col("ring"))).withColumn("_level", level_of_box(*box, width))
    boxes = explode_level_box(bounded, *box, width)
    inside = (
        F.col("l.x").between(F.col("r.xmin"), F.col("r.xmax"))
        & F.col("l.y").between(F.col("r.ymin"), F.col("r.ymax"))
        & point_in_edges(F.col("r._sides"), F.col("l.x"), F.col("l.y"))
    )
    placed = put_in_levels(points, F.col("x"), F.col("y"), width, levels_in(bounded))
    pairs = binned_join(placed, boxes, inside, [*by, "_level"])
    extra = [c for c in polygons.columns if c not in points.columns]
    return pairs.select(*[F.col(f"l.{c}") for c in points.columns], *[F.col(f"r.{c}") for c in extra])


def tiles_containing(points: DataFrame, tiles: DataFrame, width: float) -> DataFrame:
    """The tiles at each point."""
    kept = tiles.select("tile_id", "ring")
    return points_in_polygons(points, kept, width).drop("ring")


def covered_cells(surfaces: DataFrame, grids: DataFrame, feature: str, carry: Sequence[str] = ()) -> DataFrame:
    """Cells whose centre is inside each feature, by scan lines.

    Edges are cut by the rows of cell centres; consecutive crossings of a row are an inside span,
    and spans unfold to cells. The work grows with edges and covered cells; cells are never tested
    against polygons. Several rings of one feature follow the even-odd rule, so inner rings are holes.
    """
    carry = list(carry)
    shapes = with_shape(grids).select("tile_id", "xmin", "ymax", "res", "n_rows", "n_cols")
    lines = (
        on_tile(surfaces.select("tile_id", feature, *carry, F.explode(edges(F.col("ring"))).alias("e")), shapes)
        .withColumns({"_high": F.greatest("e.p.y", "e.q.y"), "_low": F.least("e.p.y", "e.q.y")})
    )
    to_row = lambda y: (F.col("ymax") - y) / F.col("res") - 0.5
    first = F.greatest(F.floor(to_row(F.col("_high"))).cast("int"), F.lit(0))
    last = F.least(F.ceil(to_row(F.col("_low"))).cast("int"), F.col("n_rows") - 1)
    crossed = lines.where(first <= last).withColumn("row_no", F.explode(F.sequence(first, last)))
    py = center_y(F.col("row_no"))
    crossed = crossed.where((F.col("e.p.y") > py) != (F.col("e.q.y") > py)).withColumn(
        "_at", (F.col("e.q.x") - F.col("e.p.x")) * (py - F.col("e.p.y")) / (F.col("e.q.y") - F.col("e.p.y")) + F.col("e.p.x")
    )
    line = W.partitionBy("tile_id", feature, "row_no").orderBy("_at")
    spans = (
        crossed.withColumns({"_k": F.row_number().over(line), "_to": F.lead("_at").over(line)})
        .where("_k % 2 = 1 and _to is not null")
    )
    to_col = lambda x: (x - F.col("xmin")) / F.col("res") - 0.5
    first = F.greatest(F.floor(to_col(F.col("_at"))).cast("int"), F.lit(0))
    last = F.least(F.ceil(to_col(F.col("_to"))).cast("int"), F.col("n_cols") - 1)
    px = center_x(F.col("col_no"))
    return (
        spans.where(first <= last)
        .withColumn("col_no", F.explode(F.sequence(first, last)))
        .where((px >= F.col("_at")) & (px < F.col("_to")))
        .select(*CELL_KEY, feature, *carry)
    )


def burn(surfaces: DataFrame, grids: DataFrame, feature: str, value: str, order: str) -> DataFrame:
    """``value`` of the last feature (by ``order``) over each covered cell; uncovered cells absent."""
    carry = [c for c in dict.fromkeys((value, order)) if c != feature]
    covered = covered_cells(surfaces, grids, feature, carry)
    return covered.groupBy(*CELL_KEY).agg(F.max_by(value, order).alias(value))


def rasterize_polygons(
    surfaces: DataFrame, grids: DataFrame, feature: str, value: str, order: str, fill=0
) -> DataFrame:
    """A full raster: the last covering feature's value, ``fill`` elsewhere."""
    carry = [c for c in dict.fromkeys((value, order)) if c != feature]
    covered = covered_cells(surfaces, grids, feature, carry).select(
        *CELL_KEY, F.col(value).alias("_value"), F.col(order).alias("_order")
    )
    blank = empty_cells(with_shape(grids))
    burned = (
        covered.unionByName(blank, allowMissingColumns=True)
        .groupBy(*CELL_KEY)
        .agg(F.max_by("_value", "_order").alias(value))
    )
    return burned.fillna(fill, subset=[value])


def mask_to_surfaces(
    cells: DataFrame, surfaces: DataFrame, grids: DataFrame, values: Sequence[str], feature: str = "surface_id", fill=None
) -> DataFrame:
    """Cells outside every surface become NULL, or ``fill``."""
    inside = covered_cells(surfaces, grids, feature).select(*CELL_KEY).distinct().withColumn("_in", F.lit(True))
    joined = cells.join(inside, CELL_KEY, "left")
    keep = lambda c: F.when(F.col("_in"), F.col(c)).otherwise(F.lit(fill).cast(cells.schema[c].dataType)).alias(c)
    return joined.select(*[keep(c) if c in values else F.col(c) for c in cells.columns])


def height_above_roof(dsm: DataFrame, surfaces: DataFrame, grids: DataFrame, value: str = "z") -> DataFrame:
    """Surface model minus the median roof height of the building (0 outside buildings).

    A building's height is that of its first surface; where buildings overlap the later id wins.
    """
    parts = surfaces.select("tile_id", "surface_id", "building_id", "h50", "ring")
    buildings = dissolve(parts, ["tile_id", "building_id"], "surface_id", ["h50"])
    roof = burn(buildings, grids, "surface_id", "h50", "building_id")
    return dsm.join(roof, CELL_KEY, "left").select(
        *CELL_KEY, (F.col(value) - F.coalesce("h50", F.lit(0.0))).alias("ndrm")
    )


def match_sheets(surfaces: DataFrame, sheets: DataFrame, width: float) -> DataFrame:
    """Which sheets cover a tile: unique ``tid`` and ``url`` arrays per tile and kind.

    A sheet counts when it shares area with a surface. Surfaces entirely inside a sheet are decided
    by bounds; only those on a sheet's border are clipped. ``width`` is the edge of the smallest matching bins; boxes
    take a few rows each, whatever their size.
    """
    box = [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    left = with_ring_bounds(surfaces.select("tile_id", "ring")).withColumn("_level", level_of_box(*box, width))
    right = sheets.withColumn("_level", level_of_box(*box, width))
    # Each box lies in bins of the level of its size; a pair meets on the level of the larger one.
    levels = levels_in(left, right)
    left, right = [explode_level_box(side, *box, width, levels) for side in (left, right)]
    c = lambda name: F.col(name)
    within = (
        (c("l.xmin") >= c("r.xmin")) & (c("l.xmax") <= c("r.xmax"))
        & (c("l.ymin") >= c("r.ymin")) & (c("l.ymax") <= c("r.ymax"))
    )
    touches = (
        (c("l.xmin") < c("r.xmax")) & (c("l.xmax") > c("r.xmin"))
        & (c("l.ymin") < c("r.ymax")) & (c("l.ymax") > c("r.ymin"))
    )
    part = clipped_area(c("l.ring"), c("r.xmin"), c("r.ymin"), c("r.xmax"), c("r.ymax"))
    overlap = touches & F.when(within, area(c("l.ring")) > 0).otherwise(part > 0)
    # A pair shares several bins; it is decided in that of the lower left corner of both boxes' overlap only.
    edge = F.pow(F.lit(2.0), c("r._level")) * width
    corner = (c("r._level") == F.greatest("l._own", "r._own")) & (c("r.bx") == F.greatest(bin_of(c("l.xmin"), edge), bin_of(c("r.xmin"), edge))) & (
        c("r.by") == F.greatest(bin_of(c("l.ymin"), edge), bin_of(c("r.ymin"), edge))
    )
    hits = binned_join(left, right, corner & overlap, ["_level"]).select(c("l.tile_id"), c("r.kind"), c("r.tid"), c("r.url"))
    # The two arrays are sorted together, so that a url stands where its id stands.
    pairs = hits.groupBy("tile_id", "kind").agg(F.array_sort(F.collect_set(F.struct("tid", "url"))).alias("s"))
    return pairs.select("tile_id", "kind", F.col("s.tid").alias("tid"), F.col("s.url").alias("url"))


def asset_manifests(matches: DataFrame) -> DataFrame:
    """One nested manifest per tile from :func:`match_sheets`."""
    side = lambda kind: F.struct(
        *[
            F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(c))), F.array().cast("array<string>")).alias(c)
            for c in ("tid", "url")
        ]
    )
    return matches.groupBy("tile_id").agg(side("image").alias("image"), side("lidar").alias("lidar")).select(
        F.col("tile_id").alias("tid"), "image", "lidar"
    )
