"""Raster algebra on long cell tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import clip
from ..schema import BLOCK_SIZE, CELL_KEY
from ..session import cut_lineage
from .grid import halo_blocks, on_tile
from .quantiles import exact_quantiles


def _block_window(line: str, order: str):
    return W.partitionBy("tile_id", "brow", "bcol", line).orderBy(order)


def slope(
    cells: DataFrame, value: str, res: float | str, degrees: bool = True, block: int = BLOCK_SIZE, keep: Sequence[str] = ()
) -> DataFrame:
    """Steepness of a surface: central differences inside, one-sided at the raster's edge.

    ``res`` is a number, or the name of a column with the resolution of each tile. NULL where the cell or a
    neighbour it needs is NULL, or an axis is one cell wide. Blocks carry
    a one-cell border, so both directions cost one shuffle together. Columns in ``keep`` come along,
    which saves joining the slope back.
    """
    own = [res] if isinstance(res, str) else []
    blocks = halo_blocks(cells.select(*dict.fromkeys([*CELL_KEY, value, *own, *keep])), 1, block)
    size = F.col(res) if own else F.lit(res)

    def gradient(line: str, order: str) -> Column:
        window = _block_window(line, order)
        here, v = F.col(order), F.col(value)
        has_prev = F.lag(order).over(window) == here - 1
        has_next = F.lead(order).over(window) == here + 1
        prev, nxt = F.lag(value).over(window), F.lead(value).over(window)
        return (
            F.when(has_prev & has_next, (nxt - prev) / (size * 2))
            .when(has_next, (nxt - v) / size)
            .when(has_prev, (v - prev) / size)
        )

    steps = blocks.withColumn("_gy", gradient("col_no", "row_no")).withColumn("_gx", gradient("row_no", "col_no"))
    angle = F.atan(F.hypot("_gy", "_gx"))
    known = F.col(value).isNotNull()
    return steps.where("owned").select(*CELL_KEY, *keep, F.when(known, F.degrees(angle) if degrees else angle).alias("slope"))


def fill_voids(cells: DataFrame, value: str, radius: int = 100, block: int = BLOCK_SIZE) -> DataFrame:
    """One filling pass: a NULL cell becomes the mean of the nearest valid cells to the west, east,
    north and south within ``radius`` cells, weighted by inverse distance."""
    blocks = halo_blocks(cells.select(*CELL_KEY, value), radius, block)

    def nearest(line: str, order: str, ahead: bool) -> Column:
        window = _block_window(line, order)
        window = (
            window.rowsBetween(1, W.unboundedFollowing) if ahead else window.rowsBetween(W.unboundedPreceding, -1)
        )
        seen = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).alias("v")))
        pick = F.first(seen, ignorenulls=True) if ahead else F.last(seen, ignorenulls=True)
        return pick.over(window)

    found = blocks.withColumns(
        {"_n": nearest("col_no", "row_no", False), "_s": nearest("col_no", "row_no", True)}
    ).withColumns({"_w": nearest("row_no", "col_no", False), "_e": nearest("row_no", "col_no", True)})
    top, bottom = F.lit(0.0), F.lit(0.0)
    for name, order in (("_n", "row_no"), ("_s", "row_no"), ("_w", "col_no"), ("_e", "col_no")):
        gap = F.abs(F.col(name)["at"] - F.col(order))
        usable = F.coalesce(gap <= radius, F.lit(False))
        top += F.when(usable, F.col(name)["v"] / gap).otherwise(0.0)
        bottom += F.when(usable, F.lit(1.0) / gap).otherwise(0.0)
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(bottom > 0, top / bottom)
    return found.where("owned").select(*CELL_KEY, filled.alias(value))


def fill_all_voids(cells: DataFrame, value: str, radius: int = 100, block: int = BLOCK_SIZE) -> DataFrame:
    """Repeat :func:`fill_voids` until nothing is NULL or a pass changes nothing.

    Each pass is checkpointed to the shared folder; a raster without any valid cell stays NULL. The
    input is read by every pass up to the first checkpoint, so pass a stored table.
    """
    current, missing = cells.select(*CELL_KEY, value), None
    while True:
        left = current.where(F.col(value).isNull()).count()
        if left == 0 or left == missing:
            return current
        missing = left
        current = cut_lineage(fill_voids(current, value, radius, block))


def snap_bounds(bounds: DataFrame, res: float) -> DataFrame:
    """Move bounds outward to multiples of the resolution."""
    down = lambda c: F.floor(F.col(c) / res) * res
    up = lambda c: F.ceil(F.col(c) / res) * res
    return bounds.withColumns(
        {"xmin": down("xmin"), "ymin": down("ymin"), "xmax": up("xmax"), "ymax": up("ymax"), "res": F.lit(float(res))}
    )


def mosaic(cells: DataFrame, grids: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Merge overlapping rasters of a tile; the valid source with the lowest ``priority`` wins.

    ``cells`` holds centres ``x, y`` per source; ``grids`` are snapped target bounds. Bands are
    chosen one by one and combine before the shuffle.
    """
    g = grids.select("tile_id", "xmin", "ymin", "xmax", "ymax", "res")
    placed = (
        on_tile(cells, g)
        .where(
            (F.col("x") >= F.col("xmin")) & (F.col("x") < F.col("xmax"))
            & (F.col("y") > F.col("ymin")) & (F.col("y") <= F.col("ymax"))
        )
        .withColumns(
            {
                "row_no": F.floor((F.col("ymax") - F.col("y")) / F.col("res")).cast("int"),
                "col_no": F.floor((F.col("x") - F.col("xmin")) / F.col("res")).cast("int"),
            }
        )
    )
    first = lambda b: F.min_by(F.col(b), F.when(F.col(b).isNotNull(), F.col("priority"))).alias(b)
    return placed.groupBy(*CELL_KEY).agg(*[first(b) for b in bands])


def _targets(index: Column, src: Column, dst: Column, shift: float) -> Column:
    """Candidate target positions along one axis for source position ``index``; the caller tests
    them exactly. The first source position also takes what lies before it."""
    ratio = dst / src
    low = F.when(index == 0, F.lit(0)).otherwise(F.floor((index + shift) * ratio - 1.0).cast("int"))
    high = F.ceil((index + 1 + shift) * ratio).cast("int")
    return F.explode(F.sequence(F.least(low, dst - 1), F.least(high, dst - 1)))


def _spread(rows: DataFrame, source, shift: float) -> DataFrame:
    """Unfold source cells to the target cells ``_r, _c`` that read them."""
    for target, index, src, dst in (("_r", "row_no", "src_rows", "dst_rows"), ("_c", "col_no", "src_cols", "dst_cols")):
        axis = [F.col(src), F.col(dst)]
        rows = rows.withColumn(target, _targets(F.col(index), *axis, shift)).where(
            source(F.col(target), *axis) == F.col(index)
        )
    return rows


def resample_nearest(cells: DataFrame, shapes: DataFrame, value: str) -> DataFrame:
    """Each source cell emits the target cells that read it: no shuffle.

    ``shapes`` has ``tile_id, src_rows, src_cols, dst_rows, dst_cols``.
    """
    source = lambda i, src, dst: F.floor((i + 0.5) * src / dst)
    rows = _spread(on_tile(cells.select(*CELL_KEY, value), shapes), source, 0.0)
    return rows.select("tile_id", F.col("_r").alias("row_no"), F.col("_c").alias("col_no"), value)


def resample_bilinear(cells: DataFrame, shapes: DataFrame, value: str, block: int = BLOCK_SIZE) -> DataFrame:
    """Bilinear resampling with the weights renormalised over valid cells.

    Every source cell first picks up its right, lower and lower-right neighbour inside its block
    (one shuffle of the source plus a one-cell border); the finer target is then written locally.
    """
    blocks = halo_blocks(cells.select(*CELL_KEY, value), 1, block)
    along_row = _block_window("row_no", "col_no")
    along_col = _block_window("col_no", "row_no")
    right = F.when(F.lead("col_no").over(along_row) == F.col("col_no") + 1, F.lead(value).over(along_row))
    quad = blocks.select("tile_id", "brow", "bcol", "owned", "row_no", "col_no", F.col(value).alias("_a"), right.alias("_b"))
    follows = F.lead("row_no").over(along_col) == F.col("row_no") + 1
    quad = quad.withColumns(
        {"_c0": F.when(follows, F.lead("_a").over(along_col)), "_d0": F.when(follows, F.lead("_b").over(along_col))}
    ).where("owned")
    quad = on_tile(quad.select(*CELL_KEY, "_a", "_b", "_c0", "_d0"), shapes)

    # Positions left of the first centre read the first cell alone; the last cell has no follower.
    position = lambda i, src, dst: (i + 0.5) * src / dst - 0.5
    source = lambda i, src, dst: F.greatest(F.floor(position(i, src, dst)), F.lit(0))

    def fraction(target: str, index: str, src: str, dst: str) -> Column:
        f = position(F.col(target), F.col(src), F.col(dst)) - F.col(index)
        last = F.col(index) == F.col(src) - 1
        return F.when(last, F.lit(0.0)).otherwise(F.greatest(f, F.lit(0.0)))

    fine = _spread(quad, source, 0.5).withColumns(
        {
            "_fr": fraction("_r", "row_no", "src_rows", "dst_rows"),
            "_fc": fraction("_c", "col_no", "src_cols", "dst_cols"),
        }
    )
    fr, fc = F.col("_fr"), F.col("_fc")
    weights = {"_a": (1 - fr) * (1 - fc), "_b": (1 - fr) * fc, "_c0": fr * (1 - fc), "_d0": fr * fc}
    valid = {c: F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()}
    fine = fine.withColumns({f"{c}w": w for c, w in valid.items()})
    bottom = sum((F.col(f"{c}w") for c in valid), F.lit(0.0))
    top = sum((F.coalesce(c, F.lit(0.0)) * F.col(f"{c}w") for c in valid), F.lit(0.0))
    fine = fine.withColumns({"_top": top, "_bottom": bottom})
    return fine.select(
        "tile_id", F.col("_r").alias("row_no"), F.col("_c").alias("col_no"),
        F.when(F.col("_bottom") > 0, F.col("_top") / F.col("_bottom")).alias(value),
    )


def preserve_total(resampled: DataFrame, original: DataFrame, value: str) -> DataFrame:
    """Scale resampled values so that each tile keeps its original sum."""
    before = original.groupBy("tile_id").agg(F.sum(value).alias("_before"))
    after = resampled.groupBy("tile_id").agg(F.sum(value).alias("_after"))
    factor = before.join(after, "tile_id").select("tile_id", (F.col("_before") / F.nullif("_after", F.lit(0))).alias("_f"))
    return resampled.join(factor, "tile_id").withColumn(value, F.col(value) * F.col("_f")).drop("_f")


def percentile_clip(
    cells: DataFrame, value: str, low: float | None = None, high: float | None = None, by: Sequence[str] = ("tile_id",)
) -> DataFrame:
    """Clip a band to its own exact percentiles (fractions), per tile by default."""
    limits = exact_quantiles(cells, value, [q for q in (low, high) if q is not None], by)
    pick = lambda q: F.max(F.when(F.col("q") == q, F.col("quantile"))) if q is not None else F.lit(None).cast("double")
    wide = limits.groupBy(*by).agg(pick(low).alias("low"), pick(high).alias("high"))
    pair = F.struct("low", "high").alias("_limits")
    if by:
        rows = cells.join(wide.select(*by, pair), list(by))
    else:
        rows = cells.withColumn("_limits", wide.select(pair).scalar())
    bounds = [F.col(f"_limits.{c}") if q is not None else None for c, q in (("low", low), ("high", high))]
    return rows.withColumn(value, clip(F.col(value), *bounds)).drop("_limits")


def stack_bands(layers: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Put one band per layer side by side on the first layer's grid, in the given order.

    All layers are joined on the cell key, so they are partitioned alike and sorted once.
    """
    stack, name = layers[0]
    stack = stack.select(*CELL_KEY, name) if isinstance(name, str) else stack.select(*CELL_KEY, *name)
    for layer, band in layers[1:]:
        stack = stack.join(layer.select(*CELL_KEY, band), CELL_KEY, "left")
    return stack


def replace_null(cells: DataFrame, columns: Sequence[str], value=0) -> DataFrame:
    """Masked cells become a plain value."""
    return cells.fillna(value, subset=list(columns))
