"""Radius and nearest-neighbour joins between point sets, as equi-joins on grid bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import binned_join, explode_box, put_in_bin


def _minkowski(dx: Column, dy: Column, p: float) -> Column:
    if math.isinf(p):
        return F.greatest(F.abs(dx), F.abs(dy))
    if p == 2:
        return F.hypot(dx, dy)
    if p == 1:
        return F.abs(dx) + F.abs(dy)
    return F.pow(F.pow(F.abs(dx), F.lit(p)) + F.pow(F.abs(dy), F.lit(p)), F.lit(1.0 / p))


def _search(queries: DataFrame, points: DataFrame, radius: float, p: float) -> DataFrame:
    width = 2.0 * radius
    boxes = explode_box(
        queries, F.col("x") - radius, F.col("y") - radius, F.col("x") + radius, F.col("y") + radius, width
    )
    near = _minkowski(F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y"), p) <= radius
    return binned_join(put_in_bin(points, F.col("x"), F.col("y"), width), boxes, near)


def radius_join(queries: DataFrame, points: DataFrame, radius: float, p: float = math.inf) -> DataFrame:
    """``query_id, idx, distance`` of all points within ``radius`` (Minkowski ``p``); the distance
    is Euclidean whatever ``p`` is."""
    hits = _search(queries.select("query_id", "x", "y"), points.select("idx", "x", "y"), radius, p)
    distance = F.hypot(F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y"))
    return hits.select(F.col("r.query_id"), F.col("l.idx"), distance.alias("distance"))


# Bins of a level are this many times as wide as those of the level below, as a power of two; levels below the given width at most.
_STEP, _DEEPEST = 2, 20


class _Bins:
    """Square bins of ``width * 4**level`` with one common corner, so that a bin of a level is 16 bins of the level below."""

    def __init__(self, x0: float, y0: float, width: float) -> None:
        self.corner, self.width = {"x": x0, "y": y0}, width

    def size(self, level) -> Column:
        level = F.lit(level) if isinstance(level, int) else level
        return F.pow(F.lit(2.0), _STEP * level) * self.width

    def place(self, df: DataFrame, level) -> DataFrame:
        """The bin of a position on a level, as ``level, bx, by``."""
        at = lambda axis: F.floor((F.col(axis) - self.corner[axis]) / self.size(level)).cast("bigint")
        return df.withColumns({"level": F.lit(level) if isinstance(level, int) else level, "bx": at("x"), "by": at("y")})

    def _sides(self, axis: str) -> tuple[Column, Column]:
        low = self.corner[axis] + F.col(f"b{axis}") * self.size(F.col("level"))
        return low, low + self.size(F.col("level"))

    def nearest(self, p: float = 2) -> Column:
        """Distance of ``x, y`` from its nearest place in the bin."""
        gap = lambda axis: F.greatest(self._sides(axis)[0] - F.col(axis), F.col(axis) - self._sides(axis)[1], F.lit(0.0))
        return _minkowski(gap("x"), gap("y"), p)

    def farthest(self, p: float = 2) -> Column:
        reach = lambda axis: F.greatest(F.abs(F.col(axis) - self._sides(axis)[0]), F.abs(F.col(axis) - self._sides(axis)[1]))
        return _minkowski(reach("x"), reach("y"), p)

    def touched(self, df: DataFrame, reach: Column) -> DataFrame:
        """The bins of ``level`` that a circle may touch, instead of ``bx, by``."""
        for axis in "xy":
            at = lambda value: F.floor((value - self.corner[axis]) / self.size(F.col("level"))).cast("bigint")
            df = df.withColumn(f"b{axis}", F.explode(F.sequence(at(F.col(axis) - reach), at(F.col(axis) + reach))))
        return df


def _nodes(points: DataFrame, bins: _Bins, top: int, capacity: int) -> DataFrame:
    """``level, bx, by, n`` of all bins that hold points: levels 0 to ``top``, and below 0 wherever a bin holds more than ``capacity``.

    Points are counted once on level 0; wider bins are sums of these. Below, only points of overfull bins are counted again.
    Where ``points`` have ``copies``, their sum is a further column.
    """
    key = ["level", "bx", "by"]
    sums = [F.sum("copies").alias("copies")] if "copies" in points.columns else []
    count = lambda level, some: bins.place(some, level).groupBy(*key).agg(F.count("*").alias("n"), *sums)
    finest = count(0, points)
    wider = finest.drop("level").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumns(
        {b: F.expr(f"shiftright({b}, {_STEP} * level)") for b in ("bx", "by")}
    )
    nodes = cut_lineage(wider.groupBy(*key).agg(F.sum("n").alias("n"), *sums))
    level, dense = 0, nodes.where((F.col("level") == 0) & (F.col("n") > capacity))
    while level > -_DEEPEST and not dense.isEmpty():
        points = bins.place(points, level).join(dense.select(*key), key, "left_semi").drop(*key)
        level -= 1
        below = cut_lineage(count(level, points))
        nodes, dense = nodes.unionByName(below), below.where(F.col("n") > capacity)
    return nodes


def radius_count(queries: DataFrame, points: DataFrame, radius: float, p: float = math.inf, capacity: int = 256) -> DataFrame:
    """Only the number of points within ``radius`` of each query, 0 included.

    Copies of a position are counted before the join, on both sides: queries at one place are answered once. Places are
    counted in bins as wide as the ball, and bins of more than ``capacity`` places are cut further. A bin that lies wholly inside
    the ball is added as a number. Only bins on its border are paired place by place, overfull ones by their parts,
    so a dense ball costs what its border costs. ``capacity`` affects speed only.
    """
    places = points.groupBy("x", "y").agg(F.count("*").alias("copies"))
    asked = queries.select("x", "y").distinct()
    bins, key = _Bins(0.0, 0.0, 2.0 * radius), ["level", "bx", "by"]
    nodes = _nodes(places, bins, 0, capacity)
    if nodes.where(F.col("n") > capacity).isEmpty():
        # No place is crowded: every bin that the ball touches is paired at once.
        counted = _search(asked, places, radius, p).select("r.x", "r.y", F.col("l.copies").alias("n"))
    else:
        counted = _counted_by_bins(asked, places, nodes, bins, radius, p, capacity)
    found = counted.groupBy("x", "y").agg(F.sum("n").alias("n"))
    return queries.join(found, ["x", "y"], "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))


def _counted_by_bins(
    asked: DataFrame, places: DataFrame, nodes: DataFrame, bins: _Bins, radius: float, p: float, capacity: int
) -> DataFrame:
    """``x, y, n``: numbers that add up to the points in the ball around each asked place."""
    key = ["level", "bx", "by"]
    # A hair of doubt on both sides: bins in it count as border.
    inner = bins.farthest(p) * (1 + 1e-9) <= radius
    border = ~inner & (bins.nearest(p) <= radius * (1 + 1e-9) + 1e-12)
    held = bins.touched(asked.withColumn("level", F.lit(0)), F.lit(radius * (1 + 1e-9))).join(nodes, key)
    whole, paired = [], []
    for level in range(0, -_DEEPEST - 1, -1):
        held = cut_lineage(held.withColumns({"_inner": inner, "_border": border}).where("_inner or _border"))
        whole.append(held.where("_inner").select("x", "y", F.col("copies").alias("n")))
        full = F.col("_border") & (F.col("n") > capacity)
        if level == -_DEEPEST or held.where(full).isEmpty():
            paired.append(held.where("_border").select("x", "y", *key))
            break
        paired.append(held.where(F.col("_border") & (F.col("n") <= capacity)).select("x", "y", *key))
        parts = nodes.where(F.col("level") == level - 1).withColumns({f"_p{b}": F.shiftright(f"b{b}", _STEP) for b in "xy"})
        above = held.where(full).select("x", "y", F.col("bx").alias("_px"), F.col("by").alias("_py"))
        held = above.join(parts, ["_px", "_py"]).drop("_px", "_py")
    keyed = bins.place(places.withColumn("level", F.explode(F.array(*[F.lit(-k) for k in range(len(paired))]))), F.col("level"))
    edge = paired[0]
    for part in paired[1:]:
        edge = edge.unionByName(part)
    same = (F.col("l.level") == F.col("r.level")) & (F.col("l.bx") == F.col("r.bx")) & (F.col("l.by") == F.col("r.by"))
    near = _minkowski(F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y"), p) <= radius
    out = keyed.alias("l").join(edge.alias("r"), same & near).select("r.x", "r.y", F.col("l.copies").alias("n"))
    for part in whole:
        out = out.unionByName(part)
    return out


def _nearest_bins(q: DataFrame, nodes: DataFrame, bins: _Bins, top: int, k: int, capacity: int) -> tuple[DataFrame, list[int]]:
    """``query_id, x, y, level, bx, by, n``: bins that together hold the ``k`` nearest points of each query (see ``knn_join``); and their levels."""
    key = ["level", "bx", "by"]
    # The lowest level from ``cell`` on whose own bin holds k points; with too few points there is none: all count.
    enough = nodes.where((F.col("level") >= 0) & (F.col("n") >= k))
    asked = bins.place(q.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top)))), F.col("level"))
    own = asked.join(enough, key, "left").groupBy("query_id", "x", "y").agg(F.min(F.when(F.col("n").isNotNull(), F.col("level"))).alias("_level"))
    own = bins.place(own.withColumn("few", F.col("_level").isNull()).withColumn("level", F.coalesce("_level", F.lit(top))).drop("_level"), F.col("level"))
    reach = F.when(F.col("few"), F.lit(0.0)).otherwise(bins.farthest())
    begun = bins.touched(own.withColumn("_reach", reach), F.col("_reach")).drop("_reach", "few")
    begun = cut_lineage(begun.join(nodes, key))

    by_reach = W.partitionBy("query_id").orderBy("_far").rangeBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("query_id")

    def pruned(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_far", bins.farthest()).withColumn("_held", F.sum("n").over(by_reach))
        bound = F.min(F.when(F.col("_held") >= k, F.col("_far"))).over(whole)
        # A hair more, so that rounding loses no tie.
        near = F.coalesce(bins.nearest() <= bound * (1 + 1e-9) + 1e-12, F.lit(True))
        return rows.withColumn("_near", near).where("_near").drop("_far", "_held", "_near")

    # Levels are few: their number grows with the logarithm of the extent and of the density.
    most = {r["level"]: r["n"] for r in begun.groupBy("level").agg(F.max("n").alias("n")).collect()}
    if max(most.values(), default=0) <= capacity:
        return pruned(begun), sorted(most)
    levels = sorted(most, reverse=True)
    held = begun.limit(0)
    for level in range(levels[0], -_DEEPEST - 1, -1):
        held = held.unionByName(begun.where(F.col("level") == level)) if level in most else held
        full = (F.col("level") == level) & (F.col("n") > capacity)
        held = cut_lineage(pruned(held))
        if held.where(full).isEmpty():
            if level <= levels[-1]:
                break
            continue
        parts = nodes.where(F.col("level") == level - 1).withColumns({f"_p{b}": F.shiftright(f"b{b}", _STEP) for b in "xy"})
        above = held.where(full).select("query_id", "x", "y", F.col("bx").alias("_px"), F.col("by").alias("_py"))
        held = held.where(~full).unionByName(above.join(parts, ["_px", "_py"]).select("query_id", "x", "y", *key, "n"))
    return held, [r["level"] for r in held.select("level").distinct().collect()]


def knn_join(queries: DataFrame, points: DataFrame, k: int, cell: float, capacity: int | None = None) -> DataFrame:
    """The ``k`` nearest points of each query as ``query_id, idx, distance, rank`` (Euclidean; equal
    distances by index). Fewer than ``k`` rows only when there are fewer points.

    Points are counted in bins of ``cell * 4**level``; where a bin holds more than ``capacity`` (default: 64, or 4 ``k``), it is
    cut further, below ``cell`` too, until none does. A query begins with its own bin on the lowest level from ``cell`` on at which it holds ``k``
    points, and those around that a circle about this bin's far corner touches. Then, level by level, overfull bins are replaced by their parts.
    After each step a bin stays only if it may hold one of the nearest: it is no farther than the radius within which
    whole bins hold ``k`` points. So a query keeps a few bins of at most ``capacity`` points, however crowded a place
    near it is, and only these are paired. ``cell`` and ``capacity`` affect speed only.
    """
    q = queries.select("query_id", "x", "y")
    capacity = capacity or max(64, 4 * k)
    # Of the copies of one position only the k with the lowest index can be among the nearest.
    place = W.partitionBy("x", "y").orderBy("idx")
    p = points.select("idx", "x", "y").withColumn("_rn", F.row_number().over(place)).where(F.col("_rn") <= k).drop("_rn")

    # One row of extents is read to fix the bins' corner and the number of levels.
    x0, y0, x1, y1 = q.select("x", "y").unionByName(points.select("x", "y")).agg(
        F.min("x"), F.min("y"), F.max("x"), F.max("y")
    ).first()
    if x0 is None:
        raise ValueError("neither queries nor points have coordinates")
    bins = _Bins(x0, y0, float(cell))
    top = math.ceil(math.log2(max(max(x1 - x0, y1 - y0) / cell, 1.0)) / _STEP) + 1
    nodes = _nodes(p, bins, top, capacity)

    held, used = _nearest_bins(q, nodes, bins, top, k, capacity)
    keyed = bins.place(p.withColumn("level", F.explode(F.array(*[F.lit(v) for v in used or [top]]))), F.col("level"))
    distance = F.hypot(F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y"))
    same = (F.col("l.level") == F.col("r.level")) & (F.col("l.bx") == F.col("r.bx")) & (F.col("l.by") == F.col("r.by"))
    pairs = keyed.alias("l").join(held.alias("r"), same).select("r.query_id", "l.idx", distance.alias("distance"))
    ordered = W.partitionBy("query_id").orderBy("distance", "idx")
    return pairs.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)


def neighbor_query(queries: DataFrame, points: DataFrame, k: int | None = None, r: float | None = None, p: float = math.inf, cell: float = 1.0) -> DataFrame:
    """Nearest-``k`` or within-``r`` search; exactly one of the two must be given."""
    if (k is None) == (r is None):
        raise ValueError(f"give exactly one of k={k!r} and r={r!r}")
    return knn_join(queries, points, k, cell) if k is not None else radius_join(queries, points, r, p)
