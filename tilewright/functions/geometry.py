"""Planar geometry on rings, i.e. ``array<struct<x, y>>``, closed or open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_ring(xmin, ymin, xmax, ymax) -> Column:
    """Closed ring of a rectangle."""
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    return F.array(*[vertex(x, y) for x, y in corners])


def vertex(x, y) -> Column:
    as_double = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(as_double(x).alias("x"), as_double(y).alias("y"))


def edges(ring: Column) -> Column:
    """Array of ``struct<p, q>`` over consecutive vertices, the last joined to the first."""
    turned = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _walk(ring: Column, start: Column, step, finish) -> Column:
    """Fold over the edges of a ring, the closing one included.

    The accumulator holds the first and the previous vertex, so the ring is evaluated once.
    """
    origin = vertex(0.0, 0.0)
    state = F.struct(F.lit(False).alias("on"), origin.alias("first"), origin.alias("last"), start.alias("value"))

    def advance(acc, v):
        here = vertex(v["x"], v["y"])
        return F.struct(
            F.lit(True).alias("on"),
            F.when(acc["on"], acc["first"]).otherwise(here).alias("first"),
            here.alias("last"),
            F.when(acc["on"], step(acc["value"], acc["first"], acc["last"], here)).otherwise(acc["value"]).alias("value"),
        )

    return F.aggregate(ring, state, advance, lambda acc: finish(step(acc["value"], acc["first"], acc["last"], acc["first"])))


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive counter-clockwise, 0 for an empty ring. Coordinates are taken
    relative to the first vertex, so large map coordinates do not cost precision."""
    def step(total, first, p, q):
        px, py, qx, qy = p["x"] - first["x"], p["y"] - first["y"], q["x"] - first["x"], q["y"] - first["y"]
        return total + (px * qy - qx * py)

    return _walk(ring, F.lit(0.0), step, lambda total: total * 0.5)


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_bounds(ring: Column) -> dict[str, Column]:
    return {
        "xmin": F.array_min(ring["x"]), "ymin": F.array_min(ring["y"]),
        "xmax": F.array_max(ring["x"]), "ymax": F.array_max(ring["y"]),
    }


def point_in_edges(sides: Column, px: Column, py: Column) -> Column:
    """Even-odd rule over :func:`edges`; an edge counts when it spans the point's height half-open.

    Store the edges once per ring where many points are tested against it.
    """
    def step(inside, e):
        p, q = e["p"], e["q"]
        crossing = (q["x"] - p["x"]) * (py - p["y"]) / (q["y"] - p["y"]) + p["x"]
        return F.when((p["y"] > py) == (q["y"] > py), inside).otherwise(inside != (px < crossing))

    return F.aggregate(sides, F.lit(False), step)


def point_in_ring(ring: Column, px: Column, py: Column) -> Column:
    return point_in_edges(edges(ring), px, py)


def _clip_to_line(ring: Column, line: Column) -> Column:
    """One Sutherland-Hodgman pass: the part of a ring where ``a*x + b*y >= c``."""
    depth = lambda v: line["a"] * v["x"] + line["b"] * v["y"] - line["c"]

    def step(e):
        p, q = e["p"], e["q"]
        t = depth(p) / (depth(p) - depth(q))
        cut = vertex(p["x"] + (q["x"] - p["x"]) * t, p["y"] + (q["y"] - p["y"]) * t)
        stay = vertex(q["x"], q["y"])
        return (
            F.when((depth(p) >= 0) & (depth(q) >= 0), F.array(stay))
            .when(depth(p) >= 0, F.array(cut))
            .when(depth(q) >= 0, F.array(cut, stay))
            .otherwise(F.slice(ring, 1, 0))
        )

    return F.flatten(F.transform(edges(ring), step))


def clipped_area(ring: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Area of the part of a ring that lies in a rectangle.

    The four sides are a fold over the ring, so that each pass is one expression, not a copy of all
    earlier ones.
    """
    line = lambda a, b, c: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c.alias("c"))
    sides = F.array(line(1.0, 0.0, xmin), line(-1.0, 0.0, -xmax), line(0.0, 1.0, ymin), line(0.0, -1.0, -ymax))
    return F.aggregate(sides, ring, _clip_to_line, area)
