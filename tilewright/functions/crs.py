"""WGS 84 longitude/latitude to Dutch RD New coordinates and back.

The published polynomial approximation (Schreutelkamp and Strang van Hees): within about half a
metre inside the Netherlands, so not a replacement for the full datum grid.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reference point, and coefficients as (power of first, power of second, value).
LAT0, LON0, X0, Y0 = 52.15517440, 5.38720621, 155000.0, 463000.0
TO_X = [
    (0, 1, 190094.945), (1, 1, -11832.228), (2, 1, -114.221), (0, 3, -32.391), (1, 0, -0.705),
    (3, 1, -2.340), (1, 3, -0.608), (0, 2, -0.008), (2, 3, 0.148),
]
TO_Y = [
    (1, 0, 309056.544), (0, 2, 3638.893), (2, 0, 73.077), (1, 2, -157.984), (3, 0, 59.788),
    (0, 1, 0.433), (2, 2, -6.439), (1, 1, -0.032), (0, 4, 0.092), (1, 4, -0.054),
]
TO_LAT = [
    (0, 1, 3235.65389), (2, 0, -32.58297), (0, 2, -0.24750), (2, 1, -0.84978), (0, 3, -0.06550),
    (2, 2, -0.01709), (1, 0, -0.00738), (4, 0, 0.00530), (2, 3, -0.00039), (4, 1, 0.00033), (1, 1, -0.00012),
]
TO_LON = [
    (1, 0, 5260.52916), (1, 1, 105.94684), (1, 2, 2.45656), (3, 0, -0.81885), (1, 3, 0.05594),
    (3, 1, -0.05607), (0, 1, 0.01199), (3, 2, -0.00256), (1, 4, 0.00128), (0, 2, 0.00022),
    (2, 0, -0.00022), (5, 0, 0.00026),
]


def _polynomial(terms, u: Column, v: Column) -> Column:
    return reduce(add, [F.pow(u, F.lit(p)) * F.pow(v, F.lit(q)) * value for p, q, value in terms])


def lonlat_to_rd(lon: Column, lat: Column) -> tuple[Column, Column]:
    u, v = (lat - LAT0) * 0.36, (lon - LON0) * 0.36
    return _polynomial(TO_X, u, v) + X0, _polynomial(TO_Y, u, v) + Y0


def rd_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    u, v = (x - X0) * 1e-5, (y - Y0) * 1e-5
    return _polynomial(TO_LON, u, v) / 3600.0 + LON0, _polynomial(TO_LAT, u, v) / 3600.0 + LAT0


def ring_to_rd(ring: Column) -> Column:
    """A ring of longitude (x) and latitude (y) in RD coordinates."""
    def convert(p):
        x, y = lonlat_to_rd(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, convert)
