"""Colour bands from red, green and blue in [0, 1]; every result is scaled to [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the triangular greenness index.
TGI_RED, TGI_BLUE = 0.39, 0.61

# Linear sRGB to XYZ (D65), and the D65 white point.
XYZ = [
    (0.412453, 0.357580, 0.180423),
    (0.212671, 0.715160, 0.072169),
    (0.019334, 0.119193, 0.950227),
]
WHITE = (0.95047, 1.0, 1.08883)


def tgi(red: Column, green: Column, blue: Column) -> Column:
    return (green - red * TGI_RED - blue * TGI_BLUE + 1.0) * 0.5


def hsv(red: Column, green: Column, blue: Column) -> list[Column]:
    """Hue in turns, saturation, value. Ties for the largest channel go to the first one."""
    high = F.greatest(red, green, blue)
    spread = high - F.least(red, green, blue)
    safe = F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    sector = (
        F.when(red == high, (green - blue) / safe)
        .when(green == high, (blue - red) / safe + 2.0)
        .otherwise((red - green) / safe + 4.0)
    )
    return [F.pmod(sector / 6.0, F.lit(1.0)), spread / (high + 1e-8), high]


def _linear(channel: Column) -> Column:
    return F.when(channel > 0.04045, F.pow((channel + 0.055) / 1.055, F.lit(2.4))).otherwise(channel / 12.92)


def _lab_curve(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 4.0 / 29.0)


def lab(red: Column, green: Column, blue: Column) -> list[Column]:
    """L/100, (a+128)/255, (b+128)/255."""
    rgb = [_linear(c) for c in (red, green, blue)]
    fx, fy, fz = (
        _lab_curve((rgb[0] * w[0] + rgb[1] * w[1] + rgb[2] * w[2]) / white) for w, white in zip(XYZ, WHITE)
    )
    return [
        (fy * 116.0 - 16.0) / 100.0,
        ((fx - fy) * 500.0 + 128.0) / 255.0,
        ((fy - fz) * 200.0 + 128.0) / 255.0,
    ]
