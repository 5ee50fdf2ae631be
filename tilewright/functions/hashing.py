"""Seeded pseudo-random numbers from row keys.

A value depends on seed and key only, never on the partition, so a recomputed task gives the same
rows again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_unit(seed, *keys: Column) -> Column:
    """Uniform in [0, 1) with 32 bits: the first eight hex digits of md5('seed:key:key...')."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(2**32)


def hash_normal_pair(seed, *keys: Column) -> tuple[Column, Column]:
    """Two independent standard normal values (Box-Muller)."""
    radius = F.sqrt(F.log(1.0 - hash_unit(f"{seed}r", *keys)) * -2.0)
    angle = hash_unit(f"{seed}a", *keys) * (2.0 * math.pi)
    return radius * F.cos(angle), radius * F.sin(angle)
