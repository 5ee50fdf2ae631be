"""Arithmetic on columns and on probability arrays. NULL is nodata and stays NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low=None, high=None) -> Column:
    """Bound a value; unlike bare ``least``/``greatest`` a NULL value stays NULL."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        bounded = F.least(bounded, high if isinstance(high, Column) else F.lit(high))
    return F.when(value.isNotNull(), bounded)


def db_to_linear(value: Column, cap: float | None = 1.0) -> Column:
    """Decibel to linear scale, capped: values above 1 are noise."""
    return clip(F.pow(F.lit(10.0), value * 0.1), high=cap)


def nodata_to_null(value: Column, nodata: float = float("nan")) -> Column:
    """NaN or a numeric nodata mark becomes NULL."""
    mark = F.lit(nodata)
    return F.when(F.isnan(value), None).otherwise(value) if nodata != nodata else F.nullif(value, mark)


def scale_coordinate(record: Column, scale, offset) -> Column:
    """Integer record coordinate to world coordinate."""
    return record * scale + offset


def record_coordinate(world: Column, scale, offset) -> Column:
    """World coordinate to the nearest integer record coordinate."""
    return F.round((world - offset) / scale).cast("bigint")


def truncate(value: Column) -> Column:
    """Toward zero, as an integer."""
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("bigint")


def minmax(value: Column, low, high, eps: float = 1e-12) -> Column:
    return (value - low) / (high - low + eps)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once. Spark repeats an expression at each place that names it, in a lambda for every element."""
    return F.transform(F.array(value), use)[0]


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores, shifted by the maximum for stability."""
    exps = bound(scores, lambda v: bound(F.array_max(v), lambda m: F.transform(v, lambda s: F.exp(s - m))))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return bound(exps, lambda e: bound(total(e), lambda t: F.transform(e, lambda x: x / t)))


def argmax(values: Column) -> Column:
    """Zero-based position of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def safe_divide(top: Column, bottom: Column) -> Column:
    """0 when the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / F.nullif(bottom, F.lit(0)))
