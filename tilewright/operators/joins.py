"""Join helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

# A table is sent to every task only if it was found to be no larger than this.
BROADCAST_BYTES = 16 << 20


def measured_bytes(df: DataFrame) -> int:
    """Rows times the width of plain columns, plus the bytes of texts. One aggregate runs; no row reaches the driver."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, (StringType, BinaryType))]
    nested = [f.name for f in df.schema if isinstance(f.dataType, (ArrayType, MapType, StructType))]
    size = F.lit(16 * len(df.columns))
    for name in texts:
        size = size + F.coalesce(F.octet_length(name), F.lit(0))
    for name in nested:
        size = size + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    return df.agg(F.sum(size.cast("bigint")).alias("bytes")).first().bytes or 0


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, with the hint to send it to every task if it measures at most ``limit`` bytes when this is called.

    A larger table comes back without a hint, and adaptive execution picks the join by the sizes it meets.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def scalar_struct(one_row: DataFrame) -> Column:
    """The single row of a global aggregate as a scalar subquery, to be read by field name."""
    return one_row.select(F.struct(*one_row.columns).alias("s")).scalar()


def bin_of(value: Column, width) -> Column:
    return F.floor(value / width).cast("bigint")


def bins_between(low: Column, high: Column, width) -> Column:
    """All bins touched by an interval; widened by a hair so that rounding never loses a bin."""
    return F.sequence(
        F.floor(low / width - 1e-9).cast("bigint"), F.floor(high / width + 1e-9).cast("bigint")
    )


def explode_box(df: DataFrame, xmin: Column, ymin: Column, xmax: Column, ymax: Column, width) -> DataFrame:
    """One row per grid bin that a box touches, as ``bx, by``."""
    return df.withColumn("bx", F.explode(bins_between(xmin, xmax, width))).withColumn(
        "by", F.explode(bins_between(ymin, ymax, width))
    )


def put_in_bin(df: DataFrame, x: Column, y: Column, width) -> DataFrame:
    """The one bin of a point, as ``bx, by``."""
    return df.withColumns({"bx": bin_of(x, width), "by": bin_of(y, width)})


def level_of_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column, width: float) -> Column:
    """The level whose bins, ``width * 2**level`` wide, are about as large as the box: it touches nine of them at most."""
    side = F.greatest(xmax - xmin, ymax - ymin)
    return F.greatest(F.ceil(F.log2(F.greatest(side, F.lit(width)) / width)), F.lit(0)).cast("int")


def levels_in(*tables: DataFrame) -> Column:
    """The distinct ``_level`` values of tables as one array, found when the query runs. They are as many as sizes double."""
    rows = tables[0].select("_level")
    for table in tables[1:]:
        rows = rows.unionByName(table.select("_level"))
    return rows.agg(F.sort_array(F.collect_set("_level")).alias("levels")).scalar()


def _level_width(width: float) -> Column:
    return F.pow(F.lit(2.0), F.col("_level")) * width


def explode_level_box(df: DataFrame, xmin: Column, ymin: Column, xmax: Column, ymax: Column, width: float, levels: Column | None = None) -> DataFrame:
    """One row per bin that a box touches, as ``_level, bx, by``, on the level of its ``_level``; with ``levels`` on
    each of these from there on, and ``_own`` keeps its own. The number of rows does not grow with the box."""
    if levels is not None:
        df = df.withColumn("_own", F.col("_level")).withColumn("_level", F.explode(levels)).where("_level >= _own")
    return explode_box(df, xmin, ymin, xmax, ymax, _level_width(width))


def put_in_levels(df: DataFrame, x: Column, y: Column, width: float, levels: Column) -> DataFrame:
    """The bin of a point on every one of ``levels``, as ``_level, bx, by``."""
    return put_in_bin(df.withColumn("_level", F.explode(levels)), x, y, _level_width(width))


def binned_join(points: DataFrame, boxes: DataFrame, residual: Column, by: list[str] = (), how: str = "inner") -> DataFrame:
    """Spatial join of binned points with exploded boxes: equality on the bins, then ``residual``.

    Since a point has exactly one bin, a pair is met once and needs no de-duplication. No cartesian
    product is planned, and a hot bin is a hot equi-join key, which adaptive execution splits.
    """
    keys = [*by, "bx", "by"]
    left, right = points.alias("l"), boxes.alias("r")
    equal = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    condition = residual
    for term in reversed(equal):
        condition = term & condition
    return left.join(right, condition, how)
