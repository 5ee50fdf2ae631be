"""Exact Euclidean distance from each cell of a two-class raster to the nearest cell of the other class.

Rasters that share their cells, such as the masks of all classes of an image, are worked on together: a cell carries
one kind per mask, and every shuffle moves it once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

NUMBERS = ArrayType(DoubleType())
# Kinds of a cell: on, off, nodata.
ON, OFF, NODATA = 1, 0, -1


def along_column(rows: np.ndarray, kinds: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance from each row ``low..high`` to the nearest one of ``rows`` that is on, and to the nearest that is off.

    ``kinds`` has one row per cell and one column per mask, and so have the results.
    """
    every = np.arange(low, high + 1, dtype="f8")[:, None]
    dense = np.full((len(every), kinds.shape[1]), NODATA, kinds.dtype)
    dense[rows - low] = kinds

    def nearest(marked: np.ndarray) -> np.ndarray:
        before = np.maximum.accumulate(np.where(marked, every, -np.inf), axis=0)
        after = np.minimum.accumulate(np.where(marked, every, np.inf)[::-1], axis=0)[::-1]
        return np.minimum(every - before, after - every)

    return nearest(dense == ON), nearest(dense == OFF)


def along_row(cols: np.ndarray, squared: np.ndarray) -> np.ndarray:
    """Least of ``squared[j] + (cols[i] - cols[j])**2`` over ``j``, for each ``i`` and each column of ``squared``.

    Goes outward cell by cell until no farther one can be nearer, so the work of each mask is the width times the largest
    distance in the row. Masks that are settled, or have nothing in the row, are left out from then on.
    """
    first = int(cols[0])
    wide = np.full((int(cols[-1]) - first + 1, squared.shape[1]), np.inf)
    wide[cols - first] = squared
    best = wide.copy()
    open_ = np.flatnonzero(np.isfinite(wide).any(axis=0))
    source = wide[:, open_]
    now = source.copy()
    for k in range(1, len(wide)):
        going = now.max(axis=0, initial=0.0) > float(k) * k
        if not going.all():
            best[:, open_[~going]] = now[:, ~going]
            open_, source, now = open_[going], source[:, going], now[:, going]
        if not len(open_):
            break
        np.minimum(now[k:], source[:-k] + k * k, out=now[k:])
        np.minimum(now[:-k], source[k:] + k * k, out=now[:-k])
    best[:, open_] = now
    return best[cols - first]


@F.pandas_udf(StructType().add("to_on", NUMBERS).add("to_off", NUMBERS))
def _columns(rows: pd.Series, kinds: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
    found = [along_column(np.asarray(r), np.asarray(k).reshape(len(r), -1), a, b) for r, k, a, b in zip(rows, kinds, low, high)]
    return pd.DataFrame({"to_on": [x.ravel() for x, _ in found], "to_off": [x.ravel() for _, x in found]})


@F.pandas_udf(NUMBERS)
def _rows(cols: pd.Series, to_on: pd.Series, to_off: pd.Series) -> pd.Series:
    def one(c, g, h):
        g, h = np.asarray(g).reshape(len(c), -1), np.asarray(h).reshape(len(c), -1)
        n = g.shape[1]
        far = along_row(np.asarray(c), np.square(np.concatenate([g, h], axis=1)))
        # A cell that is on has itself as the nearest such cell; one without a kind is at distance 0 of neither.
        return np.where(g == 0, far[:, n:], np.where(h == 0, far[:, :n], NODATA)).ravel()

    return pd.Series([one(*x) for x in zip(cols, to_on, to_off)])


def kind_of(on: Column) -> Column:
    """A condition as a kind: NULL is nodata."""
    return F.coalesce(on.cast("tinyint"), F.lit(NODATA).cast("tinyint"))


def distance_transforms(cells: DataFrame, by: Sequence[str], kinds: str) -> DataFrame:
    """``by, row_no, col_no, d2`` for several masks at once: ``kinds`` and ``d2`` are arrays with one entry per mask.

    As :func:`distance_transform`, but -1 stands for nodata and infinity where the mask has no cell of the other kind. Cells
    that have fewer kinds than others of their raster are nodata in the rest. Cells without a row may be returned, as -1.
    """
    by = list(by)
    if not by:
        raise ValueError("rasters need a key")
    column = F.col("_column")
    # Per column the cells in order of rows; the height of the raster comes from the columns' own ends.
    columns = cells.select(*by, "row_no", "col_no", F.col(kinds).alias("_kinds")).groupBy(*by, "col_no").agg(
        F.array_sort(F.collect_list(F.struct("row_no", "_kinds"))).alias("_column"),
        F.min("row_no").alias("_low"), F.max("row_no").alias("_high"), F.max(F.size("_kinds")).alias("_size"),
    )
    extent = columns.groupBy(*[F.col(c).alias(f"_b{k}") for k, c in enumerate(by)]).agg(
        F.min("_low").alias("_first"), F.max("_high").alias("_last"), F.max("_size").alias("_n")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_b{k}")) for k, c in enumerate(by)]
    nodata = lambda k: F.array_repeat(F.lit(NODATA).cast("tinyint"), F.col("_n") - F.size(k))
    filled = F.flatten(F.transform(column["_kinds"], lambda k: F.concat(k, nodata(k))))
    down = columns.join(extent, same).select(*by, "col_no", "_first", "_n", _columns(column["row_no"], filled, "_first", "_last").alias("_g"))
    part = lambda flat: F.slice(flat, F.col("_i") * F.col("_n") + 1, F.col("_n"))
    places = F.explode(F.sequence(F.lit(0), (F.size("_g.to_on") / F.col("_n")).cast("int") - 1))
    spread = down.select("*", places.alias("_i")).select(
        *by, (F.col("_first") + F.col("_i")).cast("int").alias("row_no"), "col_no", "_n", part("_g.to_on").alias("_to_on"), part("_g.to_off").alias("_to_off"),
    )
    across = spread.groupBy(*by, "row_no", "_n").agg(F.array_sort(F.collect_list(F.struct("col_no", "_to_on", "_to_off"))).alias("_row"))
    row = F.col("_row")
    nearest = _rows(row["col_no"], F.flatten(row["_to_on"]), F.flatten(row["_to_off"]))
    found = across.select(*by, "row_no", "_n", row["col_no"].alias("_cols"), nearest.alias("_d2"))
    return found.select(*by, "row_no", "_n", "_d2", F.posexplode("_cols").alias("_i", "col_no")).select(*by, "row_no", "col_no", part("_d2").alias("d2"))


def distance_transform(cells: DataFrame, by: Sequence[str], on: str) -> DataFrame:
    """``by, row_no, col_no, d2``: squared distance, in cells, from each cell to the nearest cell of its raster that is
    of the other kind; ``on`` is the boolean kind.

    NULL where the raster has no cell of the other kind. Cells with a NULL kind are nodata: they are returned with NULL
    and nothing is near them; cells that have no row are like that, too. A cell must not come twice.

    The transform is taken along columns, then along rows. A task holds single columns and rows, never a raster.
    """
    kind = cells.select(*by, "row_no", "col_no", F.col(on).cast("boolean").alias("_on"))
    found = distance_transforms(kind.select(*by, "row_no", "col_no", F.array(kind_of(F.col("_on"))).alias("_kinds")), by, "_kinds")
    d2 = F.col("d2")[0]
    known = found.where(d2 >= 0).select(*by, "row_no", "col_no", F.when(d2 < float("inf"), d2).alias("d2"))
    return known.unionByName(kind.where("_on is null").select(*by, "row_no", "col_no", F.lit(None).cast("double").alias("d2")))
