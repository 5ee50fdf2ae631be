"""Tile index, surfaces, points and cells as Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.naming import normalize_tile_id
from ..schema import POINTS, SURFACES, TILES


def read_tile_index(spark: SparkSession, path: str) -> DataFrame:
    """The tile index with ids in dashed form."""
    return spark.read.schema(TILES).parquet(path).withColumn("tile_id", normalize_tile_id(F.col("tile_id")))


def read_surfaces(spark: SparkSession, path: str, tile_id: str | None = None, lod: str | None = None) -> DataFrame:
    """Surfaces, of one tile and level of detail if given; both are partition columns, so other
    files are not opened."""
    out = spark.read.schema(SURFACES).parquet(path)
    if tile_id is not None:
        out = out.where(F.col("tile_id") == tile_id)
    if lod is not None:
        out = out.where(F.col("lod") == lod)
    return out


def write_surfaces(surfaces: DataFrame, path: str, mode: str = "errorifexists") -> None:
    surfaces.repartition("tile_id", "lod").write.mode(mode).partitionBy("tile_id", "lod").parquet(path)


def read_points(spark: SparkSession, path: str, tiles: Sequence[str] | None = None) -> DataFrame:
    out = spark.read.schema(POINTS).parquet(path)
    return out if tiles is None else out.where(F.col("tile_id").isin(list(tiles)))


def write_points(points: DataFrame, path: str, mode: str = "errorifexists", slab: int = 100_000) -> None:
    """One folder per tile, split by slabs of record rows so that a large tile is many files whose
    ``yi`` statistics let a crop skip them."""
    sliced = points.withColumn("_slab", F.floor(F.col("yi") / slab))
    sliced.repartition("tile_id", "_slab").sortWithinPartitions("tile_id", "yi", "xi").drop("_slab").write.mode(
        mode
    ).partitionBy("tile_id").parquet(path)


def read_cells(spark: SparkSession, path: str, bands: Sequence[str] | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    return out if bands is None else out.select("tile_id", "row_no", "col_no", *bands)


def write_cells(cells: DataFrame, path: str, mode: str = "errorifexists", rows: int = 512) -> None:
    """One folder per tile, one file per band of raster rows, in scan order. Doubles are stored as
    floats, the stack's type."""
    narrow = {c: F.col(c).cast("float") for c, kind in cells.dtypes if kind == "double"}
    sliced = cells.withColumns(narrow).withColumn("_slab", F.floor(F.col("row_no") / rows))
    sliced.repartition("tile_id", "_slab").sortWithinPartitions("tile_id", "row_no", "col_no").drop("_slab").write.mode(
        mode
    ).partitionBy("tile_id").parquet(path)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, None if there is nothing yet; anything else there is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        # An empty folder holds no schema, but is a fine place for a new table.
        if spark.read.format("binaryFile").load(path).select("path").isEmpty():
            return None
        raise ValueError(f"{path!r} exists but is not a Parquet table") from error
    except Py4JJavaError as error:
        raise ValueError(f"{path!r} exists but is not a Parquet table") from error


def write_if_absent(df: DataFrame, path: str, keys: Sequence[str], overwrite: bool = False) -> bool:
    """Write only the ``keys`` (partition columns) that ``path`` lacks; with ``overwrite`` replace
    those that ``df`` has and leave the others. Returns whether anything was written."""
    spark, keys = df.sparkSession, list(keys)
    have = _existing(spark, path)
    writer = lambda rows: rows.repartition(*keys).write.partitionBy(*keys)
    if have is None:
        writer(df).mode("overwrite").parquet(path)
        return True
    if overwrite:
        writer(df).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        return True
    present = have.select(*[F.col(k).cast(df.schema[k].dataType) for k in keys]).distinct()
    missing = df.join(present, keys, "left_anti")
    if missing.select(*keys).isEmpty():
        return False
    writer(missing).mode("append").parquet(path)
    return True
