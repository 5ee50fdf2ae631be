"""A finished dataset: cells, masks, and its metadata tables below one root folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import band_list
from ..operators.labels import restrict_to_split
from ..schema import CLASS_TABLE, SUBSETS

TABLES = {"counts": "json", "classes": "json", "splits": "json", "scales": "parquet", "weights": "parquet"}
SCHEMAS = {
    "counts": "image string, class_id int, n bigint",
    "classes": CLASS_TABLE,
    "splits": "image string, subset string",
    "scales": "band string, mn double, mx double",
    "weights": "class_id int, w double",
}


def write_dataset_metadata(root: str, mode: str = "errorifexists", **tables: DataFrame) -> None:
    """Write any of counts, classes, splits (JSON lines), scales and weights (Parquet)."""
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"unknown metadata: {sorted(unknown)}")
    for name, table in tables.items():
        table.write.mode(mode).format(TABLES[name]).save(f"{root}/{name}")


def read_dataset_metadata(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).format(TABLES[name]).load(f"{root}/{name}")


def write_sorted(df: DataFrame, path: str, keys: Sequence[str], mode: str = "errorifexists") -> None:
    """Globally ordered files; order is only made at the sink."""
    df.orderBy(*keys).write.mode(mode).parquet(path)


def write_samples(images: DataFrame, masks: DataFrame, root: str, mode: str = "errorifexists") -> None:
    """``image, row_no, col_no`` plus bands, and the same key plus ``class_id``."""
    for name, table in (("images", images), ("masks", masks)):
        slab = F.floor(F.col("row_no") / 512)
        table.repartition(F.col("image"), slab).sortWithinPartitions("image", "row_no", "col_no").write.mode(mode).parquet(
            f"{root}/{name}"
        )


def read_dataset(
    spark: SparkSession,
    root: str,
    subset: str,
    bands: str | Sequence[str] = "all",
    transforms: Sequence[Callable[[DataFrame], DataFrame]] = (),
) -> DataFrame:
    """Pixels of one subset: image key, chosen bands and ``class_id``; then each transform in turn."""
    if subset not in SUBSETS:
        raise ValueError(f"expected a subset out of {SUBSETS}, got {subset!r}")
    chosen = band_list(bands)
    splits = read_dataset_metadata(spark, root, "splits")
    key = ["image", "row_no", "col_no"]
    images = restrict_to_split(spark.read.parquet(f"{root}/images").select(*key, *chosen), splits, subset)
    masks = restrict_to_split(spark.read.parquet(f"{root}/masks").select(*key, "class_id"), splits, subset)
    out = images.join(masks, key)
    for transform in transforms:
        out = out.transform(transform)
    return out
