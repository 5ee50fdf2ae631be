"""Training-set statistics: band ranges and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import minmax
from ..schema import BANDS
from .joins import scalar_struct


def band_ranges(cells: DataFrame, bands: Sequence[str] = BANDS) -> DataFrame:
    """``band, mn, mx`` over all cells: one global aggregate, unpivoted."""
    wide = cells.agg(
        *[F.min(b).alias(f"mn_{b}") for b in bands], *[F.max(b).alias(f"mx_{b}") for b in bands]
    )
    rows = F.array(
        *[
            F.struct(F.lit(b).alias("band"), F.col(f"mn_{b}").cast("double").alias("mn"), F.col(f"mx_{b}").cast("double").alias("mx"))
            for b in bands
        ]
    )
    return wide.select(F.inline(rows))


def minmax_scale(cells: DataFrame, scales: DataFrame, bands: Sequence[str], eps: float = 1e-12) -> DataFrame:
    """Scale bands to [0, 1] by a ``band, mn, mx`` table, read as one scalar row."""
    wide = scales.agg(
        *[F.max(F.when(F.col("band") == b, F.col(c))).alias(f"{c}_{b}") for b in bands for c in ("mn", "mx")]
    )
    limits = scalar_struct(wide)
    return cells.withColumn("_s", limits).withColumns(
        {b: minmax(F.col(b), F.col(f"_s.mn_{b}"), F.col(f"_s.mx_{b}"), eps) for b in bands}
    ).drop("_s")


def class_weights(counts: DataFrame, method: str = "custom") -> DataFrame:
    """``class_id, w``: weights that sum to 1, background 0.

    ``inv_freq``: inverse pixel share. ``custom``: inverse mean pixel count over all images, times a
    smoothed inverse image frequency (logarithm to the number of classes; 1 if there is one class).
    Counts are ``image, class_id, n``; images of background only have ``class_id`` NULL. A class
    listed without pixels raises.
    """
    if method not in ("inv_freq", "custom"):
        raise ValueError(f"unknown weighting method: {method}")
    images = counts.agg(F.count_distinct("image").cast("double").alias("n")).scalar()
    known = counts.where("class_id is not null")
    per_class = known.groupBy("class_id").agg(
        F.sum("n").cast("double").alias("pixels"), F.count_if(F.col("n") > 0).alias("present")
    )
    everything = W.partitionBy()
    per_class = per_class.withColumns(
        {
            "all_pixels": F.sum("pixels").over(everything),
            "classes": F.count(F.lit(1)).over(everything).cast("double"),
            "images": images,
        }
    )
    absent = F.raise_error(F.concat(F.lit("class without pixels: "), F.col("class_id").cast("string")))
    pixels = F.when(F.col("pixels") > 0, F.col("pixels")).otherwise(absent.cast("double"))
    if method == "inv_freq":
        raw = F.col("all_pixels") / pixels
    else:
        rarity = F.log((F.col("images") + 1) / (F.col("present") + 1)) / F.log("classes")
        rarity = F.when(F.col("classes") > 1, rarity + 1).otherwise(F.lit(1.0))
        raw = F.col("images") / pixels * rarity
    weights = per_class.withColumn("raw", raw).select(
        F.col("class_id").cast("int").alias("class_id"), (F.col("raw") / F.sum("raw").over(everything)).alias("w")
    )
    background = counts.sparkSession.range(1).select(F.lit(0).cast("int").alias("class_id"), F.lit(0.0).alias("w"))
    return background.unionByName(weights)
