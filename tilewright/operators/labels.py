"""Segmentation masks and class tables. Masks are ``image, class_id`` plus a pixel key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def class_id_of(classes: DataFrame, name: str = "invalid") -> Column:
    """The id of a class by name, any case, as a scalar subquery; NULL if there is none."""
    return classes.where(F.lower("name") == name.lower()).agg(F.min("id").alias("id")).scalar()


def drop_invalid_class(mask: DataFrame, classes: DataFrame, name: str = "invalid") -> DataFrame:
    """The class called "invalid" becomes background."""
    invalid = class_id_of(classes, name)
    kept = F.when(F.col("class_id").eqNullSafe(invalid), F.lit(0)).otherwise(F.col("class_id"))
    return mask.withColumn("class_id", kept)


def class_counts(mask: DataFrame, keep_empty: bool = True) -> DataFrame:
    """Pixels per image and class as ``image, class_id, n``; background is not counted.

    With ``keep_empty`` an image that is all background keeps one row ``(image, NULL, 0)``. The
    counts combine before the shuffle, so one large image or class does not matter.
    """
    counts = mask.groupBy("image", "class_id").agg(F.count("*").alias("n"))
    if not keep_empty:
        return counts.where("class_id <> 0")
    # The tiny per-image counts decide which images have nothing but background.
    image = W.partitionBy("image")
    return (
        counts.withColumn("_any", F.max((F.col("class_id") != 0).cast("int")).over(image))
        .where("class_id <> 0 or _any = 0")
        .select(
            "image",
            F.when(F.col("class_id") != 0, F.col("class_id")).alias("class_id"),
            F.when(F.col("class_id") != 0, F.col("n")).otherwise(0).alias("n"),
        )
    )


def class_count_matrix(counts: DataFrame, classes: Sequence[int]) -> DataFrame:
    """One row per image, one column per class in ascending order, 0 where absent."""
    wide = [
        F.coalesce(F.sum(F.when(F.col("class_id") == c, F.col("n"))), F.lit(0)).alias(f"c{c}") for c in sorted(classes)
    ]
    return counts.groupBy("image").agg(*wide)


def class_mapping(counts: DataFrame) -> DataFrame:
    """``old_id, new_id``: present classes in ascending order become 1..k.

    A mask pixel is one byte, so there are at most 255 classes and the ranking is over a tiny table.
    """
    present = counts.where("class_id is not null and class_id <> 0 and n > 0").select("class_id").distinct()
    return present.select(
        F.col("class_id").alias("old_id"), F.row_number().over(W.orderBy("class_id")).alias("new_id")
    )


def reindex_classes(df: DataFrame, mapping: DataFrame, column: str = "class_id") -> DataFrame:
    """Replace class ids; 0 stays 0. The mapping has at most 255 rows and is broadcast."""
    m = F.broadcast(mapping.select(F.col("old_id").alias(column), "new_id"))
    return df.join(m, column, "left").withColumn(
        column, F.when(F.col(column) == 0, F.lit(0)).otherwise(F.col("new_id")).cast("int")
    ).drop("new_id").select(*df.columns)


def reindex_class_table(classes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Names and colours under the new ids, background kept, absent classes dropped."""
    return reindex_classes(classes, mapping, "id").where("id is not null")


def label_classes(df: DataFrame, classes: DataFrame, column: str = "class_id", strict: bool = True) -> DataFrame:
    """Add name and colour. The class table has at most 256 rows and is broadcast; ``strict``
    raises on an id that it lacks."""
    table = F.broadcast(classes.select(F.col("id").alias(column), "name", "rgba"))
    out = df.join(table, column, "left")
    if not strict:
        return out
    unknown = F.raise_error(F.concat(F.lit("unknown class: "), F.col(column).cast("string"))).cast("string")
    return out.withColumn("name", F.when(F.col("name").isNull(), unknown).otherwise(F.col("name")))


def restrict_to_split(df: DataFrame, splits: DataFrame, subset: str, column: str = "image") -> DataFrame:
    """Rows of one subset's images."""
    chosen = splits.where(F.col("subset") == subset).select(F.col("image").alias(column))
    return df.join(chosen, column, "left_semi")


def verify_pairs(images: DataFrame, masks: DataFrame, splits: DataFrame) -> DataFrame:
    """Split members that lack an image or a mask of the same stem, and sides that are empty.

    Returns ``image, subset, reason``; no row means that the dataset is sound.
    """
    stem = lambda c: F.substring_index(F.substring_index(c, "/", -1), ".", 1)
    # Tag and stack both sides, so one aggregate per stem answers both questions.
    have = (
        images.select(stem(F.col("image")).alias("stem"), F.lit("image").alias("side"))
        .unionByName(masks.select(stem(F.col("image")).alias("stem"), F.lit("mask").alias("side")))
        .groupBy("stem")
        .agg(
            F.max((F.col("side") == "image").cast("int")).alias("has_image"),
            F.max((F.col("side") == "mask").cast("int")).alias("has_mask"),
        )
    )
    members = splits.select("image", "subset", stem(F.col("image")).alias("stem")).join(have, "stem", "left")
    reason = F.when(F.coalesce("has_image", F.lit(0)) == 0, "no image").when(
        F.coalesce("has_mask", F.lit(0)) == 0, "no mask"
    )
    lacking = members.select("image", "subset", reason.alias("reason")).where("reason is not null")
    return lacking


def empty_sides(images: DataFrame, masks: DataFrame) -> DataFrame:
    """One row per side that has no file at all."""
    count = lambda df, name: df.limit(1).agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return count(images, "image").unionByName(count(masks, "mask")).where("n = 0").select("side")
