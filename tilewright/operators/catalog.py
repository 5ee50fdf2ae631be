"""Tile ids, download plans and checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import TILE_PATTERN, base_name


def check_tile_ids(ids: DataFrame, index: DataFrame, column: str = "tile_id") -> DataFrame:
    """``reason`` of the first failed test: delimiters, dash, pattern, index; NULL for a good id."""
    tile = F.col(column)
    marks = F.regexp_replace(tile, "[0-9]", "")
    first = F.substring(marks, 1, 1)
    uneven = (marks == "") | (F.replace(marks, first, F.lit("")) != "")
    known = index.select(F.col("tile_id").alias(column)).distinct().withColumn("_known", F.lit(True))
    return (
        ids.join(known, column, "left")
        .withColumn(
            "reason",
            F.when(tile.isNull() | uneven, "inconsistent delimiters")
            .when(first != "-", "not delimited by dashes")
            .when(~tile.rlike(f"^{TILE_PATTERN}$"), "malformed")
            .when(F.col("_known").isNull(), "not in index"),
        )
        .drop("_known")
    )


def exclude_seen(tiles: DataFrame, done: DataFrame, key: str = "tile_id") -> DataFrame:
    return tiles.join(done.select(key), key, "left_anti")


def fetch_plan(manifests: DataFrame, present: DataFrame, overwrite: bool | str = False) -> DataFrame:
    """``tid, kind, url, name`` of the files to fetch; the name is the last part of the url.

    Files listed in ``present`` (``name``) are skipped. ``overwrite`` is a flag for all files, or
    the name of a boolean manifest column.
    """
    def assets(kind: str):
        return F.transform(F.col(kind)["url"], lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("url")))

    wanted = (
        manifests.withColumn("_a", F.explode(F.concat(assets("image"), assets("lidar"))))
        .select("*", "_a.kind", "_a.url")
        .withColumn("name", base_name(F.col("url")))
    )
    columns = ["tid", "kind", "url", "name"]
    if overwrite is True:
        return wanted.select(*columns)
    have = present.select("name").distinct()
    if overwrite is False:
        return wanted.join(have, "name", "left_anti").select(*columns)
    marked = wanted.join(have.withColumn("_have", F.lit(True)), "name", "left")
    return marked.where(F.col("_have").isNull() | F.col(overwrite)).select(*columns)


def verify_checksums(files: DataFrame, expected: DataFrame) -> DataFrame:
    """``name, status``, one row per row of ``expected``: ok, mismatch or missing. ``files`` has ``name, content``, ``expected``
    has ``name, sha256``. Contents are reduced to digests before the join.

    Names may repeat and be NULL on both sides: a row is ok if any file of its name has its digest, or if it asks for none.
    """
    digests = files.select(F.col("name").alias("_name"), F.sha2(F.col("content"), 256).alias("_digest")).distinct()
    names = digests.groupBy("_name").agg(F.max(F.col("_digest").isNotNull()).alias("_read"))
    rows = expected.select("name", F.lower("sha256").alias("_wanted"))
    known = rows.join(names, rows["name"].eqNullSafe(names["_name"]), "left").drop("_name")
    equal = known["name"].eqNullSafe(digests["_name"]) & (known["_wanted"] == digests["_digest"])
    status = (
        F.when(F.col("_read").isNull(), "missing").when(F.col("_wanted").isNull() | F.col("_digest").isNotNull(), "ok")
        .when(F.col("_read"), "mismatch").otherwise("missing")
    )
    return known.join(digests, equal, "left").select("name", status.alias("status"))
