"""Ranks and running totals over whole tables without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit

# Ranges of the hash that are ranked apart. The result does not depend on it, only parallelism does.
HASH_BUCKETS = 4096


def bucketed_rank(df: DataFrame, bucket: str, order: list, by: list[str] = (), name: str = "rank") -> DataFrame:
    """0-based position in ``(bucket, order)`` order within ``by``.

    Rows are ordered inside each bucket in parallel; only the per-bucket counts are summed up in
    order. ``bucket`` must grow with the order and hold a fair share of rows each.
    """
    keys = [*by, bucket]
    before = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = df.groupBy(*keys).agg(F.count("*").alias("_n")).select(
        *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    local = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return (
        df.withColumn("_local", local)
        .join(offsets, keys)
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .drop("_local", "_offset")
    )


def running_total(df: DataFrame, value: Column, bucket: str, order: list, name: str = "total") -> DataFrame:
    """Sum of ``value`` up to and including each row, in ``(bucket, order)`` order."""
    rows = df.withColumn("_v", value)
    before = W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy(bucket).agg(F.sum("_v").alias("_n")).select(
        bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    upto = W.partitionBy(bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.withColumn("_local", F.sum("_v").over(upto))
        .join(offsets, bucket)
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_v", "_local", "_offset")
    )


def shuffled_rank(df: DataFrame, key: str, seed, by: list[str] = (), name: str = "rank") -> DataFrame:
    """0-based position in a seeded random order; hash ties are broken by the key itself."""
    unit = hash_unit(seed, *[F.col(c) for c in by], F.col(key))
    rows = df.withColumn("_u", unit).withColumn("_bucket", F.floor(F.col("_u") * HASH_BUCKETS).cast("int"))
    return bucketed_rank(rows, "_bucket", ["_u", key], by, name).drop("_u", "_bucket")


def count_scalar(df: DataFrame) -> Column:
    """The number of rows as a scalar subquery."""
    return df.agg(F.count("*").alias("n")).scalar()
