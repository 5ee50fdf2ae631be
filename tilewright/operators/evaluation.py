"""Confusion matrix and class metrics of ``stage, truth, pred`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import safe_divide

METRICS = ["accuracy", "f1", "jaccard", "precision", "recall"]


def confusion_matrix(
    scored: DataFrame, classes: int, normalize: str = "none", ignore: int | None = None
) -> DataFrame:
    """``stage, truth, pred, n, share`` over the full class grid.

    Rows whose truth is ``ignore`` are left out. ``normalize``: none, true, pred or all; 0 where the
    divisor is 0. Pixels are counted before the shuffle, so the size of a class does not matter.
    """
    divisors = {"none": None, "true": ["stage", "truth"], "pred": ["stage", "pred"], "all": ["stage"]}
    if normalize not in divisors:
        raise ValueError(f"unknown normalisation: {normalize}")
    rows = scored if ignore is None else scored.where(F.col("truth") != ignore)
    counted = rows.groupBy("stage", "truth", "pred").agg(F.count("*").alias("n"))
    # Every stage that occurs gets classes x classes rows.
    axis = F.sequence(F.lit(0), F.lit(classes - 1))
    blank = (
        counted.select("stage").distinct()
        .withColumn("truth", F.explode(axis)).withColumn("pred", F.explode(axis)).withColumn("n", F.lit(0))
    )
    full = counted.unionByName(blank).groupBy("stage", "truth", "pred").agg(F.sum("n").alias("n"))
    keys = divisors[normalize]
    if keys is None:
        return full.withColumn("share", F.col("n").cast("double"))
    return full.withColumn("share", safe_divide(F.col("n"), F.sum("n").over(W.partitionBy(*keys))))


def _per_class(confusion: DataFrame) -> DataFrame:
    """``stage, class_id, tp, fp, fn`` from row and column sums."""
    truth = confusion.select("stage", F.col("truth").alias("class_id"), F.col("n").alias("row"), F.lit(0).alias("column"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"))
    pred = confusion.select("stage", F.col("pred").alias("class_id"), F.lit(0).alias("row"), F.col("n").alias("column"), F.lit(0).alias("tp"))
    return (
        truth.unionByName(pred).groupBy("stage", "class_id")
        .agg(F.sum("tp").alias("tp"), F.sum("row").alias("row"), F.sum("column").alias("column"))
        .select("stage", "class_id", "tp", (F.col("column") - F.col("tp")).alias("fp"), (F.col("row") - F.col("tp")).alias("fn"))
    )


def _ratios(tp, fp, fn) -> dict:
    return {
        "accuracy": safe_divide(tp, tp + fn),
        "f1": safe_divide(tp * 2, tp * 2 + fp + fn),
        "jaccard": safe_divide(tp, tp + fp + fn),
        "precision": safe_divide(tp, tp + fp),
        "recall": safe_divide(tp, tp + fn),
    }


def class_metrics(confusion: DataFrame) -> DataFrame:
    """Five metrics per class; 0 where undefined. Per-class accuracy is recall."""
    ratios = _ratios(F.col("tp"), F.col("fp"), F.col("fn"))
    return _per_class(confusion).select("stage", "class_id", *[v.alias(k) for k, v in ratios.items()])


def micro_metrics(confusion: DataFrame, ignore: int | None = None) -> DataFrame:
    """The five metrics on pooled counts.

    Wrong predictions of the ignored class count as errors, except in the Jaccard index, whose
    pooled union leaves that class out.
    """
    counts = _per_class(confusion)
    kept = F.lit(True) if ignore is None else F.col("class_id") != ignore
    pooled = counts.groupBy("stage").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.coalesce(F.sum(F.when(kept, F.col("tp") + F.col("fp") + F.col("fn"))), F.lit(0)).alias("union"),
    )
    ratios = _ratios(F.col("tp"), F.col("fp"), F.col("fn")) | {"jaccard": safe_divide(F.col("tp"), F.col("union"))}
    return pooled.select("stage", *[v.alias(k) for k, v in ratios.items()])


def macro_metrics(confusion: DataFrame, ignore: int | None = None) -> DataFrame:
    """Unweighted mean of the per-class values, without the ignored class."""
    per_class = class_metrics(confusion)
    if ignore is not None:
        per_class = per_class.where(F.col("class_id") != ignore)
    return per_class.groupBy("stage").agg(*[F.avg(m).alias(m) for m in METRICS])
