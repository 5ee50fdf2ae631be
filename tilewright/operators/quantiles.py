"""Exact percentiles of groups that are too large to sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


SLICES = 1024
ACCURACY = 1000


def exact_quantiles(df: DataFrame, value: str, fractions: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Linear-interpolated percentiles, as ``by, q, quantile``; NULLs do not count.

    1. A sketch gives a narrow bracket around each percentile.
    2. Counts per slice of the bracket (plus one below, one above) tell which slice holds the
       wanted ranks; a wrong bracket only makes that slice wider.
    3. Only values of those slices are counted one by one and read off.

    Counting combines before each shuffle, so no task ever holds a whole group.
    """
    by = list(by)
    values = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    margin = 3.0 / ACCURACY
    marks = [p for q in fractions for p in (max(q - margin, 0.0), min(q + margin, 1.0))]
    sketch = values.groupBy(*by).agg(
        F.count("*").alias("n"), F.percentile_approx("v", [float(m) for m in marks], ACCURACY).alias("m")
    )
    brackets = sketch.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(float(q)).alias("q"), F.col("m")[2 * i].alias("low"), F.col("m")[2 * i + 1].alias("high"),
                        ((F.col("n") - 1) * float(q)).alias("at"),
                    )
                    for i, q in enumerate(fractions)
                ]
            )
        ).alias("b"),
    ).select(*by, "b.*")

    width = (F.col("high") - F.col("low")) / SLICES
    slot = (
        F.when(F.col("v") < F.col("low"), F.lit(-1))
        .when(F.col("v") > F.col("high"), F.lit(SLICES + 1))
        .when(width > 0, F.floor((F.col("v") - F.col("low")) / width))
        .otherwise(F.lit(0))
        .cast("int")
    )
    key = [*by, "q"]
    asked = values.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in fractions])))
    sliced = asked.join(brackets, key).withColumn("slot", slot)
    before = W.partitionBy(*key).orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    slots = (
        sliced.groupBy(*key, "slot")
        .agg(F.count("*").alias("n"), F.first("at").alias("at"))
        .withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .where((F.col("skip") <= F.ceil("at")) & (F.col("skip") + F.col("n") > F.floor("at")))
        .select(*key, "slot", "skip")
    )
    picked = sliced.join(slots, [*key, "slot"])
    upto = W.partitionBy(*key, "slot").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    ranked = (
        picked.groupBy(*key, "slot", "v")
        .agg(F.count("*").alias("n"), F.first("at").alias("at"), F.first("skip").alias("skip"))
        .withColumn("last", F.col("skip") + F.sum("n").over(upto) - 1)
        .withColumn("first", F.col("last") - F.col("n") + 1)
    )
    holds = lambda rank: F.max(F.when(rank.between(F.col("first"), F.col("last")), F.col("v")))
    return ranked.groupBy(*key).agg(
        holds(F.floor("at")).alias("lo"), holds(F.ceil("at")).alias("hi"), F.first("at").alias("at")
    ).select(*key, (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("quantile"))
