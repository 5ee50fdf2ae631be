"""Run ledger: best and last runs, and reuse of completed ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_run(runs: DataFrame, metric: str, run_id: str, mode: str = "max", by: Sequence[str] = ()) -> DataFrame:
    """The run with the best metric; the lower id wins ties."""
    if mode not in ("max", "min"):
        raise ValueError(f"unknown mode: {mode}")
    order = [F.desc(metric) if mode == "max" else F.asc(metric), F.asc(run_id)]
    known = runs.where(F.col(metric).isNotNull())
    if not by:
        return known.orderBy(*order).limit(1)
    return known.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def last_run(runs: DataFrame, run_id: str, by: Sequence[str] = ()) -> DataFrame:
    if not by:
        return runs.orderBy(F.desc(run_id)).limit(1)
    order = W.partitionBy(*by).orderBy(F.desc(run_id))
    return runs.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def skip_completed(
    candidates: DataFrame, ledger: DataFrame, params: Sequence[str], value: str, number: str, state: str = "state"
) -> DataFrame:
    """Add ``cached`` to each candidate: the value of the latest COMPLETE run with equal parameters,
    NULL if it must be run. The ledger is reduced to one row per parameter set before the join."""
    done = (
        ledger.where(F.col(state) == "COMPLETE")
        .groupBy(*params).agg(F.max_by(value, number).alias("cached"))
    )
    c, d = candidates.alias("c"), done.alias("d")
    same = F.lit(True)
    for p in params:
        term = F.col(f"c.{p}").eqNullSafe(F.col(f"d.{p}"))
        same = term if p == params[0] else same & term
    return c.join(d, same, "left").select("c.*", "d.cached")
