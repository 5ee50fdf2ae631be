"""Asset manifests as JSON, one line per tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from ..schema import MANIFEST


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def write_manifests(manifests: DataFrame, path: str, overwrite: bool = False) -> bool:
    """Write manifests of tiles that have none yet, or replace all. Returns whether it wrote."""
    if overwrite:
        manifests.write.mode("overwrite").json(path)
        return True
    try:
        have = read_manifests(manifests.sparkSession, path).select("tid")
        manifests = manifests.join(have, "tid", "left_anti")
        if manifests.isEmpty():
            return False
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    manifests.select("tid", "image", "lidar").write.mode("append").json(path)
    return True
