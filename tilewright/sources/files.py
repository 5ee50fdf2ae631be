"""Raw files: which ones are present, and their contents for checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import base_name


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``name, path, length`` of the files below a folder; contents are not read."""
    files = _binary(spark, path, pattern)
    return files.select(base_name(F.col("path")).alias("name"), "path", "length")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``name, content``."""
    return _binary(spark, path, pattern).select(base_name(F.col("path")).alias("name"), "content")


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    )
