"""Session set-up and lineage cutting."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


# Folders made for sessions without a setting, by application.
_made: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "tilewright", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks. Clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a session in a single process gets one of its own; a cluster has to name it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _made.get(spark.sparkContext.applicationId)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _made[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="run-")
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so that the data survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
