"""Bounded, seeded samples of labelled documents for fitting classifiers, and their held-out folds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import byte_values, fresh, text_of


def fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, max_chars: int) -> tuple[list[bytes], list[int]]:
    """At most ``per_class`` texts of either label, as UTF-8, and their labels (0 or 1), in a fixed order.

    Labels are ranked by a hash of doc_id, so the choice does not depend on partitions. Only ids that satisfy
    ``learn`` count; null labels are left out, of several labels of a document the largest holds. Texts longer than
    ``max_chars`` are passed over when fitting (never when scoring), which bounds the sample in bytes, too.
    """
    known = labels.where(learn & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    key = F.xxhash64(F.col("doc_id"), F.lit(11))
    parts = [known.where(F.col("_y") == y).orderBy(key, "doc_id").limit(per_class) for y in (0, 1)]
    # At most two times per_class rows: a proven bound for the broadcast.
    chosen = F.broadcast(parts[0].union(parts[1]))
    rows = (
        docs.select("doc_id", text_of("text").alias("text"))
        .where(F.length("text") <= max_chars)
        .join(chosen, "doc_id")
        .select(F.encode("text", "UTF-8").alias("text"), "_y", key.alias("_h"), "doc_id")
    )
    # Ids may repeat in the documents; one text each is enough.
    first = W.partitionBy("doc_id").orderBy("text")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").orderBy("_h", "doc_id")
    got = rows.select("text", "_y").toArrow()
    return got.column(0).to_pylist(), got.column(1).to_pylist()


def score(docs: DataFrame, model, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` and a score from 0 to 1 of the whole ``text`` (null: empty) as ``name``."""
    fields = [c for c in (docs.columns if keep is None else keep) if c != name]
    rows = docs.select(*fields, text_of("text").alias(fresh(docs, "_whole")[0]))
    schema = docs.select(*fields).schema.add(name, DoubleType())
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [held.value.score(x) for x in byte_values(batch.column(len(fields)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], names=[*fields, name])

    return rows.mapInArrow(run, schema)
