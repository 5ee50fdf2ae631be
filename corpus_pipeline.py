"""Corpus pipeline: from the table ``documents`` to the token ids of what a training set keeps.

Each stage works on all that the one before has kept, and its decisions take effect. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import bpe, decontamination, labelled, line_dedup, near_dedup, quality
from tilewright.llm.common import read, written


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.7 go. It learns from rows that are not held out."""
    model = quality.learn(docs, read(spark, sf_dir, "labels"), labelled.fold(4) != 2)
    return quality.keep_good(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that come again go; documents of which nothing but white space is left go with them.

    A document that had no text before stays as it is. ``n_chars`` counts the new text.
    """
    rows = line_dedup.dedup(docs)
    left = rows.where((F.col("_gone") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return left.withColumn("n_chars", F.when(F.col("_gone") == 0, F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, by a Jaccard similarity of five-word shingles of 0.8 or more, the document with the smallest doc_id stays."""
    return near_dedup.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold windows of benchmark items go."""
    return decontamination.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids, decoded_sha256``: ids as 32-bit numbers, and what they decode to."""
    rows = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode=True, keep=["doc_id", "lang", "source"])
    return rows.select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", reject_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("bpe", to_ids),
]

# Fingerprints and merges cannot be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``; each result between is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
