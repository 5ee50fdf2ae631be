"""Helpers shared by the corpus operators: tables, shared storage, Arrow mappers, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

# Words are cut at these bytes: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
# Texts are worked on together up to about so many bytes; a longer text by itself.
SLICE_BYTES = 2_000_000
# Edges that a task joins up at once.
LINKS_AT_ONCE = 250_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share. Nothing in it is removed here."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it is computed once and outlives executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have yet, whatever the case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def text_of(column: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def byte_values(column: pa.Array) -> list[bytes]:
    """A string column of a record batch as a list of UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def flat_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column of a record batch without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)


def words_of(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, number of the first word of each text and of the end) of texts that lie in one buffer.

    ``cuts`` marks the bytes of the texts before which a word is cut further.
    """
    base = int(offsets[0])
    data = data[base:int(offsets[-1])]
    solid = ~_IS_SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets - base] = True
    if cuts is not None:
        border[:-1] |= cuts
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~before | border[:-1]))
    after = np.concatenate([solid[1:], [False]])
    stops = np.flatnonzero(solid & (~after | border[1:])) + 1
    places = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    packed = np.ascontiguousarray(data[solid])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(packed)])
    return words, np.searchsorted(starts, offsets - base)


def text_slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together."""
    start = 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield start, stop
        start = stop


def map_batches(df: DataFrame, fill: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Row-wise Arrow mapper: ``fill`` turns a batch into columns, given by name, of ``schema``."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = fill(batch)
                yield pa.RecordBatch.from_arrays([_array(columns[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def _array(values) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        return values.combine_chunks()
    return values if isinstance(values, pa.Array) else pa.array(values)


def pair_chunks(low: np.ndarray, high: np.ndarray, limit: int = 250_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (row, target) pairs with ``low[row] <= target < high[row]``, about ``limit`` pairs at a time."""
    for row in _long_rows(low, high, limit):
        for start in range(int(low[row]), int(high[row]), limit):
            targets = np.arange(start, min(start + limit, int(high[row])))
            yield np.full(len(targets), row), targets
    rows = np.flatnonzero((high > low) & (high - low <= limit))
    counts = high[rows] - low[rows]
    ends = np.cumsum(counts)
    start = 0
    while start < len(rows):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        part, n = rows[start:stop], counts[start:stop]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(part, n), np.repeat(low[part], n) + within
        start = stop


def _long_rows(low: np.ndarray, high: np.ndarray, limit: int) -> np.ndarray:
    return np.flatnonzero(high - low > limit)


def to_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to (node, smallest node of its component): same connectivity, fewer edges than nodes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _shrunk(edges: DataFrame, at_once: int) -> DataFrame:
    """Stars that connect what ``edges(a, b)`` connect: each task joins up the edges that it reads, about ``at_once`` at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, at_once):
            node, root = to_stars(*(np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(2)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

    return edges.mapInArrow(run, "a bigint, b bigint")


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[pa.RecordBatch]]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield held
            held, n = [], 0
    if n:
        yield held


def components(edges: DataFrame, max_rounds: int = 200, at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """Connected components of ``edges(a bigint, b bigint)`` as ``node, root``: one row per node except roots.

    A round joins up edges inside of tasks of about ``at_once`` edges, then takes the large-star and small-star steps; every
    round is a written table. Only counts come to the driver: of edges, and of nodes that are not settled, which have several
    edges to smaller nodes, or edges both to smaller and to larger ones. Edges that are no more than one task's are settled
    in it without a round. A node with very many edges is a hot join key that adaptive execution splits; minima are
    partial aggregates. Null ends are ignored.
    """
    def link(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def unsettled(df: DataFrame) -> int:
        ends = df.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(df.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").count()

    now = written(link(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))), "edges")
    for _ in range(max_rounds):
        n = now.count()
        now = written(_shrunk(now.coalesce(max(1, -(-n // at_once))), max(n, 1) if n <= at_once else at_once), "stars")
        if n <= at_once or not unsettled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = link(large)
        down = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(down, large.a == down.u).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = written(link(small), "edges")
    raise RuntimeError("components did not settle")
