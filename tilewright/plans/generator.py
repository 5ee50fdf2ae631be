"""Chips from random tiles up to a quota, with a ledger of finished tiles, so that a killed run goes on where it stopped.

Below the root folder of a run lie

    batches/<name>/cells    cells of all accepted chips of the tiles of one batch
    batches/<name>/chips    one row per accepted chip: its place in the scan order of its tile
    ledger                  one row per finished tile: tile_id, draw, n (accepted chips), batch

A batch is built, then its cells, its chips and last its ledger rows are written. Each of these is one Spark write, which appears
as a whole or not at all. A batch that is not in the ledger does not count: its tiles are built again under
another name. Tiles in the ledger are never built again.

The quota is not stored. Tiles are finished in the order of their first draw, so the chips that each gives are
a running total over the ledger, and a larger quota later goes on with the same run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rank import bucketed_rank
from ..operators.sampling import RADIUS, candidate_tiles, fill_quota
from ..operators.surfaces import filter_tile_area
from ..schema import BANDS, BLOCK_SIZE, MAX_TILE_AREA
from ..session import cut_lineage
from .stages import cut_chips

CHIP = ["tile_id", "brow", "bcol"]
# Tiles of the first batch, and of a later one per finished tile, where batches have no fixed size.
FIRST_BATCH, GROWTH = 64, 8


@dataclass(frozen=True)
class TileData:
    """What a batch of tiles is cut from: the stack's cells, the surfaces that are not background, and one grid per tile."""

    stack: DataFrame
    surfaces: DataFrame
    grids: DataFrame


class Ledger:
    """Finished tiles of a run."""

    SCHEMA = "tile_id string, draw bigint, n bigint, batch string"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.path = spark, f"{root}/ledger"
        # An empty first part: the folder can be read before the first batch is done.
        spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def commit(self, tiles: DataFrame) -> None:
        """Adds finished tiles in one file, so that all of a batch count or none."""
        tiles.select("tile_id", "draw", "n", "batch").coalesce(1).write.mode("append").parquet(self.path)

    def found(self) -> tuple[int, int]:
        """(tiles, accepted chips) so far."""
        return tuple(self.rows().agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first())

    def takes(self, size: int) -> DataFrame:
        """``tile_id, draw, take`` of the tiles that make up a quota."""
        rows = self.rows()
        return fill_quota(rows.select("tile_id", "draw"), rows.select("tile_id", "n"), size)


def read_chips(spark: SparkSession, root: str, size: int) -> DataFrame:
    """Cells of the first ``size`` chips of a run, with ``draw`` and ``chip_id``: tiles by draw, the chips of a tile in scan order."""
    ledger = Ledger(spark, root)
    rows = ledger.rows()
    if rows.isEmpty():
        raise ValueError(f"{root!r} holds no finished tile")
    names = {part: f"{root}/batches/*/{part}" for part in ("cells", "chips")}
    # The folder of a batch is part of the path; only batches of the ledger count.
    read = lambda part: spark.read.parquet(names[part]).withColumn("batch", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3))
    taken = rows.join(ledger.takes(size).select("tile_id", "take"), "tile_id").where("take > 0")
    chips = read("chips").join(taken, ["tile_id", "batch"]).where("place < take").select("batch", *CHIP, "draw")
    return read("cells").join(chips, ["batch", *CHIP]).drop("batch")


def _accepted(cells: DataFrame) -> DataFrame:
    """One row per chip, with its place in the scan order of its tile."""
    chips = cells.select(*CHIP, "chip_id").distinct()
    return bucketed_rank(chips, "brow", ["bcol"], ["tile_id"], "place")


def build_batch(
    batch: DataFrame, build: Callable[[DataFrame], TileData], root: str, cutoff: float, seed, chip_size: int, bands: Sequence[str]
) -> DataFrame:
    """Builds, cuts and stores the tiles of ``batch(tile_id, draw)``; the ledger rows of all of them, also of tiles without a chip."""
    spark, name = batch.sparkSession, uuid.uuid4().hex
    data = build(batch.select("tile_id"))
    folder = f"{root}/batches/{name}"
    cut_chips(data.stack, data.surfaces, data.grids, cutoff, seed, chip_size, bands).write.parquet(f"{folder}/cells")
    _accepted(spark.read.parquet(f"{folder}/cells")).write.parquet(f"{folder}/chips")
    counts = spark.read.parquet(f"{folder}/chips").groupBy("tile_id").agg(F.count("*").alias("n"))
    return batch.join(counts, "tile_id", "left").select("tile_id", "draw", F.coalesce("n", F.lit(0)).alias("n"), F.lit(name).alias("batch"))


def generate_chips(
    root: str, seeds: DataFrame, tiles: DataFrame, build: Callable[[DataFrame], TileData], size: int, cutoff: float, width: float,
    bands: Sequence[str] = BANDS, seed=0, chip_size: int = BLOCK_SIZE, draws: int = 1000, radius: float = RADIUS,
    max_area: float = MAX_TILE_AREA, idle: int = 5, tiles_per_batch: int | None = None, chip_seed=0,
) -> DataFrame:
    """Draws tiles around ``seeds`` and cuts their chips until there are ``size``; the cells of just these (:func:`read_chips`).

    ``build`` turns a table ``tile_id`` into :class:`TileData`; it is called once per batch, with tiles that are not in the ledger
    of ``root``. A batch has as many tiles as the chips per tile so far suggest, at most ``tiles_per_batch``, and they
    follow each other by first draw, so the sample is the same however it is cut into batches or stopped
    and started. Without ``tiles_per_batch`` the first batch has at most ``FIRST_BATCH`` tiles and each later one at most
    ``GROWTH`` times the tiles finished: a batch reads the sources once, so they are read a few times, however many tiles there are. It raises when all usable tiles were met, or when ``idle`` rounds of draws on end met no new one.
    """
    spark = tiles.sparkSession
    ledger = Ledger(spark, root)
    usable = filter_tile_area(tiles, max_area).count()
    start, n, quiet = 0, draws, 0
    done, got = ledger.found()
    while got < size:
        candidates = cut_lineage(candidate_tiles(seeds, tiles, ledger.rows().select("tile_id"), n, width, radius, seed, max_area, start))
        left = candidates.count()
        quiet = 0 if left else quiet + 1
        while left and got < size:
            per_tile = max(got / done, 0.1) if done else 1.0
            most = tiles_per_batch or max(FIRST_BATCH, GROWTH * done)
            count = max(1, min(most, left, round(1.2 * (size - got) / per_tile)))
            # They are next in order of their first draw.
            batch = cut_lineage(candidates.join(ledger.rows().select("tile_id"), "tile_id", "left_anti").orderBy("draw", "tile_id").limit(count))
            ledger.commit(build_batch(batch, build, root, cutoff, chip_seed, chip_size, bands))
            left -= count
            done, got = ledger.found()
        start, n = start + n, 2 * n
        if got < size and (done >= usable or quiet >= idle):
            raise RuntimeError(f"{start} draws gave {got} of {size} chips")
    return read_chips(spark, root, size)
