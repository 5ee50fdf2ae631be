"""Random locations around seed points, and tile sampling up to a number of chips."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_normal_pair, hash_unit
from ..schema import MAX_TILE_AREA
from ..session import cut_lineage
from .catalog import exclude_seen
from .rank import count_scalar, running_total, shuffled_rank
from .surfaces import filter_tile_area, tiles_containing

# Search radius in metres, and standard deviation of an offset relative to it.
RADIUS, SIGMA = 15e3, 1.0 / 3.0


def seeded_locations(seeds: DataFrame, n: int, radius: float = RADIUS, seed=0, start: int = 0) -> DataFrame:
    """``draw, x, y``: ``n`` draws of a random seed point plus a normal offset, at most ``radius`` long.

    ``seeds`` has ``seed_id, x, y``. Draws are numbered from ``start``, so a later round continues.
    """
    ranked = shuffled_rank(seeds.select("seed_id", "x", "y"), "seed_id", seed).select(
        F.col("rank").alias("pick"), F.col("x").alias("sx"), F.col("y").alias("sy")
    )
    draw = F.col("draw")
    u, v = hash_normal_pair(f"{seed}n", draw)
    draws = (
        seeds.sparkSession.range(start, start + n).withColumnRenamed("id", "draw")
        .withColumn("pick", F.floor(hash_unit(f"{seed}p", draw) * count_scalar(seeds)).cast("bigint"))
        .withColumns({"dx": u * SIGMA, "dy": v * SIGMA})
        .withColumn("norm", F.greatest(F.hypot("dx", "dy"), F.lit(1.0)))
    )
    return draws.join(ranked, "pick").select(
        "draw",
        (F.col("sx") + F.col("dx") / F.col("norm") * radius).alias("x"),
        (F.col("sy") + F.col("dy") / F.col("norm") * radius).alias("y"),
    )


def candidate_tiles(
    seeds: DataFrame, tiles: DataFrame, done: DataFrame, n: int, width: float, radius: float = RADIUS, seed=0,
    max_area: float = MAX_TILE_AREA, start: int = 0,
) -> DataFrame:
    """Tiles met by ``n`` draws in order of their first draw: not too large, not sampled before."""
    usable = exclude_seen(filter_tile_area(tiles, max_area), done)
    hits = tiles_containing(seeded_locations(seeds, n, radius, seed, start), usable, width)
    return hits.groupBy("tile_id").agg(F.min("draw").alias("draw"))


def fill_quota(candidates: DataFrame, chips: DataFrame, size: int, chunk: int = 1024) -> DataFrame:
    """Take candidates in draw order until ``size`` chips are reached: ``tile_id, draw, take``.

    ``chips`` has ``tile_id, n`` (accepted chips of a tile); the last tile gives only what is missing.
    """
    rows = candidates.join(chips, "tile_id").withColumn("_chunk", F.floor(F.col("draw") / chunk))
    summed = running_total(rows, F.col("n"), "_chunk", ["draw", "tile_id"], "_upto")
    before = F.col("_upto") - F.col("n")
    return summed.where(before < size).select(
        "tile_id", "draw", F.least(F.col("n"), size - before).cast("bigint").alias("take")
    )


def sample_tiles(
    seeds: DataFrame, tiles: DataFrame, chips_of: Callable[[DataFrame], DataFrame], size: int, width: float,
    draws: int = 1000, radius: float = RADIUS, seed=0, max_area: float = MAX_TILE_AREA, idle: int = 5,
) -> DataFrame:
    """Draw tiles until they give ``size`` chips: ``tile_id, draw, take``.

    ``chips_of`` turns candidate tiles into ``tile_id, n``. Each round goes on from the last draw with twice as many
    draws, leaves out tiles that were met before, and asks only for the chips still missing. It raises when all
    usable tiles were met, or when ``idle`` rounds on end met no new one.
    """
    usable = filter_tile_area(tiles, max_area)
    total = usable.count()
    seen, parts, start, n, got, quiet = tiles.select("tile_id").limit(0), [], 0, draws, 0, 0
    while got < size:
        candidates = cut_lineage(candidate_tiles(seeds, tiles, seen, n, width, radius, seed, max_area, start))
        part = cut_lineage(fill_quota(candidates, chips_of(candidates), size - got))
        parts.append(part)
        got += part.agg(F.coalesce(F.sum("take"), F.lit(0)).alias("n")).first()["n"]
        seen = seen.union(candidates.select("tile_id"))
        quiet = quiet + 1 if candidates.isEmpty() else 0
        start, n = start + n, 2 * n
        if got < size and (seen.count() >= total or quiet >= idle):
            raise RuntimeError(f"{start} draws gave {got} of {size} chips")
    sample = tiles.select("tile_id", F.lit(0).cast("bigint").alias("draw"), F.lit(0).cast("bigint").alias("take")).limit(0)
    for part in parts:
        sample = sample.union(part)
    return sample
