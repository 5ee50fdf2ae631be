"""Random and stratified dataset splits. A split is a table ``image, subset``."""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit
from ..schema import SUBSETS
from ..session import cut_lineage
from .rank import HASH_BUCKETS, bucketed_rank, shuffled_rank


# Ranges of the key that are ranked apart.
RANGES = 256


def subset_sizes(lengths: Sequence[float], total: int) -> list[int]:
    """Rows per subset, none of them zero.

    Whole numbers are taken as they are and have to make up the total. Fractions of 1 give the whole part of
    their share; rows that are left over go to the subsets by turns, in order.
    """
    if all(float(x).is_integer() for x in lengths):
        sizes = [int(x) for x in lengths]
        if min(sizes) < 0 or sum(sizes) != total:
            raise ValueError(f"{sizes} do not make up {total} rows")
        return sizes
    if not math.isclose(sum(lengths), 1) or sum(lengths) > 1 or min(lengths) <= 0:
        raise ValueError(f"{list(lengths)} are not fractions of 1")
    whole = [int(total * x) for x in lengths]
    left = total - sum(whole)
    sizes = [w + len(range(k, left, len(whole))) for k, w in enumerate(whole)]
    if min(sizes) == 0:
        raise ValueError(f"{total} rows are too few for {len(sizes)} subsets")
    return sizes


def subset_names(count: int, names: Sequence[str]) -> list[str]:
    """``count`` names: the given ones, then ``subset_3`` and so on."""
    return [names[k] if k < len(names) else f"subset_{k}" for k in range(count)]


def _subset_of(rank: Column, sizes: Sequence[int], names: Sequence[str]) -> Column:
    subset = F.lit(names[len(sizes) - 1])
    for end, name in reversed(list(zip(accumulate(sizes), names))[:-1]):
        subset = F.when(rank < end, name).otherwise(subset)
    return subset


def random_split(
    images: DataFrame, lengths: Sequence[float], seed=0, key: str = "image", names: Sequence[str] = SUBSETS
) -> DataFrame:
    """Cut a seeded random order into subsets of exact sizes. Only the row count reaches the driver."""
    ids = images.select(key).distinct()
    sizes = subset_sizes(lengths, ids.count())
    subset = _subset_of(F.col("rank"), sizes, subset_names(len(sizes), names))
    return shuffled_rank(ids, key, seed).select(key, subset.alias("subset"))


def assign_batches(
    ids: DataFrame, key: str, size: int, shuffle: bool = False, drop_last: bool = False, seed=0
) -> DataFrame:
    """Batch number per row; key order (whole-number key), or a seeded random order for training.
    ``drop_last`` removes an incomplete last batch."""
    if shuffle:
        ranked = shuffled_rank(ids, key, seed)
    else:
        # Ranges of like counts are ranked apart; batches are the same however the keys are cut.
        shares = [k / RANGES for k in range(1, RANGES)]
        cuts = ids.agg(F.percentile_approx(key, shares, 50 * RANGES).alias("cuts")).first().cuts or []
        limits = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<bigint>")
        spread = ids.withColumn("_bucket", F.size(F.filter(limits, lambda c: c <= F.col(key))))
        ranked = bucketed_rank(spread, "_bucket", [key]).drop("_bucket")
    batched = ranked.withColumn("batch", F.floor(F.col("rank") / size).cast("bigint"))
    if drop_last:
        batched = batched.where(F.col("batch") < ids.count() // size)
    return batched.drop("rank")


def subset_histogram(counts: DataFrame, splits: DataFrame, normalize: str | None = "local") -> DataFrame:
    """Class sums per subset as ``subset, class_id, n, share``.

    ``local`` divides by the subset's sum, ``global`` by the class sum of the whole dataset, None
    leaves the sum. The class list is complete in every subset.
    """
    if normalize not in ("local", "global", None):
        raise ValueError(f"unknown normalisation: {normalize}")
    sums = (
        counts.where("class_id is not null").join(splits, "image", "left")
        .groupBy("subset", "class_id").agg(F.sum("n").alias("n"))
    )
    # From here on there are at most subsets x classes rows.
    everything = W.partitionBy()
    per_subset = sums.groupBy("subset").agg(
        F.map_from_entries(F.collect_list(F.struct("class_id", "n"))).alias("m")
    )
    all_keys = F.collect_list(F.map_keys("m")).over(everything)
    full = (
        per_subset.withColumn("keys", all_keys)
        .withColumn("class_id", F.explode(F.array_distinct(F.flatten("keys"))))
        .select("subset", "class_id", F.coalesce(F.element_at("m", F.col("class_id")), F.lit(0)).alias("n"))
    )
    if normalize is None:
        share = F.col("n").cast("double")
    else:
        over = W.partitionBy("subset" if normalize == "local" else "class_id")
        share = F.col("n") / F.nullif(F.sum("n").over(over), F.lit(0))
    return full.withColumn("share", share).where("subset is not null")


def full_class_support(counts: DataFrame, splits: DataFrame) -> DataFrame:
    """``subset, full_support``: whether every class of the dataset has pixels in the subset."""
    return subset_histogram(counts, splits, None).groupBy("subset").agg(F.min(F.col("n") > 0).alias("full_support"))


def js_distances(histogram: DataFrame) -> DataFrame:
    """Jensen-Shannon distance of each pair of subsets, logarithm to the number of classes (2 at least)."""
    # One row per class with the shares of the few subsets, unfolded to subset pairs.
    side = lambda name: F.explode("s").alias(name)
    pairs = (
        histogram.groupBy("class_id").agg(F.collect_list(F.struct("subset", "share")).alias("s"))
        .select("s", side("a")).select("a", side("b")).where("a.subset < b.subset")
        .select(
            F.col("a.subset").alias("this"), F.col("b.subset").alias("that"),
            F.col("a.share").alias("p"), F.col("b.share").alias("q"),
        )
    )
    m = (F.col("p") + F.col("q")) / 2
    part = lambda v: F.when(F.col(v) > 0, F.col(v) * F.log(F.col(v) / m)).otherwise(0.0)
    base = F.log(F.greatest(F.count("*"), F.lit(2)).cast("double"))
    return pairs.groupBy("this", "that").agg(
        F.sqrt(F.greatest(F.sum(part("p") + part("q")), F.lit(0.0)) / (2 * base)).alias("distance")
    )


def reduce_distance(distances: DataFrame, how: str = "avg") -> DataFrame:
    reducers = {"avg": F.avg, "max": F.max, "sum": F.sum}
    if how not in reducers:
        raise ValueError(f"unknown reduction: {how}")
    return distances.agg(reducers[how]("distance").alias("distance"))


def _random_cuts(ids: DataFrame, numbers: list[int], sizes: Sequence[int], seed) -> DataFrame:
    """``trial, cuts``: per random order of the images, where each subset but the first begins, as (hash, image).

    Counts per range of the hash tell the range of each cut; only rows of those ranges are ranked.
    """
    trial = F.explode(F.array(*[F.lit(k) for k in numbers])).alias("trial")
    drawn = ids.select("image", trial).withColumn("u", hash_unit(seed, F.col("trial"), F.col("image")))
    drawn = drawn.withColumn("slot", F.floor(F.col("u") * HASH_BUCKETS).cast("int"))
    counts = drawn.groupBy("trial", "slot").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("trial").orderBy("slot")) - F.col("n")
    ends = [F.lit(e) for e in list(accumulate(sizes))[:-1]]
    wanted = counts.withColumn("before", before).select("trial", "slot", "before", F.filter(
        F.array(*ends), lambda e: (e >= F.col("before")) & (e < F.col("before") + F.col("n"))
    ).alias("ends")).where(F.size("ends") > 0)
    # One row per trial and cut at most.
    near = drawn.join(F.broadcast(wanted), ["trial", "slot"])
    place = F.row_number().over(W.partitionBy("trial", "slot").orderBy("u", "image")) - 1 + F.col("before")
    cut = near.withColumn("place", place).where(F.array_contains("ends", F.col("place")))
    return cut.groupBy("trial").agg(F.sort_array(F.collect_list(F.struct("u", "image"))).alias("cuts"))


class _Climb:
    """A climb of one trial over its pool of images: exchanges that lower the distance are made one after another."""

    WIDTH = 16

    def __init__(self, seed, round_no: int, steps: int, subsets: int, sums: dict[int, list[list[float]]]) -> None:
        """``sums``: class sums of the subsets of every trial."""
        self.sums = sums
        self.seed, self.round_no, self.steps = zlib.crc32(str(seed).encode()), round_no, steps
        self.pairs = list(combinations(range(subsets), 2))
        self.left, self.right = np.array(self.pairs, int).reshape(-1, 2).T

    def distance(self, sums: np.ndarray) -> np.ndarray:
        """Mean Jensen-Shannon distance of ``sums[..., subset, class]``, all positive."""
        share = sums / sums.sum(axis=-1, keepdims=True)
        p, q = share[..., self.left, :], share[..., self.right, :]
        middle = (p + q) / 2
        parts = (p * np.log(p / middle) + q * np.log(q / middle)).sum(axis=-1)
        return np.sqrt(np.maximum(parts, 0) / (2 * np.log(max(sums.shape[-1], 2)))).mean(axis=-1)

    def climb(self, rows: pd.DataFrame) -> pd.DataFrame:
        trial, rows = int(rows["trial"].iloc[0]), rows.sort_values("image", ignore_index=True)
        vectors, subset = np.array(rows["vector"].tolist()), rows["subset"].to_numpy().copy()
        sums = np.array(self.sums[trial])
        rng = np.random.default_rng([self.seed, trial, self.round_no])
        members = [np.flatnonzero(subset == k) for k in range(len(sums))]
        now, begun = float(self.distance(sums)), subset.copy()
        for step in range(self.steps):
            a, b = self.pairs[step % len(self.pairs)]
            if not len(members[a]) or not len(members[b]) or now < 1e-12:
                continue
            at, to = rng.integers(len(members[a])), rng.integers(len(members[b]), size=self.WIDTH)
            change = vectors[members[b][to]] - vectors[members[a][at]]
            tried = np.repeat(sums[None], self.WIDTH, axis=0)
            tried[:, a] += change
            tried[:, b] -= change
            # Exchanges that would leave a subset without a class do not count.
            valid = np.flatnonzero((tried > 0).all(axis=(1, 2)))
            if not len(valid):
                continue
            found = self.distance(tried[valid])
            best = valid[found.argmin()]
            if found.min() < now:
                now, sums = float(found.min()), tried[best]
                one, other = members[a][at], members[b][to[best]]
                members[a][at], members[b][to[best]] = other, one
                subset[one], subset[other] = b, a
        moved = np.flatnonzero(subset != begun)
        images = rows["image"].iloc[moved].tolist()
        return pd.DataFrame({
            "trial": [trial], "distance": [now], "sums": [sums.tolist()],
            "moved": [[{"image": i, "subset": int(k)} for i, k in zip(images, subset[moved])]],
        })


def _grouped(climb: _Climb):
    # Spark counts the arguments of a method with its object, so it takes a function.
    return lambda rows: climb.climb(rows)


def stratified_split(
    counts: DataFrame,
    lengths: Sequence[float],
    trials: int = 100,
    swaps: int = 1000,
    seed=0,
    names: Sequence[str] = SUBSETS,
    pool: int = 1000,
    max_starts: int | None = None,
    rounds: int = 2,
) -> DataFrame:
    """A split whose subsets have similar class distributions, as ``image, subset``.

    1. Random starts are cut from seeded orders, and those with all classes in every subset are kept, until there
       are ``trials``. It raises if ``max_starts`` starts (20 per trial, 200 at least) do not hold so many.
    2. Every trial takes ``swaps`` steps. A step draws an image of one subset and ``_Climb.WIDTH`` of another and scores their
       exchanges by class sums alone; of those that keep all classes, the one with the least mean Jensen-Shannon
       distance is made if that falls. The images of a round are a pool: a random share of all, the same
       for all trials, in which the smallest subset has about ``pool`` images. A trial's pool is one group of bounded
       size, and trials climb side by side. Where the pool is less than all images, the steps are spread
       over ``rounds``, each with a pool of its own.
    3. The trial with the least distance is returned.

    Per round only the distance and class sums of each trial reach the driver. Sizes and support are kept
    and the distance never rises. The search runs when this is called.
    """
    spark = counts.sparkSession
    known = counts.where("class_id is not null and n > 0")
    classes = sorted(r["class_id"] for r in known.select("class_id").distinct().limit(257).collect())
    if len(classes) > 256:
        raise ValueError("a class is one byte; there are more than 256")
    vector = F.array(
        *[F.coalesce(F.sum(F.when(F.col("class_id") == c, F.col("n"))), F.lit(0)).cast("double") for c in classes]
    )
    # Read several times below: one row per image is stored in the shared folder.
    images = cut_lineage(counts.groupBy("image").agg(vector.alias("vector")))
    ids = images.select("image")
    total = ids.count()
    sizes = subset_sizes(lengths, total)
    order = subset_names(len(sizes), names)
    kind = ids.schema["image"].dataType.simpleString()
    cut_type = f"array<struct<u: double, image: {kind}>>"
    state_type = f"trial int, cuts {cut_type}"

    def placed(some: DataFrame, state: list[tuple]) -> DataFrame:
        """``trial, image, vector, subset``: where each image of ``some`` begins in every trial."""
        rows = some.select("image", "vector", F.explode(F.array(*[F.lit(t[0]) for t in state])).alias("trial"))
        # At most a row per trial.
        rows = rows.join(F.broadcast(spark.createDataFrame([t[:2] for t in state], state_type)), "trial")
        own = F.struct(hash_unit(seed, F.col("trial"), F.col("image")).alias("u"), F.col("image").alias("image"))
        begun = F.transform(F.array(own), lambda x: F.size(F.filter("cuts", lambda c: c <= x)))[0]
        return rows.select("trial", "image", "vector", begun.alias("subset"))

    def with_moves(rows: DataFrame, moves: DataFrame | None) -> DataFrame:
        if moves is None:
            return rows
        return rows.join(moves, ["trial", "image"], "left").withColumn("subset", F.coalesce("moved_to", "subset")).drop("moved_to")

    found: list[tuple] = []
    first, max_starts = 0, max_starts or max(20 * trials, 200)
    while len(found) < trials:
        if first >= max_starts:
            raise RuntimeError(f"{len(found)} of {first} random starts have full class support, not {trials}")
        numbers = list(range(first, min(first + max(trials, 100), max_starts)))
        first = numbers[-1] + 1
        cuts = [(k, []) for k in numbers] if len(sizes) == 1 else [tuple(r) for r in _random_cuts(ids, numbers, sizes, seed).collect()]
        start = [(trial, cut, []) for trial, cut in cuts]
        sums = placed(images, start).groupBy("trial", "subset").agg(F.array(*[F.sum(F.col("vector")[i]) for i in range(len(classes))]).alias("sums"))
        held: dict[int, dict[int, list[float]]] = {}
        for r in sums.collect():
            held.setdefault(r["trial"], {})[r["subset"]] = r["sums"]
        for trial, cut, _ in sorted(start, key=lambda t: t[0]):
            own = [held[trial].get(k, []) for k in range(len(sizes))]
            if all(own) and min(map(min, own)) > 0 and len(found) < trials:
                found.append((trial, cut, own))

    moves, share = None, min(1.0, pool / max(min(sizes), 1))
    climbs = 0 if len(sizes) < 2 else 1 if share >= 1 or swaps < rounds else rounds
    climb = _Climb(seed, 0, 0, len(sizes), {})
    distance = {trial: float(climb.distance(np.array(sums))) if climb.pairs else 0.0 for trial, _, sums in found}
    for k in range(climbs if swaps else 0):
        some = images if share >= 1 else images.where(hash_unit(f"{seed}pool{k}", F.col("image")) < share)
        climb = _Climb(seed, k, swaps // climbs + (k < swaps % climbs), len(sizes), {trial: sums for trial, _, sums in found})
        # A task per trial: adaptive execution would put many of these small groups into one.
        rows = with_moves(placed(some, found), moves).repartition(len(found), "trial")
        result = rows.groupBy("trial").applyInPandas(
            _grouped(climb), f"trial int, distance double, sums array<array<double>>, moved array<struct<image: {kind}, subset: int>>"
        )
        result = cut_lineage(result)
        reached = {r["trial"]: r for r in result.select("trial", "distance", "sums").collect()}
        distance.update((trial, r["distance"]) for trial, r in reached.items())
        found = [(trial, cut, reached[trial]["sums"] if trial in reached else sums) for trial, cut, sums in found]
        new = result.select("trial", F.explode("moved").alias("m")).select("trial", "m.image", F.col("m.subset").alias("new_to"))
        if moves is None:
            moves = new.withColumnRenamed("new_to", "moved_to")
        else:
            moves = moves.join(new, ["trial", "image"], "full").select("trial", "image", F.coalesce("new_to", "moved_to").alias("moved_to"))
    least = min(found, key=lambda t: (distance[t[0]], t[0]))
    chosen = with_moves(placed(images, [least]), moves)
    return chosen.select("image", F.element_at(F.array(*[F.lit(n) for n in order]), F.col("subset") + 1).alias("subset"))
