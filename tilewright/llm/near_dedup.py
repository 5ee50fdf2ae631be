"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of ``bits`` = 64 link at ``radius`` or fewer differing bits. Correlated bits are grouped into
``m`` partitions; every fingerprint gets its own thresholds t_1..t_m with sum ``radius - m + 1`` (-1 leaves a
partition out) by dynamic programming on estimated candidate counts. If two fingerprints link, some partition
of them differs in at most t_i bits, so probing all values within t_i bits of the own value finds every link.

Only fixed-size statistics reach the driver: 64 x 64 bit counts and histograms of blocks of 11 bits or fewer.
Copies are merged before the search. Candidates meet in sorted partitions and are compared as arrays; only a
spanning set of links leaves a task, so a dense group costs comparisons but no quadratic output. Keys whose
comparisons exceed ``PAIRS`` are cut into a grid of salted cells.

``similar_documents`` links texts by the exact Jaccard similarity of their shingle sets. The same search, on fingerprints
of the sets, gives the candidates of ``RADIUS`` bits, which are verified and linked first. At 0.8 fingerprints differ in
about 10 bits, 17 for nearly all pairs, too many for probing. So what is still apart also meets if it shares one of
``BANDS`` bands of ``ROWS`` minima of their set under hashes; a pair at 0.8 is missed with (1 - 0.8^5)^40 = 1.3e-7.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, components, map_batches, pair_chunks, text_of, to_stars, written

SEED = 42
BLOCK_BITS = 11
# Comparisons per key from which the key is cut into cells, and rows per side of a cell.
PAIRS, CELL = 400_000_000, 20_000
_SHINGLES_AT_ONCE = 1 << 16
# Documents of a similarity of 4 / 5 or more link.
SIMILAR = (4, 5)
# Bits within which the pigeonhole search finds candidates for that.
RADIUS = 4
BANDS, ROWS = 40, 5
_AT_ONCE = 512


def _shingle_hashes(data: bytes, words: int) -> Iterator[int]:
    """Hashes of the runs of ``words`` words; a shorter text is one run."""
    tokens = data.lower().split()
    if not tokens:
        return iter(())
    if len(tokens) <= words:
        grams: Iterator[bytes] = iter([b" ".join(tokens)])
    else:
        grams = map(b" ".join, zip(*[islice(tokens, k, None) for k in range(words)]))
    return map(xxhash.xxh64_intdigest, grams, repeat(SEED))


def simhash(data: bytes, words: int = 4) -> int:
    """Unsigned fingerprint of a UTF-8 text; no words give zero."""
    return _majority(_shingle_hashes(data, words))


def _majority(hashes: Iterator[int]) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    counts, n = np.zeros(64, np.int64), 0
    while len(part := np.fromiter(islice(hashes, _SHINGLES_AT_ONCE), np.uint64)):
        counts += _bits(part).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.bitwise_or.reduce(np.where(2 * counts > n, _POWERS, np.uint64(0))))


_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _bits(values: np.ndarray) -> np.ndarray:
    """n x 64 zeros and ones, column j is bit j."""
    raw = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every text as a signed 64-bit number. A null text counts as empty."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))

    def fill(batch: pa.RecordBatch) -> dict:
        found = np.array([simhash(x, words) for x in byte_values(batch.column(1))], np.uint64)
        return {"doc_id": batch.column(0), "fp": found.view(np.int64)}

    return map_batches(rows, fill, "doc_id bigint, fp bigint")


@dataclass(frozen=True)
class Partitioning:
    """Bit groups, their blocks and per block the share of fingerprints at each distance from each value."""

    groups: tuple[tuple[int, ...], ...]
    blocks: tuple[tuple[tuple[int, ...], ...], ...]
    near: tuple[tuple[np.ndarray, ...], ...]
    radius: int
    n: int


def group_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Splits 64 bits into ``m`` groups, each grown from its most correlated pair. ``together``: counts of both set."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, -1.0)
    left, out = set(range(64)), []
    for k in range(m):
        width = len(left) // (m - k)
        free = sorted(left)
        sub = corr[np.ix_(free, free)]
        i, j = np.unravel_index(int(sub.argmax()), sub.shape)
        group = [free[i], free[j]] if i != j else [free[i]]
        while len(group) < width:
            rest = [b for b in free if b not in group]
            group.append(max(rest, key=lambda b: (corr[b, group].mean(), -b)))
        out.append(group[:width])
        left -= set(group[:width])
    return out


def _take(bits: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """The bits at ``places`` as numbers, first place lowest."""
    return bits[:, list(places)].astype(np.int64) @ (np.int64(1) << np.arange(len(places), dtype=np.int64))


def _count_partitions(fps: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
        i, j = np.indices((64, 64))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "n"])

    rows = fps.select("fp").mapInArrow(run, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n"))
    out = np.zeros((64, 64), np.int64)
    for r in rows.collect():
        out[r.i, r.j] = r.n
    return out


def _histograms(fps: DataFrame, blocks: list[tuple[int, ...]]) -> list[np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << len(b), np.int64) for b in blocks]
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            for k, b in enumerate(blocks):
                total[k] += np.bincount(_take(bits, b), minlength=1 << len(b))
        for k, counts in enumerate(total):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(counts[at])], names=["k", "v", "n"])

    rows = fps.select("fp").mapInArrow(run, "k bigint, v bigint, n bigint").groupBy("k", "v").agg(F.sum("n").alias("n"))
    out = [np.zeros(1 << len(b), np.int64) for b in blocks]
    for r in rows.collect():
        out[r.k][r.v] = r.n
    return out


def _at_distance(hist: np.ndarray, width: int, radius: int) -> np.ndarray:
    """values x (radius + 1): the share of fingerprints whose block differs from the value in d bits."""
    out = np.zeros((len(hist), radius + 1))
    values = np.arange(len(hist))
    for d in range(min(radius, width) + 1):
        for places in combinations(range(width), d):
            out[:, d] += hist[values ^ sum(1 << p for p in places)]
    return out / max(hist.sum(), 1)


def partition_count(n: int, radius: int, most_candidates: float = 1000.0) -> int:
    """The most partitions (fewest probes) that keep the candidates of one fingerprint few. Results do not depend on it."""
    for m in range(radius + 1, 2, -1):
        # One bit more is dealt out to radius - m + 1 partitions.
        probes = m + (radius - m + 1) * 64 / m
        if probes * n / 2 ** (64 / m) <= most_candidates:
            return m
    return 2


def learn_partitioning(fps: DataFrame, radius: int = 4, m: int | None = None) -> Partitioning:
    """Bit groups and block histograms of the distinct fingerprints ``fps(fp)``."""
    together = _count_partitions(fps)
    n = fps.count()
    m = m or partition_count(n, radius)
    groups = group_bits(together, n, m)
    blocks = [[tuple(g[k:k + BLOCK_BITS]) for k in range(0, len(g), BLOCK_BITS)] for g in groups]
    flat = [b for row in blocks for b in row]
    near = iter([_at_distance(h, len(b), radius) for h, b in zip(_histograms(fps, flat), flat)])
    return Partitioning(
        tuple(map(tuple, groups)), tuple(map(tuple, blocks)), tuple(tuple(next(near) for _ in row) for row in blocks), radius, n
    )


def _probe_count(width: int, t: int) -> int:
    total, term = 0, 1
    for d in range(t + 1):
        total += term
        term = term * (width - d) // (d + 1)
    return total


def allocate(bits: np.ndarray, parts: Partitioning, row_cost: float = 100.0) -> np.ndarray:
    """n x m thresholds of least estimated cost: ``row_cost`` per probe plus one per expected candidate."""
    m, radius = len(parts.groups), parts.radius
    n = len(bits)
    # cost[i][:, t + 1] for t = -1..radius
    costs = []
    for group, blocks, near in zip(parts.groups, parts.blocks, parts.near):
        share = np.zeros((n, radius + 1))
        share[:, 0] = 1.0
        for block, table in zip(blocks, near):
            own = table[_take(bits, block)]
            share = np.stack([sum(share[:, a] * own[:, d - a] for a in range(d + 1)) for d in range(radius + 1)], axis=1)
        within = np.cumsum(share, axis=1) * parts.n
        rows = np.array([_probe_count(len(group), t) for t in range(radius + 1)]) * row_cost
        costs.append(np.concatenate([np.zeros((n, 1)), within + rows], axis=1))
    # best[:, s]: least cost of the partitions so far whose (t + 1) add up to s; the total is radius + 1
    total = radius + 1
    best = costs[0].copy()
    picks = []
    for cost in costs[1:]:
        trial = np.stack(
            [np.stack([best[:, s - k] + cost[:, k] if k <= s else np.full(n, np.inf) for k in range(total + 1)], axis=1) for s in range(total + 1)],
            axis=1,
        )
        picks.append(trial.argmin(axis=2))
        best = trial.min(axis=2)
    out = np.zeros((n, m), np.int64)
    s = np.full(n, total)
    for i in range(m - 1, 0, -1):
        k = picks[i - 1][np.arange(n), s]
        out[:, i] = k - 1
        s = s - k
    out[:, 0] = s - 1
    return out


def _keys(fps: np.ndarray, parts: Partitioning) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, fingerprint, role): role 0 once per partition, role 1 per probed value."""
    bits = _bits(fps)
    thresholds = allocate(bits, parts)
    for i, group in enumerate(parts.groups):
        value = _take(bits, group)
        tag = np.int64(i) << np.int64(56) if len(group) <= 56 else np.int64(0)
        yield tag | value, fps, np.zeros(len(fps), np.int8)
        for d in range(int(thresholds[:, i].max(initial=-1)) + 1):
            rows = np.flatnonzero(thresholds[:, i] >= d)
            masks = np.array([sum(1 << p for p in c) for c in combinations(range(len(group)), d)], np.int64)
            for k in range(0, len(rows), max(1, 100_000 // len(masks))):
                part = rows[k:k + max(1, 100_000 // len(masks))]
                key = (value[part][:, None] ^ masks[None, :]).ravel()
                yield tag | key, np.repeat(fps[part], len(masks)), np.ones(len(key), np.int8)


def _rows(fps: DataFrame, parts: Partitioning) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for key, fp, role in _keys(values, parts):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64)), pa.array(role)], names=["key", "fp", "role"])

    return fps.select("fp").mapInArrow(run, "key bigint, fp bigint, role tinyint")


def _compare(radius: int):
    """Streams rows sorted by (key, cell, role) and yields spanning links of what lies within ``radius``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key = held_fp = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group, fp, role = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if held_fp is not None and len(held_fp) and group[0] == held_key:
                group = np.concatenate([np.full(len(held_fp), held_key), group])
                role = np.concatenate([np.zeros(len(held_fp), role.dtype), role])
                fp = np.concatenate([held_fp, fp])
            number = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
            index, probe = role == 0, role == 1
            index_of, index_fp = number[index], fp[index].view(np.uint64)
            probe_of, probe_fp = number[probe], fp[probe].view(np.uint64)
            low, high = np.searchsorted(index_of, probe_of, "left"), np.searchsorted(index_of, probe_of, "right")
            for a, b in pair_chunks(low, high):
                left, right = probe_fp[a], index_fp[b]
                linked = (np.bitwise_count(left ^ right) <= radius) & (left != right)
                if linked.any():
                    node, root = to_stars(left[linked].view(np.int64), right[linked].view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])
            held_key, held_fp = group[-1], fp[index & (number == number[-1])]

    return run


def links(fps: DataFrame, radius: int = 4, m: int | None = None) -> DataFrame:
    """Spanning links ``a, b`` of distinct fingerprints ``fps(fp)``: connects exactly what links within ``radius``.

    Either end may be joined through other fingerprints of its component. Not every link is listed.
    """
    parts = learn_partitioning(fps, radius, m)
    rows = _rows(fps, parts)
    counts = rows.groupBy("key").agg(
        F.sum(F.when(F.col("role") == 0, 1).otherwise(0)).alias("n0"), F.sum(F.when(F.col("role") == 1, 1).otherwise(0)).alias("n1")
    )
    hot = written(
        counts.where(F.col("n0").cast("double") * F.col("n1") > float(PAIRS)).select(
            "key", F.ceil(F.col("n0") / CELL).cast("int").alias("c0"), F.ceil(F.col("n1") / CELL).cast("int").alias("c1")
        ),
        "hot-keys",
    )
    if not hot.isEmpty():
        salt = F.xxhash64("fp", F.lit(7))
        rows = rows.join(hot, "key", "left").withColumns({"c0": F.coalesce("c0", F.lit(1)), "c1": F.coalesce("c1", F.lit(1))})
        own = F.pmod(salt, F.when(F.col("role") == 0, F.col("c0")).otherwise(F.col("c1"))).cast("int")
        across = F.explode(F.sequence(F.lit(0), F.when(F.col("role") == 0, F.col("c1")).otherwise(F.col("c0")) - 1))
        rows = rows.withColumn("own", own).withColumn("across", across)
        cell = F.when(F.col("role") == 0, F.struct(F.col("own").alias("x"), F.col("across").alias("y"))).otherwise(
            F.struct(F.col("across").alias("x"), F.col("own").alias("y"))
        )
        rows = rows.withColumn("cell", cell).select(F.xxhash64("key", "cell.x", "cell.y").alias("key"), "fp", "role")
    # Rows of two keys that share a hash are compared, too, which does no harm: the distance decides.
    sorted_rows = rows.repartition(F.col("key")).sortWithinPartitions("key", "role")
    return sorted_rows.mapInArrow(_compare(radius), "a bigint, b bigint")


def near_duplicates(marks: DataFrame, radius: int = 4, m: int | None = None) -> DataFrame:
    """``doc_id, fp, component_id`` of ``marks(doc_id, fp)``: smallest doc_id reachable over links.

    Equal fingerprints always link. A null doc_id is kept but never names a component while others exist.
    An empty table gives an empty result.
    """
    distinct = written(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    stars = components(links(distinct, radius, m))
    rooted = distinct.join(stars, distinct.fp == stars.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    member = rooted.join(named, "root").select("fp", "component_id")
    return marks.join(member, "fp").select("doc_id", "fp", "component_id")


_RNG = np.random.default_rng(SEED)
_FACTORS, _OFFSETS = (_RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1) for _ in range(2))
_MIX = _RNG.integers(0, 1 << 64, ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_set(data: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(np.fromiter(_shingle_hashes(data, words), np.uint64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key per band of a set: sets of similarity s share a given one with probability s ** ROWS. None for no shingles."""
    if not len(found):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), _AT_ONCE):
        np.minimum(low, (found[None, k:k + _AT_ONCE] * _FACTORS + _OFFSETS).min(axis=1), out=low)
    keys = np.arange(BANDS, dtype=np.uint64)
    for j, row in enumerate(low.reshape(BANDS, ROWS).T):
        keys = (keys ^ row) * _MIX[j]
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _node(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view(np.int64)))


def _by_set(docs: DataFrame, words: int, column: str, make: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``doc_id, node`` (the name of the shingle set), ``fp`` (its fingerprint) and ``column``, made from the set."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sets = [shingle_set(x, words) for x in byte_values(part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(map(_node, sets), pa.int64()),
                        pa.array(np.array([_majority(iter(x)) for x in sets], np.uint64).view(np.int64)), _lists([make(x) for x in sets]),
                    ],
                    names=["doc_id", "node", "fp", column],
                )

    return rows.mapInArrow(run, f"doc_id bigint, node bigint, fp bigint, {column} array<bigint>")


def _close_sets(firsts: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of sets ``firsts(node, fp)``: those the pigeonhole search joins within ``RADIUS`` bits, and sets of equal fingerprints with the first of them."""
    prints = written(firsts.groupBy("fp").agg(F.min("node").alias("low")), "set-prints")
    same = firsts.join(prints, "fp").select(F.col("low").alias("a"), F.col("node").alias("b"))
    found = links(prints.select("fp"), RADIUS).select(F.col("a").alias("_x"), F.col("b").alias("_y")).distinct()
    found = found.join(prints.select(F.col("fp").alias("_x"), F.col("low").alias("x")), "_x").join(prints.select(F.col("fp").alias("_y"), F.col("low").alias("y")), "_y")
    return same.union(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).where("a < b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs(a, b)`` whose sets have a Jaccard similarity of ``SIMILAR`` or more, from sizes alone: common / (|a| + |b| - common)."""
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    met = met.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    least, whole = SIMILAR
    close = F.size(F.array_intersect("x", "y")) * (least + whole) >= (F.size("x") + F.size("y")) * least
    return met.where(close).select("a", "b")


def similar_documents(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id, component_id`` of ``docs(doc_id, text)``: smallest doc_id reachable over pairs of a Jaccard similarity of 0.8 or more.

    Equal shingle sets are merged first; texts without words are equal. Sets of near fingerprints are linked next. In each
    band a set that is not linked to the first set of its key meets it; only keys that then still hold several components are paired, across components.
    A null doc_id never names a component while others exist.
    """
    marks = written(_by_set(docs, words, "bands", band_keys), "set-marks")
    firsts = written(marks.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp")), "distinct-sets")
    near = written(_close_sets(firsts), "close-sets")
    bands = marks.select(F.explode("bands").alias("key"), "node").distinct()
    bands = written(bands, "bands")
    shared = bands.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").drop("high")
    met = written(bands.join(shared, "key"), "met-sets")
    every = met.select("node").union(near.select("a")).union(near.select("b")).distinct()
    wanted = written(every.join(firsts, "node"), "wanted-sets")
    ids = wanted.select(F.col("first").alias("_first")).distinct()
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_first")), "left_semi")
    sets = _by_set(texts, words, "shingles", lambda x: x).drop("doc_id", "fp")
    # Other rows of a doc_id may have other sets.
    sets = written(sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "shingle-sets")

    # Stars stand for the pairs that they come from when further pairs are added.
    stars = components(written(_verified(near, sets), "similar-pairs"))
    linked = stars.select(F.col("node").alias("a"), F.col("root").alias("b"))
    pairs = met.where("low < node").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(stars.select(F.col("node").alias("a"), F.col("root").alias("_x")), "a", "left")
    pairs = pairs.join(stars.select(F.col("node").alias("b"), F.col("root").alias("_y")), "b", "left")
    pairs = pairs.where(F.coalesce("_x", "a") != F.coalesce("_y", "b")).select("a", "b")
    linked = linked.union(written(_verified(pairs, sets), "similar-pairs"))
    stars = components(linked)
    linked = stars.select(F.col("node").alias("a"), F.col("root").alias("b"))
    rooted = met.join(stars, "node", "left").select("key", "node", "low", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    left = written(rooted.join(several, "key"), "open-sets")
    l, r = left.alias("l"), left.alias("r")
    # Every set has met the first one of its key, or is linked to it.
    apart = (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node")) & (F.col("l.node") > F.col("l.low")) & (F.col("l.root") != F.col("r.root"))
    more = l.join(r, apart).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()
    more = written(_verified(more, sets), "similar-pairs")
    if not more.isEmpty():
        stars = components(linked.union(more))
    rooted = firsts.join(stars, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marks.select("doc_id", "node").join(rooted.join(named, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_first(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` without the documents that a similar document with a smaller doc_id stands for.

    Rows with a null doc_id stay. Of rows that repeat a doc_id all stay or go together.
    """
    gone = similar_documents(docs, words).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def hex_of(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
