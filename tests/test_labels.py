import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import golden
from tilewright.functions.hashing import hash_unit
from tilewright.operators.labels import (
    class_count_matrix, class_counts, class_id_of, class_mapping, drop_invalid_class, empty_sides, label_classes,
    reindex_class_table, reindex_classes, restrict_to_split, verify_pairs,
)
from tilewright.operators.rank import bucketed_rank, running_total, shuffled_rank
from tilewright.operators.runs import best_run, last_run, skip_completed
from tilewright.operators.splits import (
    assign_batches, full_class_support, js_distances, random_split, reduce_distance, stratified_split, subset_histogram,
    subset_sizes,
)
from tilewright.operators.stats import band_ranges, class_weights, minmax_scale
from tilewright.schema import class_table


@pytest.fixture()
def mask(spark):
    rows = [("a", 0)] * 3 + [("a", 7)] * 2 + [("a", 4)] + [("b", 2)] * 4 + [("b", 7)] + [("c", 0)] * 5 + [("d", 4)]
    return spark.createDataFrame(rows, "image string, class_id int")


def test_counts_and_invalid_class(spark, mask):
    classes = class_table(spark)
    assert spark.range(1).select(class_id_of(classes, "INVALID")).first()[0] == 4
    clean = drop_invalid_class(mask, classes)
    got = {(r["image"], r["class_id"]): r["n"] for r in class_counts(clean).collect()}
    assert got == {("a", 7): 2, ("b", 2): 4, ("b", 7): 1, ("c", None): 0, ("d", None): 0}
    assert class_counts(clean, keep_empty=False).count() == 3
    # A table without such a class changes nothing.
    assert drop_invalid_class(mask, classes.where("id <> 4")).where("class_id = 4").count() == 2


def test_matrix_and_reindex(spark, mask):
    counts = class_counts(drop_invalid_class(mask, class_table(spark)))
    rows = {r["image"]: (r["c2"], r["c7"]) for r in class_count_matrix(counts, [7, 2]).collect()}
    assert rows == {"a": (0, 2), "b": (4, 1), "c": (0, 0), "d": (0, 0)}
    mapping = class_mapping(counts)
    assert {(r["old_id"], r["new_id"]) for r in mapping.collect()} == {(2, 1), (7, 2)}
    new = reindex_classes(drop_invalid_class(mask, class_table(spark)), mapping)
    assert Counter(r["class_id"] for r in new.collect()) == {0: 10, 1: 4, 2: 3}
    table = {r["id"]: r["name"] for r in reindex_class_table(class_table(spark), mapping).collect()}
    assert table == {0: "Background", 1: "Dark-coloured Membrane", 2: "Metal"}


def test_label_classes(spark, mask):
    labelled = label_classes(mask, class_table(spark))
    assert labelled.where("name = 'Metal'").count() == 3
    odd = spark.createDataFrame([(99,)], "class_id int")
    assert label_classes(odd, class_table(spark), strict=False).first()["name"] is None
    with pytest.raises(Exception, match="unknown class"):
        label_classes(odd, class_table(spark)).collect()


def test_verify_pairs(spark):
    files = lambda names: spark.createDataFrame([(n,) for n in names], "image string")
    splits = spark.createDataFrame([("a.tif", "training"), ("b.tif", "test"), ("c.tif", "test")], "image string, subset string")
    bad = verify_pairs(files(["x/a.tif", "x/b.tif"]), files(["y/a.png", "y/c.png"]), splits)
    assert {(r["image"], r["reason"]) for r in bad.collect()} == {("b.tif", "no mask"), ("c.tif", "no image")}
    assert [r["side"] for r in empty_sides(files([]), files(["a"])).collect()] == ["image"]


def test_hash_unit_is_uniform_and_stable(spark):
    u = [r[0] for r in spark.range(2000).select(hash_unit(1, F.col("id"))).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.03
    again = [r[0] for r in spark.range(2000).repartition(7).orderBy("id").select(hash_unit(1, F.col("id"))).collect()]
    assert u == again


def test_ranks_over_buckets(spark):
    df = spark.createDataFrame([(g, v) for g in "ab" for v in range(50)], "g string, v int").withColumn("b", F.floor(F.col("v") / 7))
    got = bucketed_rank(df, "b", ["v"], ["g"])
    assert all(r["rank"] == r["v"] for r in got.collect())
    totals = running_total(df.where("g = 'a'"), F.col("v"), "b", ["v"])
    assert all(r["total"] == r["v"] * (r["v"] + 1) // 2 for r in totals.collect())
    ranks = sorted(r["rank"] for r in shuffled_rank(df.where("g = 'a'"), "v", 3).collect())
    assert ranks == list(range(50))


@pytest.mark.parametrize("n,lengths,want", [
    (10, (0.7, 0.15, 0.15), [8, 1, 1]), (11, (0.5, 0.25, 0.25), [6, 3, 2]), (7, (3, 4), [3, 4]), (300, (0.7, 0.15, 0.15), [210, 45, 45]),
])
def test_subset_sizes(n, lengths, want):
    assert subset_sizes(lengths, n) == want


@pytest.mark.parametrize("n,lengths", [(10, (3, 4)), (2, (0.7, 0.15, 0.15)), (10, (1.0,)), (10, (0.5, 0.6))])
def test_bad_subset_sizes(n, lengths):
    with pytest.raises(ValueError):
        subset_sizes(lengths, n)


def test_random_split(spark):
    ids = spark.range(100).withColumnRenamed("id", "image")
    split = random_split(ids, [0.7, 0.15, 0.15], seed=1)
    rows = split.collect()
    assert Counter(r["subset"] for r in rows) == {"training": 70, "validation": 15, "test": 15}
    assert len({r["image"] for r in rows}) == 100
    assert {tuple(r) for r in random_split(ids.repartition(5), [0.7, 0.15, 0.15], seed=1).collect()} == {tuple(r) for r in rows}
    other = {tuple(r) for r in random_split(ids, [0.7, 0.15, 0.15], seed=2).collect()}
    assert other != {tuple(r) for r in rows}


def test_batches(spark):
    ids = spark.range(5, 25).withColumnRenamed("id", "k")
    plain = {r["k"]: r["batch"] for r in assign_batches(ids, "k", 6).collect()}
    assert plain == {k: (k - 5) // 6 for k in range(5, 25)}
    shuffled = assign_batches(ids, "k", 6, shuffle=True, drop_last=True).collect()
    assert Counter(r["batch"] for r in shuffled) == {0: 6, 1: 6, 2: 6}


def test_golden_weights(spark):
    training = golden.counts(spark).where(~F.col("image").isin(golden.HELD_OUT))
    for method, want in (("inv_freq", golden.INV_FREQ), ("custom", golden.CUSTOM)):
        got = [r["w"] for r in class_weights(training, method).orderBy("class_id").collect()]
        assert got == pytest.approx(want, abs=1e-6) and sum(got) == pytest.approx(1)


def test_weight_edge_cases(spark):
    one = spark.createDataFrame([("a", 1, 5)], "image string, class_id int, n bigint")
    assert [r["w"] for r in class_weights(one).orderBy("class_id").collect()] == [0.0, 1.0]
    absent = one.union(spark.createDataFrame([("a", 2, 0)], one.schema))
    with pytest.raises(Exception, match="class without pixels: 2"):
        class_weights(absent).collect()
    # An image of background only counts as an image.
    empty = one.union(spark.createDataFrame([("a", 2, 1), ("b", None, 0)], one.schema))
    w = [r["w"] for r in class_weights(empty).orderBy("class_id").collect()]
    assert w[1] == pytest.approx((1 / 5) / (1 / 5 + 1))


def histogram(rows):
    h = np.array(rows, dtype=float)
    return h / h.sum(axis=1, keepdims=True)


def js(p, q):
    m = (p + q) / 2
    part = lambda v: sum(a * math.log(a / b) for a, b in zip(v, m) if a > 0)
    return math.sqrt((part(p) + part(q)) / 2 / math.log(len(p)))


def test_histograms_and_distance(spark):
    counts = golden.counts(spark)
    splits = random_split(counts, [0.5, 0.3, 0.2], seed=4)
    subset = {r["image"]: r["subset"] for r in splits.collect()}
    sums = {s: [0] * len(golden.PIXELS) for s in ("training", "validation", "test")}
    for c, values in golden.PIXELS.items():
        for image, n in zip(golden.IMAGES, values):
            sums[subset[image]][c - 1] += n
    local = {(r["subset"], r["class_id"]): r["share"] for r in subset_histogram(counts, splits).collect()}
    overall = {(r["subset"], r["class_id"]): r["share"] for r in subset_histogram(counts, splits, "global").collect()}
    for s, row in sums.items():
        for c in range(len(golden.PIXELS)):
            assert local[(s, c + 1)] == pytest.approx(row[c] / sum(row))
            assert overall[(s, c + 1)] == pytest.approx(row[c] / sum(golden.PIXELS[c + 1]))
    support = {r["subset"]: r["full_support"] for r in full_class_support(counts, splits).collect()}
    assert support == {s: all(n > 0 for n in row) for s, row in sums.items()}
    h = {s: histogram([row])[0] for s, row in sums.items()}
    want = {tuple(sorted(p)): js(h[p[0]], h[p[1]]) for p in itertools.combinations(h, 2)}
    pairs = js_distances(subset_histogram(counts, splits))
    got = {(r["this"], r["that"]): r["distance"] for r in pairs.collect()}
    assert got == pytest.approx(want)
    for how, f in (("avg", np.mean), ("max", max), ("sum", sum)):
        assert reduce_distance(pairs, how).first()[0] == pytest.approx(f(list(want.values())))


def test_stratified_split(spark):
    rng = np.random.default_rng(0)
    rows = [(f"i{k}", c, int(n)) for k in range(60) for c, n in enumerate(rng.integers(0, 100, 3) ** 2, start=1) if n > 0]
    rows.append(("blank", None, 0))
    counts = spark.createDataFrame(rows, "image string, class_id int, n bigint")
    lengths = [0.6, 0.2, 0.2]
    measure = lambda s: reduce_distance(js_distances(subset_histogram(counts, s))).first()[0]
    split = stratified_split(counts, lengths, trials=4, swaps=200, seed=1)
    got = split.collect()
    assert Counter(r["subset"] for r in got) == {"training": 37, "validation": 12, "test": 12}
    assert len({r["image"] for r in got}) == 61
    assert all(r["full_support"] for r in full_class_support(counts, split).collect())
    # No swap at all leaves the best start; swapping must not be worse.
    assert measure(split) <= measure(stratified_split(counts, lengths, trials=4, swaps=0, seed=1)) + 1e-12
    assert {tuple(r) for r in stratified_split(counts, lengths, trials=4, swaps=200, seed=1).collect()} == {tuple(r) for r in got}


def climbed(vectors, sizes, trials, swaps, seed):
    """The least distance of plain climbs: one random exchange after another, kept if it is valid and closer."""
    rng, best, ends = np.random.default_rng(seed), math.inf, np.cumsum(sizes)[:-1]

    def apart(sums):
        share = [s / s.sum() for s in sums]
        found = []
        for p, q in itertools.combinations(share, 2):
            m = (p + q) / 2
            found.append(math.sqrt(max(0, sum(p * np.log(p / m) + q * np.log(q / m))) / 2 / math.log(len(p))))
        return sum(found) / len(found)

    for _ in range(trials):
        subsets = np.split(rng.permutation(len(vectors)), ends)
        sums = [vectors[s].sum(axis=0) for s in subsets]
        now, tried = apart(sums), 0
        while tried < swaps:
            for a, b in itertools.combinations(range(len(sizes)), 2):
                i, j = rng.integers(len(subsets[a])), rng.integers(len(subsets[b]))
                change = vectors[subsets[b][j]] - vectors[subsets[a][i]]
                new = list(sums)
                new[a], new[b] = sums[a] + change, sums[b] - change
                if min(new[a].min(), new[b].min()) <= 0:
                    continue
                tried += 1
                if (d := apart(new)) < now:
                    now, sums = d, new
                    subsets[a][i], subsets[b][j] = subsets[b][j], subsets[a][i]
        best = min(best, now)
    return best


@pytest.mark.parametrize("pool", [10_000, 60])
def test_stratified_split_climbs(spark, pool):
    """On many images of uneven classes, no farther than plain climbs, also from pools of a part of the images."""
    rng = np.random.default_rng(7)
    vectors = rng.lognormal(3, 2, (1500, 6)).astype(int) * (rng.random((1500, 6)) < [0.9, 0.5, 0.3, 0.2, 0.1, 0.6])
    rows = [(k, c, int(n)) for k, v in enumerate(vectors) for c, n in enumerate(v) if n]
    rows += [(k, None, 0) for k, v in enumerate(vectors) if not v.any()]
    counts = spark.createDataFrame(rows, "image int, class_id int, n bigint")
    split = stratified_split(counts, [0.7, 0.15, 0.15], trials=4, swaps=300, pool=pool).collect()
    assert Counter(r["subset"] for r in split) == {"training": 1050, "validation": 225, "test": 225}
    assert sorted(r["image"] for r in split) == list(range(1500))
    again = spark.createDataFrame(split, "image int, subset string")
    found = reduce_distance(js_distances(subset_histogram(counts, again))).first()[0]
    assert found <= 1.05 * climbed(vectors.astype(float), [1050, 225, 225], 4, 300, 1)


def test_stratified_split_without_support(spark):
    counts = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", 1, 5)], "image string, class_id int, n bigint")
    with pytest.raises(RuntimeError, match="full class support"):
        stratified_split(counts, [1, 1, 1], trials=3, swaps=5)


def test_ranges_and_scaling(spark):
    cells = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, 5.0), ("b", 9.0, 5.0)], "image string, red double, blue double")
    splits = spark.createDataFrame([("a", "training"), ("b", "test")], "image string, subset string")
    training = restrict_to_split(cells, splits, "training")
    scales = band_ranges(training, ["red", "blue"])
    assert {(r["band"], r["mn"], r["mx"]) for r in scales.collect()} == {("red", 1.0, 3.0), ("blue", 5.0, 5.0)}
    rows = minmax_scale(cells, scales, ["red", "blue"]).collect()
    assert [r["red"] for r in rows] == pytest.approx([0.0, 1.0, 4.0])
    assert [r["blue"] for r in rows] == [None, 0.0, 0.0]


def test_runs(spark):
    runs = spark.createDataFrame(
        [(1, "x", 0.5, "COMPLETE"), (2, "x", 0.9, "FAIL"), (3, "y", 0.9, "COMPLETE"), (4, "x", 0.7, "COMPLETE"), (5, None, 0.1, "COMPLETE"), (6, "z", None, "RUNNING")],
        "no int, p string, v double, state string",
    )
    assert best_run(runs, "v", "no").first()["no"] == 2
    assert best_run(runs, "v", "no", "min").first()["no"] == 5
    assert {(r["p"], r["no"]) for r in best_run(runs, "v", "no", by=["p"]).collect()} == {("x", 2), ("y", 3), (None, 5)}
    assert last_run(runs, "no").first()["no"] == 6
    asked = spark.createDataFrame([("x",), ("z",), (None,)], "p string")
    got = {r["p"]: r["cached"] for r in skip_completed(asked, runs, ["p"], "v", "no").collect()}
    assert got == {"x": 0.7, "z": None, None: 0.1}
