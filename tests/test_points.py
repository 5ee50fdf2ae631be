import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import neighbors
from tilewright.operators.neighbors import knn_join, neighbor_query, radius_count, radius_join
from tilewright.operators.points import (
    crop_points, crop_to_grids, dedupe_points, global_density, grid_idw, merge_points, point_density, scale_coords,
)

GRID = "tile_id string, xmin double, ymin double, xmax double, ymax double, res double"


def cloud(spark, rows):
    """(idx, x, y, z) with 0.1 m records."""
    data = [("t", i, round(x * 10), round(y * 10), round(z * 100), float(x), float(y), float(z)) for i, x, y, z in rows]
    return spark.createDataFrame(data, "tile_id string, idx bigint, xi bigint, yi bigint, zi bigint, x double, y double, z double")


def test_crop_is_inclusive_and_truncates_toward_zero(spark):
    points = spark.createDataFrame([(i, i, 0) for i in range(-5, 6)], "idx int, xi int, yi int")
    kept = crop_points(points, [-0.25, 0, 0.35, 0], 0.1)
    assert sorted(r["xi"] for r in kept.collect()) == [-2, -1, 0, 1, 2, 3]


def test_crop_to_grids_matches_single_crop(spark):
    points = cloud(spark, [(i, i * 0.1 - 0.5, 0.0, 1.0) for i in range(11)])
    grids = spark.createDataFrame([("t", -0.25, 0.0, 0.35, 0.0, 1.0)], GRID)
    single = {r["idx"] for r in crop_points(points, [-0.25, 0, 0.35, 0], 0.1).collect()}
    assert {r["idx"] for r in crop_to_grids(points, grids, 0.1).collect()} == single


def test_dedupe_keeps_highest_then_last(spark):
    points = cloud(spark, [(0, 1, 1, 5), (1, 1, 1, 7), (2, 1, 1, 7), (3, 2, 1, 0)])
    assert sorted(r["idx"] for r in dedupe_points(points).collect()) == [2, 3]


def test_dedupe_prunes_before_the_shuffle(spark):
    plan = dedupe_points(cloud(spark, [(0, 1, 1, 5)]))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_merge_changes_scale(spark):
    a = spark.createDataFrame([(0, 10, 10, 1)], "idx int, xi bigint, yi bigint, zi bigint")
    b = spark.createDataFrame([(1, 55, 55, 50)], "idx int, xi bigint, yi bigint, zi bigint")
    merged = merge_points([(a, 0.1, 0.0), (b, 0.2, -10.0)])
    assert sorted(r["xi"] for r in merged.collect()) == [10, 10]
    assert merge_points([(a, 0.1, 0.0), (b, 0.2, -10.0)], dedupe=True).count() == 1


def test_scale_coords(spark):
    row = scale_coords(spark.createDataFrame([(15, 20, 5)], "xi int, yi int, zi int"), 0.5, 2.0).first()
    assert (row["x"], row["y"], row["z"]) == (9.5, 12.0, 4.5)


def test_density_counts_edge_points_in_each_cell(spark, array_of):
    grids = spark.createDataFrame([("t", 0.0, 0.0, 3.0, 2.0, 1.0)], GRID)
    # Inside one cell, on a shared side, on a shared corner, on the outer rim.
    points = cloud(spark, [(0, 0.5, 0.5, 1), (1, 1.0, 1.5, 1), (2, 2.0, 1.0, 1), (3, 0.0, 0.0, 1)])
    got = array_of(point_density(points, grids), "density")
    assert got == {(0, 0): 1, (0, 1): 2, (0, 2): 1, (1, 0): 2, (1, 1): 1, (1, 2): 1}
    half_open = array_of(point_density(points, grids, "half_open"), "density")
    # The rim point is below the last row of a half-open grid.
    assert sum(half_open.values()) == 3
    assert global_density(points, grids).first()["density"] == pytest.approx(4 / 6)


def test_idw(spark, array_of):
    grids = spark.createDataFrame([("t", 0.0, 0.0, 3.0, 1.0, 1.0)], GRID)
    points = cloud(spark, [(0, 0.5, 0.5, 9), (1, 0.5, 0.5, 4), (2, 0.6, 0.5, 1), (3, 1.4, 0.5, 2), (4, 1.7, 0.5, 8)])
    got = array_of(grid_idw(points, grids, ["z"], count="n"), "z")
    assert got[(0, 0)] == 9.0
    assert got[(0, 1)] == pytest.approx((2 / 0.01 + 8 / 0.04) / (1 / 0.01 + 1 / 0.04))
    assert got[(0, 2)] is None
    assert array_of(grid_idw(points, grids, ["z"], count="n"), "n") == {(0, 0): 3, (0, 1): 2, (0, 2): 0}


@pytest.fixture(scope="module")
def scatter(spark):
    rng = random.Random(3)
    # A third of the points is one pile of copies; the rest is spread out unevenly.
    points = [(i, 5.0, 5.0) for i in range(60)]
    points += [(60 + i, rng.gauss(0, 30), rng.gauss(0, 3)) for i in range(120)]
    queries = [(i, rng.uniform(-60, 60), rng.uniform(-10, 10)) for i in range(40)] + [(40, 5.0, 5.0), (41, 900.0, -900.0)]
    make = lambda rows, key: spark.createDataFrame(rows, f"{key} bigint, x double, y double")
    return points, queries, make(points, "idx"), make(queries, "query_id")


def test_knn_is_exact(scatter):
    points, queries, p, q = scatter
    for k, cell in ((1, 1.0), (7, 0.5), (70, 4.0)):
        got = {}
        for r in knn_join(q, p, k, cell).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["idx"]))
        for query_id, x, y in queries:
            order = sorted((math.hypot(px - x, py - y), idx) for idx, px, py in points)[:k]
            assert [idx for _, idx in sorted(got[query_id])] == [idx for _, idx in order]


def test_knn_beside_a_crowd(spark, monkeypatch):
    """4,000 queries in one place, 4,000 points in another, some on a line at equal distances: a few points are paired with each query."""
    rng = np.random.default_rng(2)
    places = np.concatenate([rng.normal([13, 5], 0.2, (3000, 2)), [[13, 0.001 * i] for i in range(500)], [[14.0, 2.0]] * 500])
    asked = np.concatenate([rng.uniform(1, 2, (3900, 2)), rng.normal([13, 5], 0.3, (100, 2))])
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "idx bigint, x double, y double")
    q = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(asked)], "query_id bigint, x double, y double")
    held = []
    kept = neighbors._nearest_bins
    monkeypatch.setattr(neighbors, "_nearest_bins", lambda *a: held.append(kept(*a)) or held[-1])
    got = {}
    for r in knn_join(q, p, 3, 16.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["idx"]))
    for i in range(0, 4000, 13):
        d = np.hypot(*(places - asked[i]).T)
        assert [idx for _, idx in sorted(got[i])] == sorted(range(4000), key=lambda j: (d[j], j))[:3]
    pairs = held[0][0].groupBy("query_id").agg(F.sum("n").alias("n")).agg(F.avg("n"), F.max("n")).first()
    assert len(got) == 4000 and pairs[0] < 8 * 64 and pairs[1] < 16 * 64


def test_knn_with_too_few_points(spark, scatter):
    _, _, _, q = scatter
    two = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "idx bigint, x double, y double")
    assert knn_join(q, two, 5, 1.0).count() == 2 * 42


@pytest.mark.parametrize("p", [1, 2, 3, math.inf])
def test_radius_join_and_count(scatter, p):
    points, queries, pdf, qdf = scatter
    r = 6.0

    def norm(dx, dy):
        if math.isinf(p):
            return max(abs(dx), abs(dy))
        return (abs(dx) ** p + abs(dy) ** p) ** (1 / p)

    want = {(qid, idx) for qid, x, y in queries for idx, px, py in points if norm(px - x, py - y) <= r}
    assert {(h["query_id"], h["idx"]) for h in radius_join(qdf, pdf, r, p).collect()} == want
    counts = {h["query_id"]: h["n"] for h in radius_count(qdf, pdf, r, p).collect()}
    assert counts == {qid: sum(1 for w in want if w[0] == qid) for qid, _, _ in queries}


@pytest.mark.parametrize("p", [1, 2, math.inf])
def test_radius_count_in_a_crowd(spark, monkeypatch, p):
    """Balls that hold thousands of points are counted by bins; only their borders are paired."""
    rng = np.random.default_rng(4)
    places = np.concatenate([rng.normal(0, 1, (6000, 2)), np.round(rng.normal(0, 1, (1000, 2)), 1)])
    asked = np.concatenate([rng.normal(0, 1, (300, 2)), [[0.0, 0.0], [0.0, 0.0], [50.0, 50.0]]])
    pdf = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "idx bigint, x double, y double")
    qdf = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(asked)], "query_id bigint, x double, y double")
    parts = []
    counted = neighbors._counted_by_bins
    monkeypatch.setattr(neighbors, "_counted_by_bins", lambda *a: parts.append(counted(*a)) or parts[-1])
    got = {r["query_id"]: r["n"] for r in radius_count(qdf, pdf, 1.3, p, 30).collect()}
    gap = np.abs(asked[:, None] - places[None])
    d = gap.max(axis=2) if math.isinf(p) else (gap**p).sum(axis=2) ** (1 / p)
    want = (d <= 1.3).sum(axis=1)
    assert got == dict(enumerate(want.tolist()))
    # Rows that are added up: far fewer than the pairs.
    assert parts[0].count() < want.sum() / 4


def test_neighbor_query_needs_one_of_k_and_r(scatter):
    _, _, p, q = scatter
    with pytest.raises(ValueError):
        neighbor_query(q, p)
    with pytest.raises(ValueError):
        neighbor_query(q, p, k=1, r=1.0)
    assert neighbor_query(q, p, k=1).count() == 42


def test_spatial_joins_are_equi_joins(scatter):
    _, _, p, q = scatter
    for df in (radius_join(q, p, 2.0), knn_join(q, p, 3, 1.0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
