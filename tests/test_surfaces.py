import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions.crs import lonlat_to_rd, rd_to_lonlat
from tilewright.functions.geometry import area, clipped_area, point_in_ring, signed_area
from tilewright.operators.surfaces import (
    asset_manifests, clip_surfaces, covered_cells, dissolve, filter_tile_area, flag_invalid_rings, height_above_roof,
    mask_to_surfaces, match_sheets, points_in_polygons, rasterize_polygons,
)
from tilewright.schema import RING, SHEETS, SURFACES

GRID = "tile_id string, xmin double, ymin double, xmax double, ymax double, res double"
CONCAVE = [(0, 0), (10, 0), (10, 10), (5, 2), (0, 10), (0, 0)]


def inside(ring, x, y):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def surfaces(spark, rings, tile="t"):
    rows = [
        (tile, "2.2", i, str(b), h, [(float(x), float(y)) for x, y in ring]) for i, (b, h, ring) in enumerate(rings)
    ]
    return spark.createDataFrame(rows, SURFACES)


def grid(spark, n=10, res=1.0):
    return spark.createDataFrame([("t", 0.0, 0.0, n * res, n * res, res)], GRID)


def test_areas(spark):
    def value(expr, ring):
        df = spark.createDataFrame([([(float(x), float(y)) for x, y in ring],)], f"ring {RING.simpleString()}")
        return df.select(expr(F.col("ring")).alias("v")).first()["v"]

    assert value(area, CONCAVE) == pytest.approx(60.0)
    assert value(signed_area, CONCAVE[::-1]) == pytest.approx(-60.0)
    assert value(area, CONCAVE[:-1]) == pytest.approx(60.0)
    assert value(area, []) == 0.0
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert value(lambda r: clipped_area(r, *lit(0, 0, 10, 1)), CONCAVE) == pytest.approx(10.0)
    assert value(lambda r: clipped_area(r, *lit(-5, -5, 20, 20)), CONCAVE) == pytest.approx(60.0)
    # Only the notch of the concave ring lies here, and beside it nothing.
    assert value(lambda r: clipped_area(r, *lit(4.9, 8, 5.1, 9)), CONCAVE) == pytest.approx(0.0)
    assert value(lambda r: clipped_area(r, *lit(10, 0, 12, 5)), CONCAVE) == pytest.approx(0.0)


def test_point_in_ring(spark):
    points = [(x / 2 + 0.25, y / 2 + 0.25) for x in range(-2, 24) for y in range(-2, 24)]
    df = spark.createDataFrame(points, "x double, y double").withColumn(
        "ring", F.lit(None).cast(RING)
    )
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in CONCAVE])
    for r in df.select("x", "y", point_in_ring(ring, F.col("x"), F.col("y")).alias("v")).collect():
        assert r["v"] == inside(CONCAVE, r["x"], r["y"])


def test_flag_invalid_rings(spark):
    rings = [(1, 0.0, box(0, 0, 1, 1)), (1, 0.0, box(0, 0, 1, 1)[:4]), (1, 0.0, [(0, 0), (1, 1)]), (1, 0.0, [(0, 0), (1, 1), (2, 2), (0, 0)])]
    df = surfaces(spark, rings)
    assert [r["reason"] for r in flag_invalid_rings(df).orderBy("surface_id").collect()] == [None, "open", "too_short", "flat"]
    assert flag_invalid_rings(df, "drop").count() == 1
    with pytest.raises(Exception, match="invalid ring"):
        flag_invalid_rings(df, "fail").collect()
    with pytest.raises(ValueError):
        flag_invalid_rings(df, "mend")


def test_scan_lines_equal_point_test(spark):
    rings = [CONCAVE, box(2.3, 2.3, 4.4, 9.1), [(1, 1), (9, 2), (4, 8), (1, 1)]]
    df = surfaces(spark, [(1, 0.0, r) for r in rings])
    got = {(r["surface_id"], r["row_no"], r["col_no"]) for r in covered_cells(df, grid(spark, 20, 0.5), "surface_id").collect()}
    want = {
        (s, r, c) for s, ring in enumerate(rings) for r in range(20) for c in range(20)
        if inside(ring, (c + 0.5) * 0.5, 10 - (r + 0.5) * 0.5)
    }
    assert got == want


def test_holes_follow_the_even_odd_rule(spark):
    outer = surfaces(spark, [(1, 0.0, box(0, 0, 6, 6))])
    hole = outer.withColumn("ring", surfaces(spark, [(1, 0.0, box(2, 2, 4, 4))]).select("ring").scalar())
    assert covered_cells(outer.unionByName(hole), grid(spark), "surface_id").count() == 36 - 4


def test_later_surface_wins_and_fill(spark, array_of):
    df = surfaces(spark, [(1, 5.0, box(0, 0, 3, 3)), (2, 7.0, box(2, 2, 5, 5))])
    got = array_of(rasterize_polygons(df, grid(spark), "surface_id", "h50", "surface_id", 0.0), "h50")
    assert len(got) == 100
    # Cell (row 7, column 2) has its centre at (2.5, 2.5), inside both.
    assert got[(7, 2)] == 7.0 and got[(9, 0)] == 5.0 and got[(0, 0)] == 0.0


def test_mask(spark, grid_of, array_of):
    df = surfaces(spark, [(1, 0.0, box(0, 8, 2, 10)), (1, 0.0, box(1, 8, 3, 10))])
    cells = grid_of([[1.0] * 10] * 10)
    kept = {k for k, v in array_of(mask_to_surfaces(cells, df, grid(spark), ["v"])).items() if v is not None}
    assert kept == {(r, c) for r in (0, 1) for c in (0, 1, 2)}
    assert sum(array_of(mask_to_surfaces(cells, df, grid(spark), ["v"], fill=0)).values()) == 6.0


def test_height_above_roof(spark, grid_of, array_of):
    # Two overlapping parts of one building, of which the first has no height.
    df = surfaces(spark, [(1, None, box(0, 8, 2, 10)), (1, 3.0, box(1, 8, 3, 10))])
    got = array_of(height_above_roof(grid_of([[10.0] * 10] * 10, name="z"), df, grid(spark)), "ndrm")
    assert [got[(0, c)] for c in range(4)] == [7.0, 7.0, 7.0, 10.0]


def test_dissolve_takes_first_known_value(spark):
    df = surfaces(spark, [(1, None, box(0, 0, 1, 1)), (1, 3.0, box(1, 0, 2, 1)), (1, 4.0, box(2, 0, 3, 1))])
    assert {r["h50"] for r in dissolve(df, ["building_id"], "surface_id", ["h50"]).collect()} == {3.0}


def test_match_sheets(spark):
    # A diamond whose bounds, but not area, reach the second sheet; one box on a shared border.
    diamond = [(5, 0), (10, 5), (5, 10), (0, 5), (5, 0)]
    df = surfaces(spark, [(1, 0.0, diamond)], "a").unionByName(surfaces(spark, [(1, 0.0, box(20, 0, 30, 5))], "b"))
    sheets = spark.createDataFrame(
        [
            ("image", "i1", "u1", 0.0, 0.0, 8.0, 20.0), ("image", "i2", "u2", 8.0, 8.0, 20.0, 20.0),
            ("image", "i3", "u3", 20.0, 0.0, 40.0, 20.0), ("lidar", "l1", "u4", -50.0, -50.0, 50.0, 50.0),
            ("image", "i4", "u5", 8.0, 0.0, 20.0, 8.0),
        ],
        SHEETS,
    )
    for width in (3.0, 1000.0):
        got = {(r["tile_id"], r["kind"]): r["tid"] for r in match_sheets(df, sheets, width).collect()}
        assert got == {("a", "image"): ["i1", "i4"], ("a", "lidar"): ["l1"], ("b", "image"): ["i3"], ("b", "lidar"): ["l1"]}
    manifest = {r["tid"]: r for r in asset_manifests(match_sheets(df, sheets, 10.0).where("kind = 'lidar'")).collect()}
    assert manifest["a"]["image"]["tid"] == [] and manifest["a"]["lidar"]["url"] == ["u4"]


def test_filters(spark):
    df = surfaces(spark, [(1, 0.0, box(0, 0, 2, 2)), (1, 0.0, box(50, 50, 60, 60))])
    assert [r["surface_id"] for r in filter_tile_area(df, 4.0).collect()] == [0]
    clipped = clip_surfaces(df, grid(spark))
    assert [r["surface_id"] for r in clipped.collect()] == [0] and clipped.columns == df.columns


def test_a_country_takes_a_few_bins(spark):
    """Polygons from a house to a country, with bins of 8: every pair is found, and no box becomes many rows."""
    rng = np.random.default_rng(3)
    sides = [2.0**k for k in range(1, 20, 2)]
    corners = [(float(rng.uniform(-3e5, 3e5)), float(rng.uniform(-3e5, 3e5)), s) for s in sides for _ in range(4)]
    boxes = [(x, y, x + s, y + s / 3) for x, y, s in corners] + [(-1e6, -1e6, 1e6, 1e6), (0.0, 0.0, 8.0, 8.0)]
    df = surfaces(spark, [(k, 0.0, box(*b)) for k, b in enumerate(boxes)])
    places = [(float(rng.uniform(b[0], b[2])), float(rng.uniform(b[1], b[3]))) for b in boxes for _ in range(3)] + [(2e6, 0.0)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)], "idx int, x double, y double")
    got = {(r["idx"], r["surface_id"]) for r in points_in_polygons(points, df, 8.0).select("idx", "surface_id").collect()}
    want = {(i, k) for i, (x, y) in enumerate(places) for k, b in enumerate(boxes) if b[0] <= x < b[2] and b[1] <= y < b[3]}
    ids = [r["surface_id"] for r in df.select("surface_id").collect()]
    assert got == {(i, ids[k]) for i, k in want}
    sheets = spark.createDataFrame([("image", f"s{k}", f"u{k}", *map(float, b)) for k, b in enumerate(boxes[::2])], SHEETS)
    found = {s for r in match_sheets(df, sheets, 8.0).collect() for s in r["tid"]}
    touch = lambda a, b: a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1]
    assert found == {f"s{k}" for k, s in enumerate(boxes[::2]) if any(touch(s, b) for b in boxes)}
    one = surfaces(spark, [(0, 0.0, box(5, 5, 6, 6))])
    assert {s for r in match_sheets(one, sheets, 8.0).collect() for s in r["tid"]} == {f"s{k}" for k, s in enumerate(boxes[::2]) if touch(s, (5, 5, 6, 6))}


def test_points_in_polygons_needs_no_nested_loop(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 9.0)], "idx int, x double, y double")
    df = surfaces(spark, [(1, 0.0, box(0, 0, 2, 2)), (2, 0.0, box(1, 0, 3, 3))])
    out = points_in_polygons(points, df, 1.0)
    assert sorted((r["idx"], r["surface_id"]) for r in out.collect()) == [(1, 0), (1, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("x,y,lat,lon", [
    (155000.0, 463000.0, 52.15517440, 5.38720621), (120700.723, 487525.501, 52.37453253, 4.88352559),
    (233883.131, 582065.167, 53.21938317, 6.56820053),
])
def test_crs_known_places(spark, x, y, lat, lon):
    df = spark.createDataFrame([(x, y, lat, lon)], "x double, y double, lat double, lon double")
    to_lon, to_lat = rd_to_lonlat(F.col("x"), F.col("y"))
    to_x, to_y = lonlat_to_rd(F.col("lon"), F.col("lat"))
    row = df.select(to_lon.alias("a"), to_lat.alias("b"), to_x.alias("c"), to_y.alias("d")).first()
    assert abs(row["a"] - lon) < 1e-5 and abs(row["b"] - lat) < 1e-5
    assert abs(row["c"] - x) < 1 and abs(row["d"] - y) < 1
