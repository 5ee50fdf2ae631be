import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators.quantiles import exact_quantiles
from tilewright.operators.raster import (
    fill_all_voids, fill_voids, mosaic, percentile_clip, preserve_total, replace_null, resample_bilinear, resample_nearest,
    slope, snap_bounds, stack_bands,
)

SHAPES = "tile_id string, src_rows int, src_cols int, dst_rows int, dst_cols int"


def dense(cells, shape):
    out = np.full(shape, np.nan)
    for (r, c), v in cells.items():
        out[r, c] = np.nan if v is None else v
    return out


@pytest.mark.parametrize("block", [2, 3, 512])
def test_slope_equals_numpy_gradient(grid_of, array_of, block):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(7, 5)) * 10
    got = dense(array_of(slope(grid_of(data.tolist()), "v", 0.5, block=block), "slope"), data.shape)
    want = np.degrees(np.arctan(np.hypot(*np.gradient(data, 0.5))))
    assert np.allclose(got, want, atol=1e-10)


def test_slope_of_a_plane_is_constant(grid_of, array_of):
    plane = [[2.0 * r + c for c in range(6)] for r in range(6)]
    values = array_of(slope(grid_of(plane), "v", 1.0, degrees=False), "slope").values()
    assert np.allclose(list(values), np.arctan(np.sqrt(5)))


def test_slope_nodata_and_thin_rasters(grid_of, array_of):
    got = array_of(slope(grid_of([[1.0, 2.0, 3.0]]), "v", 1.0), "slope")
    assert set(got.values()) == {None}
    got = array_of(slope(grid_of([[1.0, None], [1.0, 1.0]]), "v", 1.0), "slope")
    assert got[(0, 1)] is None and got[(0, 0)] is None and got[(1, 0)] == 0.0


@pytest.mark.parametrize("block", [2, 4, 512])
def test_fill_voids(grid_of, array_of, block):
    cells = grid_of([[1.0, None, None, 4.0], [None, None, None, None], [None, 5.0, None, None]])
    got = array_of(fill_voids(cells, "v", radius=2, block=block))
    assert got[(0, 1)] == pytest.approx((1 / 1 + 4 / 2 + 5 / 2) / (1 + 0.5 + 0.5))
    assert got[(0, 0)] == 1.0
    # Its row holds nothing, its column only a value two cells up.
    assert got[(2, 3)] == pytest.approx((4 / 2 + 5 / 2) / 1.0)
    assert got[(1, 2)] is None


def test_fill_all_voids_stops(grid_of, array_of):
    cells = grid_of([[1.0, None, None], [None, None, None], [None, None, None]])
    assert None not in array_of(fill_all_voids(cells, "v", radius=1)).values()
    empty = grid_of([[None, None], [None, None]])
    assert set(array_of(fill_all_voids(empty, "v")).values()) == {None}


def test_mosaic_first_valid_source_wins(spark, array_of):
    grids = snap_bounds(spark.createDataFrame([("t", 0.1, 0.2, 1.7, 0.9)], "tile_id string, xmin double, ymin double, xmax double, ymax double"), 1.0)
    g = grids.first()
    assert (g["xmin"], g["ymin"], g["xmax"], g["ymax"]) == (0.0, 0.0, 2.0, 1.0)
    cells = spark.createDataFrame(
        [("t", 1, 0.5, 0.5, 8.0), ("t", 0, 0.5, 0.5, None), ("t", 2, 0.5, 0.5, 9.0), ("t", 0, 1.5, 0.5, 3.0), ("t", 0, 7.0, 0.5, 1.0)],
        "tile_id string, priority int, x double, y double, v double",
    )
    assert array_of(mosaic(cells, grids, ["v"])) == {(0, 0): 8.0, (0, 1): 3.0}


def bilinear(data, shape):
    out = np.full(shape, np.nan)
    for i in range(shape[0]):
        for j in range(shape[1]):
            y, x = (i + 0.5) * data.shape[0] / shape[0] - 0.5, (j + 0.5) * data.shape[1] / shape[1] - 0.5
            top = bottom = 0.0
            for a in (0, 1):
                for b in (0, 1):
                    r = min(max(int(np.floor(y)) + a, 0), data.shape[0] - 1)
                    c = min(max(int(np.floor(x)) + b, 0), data.shape[1] - 1)
                    fy, fx = y - np.floor(y), x - np.floor(x)
                    w = (fy if a else 1 - fy) * (fx if b else 1 - fx)
                    if not np.isnan(data[r, c]):
                        top, bottom = top + w * data[r, c], bottom + w
            if bottom > 0:
                out[i, j] = top / bottom
    return out


@pytest.mark.parametrize("shape", [(9, 12), (5, 6), (2, 2), (3, 4), (7, 13)])
@pytest.mark.parametrize("block", [2, 512])
def test_resample(spark, grid_of, array_of, shape, block):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(3, 4))
    data[1, 2] = np.nan
    cells = grid_of([[None if np.isnan(v) else float(v) for v in row] for row in data])
    shapes = spark.createDataFrame([("t", 3, 4, *shape)], SHAPES)
    got = dense(array_of(resample_bilinear(cells, shapes, "v", block=block)), shape)
    assert np.allclose(got, bilinear(data, shape), equal_nan=True)
    rows = np.floor((np.arange(shape[0]) + 0.5) * 3 / shape[0]).astype(int)
    cols = np.floor((np.arange(shape[1]) + 0.5) * 4 / shape[1]).astype(int)
    nearest = array_of(resample_nearest(cells, shapes, "v"))
    assert len(nearest) == shape[0] * shape[1]
    assert np.allclose(dense(nearest, shape), data[np.ix_(rows, cols)], equal_nan=True)


def test_preserve_total(spark, grid_of):
    cells = grid_of([[1.0, 2.0], [3.0, 4.0]])
    fine = resample_nearest(cells, spark.createDataFrame([("t", 2, 2, 5, 5)], SHAPES), "v")
    assert preserve_total(fine, cells, "v").agg(F.sum("v")).first()[0] == pytest.approx(10.0)


@pytest.mark.parametrize("kind", ["even", "heavy_tail", "one_value", "third_equal", "tiny"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(5)
    data = {
        "even": rng.uniform(size=20000), "heavy_tail": rng.standard_cauchy(size=20000), "one_value": np.full(500, 7.0),
        "third_equal": np.where(rng.uniform(size=9000) < 0.33, 1.0, rng.normal(size=9000)), "tiny": np.array([3.0, 1.0]),
    }[kind]
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(data)], "g int, v double")
    fractions = [0.02, 0.5, 0.98, 1.0]
    got = {(r["g"], r["q"]): r["quantile"] for r in exact_quantiles(df, "v", fractions, ["g"]).collect()}
    for g in (0, 1):
        for q in fractions:
            assert got[(g, q)] == pytest.approx(np.quantile(data[g::2], q), rel=1e-12, abs=1e-12)


def test_percentile_clip_keeps_nodata(grid_of, array_of):
    got = array_of(percentile_clip(grid_of([[0.0, 1.0, 2.0, 3.0, 100.0, None]]), "v", 0.25, 0.75))
    assert got == {(0, 0): 1.0, (0, 1): 1.0, (0, 2): 2.0, (0, 3): 3.0, (0, 4): 3.0, (0, 5): None}


def test_stack_and_replace(grid_of):
    a, b = grid_of([[1.0, 2.0]], name="red"), grid_of([[5.0]], name="ndrm")
    stack = stack_bands([(a, "red"), (b, "ndrm")])
    assert stack.columns == ["tile_id", "row_no", "col_no", "red", "ndrm"]
    assert [r["ndrm"] for r in replace_null(stack, ["ndrm"], 0).orderBy("col_no").collect()] == [5.0, 0.0]
