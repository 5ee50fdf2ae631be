"""Whole workflows on small made inputs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators.sampling import candidate_tiles, fill_quota, sample_tiles, seeded_locations
from tilewright.operators.scoring import classify_tile, zonal_majority
from tilewright.operators.stats import band_ranges
from tilewright.plans.stages import (
    build_stack, clean_points, cut_chips, image_grids, import_annotations, parse_images, parse_points, remask, run_stages,
)
from tilewright.functions.naming import sanitize_name
from tilewright.operators.grid import with_shape
from tilewright.schema import BANDS, POINTS, RING, SURFACES, class_table


def box(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


@pytest.fixture(scope="module")
def town(spark):
    rows = [("9-1-1", "2.2", 1, "b1", 4.0, box(0, 0, 6, 9)), ("9-1-1", "2.2", 2, "b2", 2.0, box(6, 3, 11.9, 11.9)), ("9-2-2", "2.2", 3, "b3", 1.0, box(100, 100, 105, 106))]
    surfaces = spark.createDataFrame(rows, SURFACES)
    grids = image_grids(surfaces, 1.0).cache()
    rng = np.random.default_rng(0)
    points = []
    for tile, x0, y0, w, h in (("9-1-1", 0, 0, 12, 12), ("9-2-2", 100, 100, 5, 6)):
        for i in range(w * h * 4):
            x, y = x0 + rng.uniform(-1, w + 1), y0 + rng.uniform(-1, h + 1)
            z = 5 + 0.5 * x
            xi, yi, zi = round(x * 100), round(y * 100), round(z * 100)
            # Every fourth point comes twice, from two overlapping sheets, the copy a bit lower.
            for copy in range(2 if i % 4 == 0 else 1):
                points.append((tile, f"s{copy}", 2 * i + copy, xi, yi, zi - copy, xi / 100, yi / 100, (zi - copy) / 100, -3.0))
    images = [
        (tile, p, x0 + c + 0.5, y0 + r + 0.5, float(10 * p + 1), 2.0, 3.0)
        for tile, x0, y0, w, h in (("9-1-1", 0, 0, 12, 12), ("9-2-2", 100, 100, 5, 6))
        for p in (0, 1) for r in range(h) for c in range(w) if p == 1 or c < 3
    ]
    image_cells = spark.createDataFrame(images, "tile_id string, priority int, x double, y double, red double, green double, blue double")
    return surfaces, grids, spark.createDataFrame(points, POINTS), image_cells


@pytest.fixture(scope="module")
def stack(town):
    surfaces, grids, points, images = town
    rgb = parse_images(images, grids)
    layers = parse_points(clean_points(points, grids, 0.01), surfaces, grids)
    return build_stack(rgb, layers, grids).cache(), layers


def test_stack(town, stack):
    surfaces, grids, points, _ = town
    cells, layers = stack
    assert {r["tile_id"]: (r["n_rows"], r["n_cols"]) for r in with_shape(grids).collect()} == {"9-1-1": (12, 12), "9-2-2": (6, 5)}
    clean = clean_points(points, grids, 0.01)
    assert clean.where("src = 's1'").count() == 0 and clean.select("xi", "yi").distinct().count() == clean.count()
    assert cells.columns == ["tile_id", "row_no", "col_no", *BANDS]
    assert Counter(r["tile_id"] for r in cells.select("tile_id").collect()) == {"9-1-1": 144, "9-2-2": 30}
    assert cells.where(" or ".join(f"{b} is null" for b in BANDS)).count() == 0
    assert [r["red"] for r in cells.where("tile_id = '9-1-1' and row_no = 0").orderBy("col_no").collect()][:4] == [1.0, 1.0, 1.0, 11.0]
    assert cells.agg(F.avg("reflectance")).first()[0] == pytest.approx(10 ** -0.3)
    assert 15 < cells.agg(F.avg("slope")).first()[0] < 40
    # Clipping at the 98th percentile can only lower the kept total.
    total = lambda df: df.where("tile_id = '9-1-1'").agg(F.sum("density")).first()[0]
    assert total(cells) <= total(layers["density"]) + 1e-9
    # Elevation minus roof height: 5 + x/2 - 4 over the first building.
    low = cells.where("tile_id = '9-1-1' and row_no = 7 and col_no = 2").first()["ndrm"]
    assert low == pytest.approx(5 + 1.25 - 4, abs=0.8)


def test_chips(town, stack):
    surfaces, grids, *_ = town
    cells, _ = stack
    chips = cut_chips(cells, surfaces, grids, cutoff=0.6, seed=1, size=3)
    rows = chips.collect()
    assert rows and {r["chip_id"].rsplit("_", 2)[0] for r in rows} <= {"9-1-1", "9-2-2"}
    assert set(Counter(r["chip_id"] for r in rows).values()) == {9}
    assert all(r[b] is not None for r in rows for b in BANDS)


def test_map_and_generalise(town, stack):
    surfaces, grids, *_ = town
    cells, _ = stack
    shapes = with_shape(grids)

    def predict(window):
        hot = window["red"] > 0.5
        return [[0.1, 0.7 if h else 0.2, 0.2 if h else 0.7] for h in hot]

    labels = classify_tile(cells, surfaces, grids, shapes, band_ranges(cells), predict, BANDS, 3, crop=4, stride=2).cache()
    assert labels.count() == 174
    inside = labels.where("tile_id = '9-1-1' and col_no between 7 and 10 and row_no between 2 and 6")
    assert {r["class_id"] for r in inside.collect()} == {1}
    assert {r["class_id"] for r in labels.where("tile_id = '9-1-1' and row_no < 2 and col_no < 6").collect()} == {0}
    general = zonal_majority(labels, surfaces, grids)
    per_zone = general.where("tile_id = '9-1-1' and class_id <> 0 and col_no < 6").select("class_id").distinct().collect()
    assert len(per_zone) == 1


def test_import_annotations(spark):
    rng = np.random.default_rng(3)
    masks, pixels = [], []
    for i in range(12):
        for r in range(6):
            for c in range(6):
                masks.append((f"x/9-1-1_{i}_0_png.rf.z.png", r, c, int(rng.choice([0, 1, 4, 7]))))
                pixels.append((f"9-1-1_{i}_0.tif", r, c, *[float(rng.uniform()) for _ in BANDS]))
    mask_df = spark.createDataFrame(masks, "image string, row_no int, col_no int, class_id int")
    image_df = spark.createDataFrame(pixels, "image string, row_no int, col_no int, " + ", ".join(f"{b} double" for b in BANDS))
    for method in ("random", "stratified"):
        options = {"trials": 3, "swaps": 20} if method == "stratified" else {}
        out = import_annotations(mask_df, image_df, class_table(spark), splitting=method, **options)
        assert {r["class_id"] for r in out.masks.select("class_id").distinct().collect()} == {0, 1, 2}
        assert {(r["id"], r["name"]) for r in out.classes.collect()} == {(0, "Background"), (1, "Tile"), (2, "Metal")}
        assert Counter(r["subset"] for r in out.splits.collect()) == {"training": 9, "validation": 2, "test": 1}
        assert out.scales.count() == 7
        weights = {r["class_id"]: r["w"] for r in out.weights.collect()}
        assert weights[0] == 0 and sum(weights.values()) == pytest.approx(1) and set(weights) == {0, 1, 2}
    with pytest.raises(ValueError):
        import_annotations(mask_df, image_df, class_table(spark), splitting="sorted")


def test_import_masks_the_background_again(spark):
    """Chips of 4 x 4 cells of a tile whose left half has a roof: labels outside it become background and do not count."""
    surfaces = spark.createDataFrame([("9-1-1", "2.2", 1, "b1", 4.0, box(0, 0, 6, 12))], SURFACES)
    grids = spark.createDataFrame([("9-1-1", 0.0, 0.0, 12.0, 12.0, 1.0)], "tile_id string, xmin double, ymin double, xmax double, ymax double, res double")
    rows = [(f"x/9-1-1_{b}_{k}_png.rf.z.png", r, c, 1 + (r + c) % 2) for b in range(3) for k in range(3) for r in range(4) for c in range(4)]
    masks = spark.createDataFrame(rows, "image string, row_no int, col_no int, class_id int")
    flat = masks.withColumn("image", sanitize_name(F.col("image")))
    got = {(r["image"], r["row_no"], r["col_no"]): r["class_id"] for r in remask(flat, surfaces, grids, 4).collect()}
    assert len(got) == 9 * 16
    for (image, r, c), value in got.items():
        bcol = int(image.split("_")[2].split(".")[0])
        assert value == (1 + (r + c) % 2 if 4 * bcol + c < 6 else 0)
    images = flat.select("image", "row_no", "col_no", *[F.lit(0.5).alias(b) for b in BANDS])
    out = import_annotations(masks, images, class_table(spark), "random", surfaces=surfaces, grids=grids, chip_size=4)
    counts = {(r["image"], r["class_id"]): r["n"] for r in out.counts.collect() if r["n"]}
    assert sum(n for (_, c), n in counts.items() if c) == 6 * 12
    with pytest.raises(Exception, match="no chip"):
        remask(flat.withColumn("image", F.lit("other.tif")), surfaces, grids, 4).collect()
    with pytest.raises(Exception, match="no grid"):
        remask(flat, surfaces, grids.where("false"), 4).collect()
    with pytest.raises(ValueError):
        import_annotations(masks, images, class_table(spark), "random", surfaces=surfaces)


def test_run_stages(spark):
    df = spark.range(3)
    add = lambda d: d.withColumn("id", F.col("id") + 1)
    total = lambda d: d.agg(F.sum("id")).first()[0]
    assert total(run_stages(df, None)) == 3 and total(run_stages(df, add)) == 6 and total(run_stages(df, [add, add])) == 9


def test_locations_stay_in_reach(spark):
    seeds = spark.createDataFrame([(0, 0.0, 0.0), (1, 1000.0, 0.0)], "seed_id int, x double, y double")
    rows = seeded_locations(seeds, 500, 10.0, 2).collect()
    assert [r["draw"] for r in sorted(rows)] == list(range(500))
    reach = [min(np.hypot(r["x"] - s, r["y"]) for s in (0, 1000)) for r in rows]
    assert max(reach) <= 10 + 1e-9
    # Radial distance of a normal offset with sigma 10/3: mean about 4.18.
    assert 3.7 < np.mean(reach) < 4.7
    assert 0.4 < np.mean([r["x"] > 500 for r in rows]) < 0.6
    later = {tuple(r) for r in seeded_locations(seeds, 100, 10.0, 2, start=400).collect()}
    assert later == {tuple(r) for r in rows if r["draw"] >= 400}


def test_sample_tiles(spark):
    tiles = spark.createDataFrame(
        [(f"t{i}{j}", box(i * 5 - 20, j * 5 - 20, i * 5 - 15, j * 5 - 15 if i else j * 5 + 400)) for i in range(8) for j in range(8)], f"tile_id string, ring {RING.simpleString()}"
    )
    seeds = spark.createDataFrame([(0, 0.0, 0.0)], "seed_id int, x double, y double")
    chips_of = lambda t: t.select("tile_id", F.lit(3).cast("bigint").alias("n"))
    out = sample_tiles(seeds, tiles, chips_of, 10, 5.0, draws=4, radius=15.0, max_area=100.0).collect()
    assert sum(r["take"] for r in out) == 10 and sorted(r["take"] for r in out) == [1, 3, 3, 3]
    found = candidate_tiles(seeds, tiles, tiles.where("tile_id = 't44'").select("tile_id"), 64, 5.0, 15.0, max_area=100.0)
    ids = {r["tile_id"] for r in found.collect()}
    assert "t44" not in ids and not any(t.startswith("t0") for t in ids)
    quota = fill_quota(found, chips_of(found), 7, chunk=3).collect()
    first = sorted((r["draw"], r["tile_id"]) for r in found.collect())[:3]
    assert sorted((r["draw"], r["tile_id"]) for r in quota) == first
    with pytest.raises(RuntimeError):
        sample_tiles(seeds, tiles, chips_of, 10_000, 5.0, draws=4, radius=15.0)
