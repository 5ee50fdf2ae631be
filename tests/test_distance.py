import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tilewright.functions.numeric import softmax
from tilewright.operators.distance import distance_transform, distance_transforms
from tilewright.operators.losses import compound_loss, cross_entropy, log_softmax, region_loss


def nearest_other(cells):
    """{(key, row, column): squared distance} from every cell with a kind to every other."""
    known = {k: v for k, v in cells.items() if v is not None}
    out = {k: None for k in cells}
    for (t, r, c), on in known.items():
        far = [(r - y) ** 2 + (c - x) ** 2 for (u, y, x), other in known.items() if u == t and other != on]
        out[t, r, c] = min(far) if far else None
    return out


@pytest.mark.parametrize("seed", range(4))
def test_distances_against_all_pairs(spark, seed):
    """Rasters with gaps, nodata, one kind only, a null key, one row or column, and negative rows."""
    rng = random.Random(seed)
    cells = {}
    for tile, height, width, share in [("a", 17, 23, 0.05), ("b", 9, 1, 0.5), (None, 1, 14, 0.3), ("c", 6, 6, 1.0), ("d", 8, 30, 0.02), ("e", 5, 5, 0.0)]:
        for r in range(-3, height - 3):
            for c in range(width):
                if rng.random() < 0.85:
                    cells[tile, r, c] = None if rng.random() < 0.1 else rng.random() < share
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "tile_id string, row_no int, col_no int, kind boolean").repartition(3)
    got = {(x.tile_id, x.row_no, x.col_no): x.d2 for x in distance_transform(df, ["tile_id"], "kind").collect()}
    assert got == nearest_other(cells)


def test_no_cells_and_no_key(spark):
    none = spark.createDataFrame([], "tile_id string, row_no int, col_no int, kind boolean")
    assert distance_transform(none, ["tile_id"], "kind").collect() == []
    with pytest.raises(ValueError):
        distance_transform(none, [], "kind")


def hausdorff(pixels, classes, reduction):
    """As published: per image and class, squared errors times the mean of both distances squared."""
    total = count = 0
    for image in {p[0] for p in pixels}:
        own = [p for p in pixels if p[0] == image]
        for k in classes:
            far = 0.0
            for inside in (lambda p: p[4][k] > 0.5, lambda p: p[3] == k):
                far += sum(d or 0 for d in nearest_other({p[:3]: inside(p) for p in own}).values())
            total += sum((p[4][k] - (p[3] == k)) ** 2 for p in own) * far / len(own)
            count += len(own)
    return total / count if reduction == "mean" else total


@pytest.fixture(scope="module")
def pixels():
    rng = random.Random(3)
    out = []
    for image, side in ((0, 7), (1, 5), (2, 4)):
        for r in range(side):
            for c in range(side):
                raw = [math.exp(rng.gauss(2 * (k == (r + c) // 4 % 3), 1)) for k in range(3)]
                # Image 2 is class 1 everywhere, so class 2 is absent from its truth.
                out.append((image, r, c, 1 if image == 2 else rng.choice([0, 1, 2, (r + c) // 4 % 3]), [x / sum(raw) for x in raw]))
    return out


@pytest.mark.parametrize("background", [True, False])
@pytest.mark.parametrize("reduction", ["mean", "sum"])
def test_hausdorff_loss(spark, pixels, background, reduction):
    df = spark.createDataFrame(pixels, "image int, row_no int, col_no int, truth int, probs array<double>")
    got = region_loss(df, "hausdorffdtloss", background, reduction).first().loss
    assert got == pytest.approx(hausdorff(pixels, range(0 if background else 1, 3), reduction))
    assert got > 0


def test_hausdorff_in_the_compound_and_from_scores(spark, pixels):
    df = spark.createDataFrame(pixels, "image int, row_no int, col_no int, truth int, probs array<double>")
    scores = df.withColumn("scores", F.transform("probs", lambda p: F.log(p))).drop("probs")
    want = hausdorff(pixels, range(3), "mean")
    for table in (df, scores):
        got = compound_loss(table, ["CrossEntropyLoss", "HausdorffDTLoss"], [1.0, 0.5]).first().loss
        assert got == pytest.approx(cross_entropy(df).first().loss + 0.5 * want)


def test_perfect_prediction_costs_nothing(spark):
    rows = [(0, r, c, int(c > 1), [float(c <= 1), float(c > 1)]) for r in range(3) for c in range(4)]
    df = spark.createDataFrame(rows, "image int, row_no int, col_no int, truth int, probs array<double>")
    assert region_loss(df, "hausdorffdtloss").first().loss == 0


@pytest.mark.parametrize("name", ["boundary_distance", "hausdorff_loss", "compound_hausdorff"])
def test_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for table in ("embeddings", "part"):
        duck.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = __spark_entry__.queries()[name](spark, folder)
    found = duck.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(found)
    assert name == "boundary_distance" or found[0][0] > 0


def test_several_masks_at_once(spark):
    """Masks of one raster give what each gives alone; cells with fewer kinds are nodata in the rest."""
    rng = random.Random(7)
    cells = {(r, c): [rng.choice([1, 0, 0, -1]), rng.choice([1, 0]), 1, 0][: 4 if rng.random() < 0.8 else 2] for r in range(9) for c in range(13) if rng.random() < 0.8}
    df = spark.createDataFrame([(5, *k, v) for k, v in cells.items()], "image int, row_no int, col_no int, kinds array<tinyint>").repartition(3)
    got = {(x.row_no, x.col_no): x.d2 for x in distance_transforms(df, ["image"], "kinds").collect()}
    for m in range(4):
        kinds = {(0, *k): None if m >= len(v) or v[m] < 0 else v[m] == 1 for k, v in cells.items()}
        for (_, *place), want in nearest_other(kinds).items():
            d2 = got[tuple(place)][m]
            assert d2 == (-1 if kinds[0, *place] is None else math.inf if want is None else want)


def test_scores_are_worked_out_once(spark):
    """Neither the sum nor the largest score is found again for each class, whatever the scores are made of."""
    made = F.transform(F.col("v"), lambda x: F.cbrt(x))
    df = spark.createDataFrame([([8.0, 27.0],)], "v array<double>")
    for use in (softmax, log_softmax):
        plan = df.select(use(made).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("CBRT") == 1


def test_masks_of_an_image_are_shuffled_together(spark, pixels):
    """Per pixel one row goes into the transform, not one per class and mask."""
    df = spark.createDataFrame(pixels, "image int, row_no int, col_no int, truth int, probs array<double>")
    plan = region_loss(df, "hausdorffdtloss")._jdf.queryExecution().optimizedPlan().toString()
    grouped = [x for x in plan.splitlines() if "Aggregate" in x and "collect_list" in x]
    assert grouped and not any("class_id" in x or "mask#" in x for x in grouped)
