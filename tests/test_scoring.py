import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import color
from tilewright.functions.numeric import argmax, clip, db_to_linear, nodata_to_null, softmax
from tilewright.operators.chips import (
    augment_dihedral, background_filter, background_share, block_cells, cells_of_chips, chip_blocks, limit_chips, thin_chips,
)
from tilewright.operators.evaluation import METRICS, class_metrics, confusion_matrix, macro_metrics, micro_metrics
from tilewright.operators.features import append_hsv, append_lab, append_tgi, band_list, bands_to_vector, has_rgb, select_bands
from tilewright.operators.losses import compound_loss, cross_entropy, region_loss
from tilewright.operators.scoring import blend_windows, majority_of_zones, require_stacks, score_windows, tile_windows
from tilewright.schema import BANDS


def test_scalars(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-10.0,), (5.0,)], "v double")
    rows = df.select(
        clip(F.col("v"), -1, 1).alias("c"), db_to_linear(F.col("v")).alias("d"), nodata_to_null(F.col("v")).alias("n"),
        nodata_to_null(F.col("v"), 5.0).alias("five"),
    ).collect()
    assert rows[0]["c"] is None and rows[0]["d"] is None and rows[1]["n"] is None
    assert rows[2]["c"] == -1 and rows[2]["d"] == pytest.approx(0.1) and rows[3]["d"] == 1.0 and rows[3]["five"] is None


def test_softmax_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([1000.0, 0.0, 0.0],)], "s array<double>").select(softmax(F.col("s")).alias("p"))
    rows = df.select("p", argmax(F.col("p")).alias("a")).collect()
    e = np.exp(np.array([1.0, 3, 3]) - 3)
    assert rows[0]["p"] == pytest.approx(list(e / e.sum())) and rows[0]["a"] == 1 and rows[1]["p"][0] == 1.0


def test_colours(spark):
    rgb = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.5, 0.5, 0.5), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.5)]
    df = spark.createDataFrame(rgb, "red double, green double, blue double")
    hue = [(r["hue"], r["saturation"], r["value"]) for r in append_hsv(df).collect()]
    assert [round(h[0], 6) for h in hue] == [0, round(1 / 3, 6), round(2 / 3, 6), 0, 0, 0, round(11 / 12, 6)]
    assert hue[3][1] == 0 and hue[0][1] == pytest.approx(1, abs=1e-6)
    lab = [(r["lab_l"], r["lab_a"], r["lab_b"]) for r in append_lab(df).collect()]
    assert lab[4][0] == pytest.approx(1, abs=1e-4) and lab[5][0] == pytest.approx(0, abs=1e-6)
    # sRGB red is about L 53.2, a 80.1, b 67.2.
    assert lab[0] == pytest.approx((0.5324, (80.09 + 128) / 255, (67.20 + 128) / 255), abs=2e-3)
    tgi = [r["tgi"] for r in append_tgi(df).collect()]
    assert tgi[1] == 1.0 and tgi[4] == pytest.approx(0.5) and tgi[0] == pytest.approx(0.305)
    assert len(color.XYZ) == 3


def test_band_lists(spark):
    assert band_list() == BANDS and band_list("rgb") == BANDS[:3] and band_list("slope") == ["slope"]
    assert band_list("all", "lidar") == BANDS[:3] and "slope" not in band_list("all", "slope")
    assert has_rgb(BANDS) and not has_rgb(["blue", "green", "red"])
    with pytest.raises(ValueError):
        band_list(["infrared"])
    df = spark.createDataFrame([tuple(float(i) for i in range(7))], ", ".join(f"{b} double" for b in BANDS))
    assert select_bands(df, ["slope", "red"]).columns == ["slope", "red"]
    assert bands_to_vector(df, ["slope", "red"]).first()["bands"] == [4.0, 0.0]


@pytest.fixture()
def scored(spark):
    rng = np.random.default_rng(2)
    rows = []
    for image in range(3):
        for _ in range(40):
            p = rng.dirichlet(np.ones(4))
            rows.append((image, int(rng.integers(0, 3 if image == 1 else 4)), p.tolist()))
    return rows, spark.createDataFrame(rows, "image int, truth int, probs array<double>")


WEIGHTS = [0.0, 0.2, 0.3, 0.5]


def test_cross_entropy(scored):
    rows, df = scored
    kept = [(t, np.array(p)) for _, t, p in rows if t != 0]
    w, eps = np.array(WEIGHTS), 0.1
    total = sum((1 - eps) * -w[t] * np.log(p[t]) + eps / 4 * -(w * np.log(p)).sum() for t, p in kept)
    got = lambda **k: cross_entropy(df, WEIGHTS, eps, include_background=False, **k).first()["loss"]
    assert got() == pytest.approx(total / sum(w[t] for t, _ in kept))
    assert got(reduction="sum") == pytest.approx(total)
    plain = np.mean([-np.log(p[t]) for _, t, p in rows])
    assert cross_entropy(df).first()["loss"] == pytest.approx(plain)


@pytest.mark.parametrize("background", [True, False])
def test_region_losses(scored, background):
    rows, df = scored
    start = 0 if background else 1
    dice, tversky, general = [], [], []
    for image in range(3):
        p = np.array([r[2] for r in rows if r[0] == image])
        y = np.eye(4)[[r[1] for r in rows if r[0] == image]]
        p, y = p[:, start:], y[:, start:]
        tp, sp, sy = (p * y).sum(0), p.sum(0), y.sum(0)
        dice += list(1 - (2 * tp + 1e-5) / (sp + sy + 1e-5))
        tversky += list(1 - (tp + 1e-5) / (tp + 0.5 * (sp - tp) + 0.5 * (sy - tp) + 1e-5))
        w = np.array([1 / v**2 if v > 0 else 0 for v in sy])
        w[sy == 0] = w.max()
        general.append(1 - (2 * (w * tp).sum() + 1e-5) / ((w * (sp + sy)).sum() + 1e-5))
    loss = lambda kind: region_loss(df, kind, background).first()["loss"]
    assert loss("diceloss") == pytest.approx(np.mean(dice))
    assert loss("tverskyloss") == pytest.approx(np.mean(tversky))
    assert loss("generalizeddiceloss") == pytest.approx(np.mean(general))
    focal = 0.0
    for _, t, p in rows:
        q = np.array(p)[start:] / sum(p[start:])
        focal += 0 if t < start else (1 - q[t - start]) ** 2 * -np.log(q[t - start])
    assert loss("focalloss") == pytest.approx(focal / (len(rows) * (4 - start)))


def test_compound_loss(scored):
    _, df = scored
    parts = [cross_entropy(df).first()[0], region_loss(df, "diceloss").first()[0]]
    assert compound_loss(df, ["CrossEntropyLoss", "DiceLoss"], [2, 0.5]).first()[0] == pytest.approx(2 * parts[0] + 0.5 * parts[1])
    with pytest.raises(ValueError):
        compound_loss(df, ["diceloss"], [1, 2])
    with pytest.raises(ValueError):
        compound_loss(df, "hingeloss")


def test_metrics(spark):
    rng = np.random.default_rng(9)
    truth, pred = rng.integers(0, 3, 200), rng.integers(0, 4, 200)
    df = spark.createDataFrame([("val", int(t), int(p)) for t, p in zip(truth, pred)], "stage string, truth int, pred int")
    m = np.zeros((4, 4))
    np.add.at(m, (truth, pred), 1)
    full = confusion_matrix(df, 4)
    assert {(r["truth"], r["pred"]): r["n"] for r in full.collect()} == {(t, p): m[t, p] for t in range(4) for p in range(4)}
    for how, axis in (("true", 1), ("pred", 0), ("all", None)):
        total = m.sum(axis=axis, keepdims=True) if axis is not None else m.sum()
        want = np.divide(m, total, out=np.zeros_like(m), where=np.broadcast_to(total, m.shape) > 0)
        got = {(r["truth"], r["pred"]): r["share"] for r in confusion_matrix(df, 4, how).collect()}
        assert all(got[(t, p)] == pytest.approx(want[t, p]) for t in range(4) for p in range(4))
    k = m.copy()
    k[0] = 0
    tp, fp, fn = np.diag(k), k.sum(0) - np.diag(k), k.sum(1) - np.diag(k)
    div = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    want = {"accuracy": div(tp, tp + fn), "f1": div(2 * tp, 2 * tp + fp + fn), "jaccard": div(tp, tp + fp + fn), "precision": div(tp, tp + fp), "recall": div(tp, tp + fn)}
    kept = confusion_matrix(df, 4, ignore=0)
    for r in class_metrics(kept).collect():
        assert [r[x] for x in METRICS] == pytest.approx([want[x][r["class_id"]] for x in METRICS])
    macro = macro_metrics(kept, 0).first()
    assert [macro[x] for x in METRICS] == pytest.approx([want[x][1:].mean() for x in METRICS])
    micro = micro_metrics(kept, 0).first()
    t, f, n = tp.sum(), fp.sum(), fn.sum()
    assert micro["f1"] == pytest.approx(2 * t / (2 * t + f + n)) and micro["precision"] == pytest.approx(t / (t + f))
    assert micro["jaccard"] == pytest.approx(t / (tp + fp + fn)[1:].sum())


def test_chips(spark, grid_of):
    shapes = spark.createDataFrame([("t.stack", 10, 7)], "tile_id string, n_rows int, n_cols int")
    blocks = chip_blocks(shapes, 4)
    # Rim blocks of 2 x 3, 2 x 4 and 4 x 3 cells are not square.
    assert {r["chip_id"] for r in blocks.collect()} == {"t_0_0", "t_1_0"}
    square_rim = spark.createDataFrame([("t", 6, 6)], "tile_id string, n_rows int, n_cols int")
    assert chip_blocks(square_rim, 4).count() == 2 and chip_blocks(square_rim, 4, full_only=True).count() == 1
    cells = grid_of([[1.0 if c < 4 else None for c in range(6)] for _ in range(6)], "t")
    blocked = block_cells(cells, square_rim, 4)
    assert blocked.count() == 16 + 4
    shares = {(r["brow"], r["bcol"]): (r["n_background"], r["n_cells"]) for r in background_share(blocked, "v").collect()}
    assert shares == {(0, 0): (0, 16), (1, 1): (4, 4)}
    assert background_filter(blocked, "v", 0.99).count() == 16
    assert background_filter(blocked, "v", 1.0).count() == 20
    assert cells_of_chips(cells, chip_blocks(square_rim, 4).where("brow = 1"), 4).count() == 4


def test_thinning_drops_every_fourth_kept_block(spark):
    shapes = spark.createDataFrame([("a", 40, 40), ("b", 40, 40)], "tile_id string, n_rows int, n_cols int")
    blocks = chip_blocks(shapes, 4)
    everything = thin_chips(blocks, 0, p=1.0)
    order = sorted((r["brow"], r["bcol"]) for r in everything.where("tile_id = 'a'").collect())
    assert order == [(i // 10, i % 10) for i in range(100) if (i + 1) % 4]
    half = {(r["tile_id"], r["brow"], r["bcol"]) for r in thin_chips(blocks, 5).collect()}
    assert {x[1:] for x in half if x[0] == "a"} == {x[1:] for x in half if x[0] == "b"} and 20 < len(half) / 2 < 55
    assert [r["chip_id"] for r in limit_chips(everything, 2).collect()] == ["a_0_0", "a_0_1"]


def test_dihedral(spark):
    rows = [(f"i{k}", r, c) for k in range(40) for r in range(3) for c in range(3)]
    df = spark.createDataFrame(rows, "image string, row_no int, col_no int").withColumn("v", F.col("row_no") * 3 + F.col("col_no"))
    base = np.arange(9).reshape(3, 3)
    allowed = {np.rot90(m, k).tobytes() for m in (base, base[::-1]) for k in range(4)}
    seen = {}
    for r in augment_dihedral(df, "image", 3, 1).collect():
        seen.setdefault(r["image"], np.full((3, 3), -1, dtype=base.dtype))[r["row_no"], r["col_no"]] = r["v"]
    assert all(m.tobytes() in allowed for m in seen.values())
    assert len({m.tobytes() for m in seen.values()}) == 8


@pytest.mark.parametrize("shape,crop,stride", [((10, 7), 4, 2), ((3, 3), 8, 4), ((9, 9), 4, 3)])
def test_windows_cover_every_cell(spark, grid_of, shape, crop, stride):
    cells = grid_of([[1.0] * shape[1]] * shape[0])
    shapes = spark.createDataFrame([("t", *shape)], "tile_id string, n_rows int, n_cols int")
    windows = tile_windows(cells, shapes, crop, stride)
    want = set()
    starts = lambda n: range(0, int(np.ceil(max(n - crop, 0) / stride)) + 1)
    for i in starts(shape[0]):
        for j in starts(shape[1]):
            want |= {(i, j, r, c) for r in range(i * stride, min(i * stride + crop, shape[0])) for c in range(j * stride, min(j * stride + crop, shape[1]))}
    assert {(r["wrow"], r["wcol"], r["row_no"], r["col_no"]) for r in windows.collect()} == want
    blended = blend_windows(score_windows(windows, lambda w: [[len(w), 1.0]] * len(w), ["v"]), 2)
    assert blended.count() == shape[0] * shape[1]


def test_majority(spark, grid_of):
    cells = grid_of([[1, 1, 2, 0], [2, 0, 0, 3]]).withColumn("class_id", F.col("v").cast("int"))
    zones = cells.select("tile_id", "row_no", "col_no", F.when(F.col("col_no") < 3, F.lit(5)).alias("zone")).where("zone is not null")
    read = lambda df: [[{(r["row_no"], r["col_no"]): r["class_id"] for r in df.collect()}[(i, j)] for j in range(4)] for i in range(2)]
    # Classes 1 and 2 tie: the lower one wins; background and outside cells stay.
    assert read(majority_of_zones(cells, zones)) == [[1, 1, 1, 0], [1, 0, 0, 3]]
    assert read(majority_of_zones(cells, zones, keep_background=False)) == [[0, 0, 0, 0], [0, 0, 0, 3]]
    only_background = majority_of_zones(cells.withColumn("class_id", F.lit(0)), zones)
    assert read(only_background) == [[0] * 4] * 2


def test_require_stacks(spark):
    tiles = spark.createDataFrame([("a",), ("b",)], "tile_id string")
    assert require_stacks(tiles, tiles).count() == 2
    with pytest.raises(Exception, match="no raster stack for tile b"):
        require_stacks(tiles, tiles.where("tile_id = 'a'")).collect()


def test_losses_of_scores_that_lie_far_apart(spark):
    """A softmax that underflows is the worst prediction, not the best."""
    rows = [(0, 1, [800.0, 0.0, 0.0]), (0, 1, [0.0, 1.0, 0.0]), (0, 2, [0.0, 0.0, 2.0])]
    scored = spark.createDataFrame(rows, "image int, truth int, scores array<double>")

    def logp(s):
        return np.array(s) - max(s) - math.log(sum(math.exp(v - max(s)) for v in s))

    own = [-logp(s)[t] for _, t, s in rows]
    assert cross_entropy(scored).first().loss == pytest.approx(np.mean(own))
    focal = [(1 - math.exp(-x)) ** 2 * x for x in own]
    assert region_loss(scored, "focalloss").first().loss == pytest.approx(sum(focal) / 9)
    inner = [-logp(s[1:])[t - 1] for _, t, s in rows]
    focal = [(1 - math.exp(-x)) ** 2 * x for x in inner]
    assert region_loss(scored, "focalloss", include_background=False).first().loss == pytest.approx(sum(focal) / 6)
    probs = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 1, [0.5, 0.5])], "image int, truth int, probs array<double>")
    assert cross_entropy(probs).first().loss == math.inf
    assert region_loss(probs, "focalloss").first().loss == math.inf
    assert math.isfinite(region_loss(probs, "diceloss").first().loss)
