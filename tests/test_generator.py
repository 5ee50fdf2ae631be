"""The chip generator: quota over batches, the ledger, and going on after a stop."""

import pytest
from pyspark.sql import functions as F

from tilewright.operators.grid import empty_cells, with_shape
from tilewright.plans import generator
from tilewright.plans.generator import Ledger, TileData, generate_chips, read_chips
from tilewright.schema import RING, SURFACES

SIDE = 12.0


def box(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


@pytest.fixture(scope="module")
def land(spark):
    """36 tiles of 12 x 12 cells around the only seed; a roof covers each but for its right half in every third."""
    places = [(f"9-{100 + 6 * i + j}-10", (i - 3) * SIDE, (j - 3) * SIDE, (6 * i + j) % 3 == 0) for i in range(6) for j in range(6)]
    tiles = spark.createDataFrame([(t, box(x, y, x + SIDE, y + SIDE)) for t, x, y, _ in places], f"tile_id string, ring {RING.simpleString()}")
    surfaces = spark.createDataFrame([(t, "2.2", k, f"b{k}", 1.0, box(x, y, x + (SIDE / 2 if half else SIDE), y + SIDE)) for k, (t, x, y, half) in enumerate(places)], SURFACES)
    grids = spark.createDataFrame([(t, x, y, x + SIDE, y + SIDE, 1.0) for t, x, y, _ in places], "tile_id string, xmin double, ymin double, xmax double, ymax double, res double")
    seeds = spark.createDataFrame([(0, 0.0, 0.0)], "seed_id int, x double, y double")
    return tiles, surfaces, grids, seeds


class Builder:
    """Counts the tiles that it builds; stops with an error when its batches are used up."""

    def __init__(self, land, batches=100):
        self.land, self.batches, self.built = land, batches, []

    def __call__(self, tiles):
        names = sorted(r["tile_id"] for r in tiles.collect())
        if len(self.built) >= self.batches:
            raise KeyboardInterrupt
        self.built.append(names)
        _, surfaces, grids, _ = self.land
        own = grids.join(tiles, "tile_id", "left_semi")
        cells = empty_cells(with_shape(own)).withColumn("v", (F.col("row_no") * 100 + F.col("col_no") + 1).cast("double"))
        return TileData(cells, surfaces.join(tiles, "tile_id", "left_semi"), own)


def run(land, root, build, size, per_batch=4, **more):
    tiles, _, _, seeds = land
    return generate_chips(str(root), seeds, tiles, build, size, 0.5, SIDE, ["v"], 3, 3, 200, 60.0, tiles_per_batch=per_batch, **more)


def chips(cells):
    return sorted({(r["draw"], r["tile_id"], r["brow"], r["bcol"], r["chip_id"]) for r in cells.collect()})


def test_batches_do_not_change_the_sample(spark, land, tmp_path):
    one, many = Builder(land), Builder(land)
    whole = run(land, tmp_path / "one", one, 25, 64)
    assert chips(whole) == chips(run(land, tmp_path / "many", many, 25, 1))
    assert len(chips(whole)) == 25 and whole.count() == 25 * 9
    assert whole.where("v is null").count() == 0
    # Tiles follow each other by draw; only the last one gives fewer chips than it has.
    ledger = {r["tile_id"]: r for r in Ledger(spark, str(tmp_path / "many")).rows().collect()}
    assert all(len(b) == 1 for b in many.built)
    draws = [ledger[b[0]]["draw"] for b in many.built]
    assert draws == sorted(draws)
    taken = {t: sum(c[1] == t for c in chips(whole)) for t in ledger}
    order = [b[0] for b in many.built]
    assert [taken[t] for t in order[:-1]] == [ledger[t]["n"] for t in order[:-1]] and 0 < taken[order[-1]] <= ledger[order[-1]]["n"]


def test_a_killed_run_goes_on(spark, land, tmp_path):
    want = chips(run(land, tmp_path / "whole", Builder(land), 25))
    first = Builder(land, 1)
    with pytest.raises(KeyboardInterrupt):
        run(land, tmp_path / "run", first, 25, 2)
    done = {t for b in first.built for t in b}
    assert {r["tile_id"] for r in Ledger(spark, str(tmp_path / "run")).rows().collect()} == done
    second = Builder(land)
    assert chips(run(land, tmp_path / "run", second, 25, 2)) == want
    assert not done & {t for b in second.built for t in b}
    # A finished run builds nothing, and a larger quota goes on with it.
    third = Builder(land)
    assert chips(run(land, tmp_path / "run", third, 25)) == want and not third.built
    assert chips(read_chips(spark, str(tmp_path / "run"), 5)) == want[:5]
    more = chips(run(land, tmp_path / "run", third, 40))
    assert len(more) == 40 and more[:25] == want and not done & {t for b in third.built for t in b}


def test_a_batch_without_its_ledger_rows_does_not_count(spark, land, tmp_path, monkeypatch):
    def lost(self, tiles):
        raise OSError("stopped between the chips and the ledger")

    with monkeypatch.context() as patch:
        patch.setattr(Ledger, "commit", lost)
        with pytest.raises(OSError):
            run(land, tmp_path / "run", Builder(land), 25)
    assert len(list((tmp_path / "run" / "batches").iterdir())) == 1
    assert Ledger(spark, str(tmp_path / "run")).found() == (0, 0)
    with pytest.raises(ValueError):
        read_chips(spark, str(tmp_path / "run"), 5)
    assert chips(run(land, tmp_path / "run", Builder(land), 25)) == chips(run(land, tmp_path / "whole", Builder(land), 25))


def test_too_few_tiles(land, tmp_path):
    with pytest.raises(RuntimeError, match="of 10000 chips"):
        run(land, tmp_path / "run", Builder(land), 10_000, 64)


def test_batches_grow_with_the_tiles_finished(land, tmp_path, monkeypatch):
    """Without a fixed size the sources are read a few times, not once per so many tiles; the sample is the same."""
    monkeypatch.setattr(generator, "FIRST_BATCH", 2)
    grown = Builder(land)
    assert chips(run(land, tmp_path / "grown", grown, 60, None)) == chips(run(land, tmp_path / "whole", Builder(land), 60, 64))
    sizes = [len(b) for b in grown.built]
    assert sizes[0] == 2 and max(sizes) > 2 and len(sizes) <= 4, sizes
