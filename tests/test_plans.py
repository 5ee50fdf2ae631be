"""The physical plans that the operators rely on at scale."""

import re

import pytest
from pyspark.sql import functions as F

from tilewright.operators.chips import background_filter
from tilewright.operators.neighbors import radius_join
from tilewright.operators.points import crop_points, grid_idw
from tilewright.operators.raster import fill_voids, resample_bilinear, resample_nearest, slope
from tilewright.operators.scoring import majority_of_zones
from tilewright.plans.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange ", plan_of(df)))


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells") / "c")
    spark.range(400).select(
        F.lit("t").alias("tile_id"), F.floor(F.col("id") / 20).cast("int").alias("row_no"),
        (F.col("id") % 20).cast("int").alias("col_no"), F.col("id").cast("double").alias("v"), F.lit(1.0).alias("unused"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_neighbour_operators_shuffle_once(spark, cells):
    shapes = spark.createDataFrame([("t", 20, 20, 60, 60)], "tile_id string, src_rows int, src_cols int, dst_rows int, dst_cols int")
    assert exchanges(slope(cells, "v", 1.0)) == 1
    assert exchanges(fill_voids(cells, "v")) == 1
    assert exchanges(resample_bilinear(cells, shapes, "v")) == 1
    assert exchanges(resample_nearest(cells, shapes, "v")) == 0
    blocks = cells.withColumns({"brow": F.lit(0), "bcol": F.lit(0)})
    assert exchanges(background_filter(blocks, "v", 0.5)) == 1
    assert "unused" not in re.search(r"ReadSchema: (\S+)", plan_of(slope(cells, "v", 1.0))).group(1)


def test_gridding_shuffles_partial_sums(spark):
    grids = spark.createDataFrame([("t", 0.0, 0.0, 4.0, 4.0, 1.0)], "tile_id string, xmin double, ymin double, xmax double, ymax double, res double")
    points = spark.createDataFrame([("t", 1, 0.5, 0.5, 1.0)], "tile_id string, idx bigint, x double, y double, z double")
    plan = plan_of(grid_idw(points, grids, ["z"]))
    # One exchange spreads the empty rows, one carries the sums; no join but the broadcast of grids.
    assert len(re.findall(r"\bExchange ", plan)) == 2 and "SortMergeJoin" not in plan
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan


def test_crop_reaches_the_scan(spark, tmp_path):
    spark.range(10).select(*[F.col("id").alias(c) for c in ("xi", "yi", "zi")]).write.parquet(f"{tmp_path}/p")
    plan = plan_of(crop_points(spark.read.parquet(f"{tmp_path}/p"), [0, 0, 5, 5], 1.0))
    assert "PushedFilters" in plan and "LessThanOrEqual(xi,5)" in plan


@pytest.fixture()
def skewed(spark):
    """Settings under which a few thousand rows count as skew."""
    values = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
    }
    for key, value in values.items():
        spark.conf.set(key, value)
    yield
    for key in values:
        spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hot_bin_is_split(spark, skewed):
    # A third of the points is in one bin.
    points = spark.range(0, 30000, 1, 8).select(
        F.col("id").alias("idx"), F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.col("id") * 1.0).alias("x"), F.lit(0.0).alias("y")
    )
    queries = spark.range(0, 30000, 50).select(F.col("id").alias("query_id"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    hits = radius_join(queries, points, 1.0)
    # Per query: the neighbours that are not on the pile; the pile is out of reach of all queries.
    assert hits.where("distance > 1").count() == 0
    out = radius_join(queries.unionByName(spark.createDataFrame([(-1, 5.0, 0.0)], queries.schema)), points, 1.0)
    rows = out.collect()
    assert sum(r["query_id"] == -1 for r in rows) == 10002
    assert "skew=true" in plan_of(out)


def test_cells_outside_zones_are_spread(spark, skewed):
    # Most cells have no zone; their NULL keys must not meet in one task.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    cells = spark.range(0, 40000, 1, 8).select(
        F.lit("t").alias("tile_id"), F.floor(F.col("id") / 200).cast("int").alias("row_no"), (F.col("id") % 200).cast("int").alias("col_no"), F.lit(1).alias("class_id")
    )
    zones = cells.where("row_no < 2").select("tile_id", "row_no", "col_no", F.col("col_no").cast("bigint").alias("zone"))
    out = majority_of_zones(cells, zones)
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 40000 and max(sizes) < 40000 / 4


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, name):
    if name in ("stratified_split", "stratified_balance", "generate_chips"):
        pytest.skip("runs its search when called")
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
