import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import golden
from tilewright.functions.naming import chip_id, resolve_tile_id, sanitize_name
from tilewright.operators.catalog import check_tile_ids, exclude_seen, fetch_plan, verify_checksums
from tilewright.schema import BANDS, MANIFEST, POINTS, SURFACES, TILES, class_table
from tilewright.session import cut_lineage
from tilewright.sources.dataset import (
    read_dataset, read_dataset_metadata, write_dataset_metadata, write_samples, write_sorted,
)
from tilewright.sources.files import list_files, read_files
from tilewright.sources.manifests import read_manifests, write_manifests
from tilewright.sources.tables import (
    read_cells, read_points, read_surfaces, read_tile_index, write_cells, write_if_absent, write_points, write_surfaces,
)


def test_tile_index(spark, tmp_path):
    spark.createDataFrame([("9/284/556", None, "u", "s")], TILES).write.parquet(f"{tmp_path}/i")
    assert read_tile_index(spark, f"{tmp_path}/i").first()["tile_id"] == "9-284-556"


def test_check_tile_ids(spark):
    ids = ["9-284-556", "9/284/556", "9-284/556", "9284556", "123-284-556", "9-284-5567", "10-284-556", None]
    index = spark.createDataFrame([("9-284-556",)], "tile_id string")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ids)], "n int, tile_id string")
    got = [r["reason"] for r in check_tile_ids(df, index).orderBy("n").collect()]
    assert got == [
        None, "not delimited by dashes", "inconsistent delimiters", "inconsistent delimiters", "malformed", "not in index",
        "not in index", "inconsistent delimiters",
    ]


def test_names(spark):
    df = spark.createDataFrame([("/x/9-284-556_3_4_png.rf.ab_png.png",)], "p string")
    row = df.select(
        sanitize_name(F.col("p")).alias("a"), resolve_tile_id(F.col("p")).alias("b"),
        resolve_tile_id(F.lit("none")).alias("c"), chip_id(F.lit("9-284-556.stack"), F.lit(3), F.lit(4)).alias("d"),
    ).first()
    assert tuple(row) == ("9-284-556_3_4.tif", "9-284-556", None, "9-284-556_3_4")


def surfaces(spark):
    rows = [(t, lod, i, "b", 1.0, [(0.0, 0.0)]) for t in ("a", "b") for lod in ("1.2", "2.2") for i in range(3)]
    return spark.createDataFrame(rows, SURFACES)


def test_surfaces_are_pruned(spark, tmp_path):
    write_surfaces(surfaces(spark), f"{tmp_path}/s")
    one = read_surfaces(spark, f"{tmp_path}/s", "a", "2.2")
    assert one.count() == 3 and set(one.columns) == set(SURFACES.names)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tile_id" in plan and "(lod" in plan


def test_points_and_cells(spark, tmp_path, grid_of):
    points = spark.createDataFrame([("a", "s", i, i, 2 * i, 0, 0.1, 0.2, 0.3, -1.0) for i in range(5)], POINTS)
    write_points(points, f"{tmp_path}/p", slab=4)
    assert read_points(spark, f"{tmp_path}/p", ["a"]).count() == 5 and read_points(spark, f"{tmp_path}/p", ["b"]).count() == 0
    write_cells(grid_of([[1.5, None]], "a", "red"), f"{tmp_path}/c")
    back = read_cells(spark, f"{tmp_path}/c", ["red"])
    assert dict(back.dtypes)["red"] == "float" and [r["red"] for r in back.orderBy("col_no").collect()] == [1.5, None]


def test_write_if_absent(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    read = lambda: {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()}
    assert write_if_absent(rows(("a", 1)), path, ["k"])
    assert write_if_absent(rows(("a", 2), ("b", 2)), path, ["k"]) and read() == {("a", 1), ("b", 2)}
    assert not write_if_absent(rows(("a", 3)), path, ["k"])
    assert write_if_absent(rows(("a", 4)), path, ["k"], overwrite=True) and read() == {("a", 4), ("b", 2)}
    os.mkdir(f"{tmp_path}/empty")
    assert write_if_absent(rows(("a", 1)), f"{tmp_path}/empty", ["k"])
    (tmp_path / "file.txt").write_text("no table")
    with pytest.raises(ValueError):
        write_if_absent(rows(("a", 1)), f"{tmp_path}/file.txt", ["k"])


def test_manifests(spark, tmp_path):
    row = lambda t: (t, (["i"], ["http://h/i.tif"]), (["l", "m"], ["http://h/l.laz", "http://h/m.laz"]))
    path = f"{tmp_path}/m"
    assert write_manifests(spark.createDataFrame([row("a")], MANIFEST), path)
    assert not write_manifests(spark.createDataFrame([row("a")], MANIFEST), path)
    assert write_manifests(spark.createDataFrame([row("a"), row("b")], MANIFEST), path)
    back = read_manifests(spark, path)
    assert back.count() == 2 and back.first()["lidar"]["tid"] == ["l", "m"]
    present = spark.createDataFrame([("l.laz",)], "name string")
    names = lambda df: sorted(r["name"] for r in df.where("tid = 'a'").collect())
    assert names(fetch_plan(back, present)) == ["i.tif", "m.laz"]
    assert names(fetch_plan(back, present, overwrite=True)) == ["i.tif", "l.laz", "m.laz"]
    marked = back.withColumn("again", F.col("tid") == "a")
    assert fetch_plan(marked, present, overwrite="again").count() == 5
    assert write_manifests(spark.createDataFrame([row("z")], MANIFEST), path, overwrite=True)
    assert [r["tid"] for r in read_manifests(spark, path).collect()] == ["z"]


def test_files_and_checksums(spark, tmp_path):
    for name in ("a.bin", "b.bin", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    assert sorted(r["name"] for r in list_files(spark, str(tmp_path), "*.bin").collect()) == ["a.bin", "b.bin"]
    digest = hashlib.sha256(b"a.bin").hexdigest()
    expected = spark.createDataFrame([("a.bin", digest.upper()), ("b.bin", digest), ("d.bin", digest)], "name string, sha256 string")
    got = {r["name"]: r["status"] for r in verify_checksums(read_files(spark, str(tmp_path)), expected).collect()}
    assert got == {"a.bin": "ok", "b.bin": "mismatch", "d.bin": "missing"}


def test_checksums_of_repeated_names(spark):
    """One row per expected row, whatever repeats; equal to the SQL on pages that share addresses."""
    files = spark.createDataFrame([("a", b"1"), ("a", b"1"), ("a", b"2"), ("b", b"3"), ("b", b"3"), (None, b"4"), ("e", None)], "name string, content binary")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    asked = [("a", sha(b"1")), ("a", sha(b"1").upper()), ("a", sha(b"2")), ("a", sha(b"5")), ("b", sha(b"3")), ("c", sha(b"3")), ("b", None), (None, sha(b"4")), ("e", sha(b"1"))]
    expected = spark.createDataFrame(asked, "name string, sha256 string")
    got = sorted((str(r["name"]), r["status"]) for r in verify_checksums(files, expected).collect())
    want = ["a ok", "a ok", "a ok", "a mismatch", "b ok", "b ok", "c missing", "None ok", "e missing"]
    assert got == sorted(tuple(x.split()) for x in want)


def test_checksum_report_on_repeated_pages(spark, tmp_path):
    pages = [(k, u, h) for k, (u, h) in enumerate(
        [("x/de/1", "a"), ("x/de/1", "a"), ("x/de/1", "b"), ("x/en/1", "a"), ("x/en/1", "a"), ("x/?utm_source=q", "a"), ("x/?utm_source=q", "a"), (None, "a"), ("x/de/2", None)]
    )]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.execute(__spark_entry__.oracle_sql()["checksum_report"]).fetchall()
    got = __spark_entry__.queries()["checksum_report"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) == 9


def test_exclude_seen(spark):
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "tile_id string")
    assert [r[0] for r in exclude_seen(t("a", "b"), t("a")).collect()] == ["b"]


def test_dataset_round_trip(spark, tmp_path):
    root = str(tmp_path)
    splits = spark.createDataFrame([("i0", "training"), ("i1", "test")], "image string, subset string")
    scales = spark.createDataFrame([("red", 0.0, 1.0)], "band string, mn double, mx double")
    write_dataset_metadata(root, counts=golden.counts(spark), splits=splits, classes=class_table(spark), scales=scales)
    assert read_dataset_metadata(spark, root, "classes").count() == 10
    assert {tuple(r) for r in read_dataset_metadata(spark, root, "counts").collect()} == {tuple(r) for r in golden.counts(spark).collect()}
    with pytest.raises(ValueError):
        write_dataset_metadata(root, colours=scales)
    pixels = [(f"i{i}", r, 0, *[float(r + b) for b in range(7)]) for i in range(2) for r in range(3)]
    images = spark.createDataFrame(pixels, "image string, row_no int, col_no int, " + ", ".join(f"{b} double" for b in BANDS))
    write_samples(images, images.select("image", "row_no", "col_no", F.lit(1).alias("class_id")), root)
    doubled = lambda df: df.withColumn("red", F.col("red") * 2)
    out = read_dataset(spark, root, "training", ["red", "slope"], [doubled])
    assert out.columns == ["image", "row_no", "col_no", "red", "slope", "class_id"]
    assert sorted(r["red"] for r in out.collect()) == [0.0, 2.0, 4.0]
    plan = read_dataset(spark, root, "training", ["red"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<image:string,row_no:int,col_no:int,red:double>" in plan
    with pytest.raises(ValueError):
        read_dataset(spark, root, "holdout")
    write_sorted(images, f"{root}/sorted", ["row_no", "image"])
    first = spark.read.parquet(f"{root}/sorted").first()
    assert (first["row_no"], first["image"]) == (0, "i0")


def test_cut_lineage(spark):
    df = cut_lineage(spark.range(10).withColumn("v", F.col("id") * 2))
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().toString()
