"""Queries on surfaces, rasters and chips."""

from pyspark.sql import functions as F

from ..schema import RGB as RGB_NAMES
from ..functions import crs
from ..functions.geometry import area, box_ring
from ..functions.numeric import argmax
from ..operators.chips import (
    augment_dihedral, background_filter, block_cells, chip_blocks, limit_chips, thin_chips,
)
from ..operators.distance import distance_transform
from ..operators.features import append_hsv, append_lab, append_tgi, select_bands, vector_to_bands
from ..operators.grid import cell_centers, empty_cells, with_shape
from ..operators.points import grid_idw
from ..operators.raster import (
    fill_all_voids, fill_voids, mosaic, percentile_clip, preserve_total, replace_null, resample_bilinear, resample_nearest, slope,
    snap_bounds, stack_bands,
)
from ..operators.sampling import sample_tiles, seeded_locations
from ..operators.scoring import blend_windows, majority_of_zones, score_windows, tile_windows, zonal_majority
from ..operators.stats import band_ranges, minmax_scale
from ..operators.surfaces import (
    asset_manifests, clip_surfaces, dissolve, filter_tile_area, flag_invalid_rings, height_above_roof, mask_to_surfaces,
    match_sheets, points_in_polygons, rasterize_polygons, surface_bounds, tiles_containing,
)
from .queries_points import GRID_CELLS, IDW, roofs
from .registry import query
from .views import FOLD, folded

# A roof holds a point: lower and left sides belong to it, upper and right ones do not.
HOLDS = """((r.diamond = 0 and {x} >= r.xmin and {x} < r.xmax and {y} >= r.ymin and {y} < r.ymax)
  or (r.diamond = 1 and abs({x} - (r.xmin + r.xmax)/2)/((r.xmax - r.xmin)/2) + abs({y} - (r.ymin + r.ymax)/2)/((r.ymax - r.ymin)/2) < 1))"""
CELL_HOLDS = HOLDS.format(x="c.cx", y="c.cy")
STRIP_CELLS = f"grid as (select * from v_grids), {GRID_CELLS}"


@query(
    "slope",
    sql="""
    select c.tile_id, c.row_no, c.col_no, round(degrees(atan(sqrt(
        power(case when u.v is not null and d.v is not null then (d.v - u.v)/1.0::double when d.v is not null then (d.v - c.v)/0.5::double else (c.v - u.v)/0.5::double end, 2)
        + power(case when l.v is not null and r.v is not null then (r.v - l.v)/1.0::double when r.v is not null then (r.v - c.v)/0.5::double else (c.v - l.v)/0.5::double end, 2)))), 6) as slope
    from v_cells c
    left join v_cells u on u.tile_id = c.tile_id and u.row_no = c.row_no - 1 and u.col_no = c.col_no
    left join v_cells d on d.tile_id = c.tile_id and d.row_no = c.row_no + 1 and d.col_no = c.col_no
    left join v_cells l on l.tile_id = c.tile_id and l.row_no = c.row_no and l.col_no = c.col_no - 1
    left join v_cells r on r.tile_id = c.tile_id and r.row_no = c.row_no and r.col_no = c.col_no + 1""",
)
def slope_query(inputs):
    out = slope(inputs("v_cells"), "v", 0.5, block=64)
    return out.withColumn("slope", F.round("slope", 6))


@query(
    "fill_voids",
    ctes="""
  near as (select c.tile_id, c.row_no, c.col_no, c.v_null, n.v_null as w,
      abs(n.row_no - c.row_no) + abs(n.col_no - c.col_no) as d,
      row_number() over (partition by c.tile_id, c.row_no, c.col_no, sign(n.row_no - c.row_no), sign(n.col_no - c.col_no)
        order by abs(n.row_no - c.row_no) + abs(n.col_no - c.col_no)) as k
    from v_cells c left join v_cells n on n.tile_id = c.tile_id and n.v_null is not null and c.v_null is null
      and ((n.row_no = c.row_no and abs(n.col_no - c.col_no) <= 4) or (n.col_no = c.col_no and abs(n.row_no - c.row_no) <= 4)))""",
    sql="""
    select tile_id, row_no, col_no, round(coalesce(max(v_null), sum(w/d)/sum(1/d)), 4) as v_null
    from near where k = 1 group by 1, 2, 3""",
)
def fill_voids_query(inputs):
    out = fill_voids(inputs("v_cells"), "v_null", radius=4, block=16)
    return out.withColumn("v_null", F.round("v_null", 4))


def _pass(k):
    """One filling pass of radius 1: the mean of the valid neighbours in the four directions."""
    return f"""
  fill{k + 1} as (select c.tile_id, c.row_no, c.col_no, coalesce(max(c.v), avg(n.v)) as v
    from fill{k} c left join fill{k} n on n.tile_id = c.tile_id and c.v is null and n.v is not null
      and abs(n.row_no - c.row_no) + abs(n.col_no - c.col_no) = 1 group by 1, 2, 3)"""


# Passes after the last one that fills anything change nothing; eight are more than the voids of these rasters take.
@query(
    "fill_all_voids",
    ctes="fill0 as (select tile_id, row_no, col_no, case when (row_no % 5 in (1, 2) and col_no between 3 and 6) then null else v_null end as v from v_cells),"
    + ",".join(_pass(k) for k in range(8)),
    sql="select tile_id, row_no, col_no, round(v, 4) as v from fill8",
)
def fill_all_voids_query(inputs):
    """Voids of two rows and four columns and single ones, filled from their rims inward, one pass after another."""
    hole = F.col("row_no").cast("int") % 5
    cells = inputs("v_cells").select(
        "tile_id", "row_no", "col_no", F.when(hole.isin(1, 2) & F.col("col_no").between(3, 6), None).otherwise(F.col("v_null")).alias("v")
    )
    return fill_all_voids(cells, "v", radius=1, block=16).withColumn("v", F.round("v", 4))


@query(
    "points_in_surfaces",
    sql=f"select p.idx, r.surface_id from v_cloud p join v_roofs r on p.tile_id = r.tile_id and {HOLDS.format(x='p.x', y='p.y')}",
)
def points_in_surfaces(inputs):
    points = inputs("v_cloud").select("tile_id", "idx", "x", "y")
    return points_in_polygons(points, roofs(inputs), 8.0, ["tile_id"]).select("idx", "surface_id")


def _tiles(inputs):
    return inputs("v_grids").withColumn("ring", box_ring(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]))


@query(
    "tiles_containing",
    sql="""
    select p.idx, g.tile_id from v_strip p join v_grids g
      on p.xi*0.1::double >= g.xmin and p.xi*0.1::double < g.xmax and p.yi*0.1::double >= g.ymin and p.yi*0.1::double < g.ymax""",
)
def tiles_containing_query(inputs):
    points = inputs("v_cloud").select("idx", "x", "y")
    return tiles_containing(points, _tiles(inputs), 150.0).select("idx", "tile_id")


@query(
    "rasterize_surfaces",
    ctes=STRIP_CELLS,
    sql=f"""
    select c.tile_id, c.row_no, c.col_no, coalesce(arg_max(r.h50, r.surface_id), 0) as h50
    from cell c left join v_roofs r on r.tile_id = c.tile_id and {CELL_HOLDS} group by 1, 2, 3""",
)
def rasterize_surfaces(inputs):
    return rasterize_polygons(roofs(inputs), inputs("v_grids"), "surface_id", "h50", "surface_id", 0.0)


@query(
    "mask_to_surfaces",
    ctes=STRIP_CELLS,
    sql=f"""
    select c.tile_id, c.row_no, c.col_no,
      case when count(r.surface_id) > 0 then round(max(cx)*1000 + max(cy), 3) end as v
    from cell c left join v_roofs r on r.tile_id = c.tile_id and {CELL_HOLDS} group by 1, 2, 3""",
)
def mask_to_surfaces_query(inputs):
    grids = inputs("v_grids")
    cells = cell_centers(grids).select("tile_id", "row_no", "col_no", F.round(F.col("x") * 1000 + F.col("y"), 3).alias("v"))
    return mask_to_surfaces(cells, roofs(inputs), grids, ["v"])


@query(
    "height_above_roof",
    ctes=IDW + """,
  building as (select tile_id, building_id, arg_min(h50, surface_id) filter (where h50 is not null) as h from v_roofs group by 1, 2)""",
    sql=f"""
    select i.tile_id, i.row_no, i.col_no, round(any_value(i.z) - coalesce(arg_max(b.h, b.building_id), 0), 6) as ndrm
    from idw i join cell c on c.tile_id = i.tile_id and c.row_no = i.row_no and c.col_no = i.col_no
    left join v_roofs r on r.tile_id = c.tile_id and {CELL_HOLDS}
    left join building b on b.tile_id = r.tile_id and b.building_id = r.building_id
    group by 1, 2, 3""",
)
def height_above_roof_query(inputs):
    grids = inputs("v_grids")
    dsm = grid_idw(inputs("v_cloud"), grids, ["z"])
    return height_above_roof(dsm, roofs(inputs), grids).withColumn("ndrm", F.round("ndrm", 6))


@query(
    "dissolve",
    sql="""
    select r.tile_id, r.surface_id, r.building_id, b.h as h50 from v_roofs r
    join (select tile_id, building_id, arg_min(h50, surface_id) as h from v_roofs group by 1, 2) b
      on b.tile_id = r.tile_id and b.building_id = r.building_id""",
)
def dissolve_query(inputs):
    out = dissolve(roofs(inputs), ["tile_id", "building_id"], "surface_id", ["h50"])
    return out.select("tile_id", "surface_id", "building_id", "h50")


@query(
    "match_sheets",
    ctes="""
  hit as (select distinct r.tile_id, s.kind, s.tid, s.url from v_roofs r join v_sheets s
    on r.xmin < s.xmax and r.xmax > s.xmin and r.ymin < s.ymax and r.ymax > s.ymin
    where r.diamond = 0
    or (case when (r.xmin + r.xmax)/2 between s.xmin and s.xmax then 0 else least(abs((r.xmin + r.xmax)/2 - s.xmin), abs((r.xmin + r.xmax)/2 - s.xmax)) end)/((r.xmax - r.xmin)/2)
     + (case when (r.ymin + r.ymax)/2 between s.ymin and s.ymax then 0 else least(abs((r.ymin + r.ymax)/2 - s.ymin), abs((r.ymin + r.ymax)/2 - s.ymax)) end)/((r.ymax - r.ymin)/2) < 1)""",
    sql="""
    select tile_id as tid, coalesce(string_agg(tid, ',' order by tid) filter (where kind = 'image'), '') as images,
      coalesce(string_agg(tid, ',' order by tid) filter (where kind = 'lidar'), '') as lidars,
      coalesce(string_agg(url, ',' order by url) filter (where kind = 'lidar'), '') as lidar_urls
    from hit group by tile_id""",
)
def match_sheets_query(inputs):
    manifests = asset_manifests(match_sheets(roofs(inputs), inputs("v_sheets"), 50.0))
    return manifests.select(
        "tid", F.array_join("image.tid", ",").alias("images"), F.array_join("lidar.tid", ",").alias("lidars"),
        F.array_join("lidar.url", ",").alias("lidar_urls"),
    )


@query(
    "tile_area_filter",
    sql="select surface_id from v_roofs where case diamond when 1 then 0.5::double else 1.0::double end * (xmax - xmin)*(ymax - ymin) <= 40.5",
)
def tile_area_filter(inputs):
    return filter_tile_area(roofs(inputs), 40.5).select("surface_id")


@query(
    "clip_surfaces",
    sql="""
    select r.surface_id from v_roofs r join v_grids g on r.tile_id = g.tile_id
    where r.xmin <= g.xmin + 60 and r.xmax >= g.xmin and r.ymin <= g.ymin + 90 and r.ymax >= g.ymin""",
)
def clip_surfaces_query(inputs):
    part = inputs("v_grids").withColumns({"xmax": F.col("xmin") + 60, "ymax": F.col("ymin") + 90})
    return clip_surfaces(roofs(inputs), part).select("surface_id")


@query(
    "boundary_distance",
    sql="""
    select a.tile_id, a.row_no, a.col_no, cast(min((a.row_no - b.row_no)*(a.row_no - b.row_no) + (a.col_no - b.col_no)*(a.col_no - b.col_no)) as double) as d2
    from v_cells a left join v_cells b on a.tile_id = b.tile_id and (a.v_null is null) <> (b.v_null is null) group by 1, 2, 3""",
)
def boundary_distance(inputs):
    """Squared distance of every cell to the nearest valid one if it is empty, else to the nearest empty one."""
    return distance_transform(inputs("v_cells").withColumn("valid", F.col("v_null").isNotNull()), ["tile_id"], "valid")


@query(
    "ring_check",
    sql="""
    select surface_id, case when surface_id % 5 = 1 then 'open' when surface_id % 5 = 2 then 'too_short'
      when surface_id % 5 = 3 then 'flat' end as reason,
      round(case when surface_id % 5 = 3 then 0 else case diamond when 1 then 0.5::double else 1.0::double end * (xmax - xmin)*(ymax - ymin)
        * case when surface_id % 5 = 2 then 0 else 1 end end, 4) as area
    from v_roofs""",
)
def ring_check(inputs):
    case, ring = F.col("surface_id") % 5, F.col("ring")
    damaged = (
        F.when(case == 1, F.slice(ring, 1, 4)).when(case == 2, F.slice(ring, 1, 2))
        .when(case == 3, F.concat(F.slice(ring, 1, 2), F.slice(ring, 1, 2), F.slice(ring, 1, 1))).otherwise(ring)
    )
    flagged = flag_invalid_rings(roofs(inputs).withColumn("ring", damaged))
    return flagged.select("surface_id", "reason", F.round(area(F.col("ring")), 4).alias("area"))


@query(
    "surface_bounds",
    sql="""
    select tile_id, floor(min(xmin)/0.25)*0.25::double as xmin, floor(min(ymin)/0.25)*0.25::double as ymin,
      ceil(max(xmax)/0.25)*0.25::double as xmax, ceil(max(ymax)/0.25)*0.25::double as ymax, 0.25::double as res
    from v_roofs group by tile_id""",
)
def surface_bounds_query(inputs):
    return snap_bounds(surface_bounds(roofs(inputs), ["tile_id"]), 0.25)


@query(
    "mosaic",
    ctes="""
  src as (
    select tile_id, 0 as priority, col_no + 0.5::double as x, -(row_no + 0.5::double) as y, v_null as a, v as b from v_cells
    union all
    select tile_id, 1, col_no + 3.5::double, -(row_no + 2.5::double), v, v_null from v_cells)""",
    sql="""
    select tile_id, cast(ceil(-y) - 1 as int) as row_no, cast(floor(x) as int) as col_no,
      arg_min(a, priority) filter (where a is not null) as a, arg_min(b, priority) filter (where b is not null) as b
    from src group by 1, 2, 3""",
)
def mosaic_query(inputs):
    cells = inputs("v_cells")
    place = lambda p, dx, dy, a, b: cells.select(
        "tile_id", F.lit(p).alias("priority"), (F.col("col_no") + dx + 0.5).alias("x"), (-(F.col("row_no") + dy + 0.5)).alias("y"),
        F.col(a).alias("a"), F.col(b).alias("b"),
    )
    sources = place(0, 0, 0, "v_null", "v").unionByName(place(1, 3, 2, "v", "v_null"))
    extent = inputs("v_shapes").select(
        "tile_id", F.lit(0.2).alias("xmin"), (-(F.col("n_rows") + 1.6)).alias("ymin"),
        (F.col("n_cols") + 2.7).alias("xmax"), F.lit(-0.3).alias("ymax"),
    )
    return mosaic(sources, snap_bounds(extent, 1.0), ["a", "b"])


def _finer(inputs, factor):
    return inputs("v_shapes").select(
        "tile_id", F.col("n_rows").alias("src_rows"), F.col("n_cols").alias("src_cols"),
        (F.col("n_rows") * factor + 1).alias("dst_rows"), (F.col("n_cols") * factor + 1).alias("dst_cols"),
    )


TARGET = """
  dst as (select s.*, cast(n_rows*3 + 1 as int) as dr, cast(n_cols*3 + 1 as int) as dc from v_shapes s),
  trow as (select *, unnest(range(dr)) as i from dst),
  target as (select *, unnest(range(dc)) as j from trow)"""


@query(
    "resample_nearest",
    ctes=TARGET,
    sql="""
    select t.tile_id, cast(i as int) as row_no, cast(j as int) as col_no, c.v_null
    from target t join v_cells c on c.tile_id = t.tile_id
      and c.row_no = floor((i + 0.5::double)*n_rows/dr) and c.col_no = floor((j + 0.5::double)*n_cols/dc)""",
)
def resample_nearest_query(inputs):
    return resample_nearest(inputs("v_cells"), _finer(inputs, 3), "v_null")


@query(
    "resample_bilinear",
    ctes=TARGET + """,
  pos as (select *, (i + 0.5::double)*n_rows/dr - 0.5::double as y, (j + 0.5::double)*n_cols/dc - 0.5::double as x from target),
  corner as (select p.*, a, b, greatest(least(floor(y) + a, n_rows - 1), 0) as r, greatest(least(floor(x) + b, n_cols - 1), 0) as c,
      case a when 0 then 1 - (y - floor(y)) else y - floor(y) end * case b when 0 then 1 - (x - floor(x)) else x - floor(x) end as w
    from pos p cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) k(a, b))""",
    sql="""
    select k.tile_id, cast(i as int) as row_no, cast(j as int) as col_no,
      round(sum(w*v_null)/nullif(sum(case when v_null is not null then w end), 0), 4) as v_null
    from corner k left join v_cells c on c.tile_id = k.tile_id and c.row_no = k.r and c.col_no = k.c
    group by 1, 2, 3""",
)
def resample_bilinear_query(inputs):
    out = resample_bilinear(inputs("v_cells"), _finer(inputs, 3), "v_null", block=16)
    return out.withColumn("v_null", F.round("v_null", 4))


@query(
    "preserve_total",
    ctes=TARGET + """,
  near as (select t.tile_id, i, j, c.v from target t join v_cells c on c.tile_id = t.tile_id
      and c.row_no = floor((i + 0.5::double)*n_rows/dr) and c.col_no = floor((j + 0.5::double)*n_cols/dc)),
  total as (select c.tile_id, c.s/n.s as f from (select tile_id, sum(v) as s from v_cells group by 1) c
    join (select tile_id, sum(v) as s from near group by 1) n on n.tile_id = c.tile_id)""",
    sql="select n.tile_id, cast(i as int) as row_no, cast(j as int) as col_no, round(v*f, 4) as v from near n join total t on t.tile_id = n.tile_id",
)
def preserve_total_query(inputs):
    cells = inputs("v_cells")
    out = preserve_total(resample_nearest(cells, _finer(inputs, 3), "v"), cells, "v")
    return out.withColumn("v", F.round("v", 4))


@query(
    "percentile_clip",
    ctes="lim as (select tile_id, quantile_cont(v_null, 0.02) as lo, quantile_cont(v_null, 0.98) as hi from v_cells group by 1)",
    sql="""
    select c.tile_id, row_no, col_no, round(case when v_null is null then null else least(greatest(v_null, lo), hi) end, 6) as v_null
    from v_cells c join lim l on l.tile_id = c.tile_id""",
)
def percentile_clip_query(inputs):
    out = percentile_clip(inputs("v_cells").select("tile_id", "row_no", "col_no", "v_null"), "v_null", 0.02, 0.98)
    return out.withColumn("v_null", F.round("v_null", 6))


@query(
    "percentile_clip_points",
    ctes="lim as (select quantile_cont(l_extendedprice, 0.98) as hi from lineitem)",
    sql="select l_orderkey, l_partkey, l_linenumber, round(least(l_extendedprice, hi), 4) as price from lineitem, lim",
)
def percentile_clip_points(inputs):
    rows = inputs("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return percentile_clip(rows, "price", high=0.98, by=()).withColumn("price", F.round("price", 4))


@query(
    "stack_bands",
    sql="""
    select c.tile_id, c.row_no, c.col_no, c.v as red, n.v_null as ndrm, s.v as density
    from v_cells c
    left join v_cells n on n.tile_id = c.tile_id and n.row_no = c.row_no and n.col_no = c.col_no
    left join v_cells s on s.tile_id = c.tile_id and s.row_no = c.row_no + 1 and s.col_no = c.col_no""",
)
def stack_bands_query(inputs):
    cells = inputs("v_cells")
    shifted = cells.select("tile_id", (F.col("row_no") - 1).alias("row_no"), "col_no", F.col("v").alias("density"))
    return stack_bands(
        [(cells.withColumnRenamed("v", "red"), "red"), (cells.withColumnRenamed("v_null", "ndrm"), "ndrm"), (shifted, "density")]
    )


@query(
    "replace_values",
    sql="select tile_id, row_no, col_no, coalesce(v_null, 0) as v_null from v_cells",
)
def replace_values(inputs):
    return replace_null(inputs("v_cells").select("tile_id", "row_no", "col_no", "v_null"), ["v_null"], 0.0)


@query(
    "cell_centers",
    ctes=STRIP_CELLS,
    sql="select tile_id, row_no, col_no, cx as x, cy as y from cell",
)
def cell_centers_query(inputs):
    return cell_centers(inputs("v_grids"))


BLOCKS = """
  brow as (select *, unnest(range(cast(ceil(n_rows/4.0) as int))) as b from v_shapes),
  blk as (select tile_id, cast(b as int) as brow, cast(c as int) as bcol, n_rows, n_cols
    from (select *, unnest(range(cast(ceil(n_cols/4.0) as int))) as c from brow) x),
  sq as (select tile_id, brow, bcol, cast(tile_id as string) || '_' || brow || '_' || bcol as chip_id
    from blk where least(4, n_rows - 4*brow) = least(4, n_cols - 4*bcol))"""

THIN = BLOCKS + """,
  drawn as (select *, row_number() over (partition by tile_id order by brow, bcol) as k from sq
    where cast('0x' || substr(md5('7:' || brow || ':' || bcol), 1, 8) as bigint)/4294967296.0 < 0.5)"""


@query("chip_blocks", ctes=BLOCKS, sql="select tile_id, brow, bcol, chip_id from sq")
def chip_blocks_query(inputs):
    return chip_blocks(inputs("v_shapes"), 4)


@query("chip_thin", ctes=THIN, sql="select tile_id, brow, bcol, chip_id from drawn where k % 4 <> 0")
def chip_thin(inputs):
    return thin_chips(chip_blocks(inputs("v_shapes"), 4), 7)


@query(
    "chip_limit",
    ctes=THIN,
    sql="select tile_id, brow, bcol, chip_id from drawn where k % 4 <> 0 order by tile_id, brow, bcol limit 20",
)
def chip_limit(inputs):
    return limit_chips(thin_chips(chip_blocks(inputs("v_shapes"), 4), 7), 20)


@query(
    "background_filter",
    ctes="""
  blk as (select c.*, cast(floor(row_no/4) as int) as brow, cast(floor(col_no/4) as int) as bcol, n_rows, n_cols
    from v_cells c join v_shapes s on s.tile_id = c.tile_id),
  sq as (select * from blk where least(4, n_rows - 4*brow) = least(4, n_cols - 4*bcol))""",
    sql="""
    select tile_id, row_no, col_no, brow, bcol, v_null from sq
    where tile_id*1000000 + brow*10 + bcol in (
      select tile_id*1000000 + brow*10 + bcol from sq group by tile_id, brow, bcol
      having count(*) filter (where v_null is null) <= count(*)*0.15)""",
)
def background_filter_query(inputs):
    blocks = block_cells(inputs("v_cells").select("tile_id", "row_no", "col_no", "v_null"), inputs("v_shapes"), 4)
    return background_filter(blocks, "v_null", 0.15)


@query(
    "augment_dihedral",
    ctes="""
  coin as (select p_partkey, p_brand, cast((p_size - 1) % 8 as int) as r, cast(p_partkey % 8 as int) as c,
      cast('0x' || substr(md5('3h:' || p_brand), 1, 8) as bigint)/4294967296.0 < 0.5 as h,
      cast('0x' || substr(md5('3v:' || p_brand), 1, 8) as bigint)/4294967296.0 < 0.5 as v,
      cast(cast('0x' || substr(md5('3r1:' || p_brand), 1, 8) as bigint)/4294967296.0 < 0.5 as int)
      + cast(cast('0x' || substr(md5('3r2:' || p_brand), 1, 8) as bigint)/4294967296.0 < 0.5 as int)
      + cast(cast('0x' || substr(md5('3r3:' || p_brand), 1, 8) as bigint)/4294967296.0 < 0.5 as int) as t
    from part),
  flip as (select *, case when v then 7 - r else r end as a, case when h then 7 - c else c end as b from coin)""",
    sql="""
    select p_partkey, p_brand as image,
      cast(case t when 0 then a when 1 then 7 - b when 2 then 7 - a else b end as int) as row_no,
      cast(case t when 0 then b when 1 then a when 2 then 7 - b else 7 - a end as int) as col_no
    from flip""",
)
def augment_dihedral_query(inputs):
    cells = inputs("part").select(
        "p_partkey", F.col("p_brand").alias("image"), ((F.col("p_size") - 1) % 8).cast("int").alias("row_no"),
        (F.col("p_partkey") % 8).cast("int").alias("col_no"),
    )
    return augment_dihedral(cells, "image", 8, 3)


UNIT = "cast('0x' || substr(md5({0}), 1, 8) as bigint)/4294967296.0::double"
LOCATIONS = f"""
  pick as (select c_custkey, c_acctbal*10 as sx, c_custkey*1.5::double as sy,
      row_number() over (order by {UNIT.format("'5:' || c_custkey")}, c_custkey) - 1 as rk from customer),
  draw as (select event_id as draw, cast(floor({UNIT.format("'5p:' || event_id")} * (select count(*) from customer)) as bigint) as rk,
      sqrt(-2*ln(1 - {UNIT.format("'5nr:' || event_id")}))*cos(2*pi()*{UNIT.format("'5na:' || event_id")})/3 as dx,
      sqrt(-2*ln(1 - {UNIT.format("'5nr:' || event_id")}))*sin(2*pi()*{UNIT.format("'5na:' || event_id")})/3 as dy from events),
  place as (select draw, sx + dx/greatest(sqrt(dx*dx + dy*dy), 1)*40 as x, sy + dy/greatest(sqrt(dx*dx + dy*dy), 1)*40 as y
    from draw join pick on pick.rk = draw.rk)"""


def _seeds(inputs):
    return inputs("customer").select(
        F.col("c_custkey").alias("seed_id"), (F.col("c_acctbal") * 10).alias("x"), (F.col("c_custkey") * 1.5).alias("y")
    )


@query("seeded_locations", ctes=LOCATIONS, sql="select draw, round(x, 3) as x, round(y, 3) as y from place")
def seeded_locations_query(inputs):
    n = inputs("events").count()
    out = seeded_locations(_seeds(inputs), n, 40.0, 5)
    return out.select("draw", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


SAMPLE_LOCATIONS = LOCATIONS.replace("c_acctbal*10 as sx, c_custkey*1.5::double as sy", "50.0::double as sx, c_custkey*1.0::double as sy")


@query(
    "sample_tiles",
    ctes=SAMPLE_LOCATIONS + """,
  seen as (select r.surface_id, min(draw) as draw, any_value(r.h50) as h50 from place p join v_roofs r on
    ((r.diamond = 0 and p.x >= r.xmin and p.x < r.xmax and p.y >= r.ymin and p.y < r.ymax)
      or (r.diamond = 1 and abs(p.x - (r.xmin + r.xmax)/2)/((r.xmax - r.xmin)/2) + abs(p.y - (r.ymin + r.ymax)/2)/((r.ymax - r.ymin)/2) < 1))
    where case diamond when 1 then 0.5::double else 1.0::double end * (r.xmax - r.xmin)*(r.ymax - r.ymin) <= 90.5
      and r.surface_id not in (select surface_id from v_roofs where h50 < 0)
    group by r.surface_id),
  summed as (select surface_id as tile_id, draw, cast(floor(h50) as bigint) as n,
    sum(cast(floor(h50) as bigint)) over (order by draw, surface_id rows unbounded preceding) as upto from seen)""",
    sql="select tile_id, draw, cast(least(n, 300 - (upto - n)) as bigint) as take from summed where upto - n < 300",
)
def sample_tiles_query(inputs):
    surfaces = roofs(inputs).select(F.col("surface_id").alias("tile_id"), "ring", "h50")
    seeds = _seeds(inputs).select("seed_id", F.lit(50.0).alias("x"), F.col("seed_id").cast("double").alias("y"))
    n = inputs("events").count()
    chips = surfaces.select("tile_id", F.floor("h50").alias("n"))
    return sample_tiles(seeds, surfaces.where("h50 >= 0"), lambda tiles: chips, 300, 8.0, n, 40.0, 5, 90.5)


def _terms(terms, u, v):
    return " + ".join(f"{value}::double*power({u}, {p})*power({v}, {q})" for p, q, value in terms)


@query(
    "transform_crs",
    ctes=f"""
  rd as (select c_custkey, (c_acctbal*10 + {crs.X0} - {crs.X0})*1e-5 as u, (c_custkey*10 + {crs.Y0} - {crs.Y0})*1e-5 as v from customer),
  geo as (select c_custkey, ({_terms(crs.TO_LON, 'u', 'v')})/3600 + {crs.LON0}::double as lon,
    ({_terms(crs.TO_LAT, 'u', 'v')})/3600 + {crs.LAT0}::double as lat from rd),
  back as (select *, 0.36*(lat - {crs.LAT0}::double) as a, 0.36*(lon - {crs.LON0}::double) as b from geo)""",
    sql=f"""
    select c_custkey, round(lon, 8) as lon, round(lat, 8) as lat, round({_terms(crs.TO_X, 'a', 'b')} + {crs.X0}, 4) as x,
      round({_terms(crs.TO_Y, 'a', 'b')} + {crs.Y0}, 4) as y from back""",
)
def transform_crs(inputs):
    start = inputs("customer").select(
        "c_custkey", (F.col("c_acctbal") * 10 + crs.X0).alias("x"), (F.col("c_custkey") * 10 + crs.Y0).alias("y")
    )
    lon, lat = crs.rd_to_lonlat(F.col("x"), F.col("y"))
    geo = start.select("c_custkey", lon.alias("lon"), lat.alias("lat"))
    x, y = crs.lonlat_to_rd(F.col("lon"), F.col("lat"))
    return geo.select(
        "c_custkey", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"), F.round(x, 4).alias("x"), F.round(y, 4).alias("y")
    )


# Whole vectors as three and as seven bands: each is the sum of every third or seventh component.
SCALED = f"""
  band as (select vec_id, {FOLD.format(1, 3)} as r, {FOLD.format(2, 3)} as g, {FOLD.format(3, 3)} as b from embeddings),
  lim as (select min(r) as r0, max(r) as r1, min(g) as g0, max(g) as g1, min(b) as b0, max(b) as b1 from band),
  rgb as (select vec_id, (r - r0)/(r1 - r0 + 1e-12) as r, (g - g0)/(g1 - g0 + 1e-12) as g, (b - b0)/(b1 - b0 + 1e-12) as b from band, lim)"""


def _scaled(inputs):
    rgb = inputs("embeddings").select("vec_id", folded("embedding", 3).alias("embedding"))
    bands = vector_to_bands(rgb, "embedding", RGB_NAMES)
    return minmax_scale(bands, band_ranges(bands, RGB_NAMES), RGB_NAMES)


@query(
    "band_ranges",
    sql="\n    union all ".join(
        f"select '{b}' as band, round(min({FOLD.format(i, 7)}), 6) as mn, round(max({FOLD.format(i, 7)}), 6) as mx from embeddings"
        for i, b in enumerate(["red", "green", "blue", "reflectance", "slope", "ndrm", "density"], start=1)
    ),
)
def band_ranges_query(inputs):
    ranges = band_ranges(vector_to_bands(inputs("embeddings").select(folded("embedding", 7).alias("embedding")), "embedding"))
    return ranges.select("band", F.round("mn", 6).alias("mn"), F.round("mx", 6).alias("mx"))


@query("minmax_scale", ctes=SCALED, sql="select vec_id, round(r, 6) as red, round(g, 6) as green, round(b, 6) as blue from rgb")
def minmax_scale_query(inputs):
    return select_bands(_scaled(inputs), "rgb", keys=["vec_id"]).withColumns({b: F.round(b, 6) for b in RGB_NAMES})


@query("tgi", ctes=SCALED, sql="select vec_id, round(0.5*(g - 0.39*r - 0.61*b + 1), 6) as tgi from rgb")
def tgi_query(inputs):
    return append_tgi(_scaled(inputs)).select("vec_id", F.round("tgi", 6).alias("tgi"))


@query(
    "hsv",
    ctes=SCALED + """,
  hs as (select *, greatest(r, g, b) as v, greatest(r, g, b) - least(r, g, b) as d from rgb),
  hue as (select *, (case when d = 0 then 0 when v = r then (g - b)/d when v = g then 2 + (b - r)/d else 4 + (r - g)/d end)/6 as h from hs)""",
    sql="select vec_id, round(h - floor(h), 6) as hue, round(d/(v + 1e-8), 6) as saturation, round(v, 6) as value from hue",
)
def hsv_query(inputs):
    return append_hsv(_scaled(inputs)).select("vec_id", *[F.round(c, 6).alias(c) for c in ("hue", "saturation", "value")])


LINEAR = "case when {0} > 0.04045 then power(({0} + 0.055)/1.055, 2.4) else {0}/12.92 end"
CURVE = "case when {0} > 0.008856 then cbrt({0}) else 7.787*{0} + 4.0/29.0 end"


@query(
    "lab",
    ctes=SCALED + f""",
  lin as (select vec_id, {LINEAR.format('r')} as r, {LINEAR.format('g')} as g, {LINEAR.format('b')} as b from rgb),
  xyz as (select vec_id, (0.412453*r + 0.357580*g + 0.180423*b)/0.95047 as x, 0.212671*r + 0.715160*g + 0.072169*b as y,
    (0.019334*r + 0.119193*g + 0.950227*b)/1.08883 as z from lin),
  fs as (select vec_id, {CURVE.format('x')} as fx, {CURVE.format('y')} as fy, {CURVE.format('z')} as fz from xyz)""",
    sql="""
    select vec_id, round((116*fy - 16)/100, 6) as lab_l, round((500*(fx - fy) + 128)/255, 6) as lab_a,
      round((200*(fy - fz) + 128)/255, 6) as lab_b from fs""",
)
def lab_query(inputs):
    return append_lab(_scaled(inputs)).select("vec_id", *[F.round(c, 6).alias(c) for c in ("lab_l", "lab_a", "lab_b")])


CLASS_CELLS = f"{STRIP_CELLS}, label as (select *, cast((row_no*7 + col_no*3) % 4 as int) as class_id from cell)"
ZONES = f"""
  zone as (select c.tile_id, c.row_no, c.col_no, c.class_id, max(r.surface_id) as zone
    from label c left join v_roofs r on r.tile_id = c.tile_id and {CELL_HOLDS} group by 1, 2, 3, 4)"""


@query(
    "zonal_majority",
    ctes=f"""{CLASS_CELLS}, {ZONES},
  win as (select tile_id, zone, class_id as winner, row_number() over (partition by tile_id, zone order by count(*) desc, class_id) as k
    from zone where zone is not null and class_id <> 0 group by 1, 2, 3)""",
    sql="""
    select z.tile_id, row_no, col_no, case when class_id <> 0 then coalesce(winner, class_id) else 0 end as class_id
    from zone z left join win w on w.tile_id = z.tile_id and w.zone = z.zone and k = 1""",
)
def zonal_majority_query(inputs):
    grids = inputs("v_grids")
    cells = empty_cells(with_shape(grids)).withColumn("class_id", ((F.col("row_no") * 7 + F.col("col_no") * 3) % 4).cast("int"))
    return zonal_majority(cells, roofs(inputs), grids)


@query(
    "block_majority",
    ctes="""
  label as (select tile_id, row_no, col_no, cast(floor(v) % 5 as int) as class_id, cast(floor(row_no/5)*100 + floor(col_no/5) as bigint) as zone from v_cells),
  win as (select tile_id, zone, class_id as winner, row_number() over (partition by tile_id, zone order by count(*) desc, class_id) as k
    from label group by 1, 2, 3)""",
    sql="select l.tile_id, row_no, col_no, winner as class_id from label l join win w on w.tile_id = l.tile_id and w.zone = l.zone and k = 1",
)
def block_majority(inputs):
    cells = inputs("v_cells").select("tile_id", "row_no", "col_no", (F.floor("v") % 5).cast("int").alias("class_id"))
    zone = (F.floor(F.col("row_no") / 5) * 100 + F.floor(F.col("col_no") / 5)).cast("bigint")
    return majority_of_zones(cells, cells.withColumn("zone", zone), keep_background=False)


def window_model(window):
    """A small scorer that looks at its whole window: how far a cell is above the window's mean."""
    above = window["v"] - window["v"].mean()
    share = 1.0 / (1.0 + (above / 500.0) ** 2)
    return [[s, (1.0 - s) * 0.25, (1.0 - s) * 0.75] for s in share]


@query(
    "window_scores",
    ctes="""
  origin as (select s.*, unnest(range(cast(greatest(ceil((n_rows - 8)/4.0), 0) + 1 as int))) as wr from v_shapes s),
  win as (select *, unnest(range(cast(greatest(ceil((n_cols - 8)/4.0), 0) + 1 as int))) as wc from origin),
  member as (select c.tile_id, wr, wc, c.row_no, c.col_no, v, avg(v) over (partition by c.tile_id, wr, wc) as m
    from v_cells c join win w on w.tile_id = c.tile_id and c.row_no >= 4*wr and c.row_no < 4*wr + 8 and c.col_no >= 4*wc and c.col_no < 4*wc + 8),
  prob as (select tile_id, row_no, col_no, avg(1/(1 + power((v - m)/500, 2))) as s from member group by 1, 2, 3)""",
    sql="""
    select tile_id, row_no, col_no, round(s, 6) as p0, round((1 - s)*0.25, 6) as p1, round((1 - s)*0.75, 6) as p2,
      cast(case when s >= (1 - s)*0.75 then 0 else 2 end as int) as class_id from prob""",
)
def window_scores(inputs):
    windows = tile_windows(inputs("v_cells").select("tile_id", "row_no", "col_no", "v"), inputs("v_shapes"), 8, 4)
    blended = blend_windows(score_windows(windows, window_model, ["v"]), 3)
    return blended.select(
        "tile_id", "row_no", "col_no", *[F.round(F.col("probs")[c], 6).alias(f"p{c}") for c in range(3)],
        argmax(F.col("probs")).alias("class_id"),
    )
