"""Queries on catalogue and point clouds."""

import math

from pyspark.sql import functions as F

from ..functions.geometry import box_ring, vertex
from ..functions.naming import base_name, resolve_tile_id
from ..functions.numeric import db_to_linear
from ..operators.catalog import check_tile_ids, exclude_seen, fetch_plan, verify_checksums
from ..operators.neighbors import knn_join, radius_count, radius_join
from ..operators.points import bounds, crop_points, dedupe_points, global_density, grid_idw, merge_points, point_density, scale_coords
from ..operators.raster import slope
from .registry import query

URL_NAME = "regexp_replace(url, '^.*/', '')"


@query(
    "tile_id_check",
    ctes="known as (select distinct tile_id as known_id from v_ids where s_acctbal > 0)",
    sql="""
    select s_suppkey, tile_id,
      case when length(marks) = 0 or length(replace(marks, left(marks, 1), '')) > 0 then 'inconsistent delimiters'
        when left(marks, 1) <> '-' then 'not delimited by dashes'
        when not regexp_full_match(tile_id, '\\d{1,2}-\\d{3,4}-\\d{2,4}') then 'malformed'
        when known_id is null then 'not in index' end as reason,
      nullif(regexp_extract('/data/' || tile_id || '.stack.tif', '\\d{1,2}-\\d{3,4}-\\d{2,4}'), '') as resolved
    from (select *, regexp_replace(tile_id, '[0-9]', '', 'g') as marks from v_ids) i
    left join known on tile_id = known_id""",
)
def tile_id_check(inputs):
    ids = inputs("v_ids")
    checked = check_tile_ids(ids, ids.where("s_acctbal > 0"))
    path = F.concat(F.lit("/data/"), F.col("tile_id"), F.lit(".stack.tif"))
    return checked.select("s_suppkey", "tile_id", "reason", resolve_tile_id(path).alias("resolved"))


@query(
    "fetch_plan",
    sql=f"""
    select cast((page_id - page_id % 10)/10 as bigint) as tid,
      case when page_id % 2 = 0 then 'image' else 'lidar' end as kind, url, {URL_NAME} as name
    from pages where {URL_NAME} not in (select {URL_NAME} from pages where url like '%utm_source%')""",
)
def fetch_plan_query(inputs):
    pages = inputs("pages")
    of = lambda even: F.collect_list(F.when((F.col("page_id") % 2 == 0) == even, F.col("url")))
    manifests = pages.groupBy(F.floor(F.col("page_id") / 10).alias("tid")).agg(
        F.struct(of(True).alias("url")).alias("image"), F.struct(of(False).alias("url")).alias("lidar")
    )
    present = pages.where("url like '%utm_source%'").select(base_name(F.col("url")).alias("name"))
    return fetch_plan(manifests, present)


@query(
    "checksum_report",
    sql="""
    select url as name,
      case when url like '%/en/%' then 'missing'
        when sha256(html) <> sha256(html || case when url like '%utm_source%' then 'x' else '' end) then 'mismatch'
        else 'ok' end as status
    from pages""",
)
def checksum_report(inputs):
    pages = inputs("pages")
    files = pages.where("url is null or url not like '%/en/%'").select(
        F.col("url").alias("name"), F.col("html").cast("binary").alias("content")
    )
    suffix = F.when(F.col("url").like("%utm_source%"), "x").otherwise("")
    expected = pages.select(F.col("url").alias("name"), F.sha2(F.concat("html", suffix), 256).alias("sha256"))
    return verify_checksums(files, expected)


@query(
    "points_crop",
    sql="select idx, tile_id, xi, yi, zi from v_points where xi >= 20 and xi <= 90 and yi >= 10 and yi <= 80",
)
def points_crop(inputs):
    return crop_points(inputs("v_points"), [2.05, 1.05, 9.04, 8.04], 0.1).select("idx", "tile_id", "xi", "yi", "zi")


@query(
    "points_bounds",
    sql="select tile_id, min(x) as xmin, min(y) as ymin, max(x) as xmax, max(y) as ymax from v_points group by tile_id",
)
def points_bounds(inputs):
    return bounds(inputs("v_points"), ["tile_id"])


@query(
    "points_merge",
    sql="""
    select idx, xi, yi, zi from (
      select *, row_number() over (partition by xi, yi order by zi desc, idx desc) as rn from (
        select idx, xi, yi, zi from v_points where xi between 0 and 100 and yi between 0 and 90
        union all
        select idx + 10000000, xi*2 - 100, yi*2 - 100, zi*2 - 100 from v_strip
        where xi between 50 and 100 and yi between 50 and 95) u) r
    where rn = 1""",
)
def points_merge(inputs):
    # The second cloud counts in steps of 0.2 m from -10 m.
    other = inputs("v_strip").withColumn("idx", F.col("idx") + 10_000_000)
    clouds = [(inputs("v_points").select("idx", "xi", "yi", "zi"), 0.1, 0.0), (other.select("idx", "xi", "yi", "zi"), 0.2, -10.0)]
    return merge_points(clouds, crop=[0.0, 0.0, 10.04, 9.04], dedupe=True)


@query(
    "points_dedupe",
    sql="""
    select idx, xi, yi, zi, z from (
      select *, row_number() over (partition by xi, yi order by zi desc, idx desc) as rn from v_points) r
    where rn = 1""",
)
def points_dedupe(inputs):
    return dedupe_points(inputs("v_points")).select("idx", "xi", "yi", "zi", "z")


GRID_CELLS = """
  shape as (select *, cast(ceil((xmax - xmin)/res) as int) as n_cols, cast(ceil((ymax - ymin)/res) as int) as n_rows from grid),
  rws as (select *, unnest(range(n_rows)) as row_no from shape),
  cell as (select tile_id, cast(row_no as int) as row_no, cast(col_no as int) as col_no, res,
      xmin + (col_no + 0.5::double)*res as cx, ymax - (row_no + 0.5::double)*res as cy
    from (select *, unnest(range(n_cols)) as col_no from rws) c)"""


@query(
    "point_density",
    ctes=f"""
  grid as (select tile_id, min(x) as xmin, min(y) as ymin, max(x) as xmax, max(y) as ymax, 1::double as res
    from v_points group by tile_id), {GRID_CELLS}""",
    sql="""
    select c.tile_id, c.row_no, c.col_no, count(p.idx) as density
    from cell c left join v_points p
      on p.tile_id = c.tile_id and abs(p.x - cx) <= res/2 and abs(p.y - cy) <= res/2
    group by 1, 2, 3""",
)
def point_density_query(inputs):
    points = inputs("v_points").select("tile_id", "x", "y")
    grids = bounds(points, ["tile_id"]).withColumn("res", F.lit(1.0))
    return point_density(points, grids)


@query(
    "global_density",
    sql="""
    select g.tile_id, round(count(p.idx) / (101.0::double * 150.0::double), 6) as density
    from v_grids g left join v_cloud p on p.tile_id = g.tile_id group by 1""",
)
def global_density_query(inputs):
    return global_density(inputs("v_cloud"), inputs("v_grids")).select("tile_id", F.round("density", 6).alias("density"))


IDW = f"""
  grid as (select * from v_grids), {GRID_CELLS},
  pair as (select c.tile_id, c.row_no, c.col_no, p.idx, p.z, p.reflectance, sqrt((p.x - cx)*(p.x - cx) + (p.y - cy)*(p.y - cy)) as d
    from cell c left join v_cloud p
      on p.tile_id = c.tile_id and abs(p.x - cx) <= res/2 and abs(p.y - cy) <= res/2),
  idw as (select tile_id, row_no, col_no,
      case when min(d) = 0 then arg_min(z, idx) filter (where d = 0)
        else sum(z/(d*d)) filter (where d > 0) / sum(1/(d*d)) filter (where d > 0) end as z,
      case when min(d) = 0 then arg_min(reflectance, idx) filter (where d = 0)
        else sum(reflectance/(d*d)) filter (where d > 0) / sum(1/(d*d)) filter (where d > 0) end as reflectance
    from pair group by 1, 2, 3)"""


@query(
    "grid_idw",
    ctes=IDW,
    sql="select tile_id, row_no, col_no, round(z, 4) as z, round(reflectance, 4) as reflectance from idw",
)
def grid_idw_query(inputs):
    out = grid_idw(inputs("v_cloud"), inputs("v_grids"), ["z", "reflectance"])
    return out.select("tile_id", "row_no", "col_no", F.round("z", 4).alias("z"), F.round("reflectance", 4).alias("reflectance"))


def terrain(inputs, block: int = 512):
    """De-duplicated points to elevation, density and slope per cell: one pass over the points, one
    exchange of borders, no join back."""
    points = dedupe_points(inputs("v_cloud"), ["tile_id"])
    gridded = grid_idw(points, inputs("v_grids"), ["z"], count="density")
    return slope(gridded, "z", 5.0, block=block, keep=["z", "density"])


@query(
    "terrain",
    ctes=IDW.replace("left join v_cloud p", "left join clean p").replace(
        "grid as (select * from v_grids)",
        """clean as (select * from (select *, row_number() over (partition by tile_id, xi, yi order by zi desc, idx desc) as rn
    from v_cloud) r where rn = 1),
  grid as (select * from v_grids)""",
    ),
    sql="""
    select i.tile_id, i.row_no, i.col_no, round(i.z, 4) as z, n.density,
      round(degrees(atan(sqrt(
        power(case when u.row_no is not null and d.row_no is not null then (d.z - u.z)/10 when d.row_no is not null then (d.z - i.z)/5 else (i.z - u.z)/5 end, 2)
        + power(case when l.col_no is not null and r.col_no is not null then (r.z - l.z)/10 when r.col_no is not null then (r.z - i.z)/5 else (i.z - l.z)/5 end, 2)))
        + 0 * i.z), 4) as slope
    from idw i
    join (select tile_id, row_no, col_no, count(idx) as density from pair group by 1, 2, 3) n
      on n.tile_id = i.tile_id and n.row_no = i.row_no and n.col_no = i.col_no
    left join idw u on u.tile_id = i.tile_id and u.row_no = i.row_no - 1 and u.col_no = i.col_no
    left join idw d on d.tile_id = i.tile_id and d.row_no = i.row_no + 1 and d.col_no = i.col_no
    left join idw l on l.tile_id = i.tile_id and l.row_no = i.row_no and l.col_no = i.col_no - 1
    left join idw r on r.tile_id = i.tile_id and r.row_no = i.row_no and r.col_no = i.col_no + 1""",
)
def terrain_query(inputs):
    return terrain(inputs).select(
        "tile_id", "row_no", "col_no", F.round("z", 4).alias("z"), "density", F.round("slope", 4).alias("slope")
    )


@query(
    "reflectance_linear",
    sql="select idx, round(case when refl_db is null then null else least(power(10, 0.1::double*refl_db), 1) end, 6) as reflectance from v_points",
)
def reflectance_linear(inputs):
    return inputs("v_points").select("idx", F.round(db_to_linear(F.col("refl_db")), 6).alias("reflectance"))


def _centers(inputs):
    return inputs("v_roofs").select(
        F.col("surface_id").alias("query_id"),
        ((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y"),
    )


CENTERS = "center as (select surface_id as query_id, (xmin + xmax)/2 as x, (ymin + ymax)/2 as y from v_roofs)"


@query(
    "radius_join",
    ctes=CENTERS,
    sql="""
    select query_id, idx, round(sqrt((p.x - c.x)*(p.x - c.x) + (p.y - c.y)*(p.y - c.y)), 4) as distance
    from center c join v_cloud p on abs(p.x - c.x) <= 6.1 and abs(p.y - c.y) <= 6.1""",
)
def radius_join_query(inputs):
    hits = radius_join(_centers(inputs), inputs("v_cloud"), 6.1, math.inf)
    return hits.select("query_id", "idx", F.round("distance", 4).alias("distance"))


@query(
    "radius_count",
    ctes=CENTERS,
    sql="""
    select query_id, count(idx) as n
    from center c left join v_cloud p on abs(p.x - c.x) <= 6.1 and abs(p.y - c.y) <= 6.1
      and sqrt((p.x - c.x)*(p.x - c.x) + (p.y - c.y)*(p.y - c.y)) <= 6.1
    group by query_id""",
)
def radius_count_query(inputs):
    return radius_count(_centers(inputs), inputs("v_cloud"), 6.1, 2)


@query(
    "scale_coords",
    sql="select idx, round(xi*0.1::double + 7, 6) as x, round(yi*0.1::double + 7, 6) as y, round(zi*0.1::double + 7, 6) as z from v_points",
)
def scale_coords_query(inputs):
    out = scale_coords(inputs("v_points").select("idx", "xi", "yi", "zi"), 0.1, 7.0)
    return out.select("idx", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(
    "knn_join",
    ctes=CENTERS,
    sql="""
    select query_id, idx, round(distance, 4) as distance, cast(rank as int) as rank from (
      select query_id, idx, distance, row_number() over (partition by query_id order by distance, idx) as rank from (
        select query_id, idx, sqrt((p.x - c.x)*(p.x - c.x) + (p.y - c.y)*(p.y - c.y)) as distance from center c cross join v_cloud p) d) r
    where rank <= 3""",
)
def knn_join_query(inputs):
    nearest = knn_join(_centers(inputs), inputs("v_cloud"), 3, cell=4.0)
    return nearest.select("query_id", "idx", F.round("distance", 4).alias("distance"), "rank")


@query("exclude_seen", sql="select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
def exclude_seen_query(inputs):
    done = inputs("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return exclude_seen(inputs("customer"), done, "c_custkey").select("c_custkey", "c_name")


def roofs(inputs):
    """Surfaces with rings: boxes, and diamonds through the middles of the sides."""
    mx, my = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    diamond = F.array(*[vertex(x, y) for x, y in [
        (F.col("xmin"), my), (mx, F.col("ymin")), (F.col("xmax"), my), (mx, F.col("ymax")), (F.col("xmin"), my)]])
    box = box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    ring = F.when(F.col("diamond") == 1, diamond).otherwise(box)
    return inputs("v_roofs").select("tile_id", "surface_id", "building_id", "h50", ring.alias("ring"))
