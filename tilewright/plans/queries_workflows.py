"""Queries that run whole workflows."""

import uuid

from pyspark.sql import functions as F

from ..functions.geometry import box_ring
from ..operators.joins import binned_join, explode_box, put_in_bin
from ..operators.points import grid_idw
from ..operators.surfaces import match_sheets
from ..session import shared_folder
from .generator import TileData, generate_chips
from .queries_points import IDW, roofs
from .queries_rasters import BLOCKS, HOLDS, SAMPLE_LOCATIONS
from .registry import query
from .stages import clean_points

# Sheets that share area with a roof of a tile; boxes and diamonds, as the roofs are.
SHEETS_OF_TILES = """
  hit as (select distinct r.tile_id, s.xmin, s.ymin, s.xmax, s.ymax from v_roofs r join v_sheets s
    on s.kind = 'lidar' and r.xmin < s.xmax and r.xmax > s.xmin and r.ymin < s.ymax and r.ymax > s.ymin
    where r.diamond = 0
    or (case when (r.xmin + r.xmax)/2 between s.xmin and s.xmax then 0 else least(abs((r.xmin + r.xmax)/2 - s.xmin), abs((r.xmin + r.xmax)/2 - s.xmax)) end)/((r.xmax - r.xmin)/2)
     + (case when (r.ymin + r.ymax)/2 between s.ymin and s.ymax then 0 else least(abs((r.ymin + r.ymax)/2 - s.ymin), abs((r.ymin + r.ymax)/2 - s.ymax)) end)/((r.ymax - r.ymin)/2) < 1)"""

# Points of the sheets, cropped to the tile in whole decimetres, the highest of each position.
CLEAN = """
  clean as (select * from (
      select g.tile_id, p.idx, p.xi, p.yi, p.x, p.y, p.z, p.reflectance,
        row_number() over (partition by g.tile_id, p.xi, p.yi order by p.zi desc, p.idx desc) as rn
      from v_grids g join hit h on h.tile_id = g.tile_id
      join v_cloud p on p.x between h.xmin and h.xmax and p.y between h.ymin and h.ymax
        and p.xi between 0 and 1010 and p.yi between cast(g.ymin*10 as bigint) and cast(g.ymax*10 as bigint)) r where rn = 1)"""

GENERATED = ", ".join([
    SHEETS_OF_TILES, CLEAN, IDW.replace("left join v_cloud p", "left join clean p"),
    "many as (select tile_id, row_no, col_no, count(idx) as density from pair group by 1, 2, 3)",
    BLOCKS.replace("v_shapes", "shape"), SAMPLE_LOCATIONS,
    f"""
  thin as (select *, row_number() over (partition by tile_id order by brow, bcol) as k from sq
    where cast('0x' || substr(md5('7:' || brow || ':' || bcol), 1, 8) as bigint)/4294967296.0 < 0.5),
  part as (select t.tile_id, t.brow, t.bcol, t.chip_id, c.row_no, c.col_no,
      exists (select 1 from v_roofs r where r.tile_id = c.tile_id and {HOLDS.format(x="c.cx", y="c.cy")}) as inside
    from thin t join cell c on c.tile_id = t.tile_id and floor(c.row_no/4) = t.brow and floor(c.col_no/4) = t.bcol
    where k % 4 <> 0),
  good as (select tile_id, brow, bcol, row_number() over (partition by tile_id order by brow, bcol) as place from part
    group by tile_id, brow, bcol having count(*) filter (where not inside) <= count(*)*0.9),
  met as (select g.tile_id, min(draw) as draw from place p join v_grids g
    on p.x >= g.xmin and p.x < g.xmax and p.y >= g.ymin and p.y < g.ymax group by 1),
  summed as (select m.tile_id, m.draw, coalesce(n, 0) as n, sum(coalesce(n, 0)) over (order by draw, m.tile_id rows unbounded preceding) as upto
    from met m left join (select tile_id, count(*) as n from good group by 1) a on a.tile_id = m.tile_id),
  take as (select tile_id, draw, least(n, (select count(*) from events)//200 - (upto - n)) as take from summed)""",
])


def _tile_data(inputs):
    """Batches of the strip: sheets by their roofs, points of these sheets cleaned and gridded."""
    sheets, surfaces = inputs("v_sheets").where("kind = 'lidar'"), roofs(inputs)
    inside = F.col("l.x").between(F.col("r.xmin"), F.col("r.xmax")) & F.col("l.y").between(F.col("r.ymin"), F.col("r.ymax"))

    def build(tiles):
        own = surfaces.join(tiles, "tile_id", "left_semi")
        grids = inputs("v_grids").join(tiles, "tile_id", "left_semi")
        wanted = match_sheets(own, sheets, 75.0).select(F.col("tile_id").alias("to_tile"), F.explode("tid").alias("tid"))
        boxes = explode_box(sheets.join(wanted, "tid"), F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), 75.0)
        points = binned_join(put_in_bin(inputs("v_cloud"), F.col("x"), F.col("y"), 75.0), boxes, inside).select(
            F.col("r.to_tile").alias("tile_id"), *[F.col(f"l.{c}") for c in ("idx", "xi", "yi", "zi", "x", "y", "z", "reflectance")]
        )
        return TileData(grid_idw(clean_points(points, grids, 0.1), grids, ["z"], count="density"), own, grids)

    return build


@query(
    "generate_chips",
    ctes=GENERATED,
    sql="""
    select t.tile_id, t.draw, p.chip_id, p.brow, p.bcol, p.row_no, p.col_no,
      case when p.inside then coalesce(round(i.z, 4), 0) else 0 end as z, case when p.inside then m.density else 0 end as density
    from take t join good g on g.tile_id = t.tile_id and g.place <= t.take
    join part p on p.tile_id = g.tile_id and p.brow = g.brow and p.bcol = g.bcol
    join idw i on i.tile_id = p.tile_id and i.row_no = p.row_no and i.col_no = p.col_no
    join many m on m.tile_id = p.tile_id and m.row_no = p.row_no and m.col_no = p.col_no""",
)
def generate_chips_query(inputs):
    """Sample tiles, match sheets, grid, stack, cut chips, up to one chip per 200 points."""
    grids, n = inputs("v_grids"), inputs("events").count()
    tiles = grids.select("tile_id", box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")).alias("ring"))
    seeds = inputs("customer").select(F.col("c_custkey").alias("seed_id"), F.lit(50.0).alias("x"), F.col("c_custkey").cast("double").alias("y"))
    root = f"{shared_folder(inputs.spark)}/generated-{uuid.uuid4().hex}"
    cells = generate_chips(root, seeds, tiles, _tile_data(inputs), n // 200, 0.9, 75.0, ["z", "density"], 5, 4, n, 40.0, chip_seed=7)
    return cells.select("tile_id", "draw", "chip_id", "brow", "bcol", "row_no", "col_no", F.round("z", 4).alias("z"), "density")
