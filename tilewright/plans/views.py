"""Input views: the given tables seen as points, cells, surfaces, masks and scored pixels.

Each text is plain SQL that Spark and other engines read alike. All views grow with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    # Sources on one 12 x 10 m place: many copies of positions.
    "v_points": """
        select event_id as idx, event_type as tile_id,
          cast((event_id*7919) % 401 % 120 as bigint) as xi,
          cast((event_id*event_id*31 + event_id*17) % 397 % 100 as bigint) as yi,
          cast(round(value*100) as bigint) as zi,
          cast((event_id*7919) % 401 % 120 as double)*0.1 as x,
          cast((event_id*event_id*31 + event_id*17) % 397 % 100 as double)*0.1 as y,
          value as z, -value/50.0 as refl_db
        from events""",
    # A strip 101 m wide whose length grows with the table, cut into tiles of 150 m.
    "v_strip": """
        select event_id as idx, cast((event_id*7919) % 1009 as bigint) as xi,
          cast((event_id*3 - (event_id*3) % 2)/2 as bigint) as yi, cast(round(value*100) as bigint) as zi,
          value as z, -value/50.0 as reflectance
        from events""",
    "v_cloud": """
        select idx, cast((yi - yi % 1500)/1500 as int) as tile_no,
          concat('9-', cast(100 + cast((yi - yi % 1500)/1500 as int) as string), '-10') as tile_id,
          xi, yi, zi, cast(xi as double)*0.1 as x, cast(yi as double)*0.1 as y, z, reflectance
        from v_strip""",
    "v_grids": """
        select tile_id, cast(0 as double) as xmin, cast(tile_no*150 as double) as ymin,
          cast(101 as double) as xmax, cast(tile_no*150 + 150 as double) as ymax, cast(5 as double) as res
        from (select distinct tile_id, tile_no from v_cloud) t""",
    # Roof surfaces on the same strip, boxes and diamonds, some overlapping.
    "v_roofs": """
        select concat('9-', cast(100 + cast((c_custkey - c_custkey % 150)/150 as int) as string), '-10') as tile_id,
          c_custkey as surface_id, cast((c_custkey - c_custkey % 3)/3 as bigint) as building_id,
          c_acctbal/1000 as h50, cast(c_custkey % 2 as int) as diamond,
          cast((c_custkey % 10)*10 as double) + cast(0.63 as double) as xmin,
          cast((c_custkey - c_custkey % 10) as double) + cast(0.87 as double) as ymin,
          cast((c_custkey % 10)*10 + 4 + (c_custkey*37) % 9 as double) + cast(0.63 as double) as xmax,
          cast((c_custkey - c_custkey % 10) + 4 + (c_custkey*53) % 9 as double) + cast(0.87 as double) as ymax
        from customer""",
    "v_cells": """
        select cast(p_partkey % 4 as int) as tile_id,
          cast((cast((p_partkey - p_partkey % 4) as bigint)/4
              - (cast((p_partkey - p_partkey % 4) as bigint)/4) % 10)/10 as int) as row_no,
          cast((cast((p_partkey - p_partkey % 4) as bigint)/4) % 10 as int) as col_no,
          p_retailprice + p_size as v,
          case when p_size % 7 = 0 then null else p_retailprice end as v_null
        from part""",
    "v_shapes": """
        select tile_id, cast(max(row_no) + 1 as int) as n_rows, cast(max(col_no) + 1 as int) as n_cols
        from v_cells group by tile_id""",
    # Overlapping image sheets, and point sheets with a border of 20 m.
    "v_sheets": """
        select kind, concat(kind, '-', tile_id, '-', cast(part as string)) as tid,
          concat('https://example.org/', kind, '/', tile_id, '-', cast(part as string), '.bin') as url,
          xmin, ymin - pad as ymin, xmax, ymax + pad as ymax
        from (
          select 'image' as kind, tile_id, 0 as part, cast(0 as double) as xmin, cast(41 as double) as xmax, ymin, ymax, cast(0 as double) as pad from v_grids
          union all select 'image', tile_id, 1, cast(40 as double), cast(81 as double), ymin, ymax, cast(0 as double) from v_grids
          union all select 'image', tile_id, 2, cast(80 as double), cast(121 as double), ymin, ymax, cast(0 as double) from v_grids
          union all select 'lidar', tile_id, 0, cast(0 as double), cast(60 as double), ymin, ymax, cast(20 as double) from v_grids
          union all select 'lidar', tile_id, 1, cast(60 as double), cast(120 as double), ymin, ymax, cast(20 as double) from v_grids
        ) s""",
    "v_mask": """
        select cast(user_id % 20 as int) as image, event_id as pixel,
          case event_type when 'error' then 0 when 'click' then 1 when 'purchase' then 2 when 'signup' then 4 else 7 end as class_id
        from events""",
    "v_user_mask": """
        select user_id as image,
          case event_type when 'error' then 0 when 'click' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as class_id
        from events""",
    "v_scored": """
        select case l_returnflag when 'A' then 'tra' when 'N' then 'val' else 'tst' end as stage,
          cast(l_linenumber % 5 as int) as truth,
          cast((l_linenumber + case when l_quantity > 30 then 1 else 0 end) % 5 as int) as pred
        from lineitem""",
    "v_runs": """
        select p_partkey as run_no, p_brand as param_a, p_size as param_b,
          case when p_type in ('PROMO','SMALL') then 'FAIL' else 'COMPLETE' end as state, p_retailprice as objective
        from part""",
    "v_ids": """
        select s_suppkey, s_acctbal,
          case when s_suppkey % 11 = 3
            then concat(cast(s_suppkey % 12 as string), '/', cast(100 + s_suppkey as string), '/', cast(10 + s_nationkey as string))
            when s_suppkey % 13 = 5
            then concat(cast(s_suppkey % 12 as string), '-', cast(10000 + s_suppkey as string), '-', cast(10 + s_nationkey as string))
            else concat(cast(s_suppkey % 12 as string), case when s_suppkey % 7 = 0 then '/' else '-' end,
              cast(100 + s_suppkey as string), '-', cast(10 + s_nationkey as string))
          end as tile_id
        from supplier""",
}


# The sum of every n-th component of a vector, from the given one on (counted from 1): whole vectors become n numbers.
FOLD = "list_reduce(list_transform(range({0}, len(embedding) + 1, {1}), lambda k: embedding[k]::double), lambda a, x: a + x)"


def folded(vector: str, n: int) -> Column:
    """All components of a vector as ``n`` sums: the sum of every n-th, from each of the first n on."""
    part = lambda c: F.filter(F.col(vector), lambda v, k: k % n == c)
    return F.array(*[F.aggregate(part(c), F.lit(0.0), lambda a, v: a + v.cast("double")) for c in range(n)])


def with_clause(text: str) -> str:
    """The ``with`` clause that defines every view a query text needs, in order."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                visit(VIEWS[name])
                needed.append(name)

    visit(text)
    return ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in needed)


class Inputs:
    """Given tables and views of one scale folder: ``inputs("v_points")``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        views = with_clause(name)
        tables = [
            f"{t} as (select * from parquet.`{self.folder}/{t}.parquet`)" for t in TABLES if re.search(rf"\bfrom {t}\b", views)
        ]
        return self.spark.sql(f"with {', '.join([*tables, views])} select * from {name}")
