"""Point clouds, cameras, frames and jobs derived from the driver's tables, in SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Each view over the tables it names; integer lattices keep arithmetic exact.
SQL = {
    "points": """
select ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as pid, l_orderkey as okey,
       cast(l_partkey % 200 as int) as xi, cast(l_suppkey % 100 as int) as yi, cast(l_quantity as int) as zi,
       cast(l_partkey % 200 as double) / 10e0 as x, cast(l_suppkey % 100 as double) / 10e0 as y, l_quantity / 10e0 as z,
       cast(case when l_returnflag = 'A' then 1 else 0 end * case when l_linestatus = 'F' then 1 else -1 end as double) as nx,
       cast(case when l_returnflag = 'R' then 1 else 0 end * case when l_linestatus = 'F' then 1 else -1 end as double) as ny,
       cast(case when l_returnflag = 'N' then 1 else 0 end * case when l_linestatus = 'F' then 1 else -1 end as double) as nz,
       cast(l_orderkey * 37 % 256 as int) as red, cast(l_partkey * 11 % 256 as int) as green, cast(l_suppkey * 7 % 256 as int) as blue,
       l_linenumber as view_id, 1 - l_discount as confidence, cast(round(100 * (1 - l_discount)) as bigint) as weight, 1 + l_orderkey % 9 as support
from lineitem""",
    "palette": """
select cast(row_number() over (order by p_size) as int) as pos, p_size + 1 as palette_id,
       concat('minecraft:', replace(min(p_name), ' ', '_'), '_', cast(p_size + 1 as varchar(20))) as block_state,
       cast(p_size * 83 % 256 as int) as pr, cast(p_size * 151 % 256 as int) as pg, cast(p_size * 29 % 256 as int) as pb, max(p_partkey) % 5 / 4e0 as penalty
from part group by p_size""",
    "cameras": """
select s_suppkey as cam, s_nationkey as rig, cast(s_suppkey * 7 % 41 as double) as x, cast(s_suppkey * 3 % 17 as double) as y, cast(s_suppkey * 13 % 29 as double) as z
from supplier""",
    "frames": """
select user_id, ts, event_id, value * 10 as brightness, (event_id % 50) / 100e0 as clipped, (event_id * 7 % 100) / 100e0 as sharpness, value from events""",
    "pixels": """
select cast(event_id % 8 as int) as frame, cast(floor(event_id / 8) % 16 as int) as v, cast(floor(event_id / 128) % 16 as int) as u, cast(max(round(value * 10)) as int) as grey
from events group by 1, 2, 3""",
    "metrics": """
select event_id, user_id as job, event_type as stage, ts as started_at, cast(round(value * 1000) as bigint) as ms,
       case when event_type = 'error' then 'FAILED' else 'COMPLETED' end as status from events""",
    "pairs": """
select l_suppkey % 100 as frame, l_quantity as disparity, round(l_quantity * 3 + 7 + case when l_orderkey % 23 = 0 then 200 else l_partkey % 5 end) as depth, l_orderkey as okey from lineitem""",
    "blocks": """
select distinct cast(l_partkey % 61 - 30 as int) as x, cast(l_suppkey % 45 - 20 as int) as y, cast(l_quantity as int) - 25 as z, concat('minecraft:s', cast(max(l_orderkey % 7) as varchar(20))) as state
from lineitem group by 1, 2, 3""",
    "cells": """
select cast(l_partkey % 30 as int) as ix, cast(l_suppkey % 7 as int) as iy, cast(l_quantity as int) % 20 as iz, count(*) as n, cast(sum(l_orderkey % 5) as bigint) as s
from lineitem group by 1, 2, 3 having count(*) > (select count(*) / 4200e0 + 0.4e0 * sqrt(count(*) / 4200e0) from lineitem)""",
    # Ten frames a room, rooms side by side: frames, depths and cells grow with the tables.  Rotations are quarter turns about y.
    "poses": """
select frame, cast(floor(frame / 10) as int) as room, cast(r0 as double) as r00, 0e0 as r01, cast(-r2 as double) as r02, 0e0 as r10, 1e0 as r11, 0e0 as r12, cast(r2 as double) as r20, 0e0 as r21, cast(r0 as double) as r22,
       -(r0 * x - r2 * z) as tx, -y as ty, -(r2 * x + r0 * z) as tz, 8e0 as fx, 8e0 as fy, 8e0 as cx, 6e0 as cy, 16 as width, 12 as height
from (select s_suppkey as frame, case s_suppkey % 4 when 0 then 1 when 2 then -1 else 0 end as r0, case s_suppkey % 4 when 1 then 1 when 3 then -1 else 0 end as r2,
             floor(s_suppkey / 10) * 12 + 3e0 + (s_suppkey * 7 % 13) / 2e0 as x, 1.5e0 + (s_suppkey * 3 % 5) / 4e0 as y, 3e0 + (s_suppkey * 5 % 13) / 2e0 as z from supplier) q""",
    "depth_maps": """
select l_suppkey as frame, cast(l_orderkey % 12 as int) as v, cast(l_partkey % 16 as int) as u, max(l_quantity) / 8e0 as depth,
       max(l_orderkey * 37 % 256) as red, max(l_partkey * 11 % 256) as green, max(l_linenumber * 30) as blue from lineitem group by 1, 2, 3""",
}
#: Tables and views each view reads.
_TABLES = {"points": ["lineitem"], "palette": ["part"], "cameras": ["supplier"], "frames": ["events"], "pixels": ["events"], "metrics": ["events"], "pairs": ["lineitem"], "blocks": ["lineitem"], "cells": ["lineitem"], "poses": ["supplier"], "depth_maps": ["lineitem"]}


class Views:
    """The tables and views of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SQL:
            raise AttributeError(name)
        text = SQL[name]
        for t in _TABLES[name]:
            text = text.replace(f"from {t}", "from {" + t + "}")
        return self.spark.sql(text, **{t: self.table(t) for t in _TABLES[name]})


def with_views(*names: str) -> str:
    """The common table expressions of views, for the other engine."""
    return "with recursive " + ", ".join(f"{n} as ({SQL[n].strip()})" for n in names)
