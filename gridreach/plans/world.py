"""A synthetic city derived from the given tables; it grows with them.

The plane is a strip 20 km wide.  Every 2,000 parts (100 suppliers, 15,000
orders, 10,000 events) add another 20 km of strip, so density stays constant
while the city grows.  Each view is one SQL text that both engines run.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, tuple[str, str]] = {
    # name: (views it needs, SQL)
    "town": ("", "select distinct cast(floor(p_partkey/2000) as bigint) as town from part"),
    "grid": (
        "town",
        """select (t.town*40+j.v)*40+i.v as grid_id, cast(i.v as bigint) as ix, cast(t.town*40+j.v as bigint) as iy,
        cast(floor((t.town*40+j.v)/8)*5+floor(i.v/8) as bigint) as district,
        500e0*i.v as x0, 500e0*(t.town*40+j.v) as y0,
        case when i.v>=38 then 150000e0 else 250000e0 end as land_area_m2
        from town t, (select unnest(range(0,40)) as v) i, (select unnest(range(0,40)) as v) j""",
    ),
    "poi": (
        "",
        """select p_partkey as poi_id, p_size, p_retailprice,
        floor(((p_partkey*7919)%20000)*((p_partkey*7919)%20000)/20000)+0.25e0 as x,
        (p_partkey*104729)%20000+0.25e0+20000e0*floor(p_partkey/2000) as y,
        case when p_partkey%3=0 then 'way' else 'node' end as element,
        case p_partkey%13 when 0 then 'hospital' when 1 then 'university' when 2 then 'school' when 3 then 'clinic'
          when 4 then 'cafe' when 5 then 'fast_food' when 6 then 'pub' when 7 then 'marketplace' when 8 then 'bank' when 9 then 'library' end as amenity,
        case when p_partkey%13>=9 and p_partkey%5=0 then 'supermarket' when p_partkey%13>=9 and p_partkey%5=1 then 'hairdresser'
          when p_partkey%13>=9 and p_partkey%5=2 then 'clothes' end as shop,
        case when p_partkey%17=0 then 'yes' when p_partkey%17=1 then 'hospital' end as healthcare,
        case when p_partkey%19=0 then 'company' end as office,
        case when p_partkey%23=0 then 'hotel' end as tourism,
        case p_partkey%7 when 0 then 'park' when 1 then 'pitch' when 2 then 'garden' end as leisure
        from part""",
    ),
    "poi_cell": (
        "poi",
        "select *, cast(floor(y/500)*40+floor(x/500) as bigint) as grid_id, poi_id%8 as cat from poi",
    ),
    "stop": (
        "",
        """select s_suppkey as stop_id, s_name as stop_name, (s_suppkey*6151)%20000+0.5e0 as x,
        (s_suppkey*3571)%20000+0.5e0+20000e0*floor(s_suppkey/100) as y, s_suppkey%6 as mode,
        case s_suppkey%6 when 0 then 'bus' when 1 then 'metro' when 2 then 'tram' when 3 then 'rail' when 4 then 'ferry' else 'metrobus' end as mode_name,
        case s_suppkey%5 when 0 then '1' when 1 then '' when 2 then cast(null as varchar(1)) else '0' end as location_type
        from supplier""",
    ),
    "route": (
        "",
        """select c_custkey as route_id, c_mktsegment as agency, cast(c_nationkey%4 as varchar(2)) as route_type,
        case when c_nationkey%9=0 then concat('MetroB ', c_name) else c_name end as route_long_name from customer""",
    ),
    "gtrip": ("", "select o_orderkey as trip_id, o_custkey as route_id, o_orderpriority as service_id from orders"),
    "stop_time": (
        "",
        """select l_orderkey as trip_id, l_suppkey as stop_id,
        case when l_linenumber=7 then cast(null as varchar(8)) else concat(lpad(cast((l_orderkey*7+l_linenumber)%26 as varchar(2)),2,'0'),':00:00') end as departure_time,
        concat(lpad(cast((l_orderkey*7+l_linenumber)%26 as varchar(2)),2,'0'),':00:00') as arrival_time from lineitem""",
    ),
    "pixel": (
        "",
        """select cast(floor(o_orderkey/120) as bigint) as r, o_orderkey%120 as c,
        160e0*(o_orderkey%120) as x0, 160e0*floor(o_orderkey/120) as y0,
        cast(o_custkey%23 as double) as pop,
        case when o_orderkey%211=0 then cast(null as double) else 100+((floor(o_orderkey/120)*floor(o_orderkey/120)*3+(o_orderkey%120)*(o_orderkey%120)*2)%500)/10e0 end as elev
        from orders""",
    ),
    "node": (
        "",
        """select o_orderkey as node_id, 160e0*(o_orderkey%120)+30 as x, 160e0*floor(o_orderkey/120)+30 as y from orders""",
    ),
    "edge": (
        "",
        """select src, dst, d, 160e0+40*((src*5+d*3)%3) as length_m,
        case (src*3+d)%9 when 0 then 'primary' when 1 then 'motorway' when 2 then 'footway' when 3 then 'steps' when 4 then 'service' else 'residential' end as highway,
        case when (src*7+d*3)%23=0 then 'no' end as foot, case when (src+d)%4=0 then 'yes' else 'no' end as oneway
        from (select o_orderkey as src, o_orderkey+1 as dst, 0 as d from orders where o_orderkey%120<>119 and o_orderkey%120<>59
          union all select o_orderkey, o_orderkey+120, 1 from orders) e
        where dst <= (select max(o_orderkey) from orders) and (src*7+d*13)%11<>0""",
    ),
    "undirected": (
        "edge",
        "select src, dst, length_m from edge union all select dst, src, length_m from edge",
    ),
    "origin": (
        "grid",
        """select grid_id, district, node_id from (select grid_id, district,
        cast(floor((500*iy+250)/160)*120+least(floor((500*ix+250)/160),119) as bigint) as node_id from grid) g
        where node_id <= (select max(o_orderkey) from orders)""",
    ),
    "dest": (
        "poi_cell",
        """select poi_id as dest_id, cat, node_id, case when poi_id%29=0 then 'QUESTIONABLE' else 'OK' end as snap_status from (select poi_id, cat,
        cast(floor(y/160)*120+least(floor(x/160),119) as bigint) as node_id from poi_cell) p
        where node_id <= (select max(o_orderkey) from orders)""",
    ),
    "building": (
        "",
        """select p_partkey as b_id, (p_partkey*7919)%19900+0e0 as x0, (p_partkey*104729)%19900+20000e0*floor(p_partkey/2000) as y0,
        10e0+p_size as w, 10e0+(p_size%7)*5 as h, case p_partkey%5 when 0 then 'residential' when 1 then 'commercial' when 2 then 'retail' when 3 then 'industrial' end as landuse,
        case when p_partkey%6=0 then 'park' end as leisure, case when p_partkey%8=0 then 'wood' end as natural_kind from part""",
    ),
    "landuse": (
        "building",
        """select b_id as poly_id, x0, y0, x0+20*w as x1, y0+20*h as y1, coalesce(landuse, 'other') as kind from building""",
    ),
    "road": (
        "",
        """select l_orderkey*10+l_linenumber as seg_id, l_orderkey, l_linenumber,
        (l_orderkey*7919+l_linenumber*401)%19000+0.25e0 as x1,
        (l_orderkey*104729+l_linenumber*211)%19000+0.25e0+20000e0*floor(l_partkey/2000) as y1,
        (l_orderkey*7919+l_linenumber*401)%19000+0.25e0+l_partkey%600 as x2,
        (l_orderkey*104729+l_linenumber*211)%19000+0.25e0+20000e0*floor(l_partkey/2000)+l_suppkey%700 as y2,
        case l_linenumber when 1 then 'primary' when 2 then 'residential' when 3 then 'motorway' when 4 then 'steps' when 5 then 'cycleway' when 6 then 'footway' else 'tertiary' end as highway
        from lineitem""",
    ),
    "cycleway": (
        "road",
        "select l_orderkey as line_id, x1, y1, x2, y2 from road where highway='cycleway'",
    ),
    "trip": (
        "",
        """select event_id as trip_id, ts as start_time, user_id, event_type, value,
        (user_id*7919+event_id*37)%20000+0.5e0 as x, (user_id*104729+event_id*53)%20000+0.5e0+20000e0*floor(event_id/10000) as y from events""",
    ),
    "dirty": (
        "",
        """select s_suppkey as stop_id, case s_suppkey%4 when 0 then concat('41.01',cast(s_suppkey as varchar(10)))
        when 1 then concat('410.1',cast(s_suppkey as varchar(10)),'.564') when 2 then 'n.a.x' else concat('28.',cast(s_suppkey as varchar(10)),'.1') end as raw from supplier""",
    ),
    "district_box": (
        "grid",
        """select district, min(x0)+130 as x0, min(y0)+130 as y0, max(x0)+630 as x1, max(y0)+630 as y1 from grid group by district""",
    ),
    "features": (
        "grid poi_cell stop trip pixel",
        """select g.grid_id, g.ix, g.iy, g.district, g.land_area_m2, cast(coalesce(p.n_poi,0) as double) as n_poi,
        cast(coalesce(p.sum_size,0) as double) as sum_size, cast(coalesce(t.n_trip,0) as double) as n_trip,
        cast(coalesce(t.trip_value,0) as double) as trip_value, cast(coalesce(s.n_stop,0) as double) as n_stop,
        cast(coalesce(x.pop,0) as double) as pop, x.elev as elev, cast((g.grid_id*7919)%1009 as double) as noise
        from grid g left join (select grid_id, count(*) as n_poi, sum(p_size) as sum_size from poi_cell group by grid_id) p on g.grid_id=p.grid_id
        left join (select cast(floor(y/500)*40+floor(x/500) as bigint) as grid_id, count(*) as n_trip, sum(floor(value)) as trip_value from trip group by 1) t on g.grid_id=t.grid_id
        left join (select cast(floor(y/500)*40+floor(x/500) as bigint) as grid_id, count(*) as n_stop from stop group by 1) s on g.grid_id=s.grid_id
        left join (select cast(floor(y0/500)*40+floor(x0/500) as bigint) as grid_id, sum(pop) as pop, max(elev) as elev from pixel group by 1) x on g.grid_id=x.grid_id""",
    ),
    "cell_labels": (
        "features",
        """select grid_id, district, ix, iy, pop, n_poi, n_trip, sum_size, noise, cast(floor(ix/10) as bigint) as la,
        case when (grid_id*13)%10<8 then cast(floor(ix/10) as bigint) else (ix+iy)%5 end as lb from features""",
    ),
    "cell_scores": (
        # opportunity by residents (t1) and by places (t2), demand times missing transit, linear and square root; whole ten-thousandths
        "features",
        """select grid_id, district, floor(10000*d1*gap)/10000 as t1__lin__uf0, floor(10000*sqrt(d1)*gap)/10000 as t1__sqrt__uf0,
        floor(10000*d2*gap)/10000 as t2__lin__uf0, floor(10000*sqrt(d2)*gap)/10000 as t2__sqrt__uf0
        from (select grid_id, district, (pop+n_trip)/(pop+n_trip+50) as d1, (sum_size+n_trip)/(sum_size+n_trip+30) as d2, 1/(1+n_stop) as gap from features) f""",
    ),
    "access15": (
        "features",
        """select grid_id, district, pop, sum_size, n_trip, n_poi,
        case when (grid_id*31)%17<12 then ((grid_id*31)%170)/10e0 end as walk_food, case when (grid_id*37)%19<14 then ((grid_id*37)%190)/10e0 end as walk_healthcare,
        case when (grid_id*41)%23<17 then ((grid_id*41)%230)/10e0 end as walk_education,
        case when (grid_id*31)%17<15 then ((grid_id*31)%170)/30e0 end as cycle_food, case when (grid_id*37)%19<17 then ((grid_id*37)%190)/30e0 end as cycle_healthcare,
        case when (grid_id*41)%23<21 then ((grid_id*41)%230)/30e0 end as cycle_education,
        case when (grid_id*43)%29<20 then ((grid_id*43)%290)/10e0 end as walk_transit_a, case when (grid_id*47)%31<18 then ((grid_id*47)%310)/10e0 end as walk_transit_b,
        case when (grid_id*43)%29<25 then ((grid_id*43)%290)/30e0 end as cycle_transit_a, case when (grid_id*47)%31<25 then ((grid_id*47)%310)/30e0 end as cycle_transit_b,
        (grid_id*3)%13<>0 as everyday_reliable, (grid_id*5)%11<>0 as transit_reliable, ((grid_id*7919)%1000)/1000e0 as score from features""",
    ),
}


def _needed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in VIEWS[n][0].split():
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def oracle_prefix(names: tuple[str, ...], sql: str) -> str:
    """Put the derived views a query needs in front of its SQL as common table expressions."""
    ctes = [f"{n} as ({VIEWS[n][1]})" for n in _needed(names)]
    body = sql.strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive"):
        return "with recursive " + ", ".join(ctes) + ", " + body[len("with recursive"):]
    if body.lower().startswith("with "):
        return "with " + ", ".join(ctes) + ", " + body[5:]
    return "with " + ", ".join(ctes) + " " + body


class World:
    """Spark side of the views: `w.poi`, `w.grid`, ... and the given tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def grid(self) -> DataFrame:
        from gridreach.operators.spatial import fishnet

        tall = self.base("part").agg(((F.floor(F.max("p_partkey") / 2000) + 1) * 20000).cast("double").alias("y1"))
        bounds = tall.select(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(20000.0).alias("x1"), "y1")
        cells = fishnet(bounds, 500.0)
        return cells.select(
            (F.col("iy") * 40 + F.col("ix")).alias("grid_id"),
            "ix",
            "iy",
            (F.floor(F.col("iy") / 8) * 5 + F.floor(F.col("ix") / 8)).alias("district"),
            "x0",
            "y0",
            F.when(F.col("ix") >= 38, 150000.0).otherwise(250000.0).alias("land_area_m2"),
        )

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in self._made:
            return self._made[name]
        if name in BASE:
            df = self.base(name)
        elif name in VIEWS:
            deps, sql = VIEWS[name]
            for d in deps.split():
                getattr(self, d).createOrReplaceTempView(d)
            for b in BASE:
                if re.search(rf"\b{b}\b", sql):
                    self.base(b).createOrReplaceTempView(b)
            df = self.spark.sql(sql)
        else:
            raise AttributeError(name)
        self._made[name] = df
        return df
