"""Joins: keyed, spatial, radius."""

from pyspark.sql import functions as F

from gridreach.functions import scalars as s
from gridreach.operators import ordered as o
from gridreach.operators import relational as rel
from gridreach.operators import spatial as sp
from gridreach.plans.q_b_scalars import ROUTE_MODE_SQL, mode_rules
from gridreach.plans.registry import query


def cells(w, *extra):
    return w.grid.select("ix", "iy", "grid_id", *extra)


@query("c1_join_one_to_one", "features", "select grid_id, district, n_poi, pop from features")
def c1(w):
    return rel.join_one_to_one(w.grid.select("grid_id", "district"), w.features.select("grid_id", "n_poi", "pop"), "grid_id")


@query(
    "c2_star_join", "features access15 cell_labels cell_scores",
    "select f.grid_id, f.district, f.n_poi, a.walk_food, l.la, c.t1__lin__uf0 as base_score, a.everyday_reliable from features f left join access15 a using (grid_id) left join cell_labels l using (grid_id) left join cell_scores c using (grid_id)",
)
def c2(w):
    base = w.features.select("grid_id", "district", "n_poi")
    fams = [w.access15.select("grid_id", "walk_food", "everyday_reliable"), w.cell_labels.select("grid_id", "la"), w.cell_scores.select("grid_id", F.col("t1__lin__uf0").alias("base_score"))]
    return rel.star_join(base, fams, "grid_id")


@query("c3_inner_chain", "", "select n_name, count(*) as n, round(sum(o_totalprice),2) as total from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey group by 1")
def c3(w):
    j = w.orders.join(w.customer, F.col("o_custkey") == F.col("c_custkey")).join(w.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "c4_full_outer_counts", "trip poi",
    """select ix, iy, cast(sum(a) as bigint) as n_trips, cast(sum(b) as bigint) as n_pois from (select cast(floor(x/500) as bigint) as ix, cast(floor(y/500) as bigint) as iy, 1 as a, 0 as b from trip
    union all select cast(floor(x/500) as bigint), cast(floor(y/500) as bigint), 0, 1 from poi) u group by 1,2""",
)
def c4(w):
    return rel.full_outer_counts(sp.point_to_cell(w.trip, 500), sp.point_to_cell(w.poi, 500), ["ix", "iy"], ("n_trips", "n_pois"))


@query("c5_missing_keys", "grid poi_cell", "select grid_id from grid where grid_id not in (select grid_id from poi_cell)")
def c5(w):
    return rel.missing_keys(w.grid, w.poi_cell.select("grid_id"), "grid_id")


@query("c6_semi_join", "gtrip stop_time", "select stop_id, count(*) as n from stop_time where trip_id in (select trip_id from gtrip where service_id in ('1-URGENT','2-HIGH')) group by 1")
def c6(w):
    weekday = w.gtrip.where(F.col("service_id").isin("1-URGENT", "2-HIGH"))
    return w.stop_time.join(weekday.select("trip_id"), "trip_id", "left_semi").groupBy("stop_id").agg(F.count("*").alias("n"))


@query("c7_lookup_default", "features", "select grid_id, round(pop*coalesce(1+f/10e0,1.0e0),6) as adjusted from features left join (select c_nationkey+25*cast(floor(c_custkey/1500) as bigint) as district, count(*)%7 as f from customer where c_nationkey<20 group by 1) d using (district)")
def c7(w):
    f = w.customer.where(F.col("c_nationkey") < 20).groupBy((F.col("c_nationkey") + 25 * F.floor(F.col("c_custkey") / 1500)).alias("district"))
    f = f.agg((1 + (F.count("*") % 7) / 10).alias("factor"))
    return rel.lookup(w.features, f, "district", "factor", 1.0).select("grid_id", F.round(F.col("pop") * F.col("factor"), 6).alias("adjusted"))


STOP_MODES_SQL = f"""with rm as ({ROUTE_MODE_SQL}), served as (select distinct st.stop_id, t.route_id, rm.mode from stop_time st join gtrip t on st.trip_id=t.trip_id join rm on t.route_id=rm.route_id where rm.mode is not null)"""


@query(
    "c8_stop_modes", "route stop stop_time gtrip",
    STOP_MODES_SQL + """ select stop_id, mode, cast(count(*) as bigint) as n_mode_routes, any_value(ids) as route_ids from served join
    (select stop_id, string_agg(cast(route_id as varchar), ',' order by route_id) as ids from (select distinct stop_id, route_id from served) d group by 1) i using (stop_id) group by 1,2""",
)
def c8(w):
    m = rel.stop_modes(w.stop.select("stop_id"), w.stop_time, w.gtrip, rel.route_mode(w.route, mode_rules(w)))
    return m.select("stop_id", "mode", "n_mode_routes", F.concat_ws(",", F.col("route_ids").cast("array<string>")).alias("route_ids"))


@query("c9_point_to_cell", "trip grid", "select t.trip_id, g.grid_id, g.district from trip t join grid g on t.x>=g.x0 and t.x<g.x0+500 and t.y>=g.y0 and t.y<g.y0+500")
def c9(w):
    return sp.join_cells(w.trip.select("trip_id", "x", "y"), cells(w, "district"), 500).select("trip_id", "grid_id", "district")


@query(
    "c10_point_in_district", "stop district_box",
    """with inside as (select s.stop_id, min(d.district) as district from stop s join district_box d on s.x>=d.x0 and s.x<d.x1 and s.y>=d.y0 and s.y<d.y1 group by 1),
    near as (select s.stop_id, arg_min(d.district, round(greatest(d.x0-s.x, s.x-d.x1, 0)**2+greatest(d.y0-s.y, s.y-d.y1, 0)**2,3)*1e4+d.district) as district from stop s cross join district_box d where s.stop_id not in (select stop_id from inside) group by 1)
    select stop_id, district, true as is_inside from inside union all select stop_id, district, false from near""",
)
def c10(w):
    polys = sp.box_ring_col(w.district_box)
    j = sp.point_in_polygon(w.stop.select("stop_id", "x", "y"), polys, 2000.0, "district", "stop_id")
    inside = j.where(F.col("district").isNotNull()).select("stop_id", "district", F.lit(True).alias("is_inside"))
    borders = w.district_box.select("district", F.inline(box_sides()))
    outside = j.where(F.col("district").isNull()).select("stop_id", "x", "y")
    near = sp.nearest_segment(outside, "stop_id", borders, "district", 1000.0)
    return inside.unionByName(near.select("stop_id", "district", F.lit(False).alias("is_inside")))


def box_sides():
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    sides = [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)]
    return F.array(*[F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")) for a, b, c, d in sides])


BOX_CELLS = """from building b, grid g where b.x0<g.x0+500 and b.x0+b.w>g.x0 and b.y0<g.y0+500 and b.y0+b.h>g.y0"""


@query("c11_overlay_area", "building grid", f"select b.b_id, g.grid_id, round((least(b.x0+b.w,g.x0+500)-greatest(b.x0,g.x0))*(least(b.y0+b.h,g.y0+500)-greatest(b.y0,g.y0)),4) as area {BOX_CELLS}")
def c11(w):
    polys = sp.box_ring_col(boxes(w))
    return sp.overlay_rings(polys, cells(w), 500.0).select("b_id", "grid_id", F.round("piece_area", 4).alias("area"))


def boxes(w, *extra):
    return w.building.select("b_id", *extra, "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))


# Liang-Barsky in SQL: parameter interval of a segment inside a cell.
SEG_PIECES = """(select seg_id, highway, x1, y1, x2, y2, grid_id, gx, gy, greatest(0, case when x2>x1 then (gx-x1)/(x2-x1) else 0 end, case when y2>y1 then (gy-y1)/(y2-y1) else 0 end) as t0,
 least(1, case when x2>x1 then (gx+500-x1)/(x2-x1) else 1 end, case when y2>y1 then (gy+500-y1)/(y2-y1) else 1 end) as t1 from (
 select r.*, g.grid_id, g.x0 as gx, g.y0 as gy from (select *, unnest(range(cast(floor(x1/500) as bigint), cast(floor(x2/500) as bigint)+1)) as kx from road) r,
 lateral (select unnest(range(cast(floor(r.y1/500) as bigint), cast(floor(r.y2/500) as bigint)+1)) as ky) k join grid g on g.ix=r.kx and g.iy=k.ky) c)"""


@query("c12_overlay_length", "road grid", f"select grid_id, highway, count(*) as n_pieces, round(sum((t1-t0)*sqrt((x2-x1)**2+(y2-y1)**2)),3) as length_m from {SEG_PIECES} p where t0<t1 group by 1,2")
def c12(w):
    p = sp.overlay_segments(w.road, None, 500.0)
    p = p.groupBy("ix", "iy", "highway").agg(F.count("*").alias("n_pieces"), F.round(F.sum("piece_m"), 3).alias("length_m"))
    return p.join(cells(w), ["ix", "iy"]).drop("ix", "iy")


OVERLAY3 = """(select p.r, p.c, p.pop, g.grid_id, d.district as poly_district,
 greatest(0,least(p.x0+160,g.x0+500,d.x1)-greatest(p.x0,g.x0,d.x0))*greatest(0,least(p.y0+160,g.y0+500,d.y1)-greatest(p.y0,g.y0,d.y0)) as area
 from pixel p join grid g on g.ix between floor(p.x0/500) and floor((p.x0+160)/500) and g.iy between floor(p.y0/500) and floor((p.y0+160)/500)
 join district_box d on d.x0<p.x0+160 and d.x1>p.x0 and d.y0<p.y0+160 and d.y1>p.y0)"""


@query("c13_overlay_three_way", "pixel grid district_box", f"select grid_id, poly_district, count(*) as n_pieces, round(sum(area),4) as area from {OVERLAY3} o where area>0 group by 1,2")
def c13(w):
    o3 = overlay3(w)
    return o3.groupBy("grid_id", "poly_district").agg(F.count("*").alias("n_pieces"), F.round(F.sum("piece_area"), 4).alias("area"))


def pixel_boxes(w):
    return w.pixel.select("r", "c", "pop", "x0", "y0", (F.col("x0") + 160).alias("x1"), (F.col("y0") + 160).alias("y1"))


def overlay3(w):
    """Pixel x cell x district: the pixel-cell piece is a box again, so it can be overlaid a second time."""
    pc = sp.overlay_boxes(pixel_boxes(w), cells(w), 500.0)
    cx, cy = F.col("ix") * 500.0, F.col("iy") * 500.0
    piece = pc.select(
        "r", "c", "pop", "grid_id", F.greatest("x0", cx).alias("x0"), F.greatest("y0", cy).alias("y0"),
        F.least("x1", cx + 500).alias("x1"), F.least("y1", cy + 500).alias("y1"),
    )
    d = w.district_box.select(F.col("district").alias("poly_district"), F.col("x0").alias("dx0"), F.col("y0").alias("dy0"), F.col("x1").alias("dx1"), F.col("y1").alias("dy1"))
    size = 2000.0
    left = piece.withColumn("_bx", sp.tile(F.col("x0"), size)).withColumn("_by", sp.tile(F.col("y0"), size))
    # a piece is smaller than a tile, so it touches at most the next tile as well
    left = left.withColumn("_bx", F.explode(F.sequence(F.col("_bx"), sp.tile(F.col("x1"), size)))).withColumn("_by", F.explode(F.sequence(F.col("_by"), sp.tile(F.col("y1"), size))))
    right = sp._box_tiles(d, size, F.col("dx0"), F.col("dy0"), F.col("dx1"), F.col("dy1"))
    area = sp.g.rect_overlap_area(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), tuple(F.col(c) for c in ("dx0", "dy0", "dx1", "dy1")))
    # count a (piece, district) pair only in the tile that holds the lower-left corner of their overlap
    home = (sp.tile(F.greatest("x0", "dx0"), size) == F.col("_bx")) & (sp.tile(F.greatest("y0", "dy0"), size) == F.col("_by"))
    return left.join(right, ["_bx", "_by"]).where(home).withColumn("piece_area", area).where(F.col("piece_area") > 0)


def centres(w):
    return w.grid.select("grid_id", (F.col("x0") + 250).alias("x"), (F.col("y0") + 250).alias("y"))


@query("c14_count_within_radius", "grid stop", "select g.grid_id, count(s.stop_id) as n_all, count(case when s.mode_name='metro' then 1 end) as n_metro from grid g left join stop s on (g.x0+250-s.x)*(g.x0+250-s.x)+(g.y0+250-s.y)*(g.y0+250-s.y)<=1500*1500 group by 1")
def c14(w):
    return sp.count_within(centres(w), "grid_id", w.stop, 1500.0, {"n_all": F.lit(True), "n_metro": F.col("mode_name") == "metro"})


@query("c15_near_pairs", "poi", "select a.poi_id as a_id, b.poi_id as b_id, round(sqrt((a.x-b.x)**2+(a.y-b.y)**2),4) as dist from poi a join poi b on a.poi_id<b.poi_id and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=2500")
def c15(w):
    return sp.near_pairs(w.poi, "poi_id", 50.0).select("a_id", "b_id", F.round("dist", 4).alias("dist"))


@query("c15b_near_pair_count", "poi", "select count(*) as n_pairs from poi a join poi b on a.poi_id<b.poi_id and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=2500")
def c15b(w):
    return sp.near_pair_count(w.poi, 50.0)


@query("c16_near_any", "poi stop", "select poi_id from poi p where exists (select 1 from stop s where (p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y)<=300*300)")
def c16(w):
    return sp.near_any(w.poi, "poi_id", w.stop, 300.0).select("poi_id")


@query("c17_with_global", "features", "select grid_id, round(pop/(select sum(pop) from features)*100,6) as share_pct, n_poi>(select avg(n_poi) from features) as above_mean from features")
def c17(w):
    f = o.with_global(w.features, tot=F.sum("pop"), mean=F.avg("n_poi"))
    return f.select("grid_id", F.round(F.col("pop") / F.col("tot") * 100, 6).alias("share_pct"), (F.col("n_poi") > F.col("mean")).alias("above_mean"))


VARIANTS = ["t1__lin__uf0", "t1__sqrt__uf0", "t2__lin__uf0", "t2__sqrt__uf0"]
LONG_SCORES = "(" + " union all ".join(f"select grid_id, {i} as i, '{v}' as v, {v} as s from cell_scores" for i, v in enumerate(VARIANTS)) + ")"


@query("c18_variant_pairs", "cell_scores", f"select x.v as a, y.v as b, count(*) as n, floor(sum(abs(cast(round(x.s*10000) as bigint)-cast(round(y.s*10000) as bigint)))*100/count(*))/1000000 as mean_abs_diff from {LONG_SCORES} x join {LONG_SCORES} y on x.grid_id=y.grid_id and x.i<y.i group by 1,2")
def c18(w):
    p = w.cell_scores.select(F.inline(rel.in_row_pairs([], VARIANTS)))
    return p.groupBy("a", "b").agg(F.count("*").alias("n"), (F.floor(F.sum(F.abs(F.round(F.col("x") * 10000).cast("long") - F.round(F.col("y") * 10000).cast("long"))) * 100 / F.count("*")) / 1_000_000).alias("mean_abs_diff"))
