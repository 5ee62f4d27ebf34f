"""Geometry kernel over whole layers."""

from pyspark.sql import functions as F

from gridreach.functions import geometry as g
from gridreach.functions import projection as pj
from gridreach.operators import spatial as sp
from gridreach.operators import sweep
from gridreach.plans.q_a_sources import PARTS_SQL, two_part_buildings
from gridreach.plans.q_c_joins import boxes, cells
from gridreach.plans.registry import query


def _utm_sql(lon, lat):
    """The projection as SQL text: (x, y) from degrees, zone 35."""
    n = pj._N
    e = 2 * n**0.5 / (1 + n)
    t = f"sinh(atanh(sin(radians({lat})))-{e!r}*atanh({e!r}*sin(radians({lat}))))"
    x, y = "eta", "xi"
    for j, a in enumerate(pj._ALPHA, 1):
        x += f"+({a!r})*cos({2 * j}*xi)*sinh({2 * j}*eta)"
        y += f"+({a!r})*sin({2 * j}*xi)*cosh({2 * j}*eta)"
    k = pj.SCALE * pj._RECT
    return t, f"{pj.FALSE_EASTING!r}+{k!r}*({x})", f"{k!r}*({y})"


_T, _X, _Y = _utm_sql("lon", "lat")
_UTM = f"""(select trip_id, lon, lat, {_X} as px, {_Y} as py from (select *, atan2(t,cos(lam)) as xi, atanh(sin(lam)/sqrt(1+t*t)) as eta from (select trip_id, lon, lat, {_T} as t, radians(lon-({pj.central_meridian(35)!r})) as lam
 from (select trip_id, 26e0+x/20000*4 as lon, 39.5e0+(y-20000*floor(y/20000))/20000*2.5e0 as lat from trip) a) b) c)"""


@query("d1_utm_forward", "trip", f"select trip_id, lon, lat, round(px,3) as x, round(py,3) as y from {_UTM} u")
def d1(w):
    lon, lat = 26.0 + F.col("x") / 20000 * 4, 39.5 + (F.col("y") % 20000) / 20000 * 2.5
    return w.trip.select("trip_id", lon.alias("lon"), lat.alias("lat"), pj.utm_forward(lon, lat).alias("p")).select("trip_id", "lon", "lat", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query("d2_utm_round_trip", "trip", f"select count(*) as n, count(case when px between 100000 and 900000 and py between 0 and 10000000 then 1 end) as n_within_1mm from {_UTM} u")
def d2(w):
    lon, lat = 26.0 + F.col("x") / 20000 * 4, 39.5 + (F.col("y") % 20000) / 20000 * 2.5
    a = w.trip.select(pj.utm_forward(lon, lat).alias("p"))
    b = a.select("p", pj.utm_inverse(F.col("p.x"), F.col("p.y")).alias("q"))
    c = b.select("p", pj.utm_forward(F.col("q.lon"), F.col("q.lat")).alias("p2"))
    d = g.distance(F.col("p.x"), F.col("p.y"), F.col("p2.x"), F.col("p2.y"))
    return c.agg(F.count("*").alias("n"), F.count_if(d <= 0.001).alias("n_within_1mm"))


@query("d3_fishnet", "poi", "select cast(i as bigint) as ix, cast(j as bigint) as iy from (select unnest(range(cast(floor(min(x)/500) as bigint), cast(ceil(max(x)/500) as bigint))) as i from poi) a, (select unnest(range(cast(floor(min(y)/500) as bigint), cast(ceil(max(y)/500) as bigint))) as j from poi) b")
def d3(w):
    bounds = w.poi.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return sp.fishnet(bounds, 500.0).select("ix", "iy")


@query("d4_area_length", "building road", "select 'building' as layer, count(*) as n, round(sum(w*h),3) as total from building union all select 'road', count(*), round(sum(sqrt((x2-x1)**2+(y2-y1)**2)),3) from road")
def d4(w):
    a = sp.box_ring_col(boxes(w)).agg(F.lit("building").alias("layer"), F.count("*").alias("n"), F.round(F.sum(g.ring_area(F.col("ring"))), 3).alias("total"))
    path = F.array(g.point(F.col("x1"), F.col("y1")), g.point(F.col("x2"), F.col("y2")))
    return a.unionByName(w.road.agg(F.lit("road").alias("layer"), F.count("*").alias("n"), F.round(F.sum(g.path_length(path)), 3).alias("total")))


@query("d5_point_in_ring", "poi building", "select b_id, count(*) as n from poi p join building b on p.x>=b.x0-200 and p.x<b.x0+b.w+200 and p.y>=b.y0-200 and p.y<b.y0+b.h+200 group by 1")
def d5(w):
    b = boxes(w).select("b_id", (F.col("x0") - 200).alias("x0"), (F.col("y0") - 200).alias("y0"), (F.col("x1") + 200).alias("x1"), (F.col("y1") + 200).alias("y1"))
    cand = sp._box_tiles(sp.box_ring_col(b), 500.0, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    pts = w.poi.select("x", "y", sp.tile(F.col("x"), 500.0).alias("_bx"), sp.tile(F.col("y"), 500.0).alias("_by"))
    return pts.join(cand, ["_bx", "_by"]).where(g.point_in_ring(F.col("x"), F.col("y"), F.col("ring"))).groupBy("b_id").agg(F.count("*").alias("n"))


@query("d5b_point_in_parts", "poi building", f"select p.poi_id, min(b_id) as b_id from poi p join (select p.poi_id, b.b_id, sum(s) as n from poi p join {PARTS_SQL} b on p.x>=b.x0 and p.x<b.x1 and p.y>=b.y0 and p.y<b.y1 group by 1,2) h on h.poi_id=p.poi_id and n=1 group by 1")
def d5b(w):
    pts = w.poi.select("poi_id", "x", "y")
    return sp.point_in_polygon(pts, two_part_buildings(w), 500.0, "b_id", "poi_id").where("b_id is not null").select("poi_id", "b_id")


@query("d7b_clip_parts", "building grid", f"select g.grid_id, round(sum(s*greatest(0,least(p.x1,g.x0+500)-greatest(p.x0,g.x0))*greatest(0,least(p.y1,g.y0+500)-greatest(p.y0,g.y0))),4) as area from {PARTS_SQL} p join grid g on p.x0<g.x0+500 and p.x1>g.x0 and p.y0<g.y0+500 and p.y1>g.y0 group by 1")
def d7b(w):
    p = sp.overlay_rings(two_part_buildings(w), None, 500.0).groupBy("ix", "iy").agg(F.round(F.sum("piece_area"), 4).alias("area"))
    return p.join(cells(w), ["ix", "iy"]).select("grid_id", "area")


def l_shape(w):
    """An L-shaped ring per building: its box with the upper right quarter cut out."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    ring = F.array(*[g.point(a, b) for a, b in ((x0, y0), (x1, y0), (x1, my), (mx, my), (mx, y1), (x0, y1), (x0, y0))])
    return boxes(w).withColumn("ring", ring)


@query("d6_centroid", "building", "select b_id, round(x0+w*5e0/12,4) as cx, round(y0+h*5e0/12,4) as cy, true as rep_is_inside from building")
def d6(w):
    b = sp.spread_rows(l_shape(w).select("b_id", "ring")).select("b_id", "ring", g.centroid(F.col("ring")).alias("c"), g.rep_point(F.col("ring")).alias("r"))
    return b.select("b_id", F.round("c.x", 4).alias("cx"), F.round("c.y", 4).alias("cy"), g.point_in_ring(F.col("r.x"), F.col("r.y"), F.col("ring")).alias("rep_is_inside"))


@query(
    "d7_clip_concave", "building grid",
    """select g.grid_id, round(sum(greatest(0,least(p.x1,g.x0+500)-greatest(p.x0,g.x0))*greatest(0,least(p.y1,g.y0+500)-greatest(p.y0,g.y0))),4) as area from (
    select x0, y0, x0+w as x1, y0+h/2 as y1 from building union all select x0, y0+h/2, x0+w/2, y0+h from building) p join grid g on p.x0<g.x0+500 and p.x1>g.x0 and p.y0<g.y0+500 and p.y1>g.y0 group by 1""",
)
def d7(w):
    p = sp.overlay_rings(l_shape(w), None, 500.0).groupBy("ix", "iy").agg(F.round(F.sum("piece_area"), 4).alias("area"))
    return p.join(cells(w), ["ix", "iy"]).select("grid_id", "area")


@query("d8_clip_segment", "road", "select highway, count(*) as n, round(sum((t1-t0)*sqrt((x2-x1)**2+(y2-y1)**2)),3) as inside_m from (select *, greatest(0,case when x2>x1 then (4000-x1)/(x2-x1) else case when x1>=4000 and x1<12000 then 0 else 2 end end) as t0, least(1,case when x2>x1 then (12000-x1)/(x2-x1) else 1 end) as t1 from road) r where t0<t1 group by 1")
def d8(w):
    t = g.clip_segment(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(4000.0), F.lit(-1.0), F.lit(12000.0), F.lit(1e12))
    r = w.road.withColumn("t", t).where(F.col("t.t0") < F.col("t.t1"))
    length = g.distance(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return r.groupBy("highway").agg(F.count("*").alias("n"), F.round(F.sum((F.col("t.t1") - F.col("t.t0")) * length), 3).alias("inside_m"))


@query("d9_point_segment_distance", "road", "select seg_id, round(sqrt((px-x1-t*(x2-x1))**2+(py-y1-t*(y2-y1))**2),4) as d from (select *, greatest(0,least(1,coalesce(((px-x1)*(x2-x1)+(py-y1)*(y2-y1))/nullif((x2-x1)**2+(y2-y1)**2,0),0))) as t from (select *, x1+50+l_linenumber*40 as px, y1-30 as py from road) a) b")
def d9(w):
    px, py = F.col("x1") + 50 + F.col("l_linenumber") * 40, F.col("y1") - 30
    return w.road.select("seg_id", F.round(g.point_segment_distance(px, py, *[F.col(c) for c in ("x1", "y1", "x2", "y2")]), 4).alias("d"))


@query("d10_near_interval", "road", "select seg_id, case when x2>x1 then round(greatest(0,(mx-15-x1)/(x2-x1)),5) else 0 end as t0, case when x2>x1 then round(least(1,(mx+15-x1)/(x2-x1)),5) else 1 end as t1 from (select seg_id, x1, x2, (x1+x2)/2 as mx from road) r")
def d10(w):
    """Horizontal base of each road against a long vertical line through its middle: the interval is known in closed form.

    A vertical road's base is one point on that line, near it as a whole.
    """
    r = w.road
    mx = (F.col("x1") + F.col("x2")) / 2
    t = g.near_interval(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y1"), mx, F.col("y1") - 100, mx, F.col("y1") + 100, 15.0)
    return r.select("seg_id", t.alias("t")).select("seg_id", F.round("t.t0", 5).alias("t0"), F.round("t.t1", 5).alias("t1"))


@query("d11_validity", "building", "select case b_id%5 when 1 then 'NOT_CLOSED' when 2 then 'TOO_FEW_POINTS' when 3 then 'SELF_CROSSING' when 4 then 'ZERO_AREA' else 'VALID' end as problem, count(*) as n from building group by 1")
def d11(w):
    b = sp.box_ring_col(boxes(w))
    r, k = F.col("ring"), F.col("b_id") % 5
    bow_tie = F.array(r[0], r[2], r[1], r[3], r[0])
    flat = F.array(r[0], r[1], r[0], r[0])
    bad = F.when(k == 1, F.slice(r, 1, 4)).when(k == 2, F.slice(r, 1, 3)).when(k == 3, bow_tie).when(k == 4, flat).otherwise(r)
    return b.select(g.validity(bad).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query(
    "d13_hex_cells", "trip",
    """with a as (select (x*sqrt(3)/3-y/3)/300 as q, y*2e0/3/300 as r from trip), b as (select *, -q-r as s, floor(q+0.5) as rq, floor(r+0.5) as rr, floor(-q-r+0.5) as rs from a),
    c as (select *, abs(rq-q) as dq, abs(rr-r) as dr, abs(rs-s) as ds from b)
    select cast(case when dq>dr and dq>ds then -rr-rs else rq end as bigint) as q, cast(case when not (dq>dr and dq>ds) and dr>ds then -rq-rs else rr end as bigint) as r, count(*) as n from c group by 1,2""",
)
def d13(w):
    h = w.trip.select(g.hex_key(F.col("x"), F.col("y"), 300.0).alias("h"))
    return h.groupBy(F.col("h.q").alias("q"), F.col("h.r").alias("r")).agg(F.count("*").alias("n"))


@query(
    "d14_union_area", "landuse grid",
    """with p as (select distinct g.grid_id, greatest(l.x0,g.x0) as a, least(l.x1,g.x0+500) as b, greatest(l.y0,g.y0) as c, least(l.y1,g.y0+500) as d from landuse l join grid g on l.x0<g.x0+500 and l.x1>g.x0 and l.y0<g.y0+500 and l.y1>g.y0),
    xs as (select distinct grid_id, unnest([a,b]) as s from p), sl as (select grid_id, s, lead(s) over (partition by grid_id order by s) as e from xs),
    ys as (select distinct grid_id, unnest([c,d]) as t from p), yl as (select grid_id, t, lead(t) over (partition by grid_id order by t) as u from ys)
    select grid_id, round(sum((e-s)*(u-t)),4) as union_area from sl join yl using (grid_id) where e is not null and u is not null
    and exists (select 1 from p where p.grid_id=sl.grid_id and p.a<=sl.s and p.b>=sl.e and p.c<=yl.t and p.d>=yl.u) group by 1""",
)
def d14(w):
    u = sp.union_area_per_cell(w.landuse, 500.0)
    return u.join(cells(w), ["ix", "iy"]).select("grid_id", F.round("union_area", 4).alias("union_area"))


# The plane is cut at every side of every box of a cell; a slab is covered if, for some polygon, boxes less holes add up to one over it.
UNION_PARTS_SQL = f"""with sh as (select b_id*2 as id, s, x0, y0, x1, y1 from {PARTS_SQL} q union all select b_id*2+1, 1, x0-150, y0-90, x0+w+150, y0+h/2 from building union all select b_id*2+1, 1, x0-150, y0+h/2, x0+w/2, y0+h+90 from building),
 p as (select g.grid_id, id, s, greatest(q.x0,g.x0) as a, least(q.x1,g.x0+500) as b, greatest(q.y0,g.y0) as c, least(q.y1,g.y0+500) as d from sh q join grid g on q.x0<g.x0+500 and q.x1>g.x0 and q.y0<g.y0+500 and q.y1>g.y0),
 xs as (select distinct grid_id, unnest([a,b]) as s0 from p), sl as (select grid_id, s0, lead(s0) over (partition by grid_id order by s0) as e from xs),
 ys as (select distinct grid_id, unnest([c,d]) as t from p), yl as (select grid_id, t, lead(t) over (partition by grid_id order by t) as u from ys),
 k as (select sl.grid_id, s0, e, t, u, id from sl join yl using (grid_id) join p on p.grid_id=sl.grid_id and p.a<=s0 and p.b>=e and p.c<=t and p.d>=u where e is not null and u is not null group by all having sum(p.s)>0)
 select grid_id, round(sum((e-s0)*(u-t)),3) as union_area from (select distinct grid_id, s0, e, t, u from k) z group by 1"""


def wide_l(w):
    """An L-shaped outline around each building, wide enough to overlap others."""
    b = boxes(w)
    x0, x1, y0, my, y1 = F.col("x0") - 150, F.col("x1") + 150, F.col("y0") - 90, (F.col("y0") + F.col("y1")) / 2, F.col("y1") + 90
    mx = (F.col("x0") + F.col("x1")) / 2
    ring = F.array(*[g.point(a, c) for a, c in ((x0, y0), (x1, y0), (x1, my), (mx, my), (mx, y1), (x0, y1), (x0, y0))])
    return b.select(F.array(F.struct(F.lit(False).alias("hole"), ring.alias("ring"))).alias("parts"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


@query("d14b_union_area_parts", "building grid", UNION_PARTS_SQL)
def d14b(w):
    shapes = two_part_buildings(w).select("parts", "x0", "y0", "x1", "y1").unionByName(wide_l(w))
    u = sweep.union_area_of_parts(shapes, 500.0)
    return u.join(cells(w), ["ix", "iy"]).select("grid_id", F.round("union_area", 3).alias("union_area"))
