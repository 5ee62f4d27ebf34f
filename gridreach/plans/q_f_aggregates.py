"""Aggregations over cells, pieces and classes."""

from pyspark.sql import functions as F

from gridreach.functions import scalars as s
from gridreach.operators import dedup as dd
from gridreach.operators import ordered as o
from gridreach.operators import relational as rel
from gridreach.operators import spatial as sp
from gridreach.operators import summary as sm
from gridreach.operators import terrain as tr
from gridreach.plans.q_b_scalars import EVERYDAY_CASE, POI_CASE, missing_flags, mode_rules
from gridreach.plans.q_c_joins import OVERLAY3, SEG_PIECES, STOP_MODES_SQL, boxes, cells, overlay3, pixel_boxes
from gridreach.plans.q_e_nearest import near_share_sql
from gridreach.plans.registry import query

FEATS = ["n_poi", "sum_size", "n_trip", "trip_value", "n_stop", "pop", "elev", "noise"]
LONG_F = "(" + " union all ".join(f"select grid_id, district, '{c}' as feature, {c} as value from features" for c in FEATS) + ")"
LONG_L = "(" + " union all ".join(f"select la, '{c}' as feature, {c} as value from cell_labels" for c in ("n_poi", "n_trip", "sum_size", "noise")) + ")"
SKEW = "avg((value-m)**3)/nullif(sqrt(avg((value-m)**2))**3,0)"


def poi_features(w):
    """Category counts, density, category variety and entropy per cell."""
    p = w.poi_cell.select("grid_id", s.first_match(s.POI_RULES, F.col).alias("category"))
    cats = {c: c for c in s.POI_CATEGORIES}
    f = sm.category_pivot(p.where(F.col("category").isNotNull()), w.grid.select("grid_id", "land_area_m2"), "grid_id", "category", cats)
    counts = [F.col(c) for c in s.POI_CATEGORIES]
    total = sum(counts, F.lit(0))
    return f.select(
        "grid_id", *s.POI_CATEGORIES, total.cast("long").alias("total_poi_count"),
        F.round(s.density_km2(total, F.col("land_area_m2")), 6).alias("poi_density_km2"),
        s.count_true([c > 0 for c in counts]).alias("poi_category_count"), F.round(s.entropy_bits(counts), 6).alias("poi_entropy"),
    )


_C = s.POI_CATEGORIES
_TOT = "+".join(_C)
_ENT = "+".join(f"case when {c}>0 then -({c}*1e0/total)*log2({c}*1e0/total) else 0 end" for c in _C)


@query(
    "f1_poi_features", "grid poi_cell",
    f"""select grid_id, {', '.join(_C)}, cast(total as bigint) as total_poi_count, round(total/(land_area_m2/1e6),6) as poi_density_km2,
    cast({'+'.join(f'({c}>0)::int' for c in _C)} as bigint) as poi_category_count, case when total>0 then round({_ENT},6) else 0 end as poi_entropy from (
    select *, {_TOT} as total from (select g.grid_id, any_value(g.land_area_m2) as land_area_m2, {', '.join(f"count(case when category='{c}' then 1 end) as {c}" for c in _C)}
    from grid g left join (select grid_id, {POI_CASE} as category from poi_cell) p on g.grid_id=p.grid_id group by 1) a) b""",
)
def f1(w):
    return poi_features(w)


@query("f2_building_stats", "building", "select cast(floor((y0+h/2)/500)*40+floor((x0+w/2)/500) as bigint) as grid_id, count(*) as n, round(avg(w*h),6) as mean_area from building group by 1")
def f2(w):
    b = boxes(w, "w", "h").select(((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), (F.col("w") * F.col("h")).alias("area"))
    per = sp.point_to_cell(b, 500.0).groupBy("ix", "iy").agg(F.count("*").alias("n"), F.round(F.avg("area"), 6).alias("mean_area"))
    return per.join(cells(w), ["ix", "iy"]).select("grid_id", "n", "mean_area")


@query(
    "f3_road_length_by_class", "road grid",
    f"""select grid_id, round(sum(case when highway in ('primary','motorway') then len else 0 end),3) as major_m, round(sum(case when highway in ('residential','tertiary') then len else 0 end),3) as local_m,
    round(sum(case when highway<>'motorway' then len else 0 end),3) as walkable_m, round(sum(len),3) as total_m from (select *, (t1-t0)*sqrt((x2-x1)**2+(y2-y1)**2) as len from {SEG_PIECES} p where t0<t1) q group by 1""",
)
def f3(w):
    p = sp.overlay_segments(w.road, None, 500.0)
    fl = s.road_flags(F.col("highway"))
    part = lambda c: F.round(F.sum(F.when(c, F.col("piece_m")).otherwise(0.0)), 3)
    p = p.groupBy("ix", "iy").agg(part(fl["is_major"]).alias("major_m"), part(fl["is_local"]).alias("local_m"), part(fl["is_walkable"]).alias("walkable_m"), F.round(F.sum("piece_m"), 3).alias("total_m"))
    return p.join(cells(w), ["ix", "iy"]).drop("ix", "iy")


@query(
    "f4_route_diversity", "route stop stop_time gtrip",
    STOP_MODES_SQL + """ select cast(floor(y/500)*40+floor(x/500) as bigint) as grid_id, cast(count(distinct route_id) as bigint) as n_routes,
    cast(count(distinct case when served.mode='metrobus' then route_id end) as bigint) as n_metrobus from served join stop using (stop_id) group by 1""",
)
def f4(w):
    served = rel.served_routes(w.stop_time, w.gtrip, rel.route_mode(w.route, mode_rules(w)))
    where = sp.point_to_cell(w.stop.select("stop_id", "x", "y"), 500.0).select("stop_id", "ix", "iy")
    c = served.join(where, "stop_id").select("ix", "iy", "route_id", "mode").distinct()
    c = c.groupBy("ix", "iy").agg(F.count("*").alias("n_routes"), F.count_if(F.col("mode") == "metrobus").alias("n_metrobus"))
    return c.join(cells(w), ["ix", "iy"]).drop("ix", "iy")


@query(
    "f5_bus_departures", "grid stop stop_time gtrip",
    """select g.grid_id, cast(coalesce(sum(d.n),0) as bigint) as per_day, cast(coalesce(sum(d.pk),0) as bigint) as peak from grid g left join
    (select cast(floor(y/500)*40+floor(x/500) as bigint) as grid_id, n, pk from stop join (select stop_id, count(*) as n, count(case when coalesce(departure_time,arrival_time) like '08:%' then 1 end) as pk
    from stop_time where trip_id in (select trip_id from gtrip where service_id='1-URGENT') group by 1) t using (stop_id) where mode_name in ('bus','metrobus')) d on g.grid_id=d.grid_id group by 1""",
)
def f5(w):
    weekday = w.gtrip.where(F.col("service_id") == "1-URGENT").select("trip_id")
    st = w.stop_time.join(weekday, "trip_id", "left_semi")
    peak = F.coalesce("departure_time", "arrival_time").startswith("08:")
    per = st.groupBy("stop_id").agg(F.count("*").alias("per_day"), F.count_if(peak).alias("peak"))
    stops = w.stop.where(F.col("mode_name").isin("bus", "metrobus")).select("stop_id", "x", "y").join(per, "stop_id")
    c = sp.point_to_cell(stops, 500.0).groupBy("ix", "iy").agg(F.sum("per_day").alias("per_day"), F.sum("peak").alias("peak"))
    return cells(w).join(c, ["ix", "iy"], "left").na.fill(0).drop("ix", "iy")


PX = "(select cast(floor((y0+80)/500)*40+floor((x0+80)/500) as bigint) as grid_id, elev from pixel where elev is not null)"


@query("f6_zonal_stats", "pixel", f"select grid_id, round(min(elev),6) as min_v, round(max(elev),6) as max_v, round(avg(elev),6) as mean_v, round(median(elev),6) as median_v, round(stddev_samp(elev),5) as std_v, round(max(elev)-min(elev),6) as range_v from {PX} p group by 1")
def f6(w):
    return tr.zonal_stats(pixel_cells(w), "grid_id", "elev")


def pixel_cells(w):
    px = w.pixel.select("r", "c", "elev", "pop", (F.col("x0") + 80).alias("x"), (F.col("y0") + 80).alias("y"))
    return sp.join_cells(px, cells(w), 500.0)


@query("f7_bin_shares", "pixel", f"select grid_id, round(100e0*count(case when v<3 then 1 end)/count(*),6) as lt3, round(100e0*count(case when v>=3 and v<6 then 1 end)/count(*),6) as b3_6, round(100e0*count(case when v>=6 and v<10 then 1 end)/count(*),6) as b6_10, round(100e0*count(case when v>=10 then 1 end)/count(*),6) as gt10 from (select grid_id, elev/12 as v from {PX} p) q group by 1")
def f7(w):
    p = pixel_cells(w).where(F.col("elev").isNotNull()).withColumn("v", F.col("elev") / 12)
    return tr.bin_shares(p, "grid_id", "v", [0, 3, 6, 10], ["lt3", "b3_6", "b6_10", "gt10"])


@query(
    "f8_weighted_grade_stats", "road",
    """with p as (select cast(floor(y1/500)*40+floor(x1/500) as bigint) as grid_id, sqrt((x2-x1)**2+(y2-y1)**2) as len, cast(l_orderkey%12 as double) as grade from road where x2>x1 or y2>y1),
    m as (select grid_id, grade, sum(len) as len from p group by 1,2), c as (select *, sum(len) over (partition by grid_id order by grade) as cum, sum(len) over (partition by grid_id) as tot from m)
    select grid_id, round(sum(grade*len)/sum(len),6) as mean_grade, min(case when cum>=tot*0.5 then grade end) as median_grade, round(100*sum(case when grade>5 then len else 0 end)/sum(len),6) as pct_gt5,
    round(100*sum(case when grade>8 then len else 0 end)/sum(len),6) as pct_gt8, round(sum(len),4) as sample_m from c group by 1""",
)
def f8(w):
    r = w.road.where((F.col("x2") > F.col("x1")) | (F.col("y2") > F.col("y1")))  # a road without length has no grade
    p = sp.point_to_cell(r.withColumn("x", F.col("x1")).withColumn("y", F.col("y1")), 500.0).select(
        (F.col("iy") * 40 + F.col("ix")).alias("grid_id"), (F.col("l_orderkey") % 12).cast("double").alias("grade"),
        sp.g.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("len"),
    )
    return tr.weighted_grade_stats(p, "grid_id", "grade", "len")


PIX_PIECES = """(select p.r, p.c, p.pop, g.grid_id, greatest(0,least(p.x0+160,g.x0+500)-greatest(p.x0,g.x0))*greatest(0,least(p.y0+160,g.y0+500)-greatest(p.y0,g.y0)) as area
 from pixel p join grid g on g.ix between floor(p.x0/500) and floor((p.x0+160)/500) and g.iy between floor(p.y0/500) and floor((p.y0+160)/500))"""


@query("f9_allocate_mass", "pixel grid", f"select grid_id, round(sum(pop*area/25600),6) as pop from {PIX_PIECES} p where area>0 group by 1")
def f9(w):
    per = allocate(w).groupBy("ix", "iy").agg(F.round(F.sum("mass"), 6).alias("pop"))
    return per.join(cells(w), ["ix", "iy"]).select("grid_id", "pop")


def allocate(w):
    return sp.overlay_boxes(pixel_boxes(w), None, 500.0).withColumn("mass", F.col("pop") * F.col("piece_area") / 25600.0)


@query("f9b_mass_check", "pixel grid", f"select round(s,3) as source, round(a,3) as allocated, round((a-s)/s*100,6) as diff_pct from (select (select sum(pop) from pixel) as s, (select sum(pop*area/25600) from {PIX_PIECES} p) as a) t")
def f9b(w):
    """Mass before and after allocation; both sides are one aggregate each."""
    src = w.pixel.agg(F.sum("pop").alias("s"))
    out = allocate(w).join(cells(w), ["ix", "iy"], "left_semi").agg(F.sum("mass").alias("a")).withColumn("s", src.scalar())
    return out.select(F.round("s", 3).alias("source"), F.round("a", 3).alias("allocated"), F.round((F.col("a") - F.col("s")) / F.col("s") * 100, 6).alias("diff_pct"))


OFFICIAL = "(select c_nationkey+25*cast(floor(c_custkey/1500) as bigint) as poly_district, count(*)*1000e0 as official from customer group by 1)"


@query(
    "f10_calibrate", "pixel grid district_box",
    f"""with p as (select grid_id, poly_district, sum(pop*area/25600) as raw from {OVERLAY3} o where area>0 group by 1,2), f as (select poly_district, any_value(official)/nullif(sum(raw),0) as factor from p join {OFFICIAL} o using (poly_district) group by 1)
    select grid_id, round(sum(raw*coalesce(factor,1)),4) as calibrated from p left join f using (poly_district) group by 1""",
)
def f10(w):
    p = overlay3(w).groupBy("grid_id", "poly_district").agg(F.sum(F.col("pop") * F.col("piece_area") / 25600.0).alias("raw"))
    off = w.customer.groupBy((F.col("c_nationkey") + 25 * F.floor(F.col("c_custkey") / 1500)).alias("poly_district")).agg((F.count("*") * 1000.0).alias("official"))
    f = p.groupBy("poly_district").agg(F.sum("raw").alias("t")).join(off, "poly_district").select("poly_district", F.try_divide("official", "t").alias("factor"))
    c = rel.lookup(p, f, "poly_district", "factor", 1.0)
    return c.groupBy("grid_id").agg(F.round(F.sum(F.col("raw") * F.col("factor")), 4).alias("calibrated"))


@query("f11_straddling_cells", "pixel grid district_box", f"select count(*) as n_straddling from (select grid_id from {OVERLAY3} o where area>0 group by 1 having count(distinct poly_district)>1) t")
def f11(w):
    p = overlay3(w).select("grid_id", "poly_district").distinct().groupBy("grid_id").count()
    return p.where(F.col("count") > 1).agg(F.count("*").alias("n_straddling"))


@query("f12_weighted_class_summary", "access15", "select score_class, n, round(n*100e0/sum(n) over (),2) as pct_n, round(w,1) as w, round(w*100/sum(w) over (),2) as pct_w from (select floor(score*5)::int as score_class, count(*) as n, sum(pop) as w from access15 group by 1) t")
def f12(w):
    a = w.access15.withColumn("score_class", F.floor(F.col("score") * 5).cast("int"))
    return sm.weighted_class_summary(a, ["score_class"], "pop")


@query("f13_crosstab", "cell_labels", "select la, lb, count(*) as n, round(round_even(count(*)*1e0/sum(count(*)) over (partition by la),4)*100,2) as row_pct from cell_labels group by 1,2")
def f13(w):
    return sm.crosstab(w.cell_labels, "la", "lb").withColumn("row_pct", F.round("row_pct", 2))


@query(
    "f14_merge_intervals", "",
    """with i as (select l_orderkey, l_partkey%50/100e0 as t0, l_partkey%50/100e0+l_suppkey%40/100e0 as t1 from lineitem), o as (select *, max(t1) over (partition by l_orderkey order by t0, t1 rows between unbounded preceding and 1 preceding) as m from i)
    select l_orderkey, round(sum(greatest(0, t1-greatest(t0, coalesce(m, t0)))),6) as covered from o group by 1""",
)
def f14(w):
    t0 = (F.col("l_partkey") % 50) / 100
    i = w.lineitem.select("l_orderkey", t0.alias("t0"), (t0 + (F.col("l_suppkey") % 40) / 100).alias("t1"))
    return sp.covered_share(i, ["l_orderkey"]).select("l_orderkey", F.round("covered", 6).alias("covered"))


# Roads run up and to the right; a part inside a cell lies between the later entry and the earlier exit of the two axes.
_ROADS = "(select x1, y1, x2, y2, x2-x1 as dx, y2-y1 as dy, count(*) as copies from road group by 1,2,3,4)"
_IN = "case when {d}>0 then ({g}-{a})/{d} when {a}>={g} and {a}<{g}+500 then 0 else 2 end"
_PARTS = f"""(select grid_id, x1+t0*dx as x1, y1+t0*dy as y1, x1+t1*dx as x2, y1+t1*dy as y2, copies, (t1-t0)*sqrt(dx*dx+dy*dy) as piece_m from (select r.*, g.grid_id, greatest(0, {_IN.format(d="dx", g="g.x0", a="x1")}, {_IN.format(d="dy", g="g.y0", a="y1")}) as t0,
 least(1, case when dx>0 then (g.x0+500-x1)/dx else 1 end, case when dy>0 then (g.y0+500-y1)/dy else 1 end) as t1 from {_ROADS} r join grid g on r.x1<=g.x0+500 and r.x2>=g.x0 and r.y1<=g.y0+500 and r.y2>=g.y0) t where t0<t1)"""


@query(
    "f15_pct_road_near_cycleway", "road grid cycleway",
    f"""with pc as materialized {_PARTS}, n as (select grid_id, sum(covered*piece_m*copies) as near_m from {near_share_sql("(select * from pc)", ["grid_id", "x1", "y1", "x2", "y2", "copies", "piece_m"], "cycleway", "60e0")} c group by 1), t as (select grid_id, sum(piece_m*copies) as road_m from pc group by 1)
    select g.grid_id, round(case when road_m>0 then coalesce(near_m,0) end/nullif(road_m,0)*100,4) as pct_near from grid g left join t using (grid_id) left join n using (grid_id)""",
)
def f15(w):
    r = w.road.groupBy("x1", "y1", "x2", "y2").agg(F.count("*").alias("copies"))
    at = lambda a, b, t: (F.col(a) + F.col(t) * (F.col(b) - F.col(a)))
    p = sp.overlay_segments(r, None, 500.0).select(
        F.col("ix").alias("_bx"), F.col("iy").alias("_by"), "copies", "piece_m",
        at("x1", "x2", "t0").alias("x1"), at("y1", "y2", "t0").alias("y1"), at("x1", "x2", "t1").alias("x2"), at("y1", "y2", "t1").alias("y2"),
    )
    per = dd.near_sums(p, w.cycleway, 60.0, 500.0).withColumnsRenamed({"_bx": "ix", "_by": "iy"})
    j = w.grid.select("grid_id", "ix", "iy").join(per, ["ix", "iy"], "left")
    return j.select("grid_id", F.round(F.try_divide("near", "whole") * 100, 4).alias("pct_near"))


@query("f16_mode_per_group", "cell_labels", "select district, lb, n from (select district, lb, count(*) as n, row_number() over (partition by district order by count(*) desc, lb) as rn from cell_labels group by 1,2) t where rn=1")
def f16(w):
    return sm.mode_per_group(w.cell_labels, "district", "lb")


@query(
    "f17_median_member", "access15",
    """with t as (select 'far' as "case", grid_id, pop from access15 where walk_food>10 union all select 'near', grid_id, pop from access15 where walk_food<=5), p as (select *, row_number() over (partition by "case" order by pop, grid_id)-1 as i, count(*) over (partition by "case") as n from t where pop>0)
    select "case", grid_id, pop from p where i=n//2""",
)
def f17(w):
    return sm.median_member(w.access15, {"far": F.col("walk_food") > 10, "near": F.col("walk_food") <= 5}, "pop", "grid_id")


@query("f18_quantiles", "", "select l_returnflag, round(quantile_cont(l_extendedprice,0.05),4) as p5, round(quantile_cont(l_extendedprice,0.25),4) as p25, round(quantile_cont(l_extendedprice,0.5),4) as p50, round(quantile_cont(l_extendedprice,0.9),4) as p90, round(quantile_cont(l_extendedprice,0.99),4) as p99 from lineitem group by 1")
def f18(w):
    ps = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    q = o.quantiles(w.lineitem, "l_extendedprice", list(ps.values()), ["l_returnflag"])
    return q.groupBy("l_returnflag").agg(*[F.round(F.max(F.when(F.col("p") == p, F.col("q"))), 4).alias(n) for n, p in ps.items()])


@query(
    "f19_weighted_quantiles", "access15",
    """with m as (select district%5 as g, walk_food as v, sum(pop) as w from access15 where walk_food is not null group by 1,2), c as (select *, sum(w) over (partition by g order by v) as cum, sum(w) over (partition by g) as tot from m)
    select g, p, min(case when cum>=p*tot then v end) as q from c, (select unnest([0.25e0,0.5e0,0.9e0]) as p) ps group by 1,2""",
)
def f19(w):
    return o.weighted_quantiles(w.access15.withColumn("g", F.col("district") % 5), "walk_food", "pop", [0.25, 0.5, 0.9], ["g"])


def _tt(col):
    lim = ", ".join(f"round(count(case when {col}<={x} then 1 end)*100e0/count({col}),2) as pct_within_{x}, round(sum(case when {col}<={x} then pop else 0 end)*100/sum(pop),2) as pct_w_within_{x}" for x in (5, 10, 15))
    q = ", ".join(f"round(quantile_cont({col},{p}),2) as {n}" for n, p in (("p25", 0.25), ("median", 0.5), ("p90", 0.9)))
    wq = ", ".join(f"(select min(v) from (select v, sum(w) over (order by v) as cum, sum(w) over () as tot from (select {col} as v, sum(pop) as w from access15 where {col} is not null group by 1) m) c where cum>={p}*tot) as w_{n}" for n, p in (("p25", 0.25), ("median", 0.5), ("p90", 0.9)))
    return f"select '{col}' as measure, count(*) as n, count({col}) as n_reached, round((count(*)-count({col}))*100e0/count(*),2) as pct_unreachable, round((sum(pop)-sum(case when {col} is not null then pop else 0 end))*100/sum(pop),2) as pct_w_unreachable, {lim}, {q}, {wq} from access15"


@query("f20_travel_time_stats", "access15", _tt("walk_food") + " union all " + _tt("walk_education"))
def f20(w):
    return sm.travel_time_stats(w.access15, ["walk_food", "walk_education"], "pop")


@query("f21_skewness", "features", f"select feature, round({SKEW},5) as skew from (select *, avg(value) over (partition by feature) as m from {LONG_F} f where value is not null) g group by 1")
def f21(w):
    return o.unpivot(w.features, [], FEATS).groupBy("feature").agg(F.round(F.skewness("value"), 5).alias("skew"))


@query(
    "f22_describe_audit", "features",
    f"""select *, abs(skew)>3 as flag_extreme_skew, abs(mean)>1e-9 and std/abs(mean)<0.05 and zero_pct<50 as flag_near_constant, zero_pct>90 as flag_very_sparse from (select feature, count(value) as n_valid, (select count(*) from features)-count(value) as n_missing, min(value) as min, max(value) as max, round(avg(value),6) as mean,
    round(stddev_samp(value),5) as std, round({SKEW},5) as skew, round(count(case when value=0 then 1 end)*100e0/count(value),4) as zero_pct, cast(count(distinct value) as bigint) as n_unique, round(quantile_cont(value,0.05),6) as p5, round(quantile_cont(value,0.25),6) as p25,
    round(median(value),6) as median, round(quantile_cont(value,0.75),6) as p75, round(quantile_cont(value,0.95),6) as p95, round(quantile_cont(value,0.75)-quantile_cont(value,0.25),6) as iqr from (select *, avg(value) over (partition by feature) as m from {LONG_F} f where value is not null) g group by 1) h""",
)
def f22(w):
    a = sm.describe_audit(w.features, FEATS)
    digits = {"mean": 6, "std": 5, "skew": 5, "zero_pct": 4, "p5": 6, "p25": 6, "median": 6, "p75": 6, "p95": 6, "iqr": 6}
    return a.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in a.columns])


@query(
    "f23_coverage_gate", "features",
    f"""with g as (select feature, district, count(*) as n, count(case when value is null then 1 end) as nn, count(case when value=0 then 1 end) as nz, sum(coalesce(value,0)) as tot, sum(case when district%25 in (0,1,2) then coalesce(value,0) else 0 end) as sub from {LONG_F} f group by 1,2)
    select feature, cast(sum(nn) as bigint) as n_null, cast(sum(nz) as bigint) as n_zero, round(sum(nz)*100e0/sum(n),2) as pct_zero, count(case when (nn+nz)*100e0/n>=99.9 then 1 end) as n_empty_groups, round(sum(sub)/nullif(sum(tot),0)*100,2) as subset_share_pct, coalesce(sum(sub)/nullif(sum(tot),0)>0.5,false) as concentrated from g group by 1""",
)
def f23(w):
    return sm.coverage_gate(w.features, FEATS, "district", (F.col("district") % 25).isin(0, 1, 2))


@query("f24_group_mean_median", "features", f"select district, feature, round(avg(value),8) as mean, round(median(value),6) as median from {LONG_F} f where value is not null group by 1,2")
def f24(w):
    q = o.wide_quantiles(w.features, FEATS, {"median": 0.5}, ["district"])
    m = o.unpivot(w.features, ["district"], FEATS).where(F.col("value").isNotNull()).groupBy("district", "feature").agg(F.round(F.avg("value"), 8).alias("mean"))
    return m.join(q, ["district", "feature"]).select("district", "feature", "mean", F.round("median", 6).alias("median"))


@query(
    "f25_concentration_bands", "access15",
    """with r as (select *, row_number() over (order by pop desc, grid_id)-1 as i, count(*) over () as n, coalesce(walk_food<=15,false) as ok from access15)
    select cast(p as integer) as pct, count(*) as n_cells, round(sum(pop)*100/(select sum(pop) from r),2) as pct_weight, round(sum(case when ok then pop else 0 end)*100/(select sum(case when ok then pop else 0 end) from r),2) as pct_flagged_weight,
    round(sum(case when ok then pop else 0 end)*100/sum(pop),2) as pct_flagged_within from r, (select unnest([10,20,30]) as p) ps where i<floor(n*p/100) group by 1""",
)
def f25(w):
    a = w.access15.withColumn("ok", F.coalesce(F.col("walk_food") <= 15, F.lit(False)))
    return sm.concentration_bands(a, "pop", "grid_id", "pop", "ok")


@query("f26_by_universe", "access15", "select universe, count(*) as n, round(sum(pop),1) as pop, count(case when walk_food<=15 then 1 end) as n_food from (select 'all' as universe, * from access15 union all select 'reliable', * from access15 where everyday_reliable union all select 'strict', * from access15 where everyday_reliable and transit_reliable) u group by 1")
def f26(w):
    e, t = F.col("everyday_reliable"), F.col("transit_reliable")
    return sm.by_universe(w.access15, {"all": F.lit(True), "reliable": e, "strict": e & t}, [F.count("*").alias("n"), F.round(F.sum("pop"), 1).alias("pop"), F.count_if(F.col("walk_food") <= 15).alias("n_food")])


CURVE = """(select category, lim as "limit", round(count(case when t<=lim then 1 end)*100e0/count(*),2) as pct_n, round(sum(case when t<=lim then pop else 0 end)*100/sum(pop),2) as pct_w from (
 select 'food' as category, walk_food as t, pop from access15 union all select 'healthcare', walk_healthcare, pop from access15 union all select 'education', walk_education, pop from access15) a, (select unnest([5e0,10e0,15e0]) as lim) l group by 1,2)"""


@query("f27_growth_curve", "access15", f'select *, round(pct_n-lag(pct_n) over w,2) as gain_n, round(pct_w-lag(pct_w) over w,2) as gain_w from {CURVE} c window w as (partition by category order by "limit")')
def f27(w):
    return curve(w)


def curve(w):
    return sm.growth_curve(w.access15, {n: f"walk_{n}" for n in ("food", "healthcare", "education")}, [5, 10, 15], "pop")


@query("f28_cliff_flags", "access15", f'select *, jump2>jump1*1.5 and jump2>5 as is_cliff from (select category, round(max(case when "limit"=10 then pct_w end)-max(case when "limit"=5 then pct_w end),2) as jump1, round(max(case when "limit"=15 then pct_w end)-max(case when "limit"=10 then pct_w end),2) as jump2 from {CURVE} c group by 1) d')
def f28(w):
    return sm.cliff_flags(curve(w), (5, 10, 15))


BOTTLE = "coalesce(nullif(concat_ws('+', case when not coalesce(walk_food<=15,false) then 'FOOD' end, case when not coalesce(walk_healthcare<=15,false) then 'HEALTHCARE' end, case when not coalesce(walk_education<=15,false) then 'EDUCATION' end),''),'COMPLETE')"


@query("f29_bottleneck_summary", "access15", f"select bottleneck, n, round(n*100e0/sum(n) over (),2) as pct_n, round(w,1) as w, round(w*100/sum(w) over (),2) as pct_w from (select {BOTTLE} as bottleneck, count(*) as n, sum(pop) as w from access15 group by 1) t")
def f29(w):
    a = w.access15.withColumn("bottleneck", s.join_labels(missing_flags(), "COMPLETE"))
    return sm.weighted_class_summary(a, ["bottleneck"], "pop").orderBy(F.desc("n"), "bottleneck")


@query("f30_day_concentration", "trip", "select count(*) as n_days, cast(sum(n) as bigint) as n_trips, round((select sum(n) from (select count(*) as n from trip group by cast(start_time as date) order by n desc, cast(start_time as date) limit 5) x)*100e0/sum(n),1) as top_share_pct, max(n) as busiest from (select count(*) as n from trip group by cast(start_time as date)) d")
def f30(w):
    return sm.day_concentration(w.trip, "start_time")


@query("f31_sparse_count_stats", "features", "select count(*) as n, count(case when n_stop>0 then 1 end) as n_nonzero, round(avg(case when n_stop>0 then n_stop end),4) as mean_nonzero, max(n_stop) as max_count, round(count(case when n_stop>0 then 1 end)*100e0/count(*),2) as pct_nonzero, median(case when n_stop>0 then n_stop end) as median_nonzero from features")
def f31(w):
    return sm.sparse_count_stats(w.features, "n_stop")


@query("f32_time_histogram", "trip", "select dayname(start_time) as weekday_name, cast(hour(start_time) as integer) as hour, count(*) as n from trip group by 1,2")
def f32(w):
    p = s.time_parts(F.col("start_time"))
    return w.trip.groupBy(p["weekday_name"].alias("weekday_name"), p["hour"].alias("hour")).agg(F.count("*").alias("n"))


@query(
    "f33_trips_vs_poi", "trip poi_cell",
    f"""select t.grid_id, t.n_trips, {', '.join(f"coalesce({c},0) as {c}" for c in "abcdefg")} from (select cast(floor(y/500)*40+floor(x/500) as bigint) as grid_id, count(*) as n_trips from trip group by 1) t left join
    (select grid_id, {', '.join(f"count(case when cat like '{c.upper()}%' then 1 end) as {c}" for c in "abcdefg")} from (select grid_id, {EVERYDAY_CASE} as cat from poi_cell) q group by 1) p on t.grid_id=p.grid_id""",
)
def f33(w):
    t = sp.point_to_cell(w.trip, 500.0).groupBy((F.col("iy") * 40 + F.col("ix")).alias("grid_id")).agg(F.count("*").alias("n_trips"))
    p = w.poi_cell.select("grid_id", s.first_match(s.EVERYDAY_RULES, F.col).alias("cat"))
    return sm.category_pivot(p, t, "grid_id", "cat", {c[0].lower(): c for c in s.EVERYDAY_CATEGORIES})


@query(
    "f34_zscore_outliers", "features",
    f"""with m as (select feature, avg(value) as mu, stddev_samp(value) as sd from {LONG_F} f group by 1), z as (select feature, grid_id, value, (value-mu)/nullif(sd,0) as z from {LONG_F} f join m using (feature) where value is not null)
    select feature, grid_id, value, round(z,5) as z from (select *, row_number() over (partition by feature order by abs(round(z,9)) desc, grid_id) as rn from z where abs(z)>2.5) t where rn<=20""",
)
def f34(w):
    return sm.zscore_outliers(w.features, "grid_id", FEATS, 2.5, 20).withColumn("z", F.round("z", 5))


FAMILY = {"n_poi": "POI", "sum_size": "POI", "n_trip": "DEMAND", "noise": "NOISE"}


def _bss_sql():
    fam = "case feature when 'n_poi' then 'POI' when 'sum_size' then 'POI' when 'n_trip' then 'DEMAND' else 'NOISE' end"
    return f"""(select feature, {fam} as family, round(bss,4) as bss, round(bss*100/sum(bss) over (),3) as pct, bss*100/sum(bss) over ()>20 as dominant from (
    select feature, sum(n*m*m)-sum(n*m)**2/sum(n) as bss from (select feature, la, count(*) as n, avg(value) as m from {LONG_L} l group by 1,2) g group by 1) b)"""


@query("f35_bss_by_feature", "cell_labels", f"select * from {_bss_sql()} t")
def f35(w):
    return sm.bss_by_feature(w.cell_labels, list(FAMILY), "la", FAMILY)


@query("f35b_family_bss", "cell_labels", f"select family, round(sum(pct),2) as pct, count(*) as n_features, round(round(sum(pct),2)/count(*),3) as pct_per_feature from {_bss_sql()} t group by 1")
def f35b(w):
    return sm.family_bss(sm.bss_by_feature(w.cell_labels, list(FAMILY), "la", FAMILY))


PROFILE = f"""(select q.la, q.feature, q1, med, q3, (select (count(case when l.value<q.med then 1 end)+count(case when l.value<=q.med then 1 end))*50e0/count(*) from {LONG_L} l where l.feature=q.feature) as pct
 from (select la, feature, quantile_cont(value,0.25) as q1, median(value) as med, quantile_cont(value,0.75) as q3 from {LONG_L} l group by 1,2) q)"""


@query("f36_percentile_profile", "cell_labels", f"select la, feature, round(q1,6) as q1, round(med,6) as median, round(q3,6) as q3, round(pct,1) as percentile, cast(row_number() over (partition by la order by abs(round(pct,1)-50) desc, feature) as integer) as rank from {PROFILE} p qualify rank<=3")
def f36(w):
    from pyspark.sql import Window

    p = sm.percentile_profile(w.cell_labels, list(FAMILY), "la").withColumn("percentile", F.round("percentile", 1))
    rn = F.row_number().over(Window.partitionBy("la").orderBy(F.desc(F.abs(F.col("percentile") - 50)), "feature"))
    p = p.withColumn("rank", rn).where(F.col("rank") <= 3)
    return p.select("la", "feature", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "percentile", "rank")


@query("f37_z_profile", "cell_labels", f"select la, feature, round((gm-m)/nullif(s,0),5) as z from (select la, feature, avg(value) as gm from {LONG_L} l group by 1,2) g join (select feature, avg(value) as m, stddev_pop(value) as s from {LONG_L} l group by 1) a using (feature)")
def f37(w):
    return sm.z_profile(w.cell_labels, list(FAMILY), "la").withColumn("z", F.round("z", 5))


@query(
    "f38_feed_quality", "grid stop",
    """with d as (select district, sum(land_area_m2)/1e6 as area_km2 from grid group by 1), n as (select g.district, count(*) as n from stop s join grid g on s.x>=g.x0 and s.x<g.x0+500 and s.y>=g.y0 and s.y<g.y0+500 group by 1),
    q as (select district, area_km2, coalesce(n,0) as total_stops, round(coalesce(n,0)/area_km2,3) as per_km2 from d left join n using (district)), m as (select median(per_km2) as med from q where total_stops>0)
    select district, round(area_km2,4) as area_km2, total_stops, per_km2, case when total_stops=0 then 'NO_FEED_COVERAGE' when district in (3,7) then 'SUSPECT_FEED_COVERAGE' when per_km2<med*0.25 then 'SUSPECT_FEED_COVERAGE' when per_km2<med*0.75 then 'USABLE_WITH_LIMITATION' else 'GOOD_COVERAGE' end as quality from q, m""",
)
def f38(w):
    d = w.grid.groupBy("district").agg((F.sum("land_area_m2") / 1e6).alias("area_km2"))
    st = sp.join_cells(w.stop.select("stop_id", "x", "y"), cells(w, "district"), 500.0)
    return sm.feed_quality(st, d, [3, 7]).withColumn("area_km2", F.round("area_km2", 4))


@query(
    "f39_table_diff", "features",
    """select 'n_poi' as "column", count(*) as n_compared, count(case when grid_id%7=0 then 1 end) as n_changed, (select count(*) from features where grid_id%11=0) as n_only_a, cast(0 as bigint) as n_only_b from features where grid_id%11<>0
    union all select 'elev', count(*), count(case when elev is not null and grid_id%5=0 then 1 end), (select count(*) from features where grid_id%11=0), 0 from features where grid_id%11<>0""",
)
def f39(w):
    a = w.features.select("grid_id", "n_poi", "elev")
    b = a.where(F.col("grid_id") % 11 != 0).select("grid_id", (F.col("n_poi") + F.when(F.col("grid_id") % 7 == 0, 1).otherwise(0)).alias("n_poi"), F.when(F.col("grid_id") % 5 != 0, F.col("elev")).alias("elev"))
    return sm.table_diff(a, b, "grid_id", ["n_poi", "elev"])


@query("f40_null_audit", "features", f"select feature, count(case when value is null then 1 end) as n_null, cast(0 as bigint) as n_inf, min(value)=max(value) as is_constant, round(count(case when value=0 then 1 end)*100e0/count(*),2) as zero_pct from {LONG_F} f group by 1")
def f40(w):
    return sm.null_audit(w.features, FEATS)


@query(
    "f41_rollup_profile", "cell_labels access15",
    """with c as (select l.district, l.lb, sum(a.pop) as pop from cell_labels l join access15 a using (grid_id) group by 1,2), d as (select l.district, round(sum(a.pop),1) as pop, round(avg(a.score),6) as mean_score, round(count(case when a.everyday_reliable then 1 end)*100e0/count(*),2) as pct_reliable,
    case when count(case when a.everyday_reliable then 1 end)<50 then 'INSUFFICIENT_DATA' else 'OK' end as status from cell_labels l join access15 a using (grid_id) group by 1)
    select d.*, m as dominant_class, comp as composition from d join (select district, arg_min(lb, -n*1000+lb) as m from (select district, lb, count(*) as n from cell_labels group by 1,2) x group by 1) m using (district)
    join (select district, string_agg(concat(lb,':',cast(round(pop) as bigint)), ',' order by lb) as comp from c group by 1) k using (district)""",
)
def f41(w):
    j = w.cell_labels.select("grid_id", "lb").join(w.access15, "grid_id")
    good = F.count_if("everyday_reliable")
    d = j.groupBy("district").agg(
        F.round(F.sum("pop"), 1).alias("pop"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(good / F.count("*") * 100, 2).alias("pct_reliable"),
        F.when(good < 50, "INSUFFICIENT_DATA").otherwise("OK").alias("status"),
    )
    mode = sm.mode_per_group(j, "district", "lb").select("district", F.col("lb").alias("dominant_class"))
    # the closed class list bounds the collected entries per district
    comp = j.groupBy("district", "lb").agg(F.sum("pop").alias("p")).groupBy("district").agg(F.sort_array(F.collect_list(F.struct("lb", "p"))).alias("e"))
    text = F.concat_ws(",", F.transform("e", lambda e: F.concat(e.lb, F.lit(":"), F.round(e.p).cast("long"))))
    return d.join(mode, "district").join(comp.select("district", text.alias("composition")), "district")
