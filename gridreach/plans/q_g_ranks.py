"""Ranks, bands, top-k, set operations."""

from pyspark.sql import functions as F

from gridreach.functions import scalars as s
from gridreach.operators import cells as ce
from gridreach.operators import graph as gr
from gridreach.operators import ordered as o
from gridreach.operators import relational as rel
from gridreach.operators import spatial as sp
from gridreach.plans.q_c_joins import LONG_SCORES, VARIANTS, cells
from gridreach.plans.registry import query


@query("g1_pct_rank_min", "", "select o_orderkey, round(percent_rank() over (order by o_totalprice),9) as r from orders")
def g1(w):
    return o.pct_rank_min(w.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "r").select("o_orderkey", F.round("r", 9).alias("r"))


@query("g2_pct_rank_avg", "", "select l_orderkey, l_linenumber, l_partkey, round((rank() over (order by l_quantity)+(count(*) over (partition by l_quantity)-1)/2e0)/count(*) over (),9) as r from lineitem")
def g2(w):
    r = o.pct_rank_avg(w.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_quantity", "r")
    return r.select("l_orderkey", "l_linenumber", "l_partkey", F.round("r", 9).alias("r"))


@query("g3_value_functions", "features", "select grid_id, round(sqrt(r),8) as benefit, round(sqrt(1-r),8) as cost, round(r,8) as linear from (select grid_id, percent_rank() over (order by n_poi) as r from features) f")
def g3(w):
    r = o.pct_rank_min(w.features.select("grid_id", "n_poi"), "n_poi", "r")
    return r.select("grid_id", F.round(s.benefit(F.col("r")), 8).alias("benefit"), F.round(s.cost(F.col("r")), 8).alias("cost"), F.round("r", 8).alias("linear"))


PIECES = "(select g.grid_id, d.district, (least(g.x0+500,d.x1)-greatest(g.x0,d.x0))*(least(g.y0+500,d.y1)-greatest(g.y0,d.y0)) as area from grid g join district_box d on g.x0<d.x1 and g.x0+500>d.x0 and g.y0<d.y1 and g.y0+500>d.y0)"


def district_pieces(w):
    return sp.overlay_boxes(w.district_box, cells(w), 500.0).select("grid_id", "district", F.col("piece_area").alias("area"))


# Areas in whole square metres (corners stand on quarters and the like), added up by cell and kind of land use.
KINDS = "(select g.grid_id, l.kind as district, sum((least(g.x0+500,l.x1)-greatest(g.x0,l.x0))*(least(g.y0+500,l.y1)-greatest(g.y0,l.y0))) as area from grid g join landuse l on g.x0<l.x1 and g.x0+500>l.x0 and g.y0<l.y1 and g.y0+500>l.y0 group by 1,2)"


def kind_pieces(w):
    p = sp.overlay_boxes(w.landuse, cells(w), 500.0)
    return p.groupBy("grid_id", F.col("kind").alias("district")).agg(F.sum("piece_area").alias("area"))


@query("g4_rank_first", "grid landuse", f"select grid_id, district, area from (select *, row_number() over (partition by grid_id order by area desc, district) as rn from {KINDS} p) q where rn=1")
def g4(w):
    return o.first_row(kind_pieces(w), ["grid_id"], [-F.col("area"), F.col("district")])


@query(
    "g5_assign_district", "grid landuse",
    f"""with r as (select *, row_number() over (partition by grid_id order by area desc, district) as rn, sum(area) over (partition by grid_id) as total from {KINDS} p),
    j as (select g.grid_id, g.land_area_m2 as la, a.district, b.district as second_district, a.area as a1, coalesce(b.area,0) as a2, a.total from grid g left join (select * from r where rn=1) a using (grid_id) left join (select * from r where rn=2) b using (grid_id))
    select grid_id, district, second_district, round(a1/la*100,6) as district_overlap_pct, round(a2/la*100,6) as second_overlap_pct, coalesce(a2>0 and a2/a1>=0.2,false) as ambiguous_district, la-coalesce(total,0) as overlap_vs_land_diff_m2 from j""",
)
def g5(w):
    d = ce.assign_district(w.grid.select("grid_id", "land_area_m2"), kind_pieces(w))
    return d.select("grid_id", "district", "second_district", F.round("district_overlap_pct", 6).alias("district_overlap_pct"), F.round("second_overlap_pct", 6).alias("second_overlap_pct"), "ambiguous_district", "overlap_vs_land_diff_m2")


# Land as far as pixels with a height cover a cell: 9 to 16 pixels of 25,600 square metres begin in each.
LAND = "(select grid_id, ix, iy, coalesce(n,0)*25600e0 as land_area_m2 from grid left join (select cast(floor(y0/500)*40+floor(x0/500) as bigint) as grid_id, count(elev) as n from pixel group by 1) p using (grid_id))"


@query("g6_retain_cells", "grid pixel", f"select grid_id, concat('GRID_',lpad(cast(row_number() over (order by ix,iy)-1 as varchar),5,'0')) as cell_name from {LAND} g where land_area_m2/250000*100>=95")
def g6(w):
    px = w.pixel.select(F.col("x0").alias("x"), F.col("y0").alias("y"), "elev")
    land = sp.point_to_cell(px, 500.0).groupBy("ix", "iy").agg((F.count("elev") * 25600.0).alias("land_area_m2"))
    g = w.grid.select("grid_id", "ix", "iy").join(land, ["ix", "iy"], "left").na.fill(0.0, ["land_area_m2"])
    return ce.retain_cells(g, 250000.0, 0.95).select("grid_id", "cell_name")


@query("g7_quartile_bands", "features", "with q as (select quantile_cont(pop,0.25) as a, quantile_cont(pop,0.5) as b, quantile_cont(pop,0.75) as c from features) select grid_id, case when pop<=a then 'LOW' when pop<=b then 'MID_LOW' when pop<=c then 'MID_HIGH' else 'HIGH' end as band from features, q")
def g7(w):
    return o.quantile_bands(w.features.select("grid_id", "pop"), "pop", ["LOW", "MID_LOW", "MID_HIGH", "HIGH"]).select("grid_id", "band")


@query("g8_top_decile", "cell_scores", "select grid_id, " + ", ".join(f"{v}>=(select quantile_cont({v},0.9) from cell_scores) as top_{v}" for v in VARIANTS) + " from cell_scores")
def g8(w):
    return o.top_decile_flags(w.cell_scores, VARIANTS).select("grid_id", *[f"top_{v}" for v in VARIANTS])


@query("g9_top_k_per_group", "features", "select district, grid_id, n_trip from (select district, grid_id, n_trip, row_number() over (partition by district order by n_trip desc, grid_id) as rn from features) t where rn<=5")
def g9(w):
    return o.top_k(w.features.select("district", "grid_id", "n_trip"), [F.desc("n_trip"), F.col("grid_id")], 5, ["district"])


@query("g9b_top_k", "", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 500")
def g9b(w):
    return o.top_k(w.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 500)


@query("g10_argmax_row", "features", "select district, arg_min(grid_id, -pop*1e7+grid_id) as grid_id, max(pop) as pop from features group by 1")
def g10(w):
    return o.first_row(w.features.select("district", "grid_id", "pop"), ["district"], [-F.col("pop"), F.col("grid_id")])


@query(
    "g11_largest_log_gap", "features",
    "with s as (select cast(pop as bigint) as n, count(*) as k from features where pop>0 group by 1), g as (select n, lead(n) over (order by n desc) as below, log10(n)-log10(lead(n) over (order by n desc)) as gap from s) select n, below, round(gap,6) as gap, gap>1 as is_break from g order by gap desc nulls last, n desc limit 1",
)
def g11(w):
    return gr.largest_log_gap(w.features.where(F.col("pop") > 0).select(F.col("pop").cast("long").alias("n")), "n")


@query("g12_argmax_factor", "features", "select grid_id, case when n_poi>=n_trip and n_poi>=n_stop then 'n_poi' when n_trip>=n_stop then 'n_trip' else 'n_stop' end as driver from features")
def g12(w):
    return w.features.select("grid_id", s.argmax_name({c: F.col(c) for c in ("n_poi", "n_trip", "n_stop")}).alias("driver"))


@query("h1_union_layers", "poi stop", "select 'poi' as source, poi_id as id, amenity, cast(null as varchar) as mode_name from poi union all select 'stop', stop_id, null, mode_name from stop")
def h1(w):
    return rel.union_layers({"poi": w.poi.select(F.col("poi_id").alias("id"), "amenity"), "stop": w.stop.select(F.col("stop_id").alias("id"), "mode_name")})


@query("h2_distinct", "", "select distinct l_orderkey, l_suppkey from lineitem")
def h2(w):
    return w.lineitem.select("l_orderkey", "l_suppkey").distinct()


@query("h3_except_intersect", "poi_cell trip", "select 'only_poi' as kind, count(*) as n from (select grid_id from poi_cell except select cast(floor(y/500)*40+floor(x/500) as bigint) from trip) a union all select 'both', count(*) from (select grid_id from poi_cell intersect select cast(floor(y/500)*40+floor(x/500) as bigint) from trip) b")
def h3(w):
    a = w.poi_cell.select("grid_id")
    b = w.trip.select((F.floor(F.col("y") / 500) * 40 + F.floor(F.col("x") / 500)).alias("grid_id"))
    only = a.subtract(b).agg(F.lit("only_poi").alias("kind"), F.count("*").alias("n"))
    return only.unionByName(a.intersect(b).agg(F.lit("both").alias("kind"), F.count("*").alias("n")))


TOPS = "(select x.grid_id, x.i, x.v, x.s>=q.q as top from " + LONG_SCORES + " x join (select v, quantile_cont(s,0.9) as q from " + LONG_SCORES + " y group by 1) q on x.v=q.v)"


@query("h4_jaccard_matrix", "cell_scores", f"select a.v as a, b.v as b, count(case when a.top and b.top then 1 end) as n_both, count(case when a.top or b.top then 1 end) as n_either, round(count(case when a.top and b.top then 1 end)*1e0/count(case when a.top or b.top then 1 end),6) as jaccard from {TOPS} a join {TOPS} b on a.grid_id=b.grid_id and a.i<b.i group by 1,2")
def h4(w):
    return rel.jaccard_matrix(_flags(w), VARIANTS).withColumn("jaccard", F.round("jaccard", 6))


def _flags(w):
    f = o.top_decile_flags(w.cell_scores, VARIANTS)
    return f.select("grid_id", *[F.col(f"top_{v}").alias(v) for v in VARIANTS])


@query("h5_entries_exits", "cell_scores", f"select count(case when not a.top and b.top then 1 end) as entries, count(case when a.top and not b.top then 1 end) as exits, count(case when a.top and b.top then 1 end) as stay from {TOPS} a join {TOPS} b on a.grid_id=b.grid_id where a.i=0 and b.i=1")
def h5(w):
    return rel.entries_exits(_flags(w), VARIANTS[0], VARIANTS[1])
