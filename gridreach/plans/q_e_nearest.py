"""Nearest neighbours and deduplication."""

from pyspark.sql import functions as F

from gridreach.operators import dedup as dd
from gridreach.operators import spatial as sp
from gridreach.plans.q_c_joins import cells, centres
from gridreach.plans.registry import query

D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)"


@query("e1_nearest_stop", "grid stop", f"select a.grid_id, round(sqrt(min({D2})),4) as dist from (select grid_id, x0+250 as x, y0+250 as y from grid) a cross join stop b group by 1")
def e1(w):
    return sp.nearest(centres(w), "grid_id", w.stop, "stop_id", start=1000.0).select("grid_id", F.round("dist", 4).alias("dist"))


@query("e1b_nearest_by_mode", "poi stop", f"select a.poi_id, b.mode_name, round(sqrt(min({D2})),4) as dist from poi a cross join stop b where b.mode_name in ('metro','tram') group by 1,2")
def e1b(w):
    n = sp.nearest_by_group(w.poi, "poi_id", w.stop, "mode_name", ["metro", "tram", "funicular"], "stop_id", start=2000.0)
    return n.select("poi_id", "mode_name", F.round("dist", 4).alias("dist"))


@query(
    "e2_anchor_nodes", "grid node",
    # all squared distances are whole numbers here, so equality with the minimum is exact
    """with m as (select a.grid_id, any_value(a.x0) as x0, any_value(a.y0) as y0, min((a.x0+250-b.x)*(a.x0+250-b.x)+(a.y0+250-b.y)*(a.y0+250-b.y)) as d2 from grid a cross join node b group by 1),
    n as (select m.grid_id, min(m.d2) as d2, min(b.node_id) as node_id from m cross join node b where (m.x0+250-b.x)*(m.x0+250-b.x)+(m.y0+250-b.y)*(m.y0+250-b.y)=m.d2 group by 1)
    select grid_id, node_id, round(sqrt(d2),2) as snap_distance_m, grid_id in (select cast(floor(y/500)*40+floor(x/500) as bigint) from node) as has_local_node,
    case when round(sqrt(d2),2)<=100 then 'DIRECT' when round(sqrt(d2),2)<=300 then 'NEARBY' when round(sqrt(d2),2)<=1000 then 'LARGE_SNAP' else 'QUESTIONABLE' end as snap_quality from n""",
)
def e2(w):
    from gridreach.functions.scalars import snap_class

    near = sp.nearest(centres(w), "grid_id", w.node, "node_id", start=250.0)
    local = sp.join_cells(w.node, cells(w), 500.0).select("grid_id").distinct().withColumn("has_local_node", F.lit(True))
    out = near.join(local, "grid_id", "left")
    return out.select(
        "grid_id", "node_id", F.bround("dist", 2).alias("snap_distance_m"),
        F.coalesce("has_local_node", F.lit(False)).alias("has_local_node"), snap_class(F.col("dist")).alias("snap_quality"),
    )


@query(
    "e3_nearest_segment", "stop cycleway",
    """select stop_id, round(min(sqrt((x-x1-t*(x2-x1))**2+(y-y1-t*(y2-y1))**2)),4) as dist from (select *, greatest(0,least(1,coalesce(((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/nullif((x2-x1)**2+(y2-y1)**2,0),0))) as t from stop cross join cycleway) a group by 1""",
)
def e3(w):
    return sp.nearest_segment(w.stop, "stop_id", w.cycleway, "line_id", 500.0).select("stop_id", F.round("dist", 4).alias("dist"))


@query(
    "e4_dedup_near_ways", "poi_cell",
    f"select poi_id, cat, element from poi_cell a where element='way' or not exists (select 1 from poi_cell b where b.element='way' and b.cat=a.cat and {D2}<=150*150)",
)
def e4(w):
    return dd.dedup_points_near_ways(w.poi_cell, "poi_id", "cat", F.col("element") == "node", 150.0).select("poi_id", "cat", "element")


@query(
    "e5_dedup_greedy", "stop",
    f"""with recursive pairs as (select a.stop_id as a, b.stop_id as b from stop a join stop b on a.mode=b.mode and b.stop_id<a.stop_id and {D2}<=2500*2500),
    walk as (select (select min(stop_id) from stop)-1 as i, cast([] as bigint[]) as kept union all
    select n.stop_id, case when exists (select 1 from pairs p where p.a=n.stop_id and list_contains(w.kept, p.b)) then w.kept else list_append(w.kept, n.stop_id) end
    from walk w join stop n on n.stop_id=w.i+1) select unnest(kept) as stop_id from walk where i=(select max(stop_id) from stop)""",
)
def e5(w):
    return dd.dedup_greedy(w.stop, "stop_id", "mode", 2500.0).select("stop_id")


def near_share_sql(segs, ids, ref, buf):
    """(ids, covered): share of each segment within buf of any reference, from the closed form of each pair's interval."""
    i = ", ".join(ids)
    return f"""(with sg as {segs}, rf as (select distinct x1 as cx, y1 as cy, x2 as dx, y2 as dy from {ref} r),
     pr as (select {i}, x1 as ax, y1 as ay, x2-x1 as ux, y2-y1 as uy, cx, cy, dx, dy, sqrt((dx-cx)**2+(dy-cy)**2) as l from sg join rf on least(x1,x2)<=greatest(cx,dx)+{buf} and least(cx,dx)<=greatest(x1,x2)+{buf} and least(y1,y2)<=greatest(cy,dy)+{buf} and least(cy,dy)<=greatest(y1,y2)+{buf}),
     q as (select *, ux*ux+uy*uy as uu, (ax-cx)*ux+(ay-cy)*uy as b0, (ax-cx)**2+(ay-cy)**2-{buf}*{buf} as c0, (ax-dx)*ux+(ay-dy)*uy as b1, (ax-dx)**2+(ay-dy)**2-{buf}*{buf} as c1,
      ((ax-cx)*(dy-cy)-(ay-cy)*(dx-cx))/nullif(l,0) as pa, (ux*(dy-cy)-uy*(dx-cx))/nullif(l,0) as sa, ((ax-cx)*(dx-cx)+(ay-cy)*(dy-cy))/nullif(l,0) as pl, (ux*(dx-cx)+uy*(dy-cy))/nullif(l,0) as sl from pr where ux<>0 or uy<>0),
     e as (select {i}, case when b0*b0-uu*c0>=0 then (-b0-sqrt(b0*b0-uu*c0))/uu end as lo0, case when b0*b0-uu*c0>=0 then (-b0+sqrt(b0*b0-uu*c0))/uu end as hi0, case when b1*b1-uu*c1>=0 then (-b1-sqrt(b1*b1-uu*c1))/uu end as lo1, case when b1*b1-uu*c1>=0 then (-b1+sqrt(b1*b1-uu*c1))/uu end as hi1,
      case when l>0 then greatest(case when sa<>0 then least((-{buf}-pa)/sa,({buf}-pa)/sa) when abs(pa)<={buf} then 0 else 2 end, case when sl<>0 then least(-pl/sl,(l-pl)/sl) when pl>=0 and pl<=l then 0 else 2 end) end as lo2,
      case when l>0 then least(case when sa<>0 then greatest((-{buf}-pa)/sa,({buf}-pa)/sa) when abs(pa)<={buf} then 1 else -1 end, case when sl<>0 then greatest(-pl/sl,(l-pl)/sl) when pl>=0 and pl<=l then 1 else -1 end) end as hi2 from q),
     f as (select *, greatest(lo0,0) as a0, least(hi0,1) as z0, greatest(lo1,0) as a1, least(hi1,1) as z1, greatest(lo2,0) as a2, least(hi2,1) as z2 from e),
     h as (select {i}, least(case when lo0 is not null and a0<=z0 then a0 end, case when lo1 is not null and a1<=z1 then a1 end, case when lo2 is not null and a2<=z2 then a2 end) as t0, greatest(case when lo0 is not null and a0<=z0 then z0 end, case when lo1 is not null and a1<=z1 then z1 end, case when lo2 is not null and a2<=z2 then z2 end) as t1 from f),
     o as (select *, max(t1) over (partition by {i} order by t0, t1 rows between unbounded preceding and 1 preceding) as m from h where t0<t1)
     select {i}, sum(greatest(0, t1-greatest(t0, coalesce(m, t0)))) as covered from o group by {i})"""


_E6 = "(select l_orderkey as line_id, x1, y1, x2, y2, sum(sqrt((x2-x1)**2+(y2-y1)**2)) as len from road where highway='residential' group by 1,2,3,4,5)"


@query(
    "e6_drop_overlapping_lines", "road cycleway",
    f"""with sg as {_E6}, n as (select line_id, sum(covered*len) as near from {near_share_sql(_E6, ["line_id", "x1", "y1", "x2", "y2", "len"], "cycleway", "60e0")} c group by 1), bad as (select line_id from (select line_id, sum(len) as total from sg group by 1) t join n using (line_id) where near/nullif(total,0)>0.5)
    select l_orderkey as line_id, count(*) as n_segments from road where highway='residential' and l_orderkey not in (select line_id from bad) group by 1""",
)
def e6(w):
    cand = w.road.where(F.col("highway") == "residential").select(F.col("l_orderkey").alias("line_id"), "x1", "y1", "x2", "y2")
    out = dd.drop_overlapping(cand, "line_id", w.cycleway, 60.0, 0.5)
    return out.groupBy("line_id").agg(F.count("*").alias("n_segments"))


@query("e7_exact_duplicates", "road", "select count(*) as n_rows, cast(count(distinct concat_ws('|',x1,y1,x2,y2)) as bigint) as n_distinct, cast(count(*)-count(distinct concat_ws('|',x1,y1,x2,y2)) as bigint) as n_duplicates from road")
def e7(w):
    return dd.dup_counts(w.road, ["x1", "y1", "x2", "y2"])


@query("e8_to_undirected", "edge undirected", "select distinct least(src,dst) as src, greatest(src,dst) as dst, length_m from undirected")
def e8(w):
    return dd.to_undirected(w.undirected)


@query(
    "e9_knn_graph", "stop",
    f"select stop_id, near_id, cast(rank as integer) as rank, round(sqrt(d2),4) as dist from (select a.stop_id, b.stop_id as near_id, {D2} as d2, row_number() over (partition by a.stop_id order by sqrt({D2}), b.stop_id) as rank from stop a join stop b on a.stop_id<>b.stop_id) n where rank<=5",
)
def e9(w):
    n = sp.nearest(w.stop, "stop_id", w.stop, "stop_id", k=5, start=2000.0, exclude_self=True)
    return n.select("stop_id", F.col("near_stop_id").alias("near_id"), "rank", F.round("dist", 4).alias("dist"))
