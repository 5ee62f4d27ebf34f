"""Network reachability, components, contiguity."""

from pyspark.sql import functions as F

from gridreach.functions import scalars as s
from gridreach.operators import cells as ce
from gridreach.operators import graph as gr
from gridreach.operators import spatial as sp
from gridreach.operators import summary as sm
from gridreach.plans.q_c_joins import cells
from gridreach.plans.registry import query

WALK_SQL = "(select least(src,dst) as a, greatest(src,dst) as b, length_m from edge where highway not in ('motorway','cycleway') and coalesce(foot,'')<>'no')"
WALK2 = f"(select a as src, b as dst, length_m from {WALK_SQL} e union all select b, a, length_m from {WALK_SQL} e)"
# Times in whole tenths of a second would be inexact; metres are exact, so SQL works in metres: 15 min at 5 km/h = 1250 m.
REACH = f"""reach as (select node_id as source, node_id as node, 0e0 as m from origin union select r.source, e.dst, r.m+e.length_m from reach r join w2 e on r.node=e.src where r.m+e.length_m<=1250),
best as (select source, node, min(m) as m from reach group by 1,2)"""
WITH_REACH = f"with recursive w2 as (select * from {WALK2} w), {REACH} "


def walk_graph(w):
    return gr.build_mode_graph(w.edge, s.WALK_EXCLUDE, gr.WALK_KMH, directed=False)


def cycle_graph(w):
    return gr.build_mode_graph(w.edge, s.CYCLE_EXCLUDE, gr.CYCLE_KMH, directed=True)


def walk_times(w, minutes=15, ends=None):
    return gr.reach(walk_graph(w), w.origin.select("node_id"), minutes * 60.0, ends=ends)


@query("i1_build_walk_graph", "edge", f"select src, dst, length_m, round(length_m/(5/3.6e0),6) as time_s from {WALK2} w")
def i1(w):
    return walk_graph(w).withColumn("time_s", F.round("time_s", 6))


@query("i1b_build_cycle_graph", "edge", "with e as (select * from edge where highway not in ('motorway','footway','steps')) select src, dst, length_m from e union all select dst, src, length_m from e where oneway<>'yes'")
def i1b(w):
    return cycle_graph(w).drop("time_s")


@query("i2_reach_15min", "edge origin", WITH_REACH + "select source, node, round(m/(5/3.6e0),3) as t from best")
def i2(w):
    return walk_times(w).select("source", "node", F.round("t", 3).alias("t"))


@query("i3_thresholds", "edge origin", WITH_REACH + "select source, mins as minutes, count(*) as n_nodes from best, (select unnest([5,10,15]) as mins) t where m<=mins*60*5/3.6e0+1e-6 group by 1,2")
def i3(w):
    return gr.by_threshold(walk_times(w), [5, 10, 15]).groupBy("source", "minutes").agg(F.count("*").alias("n_nodes"))


@query("i4_reachable_edges", "edge origin", WITH_REACH + f"select x.source, count(*) as n_edges from {WALK_SQL} e join best x on e.a=x.node join best y on e.b=y.node and x.source=y.source group by 1")
def i4(w):
    one_way = gr.to_undirected(walk_graph(w).select("src", "dst", "length_m"))
    return gr.reachable_edges(one_way, walk_times(w)).groupBy("source").agg(F.count("*").alias("n_edges"))


@query("i5_reachable_cells", "edge origin", WITH_REACH + "select b.source, o.grid_id, round(b.m/(5/3.6e0),3) as t from best b join origin o on b.node=o.node_id")
def i5(w):
    return walk_times(w, ends=gr.cell_ends(w.origin)).select("source", "grid_id", F.round("t", 3).alias("t"))


CATS = {"food": 0, "health": 1, "edu": 2, "retail": 3, "green": 4, "culture": 5, "finance": 6, "sport": 7}


CYCLE2 = "(select src, dst, length_m from edge where highway not in ('motorway','footway','steps') union all select dst, src, length_m from edge where highway not in ('motorway','footway','steps') and oneway<>'yes')"
# 15 min at 15 km/h = 3750 m; one settled value for each source and node.
WITH_CYCLE = f"""with recursive w2 as (select * from {CYCLE2} w), best(source, node, m) using key (source, node) as (select node_id, node_id, 0e0 from origin
 union select b.source, e.dst, min(b.m+e.length_m) from best b join w2 e on b.node=e.src left join recurring.best k on k.source=b.source and k.node=e.dst where b.m+e.length_m<=3750 and (k.m is null or b.m+e.length_m<k.m) group by 1,2) """


def cycle_times(w, minutes=15, ends=None):
    return gr.reach(cycle_graph(w), w.origin.select("node_id"), minutes * 60.0, ends=ends)


def _access_sql(kmh=5):
    parts = []
    for n, v in CATS.items():
        parts.append(f"round_even(min(case when cat={v} then m end)/({kmh}/3.6e0)/60,3) as {n}_nearest_min")
        for t in (5, 10, 15):
            lim = f"cat={v} and m<={t}*60*{kmh}/3.6e0+1e-6"
            parts += [f"cast(coalesce(sum(case when {lim} then n end),0) as bigint) as {n}_count_{t}", f"coalesce(sum(case when {lim} then n end),0)>0 as {n}_access_{t}"]
    return ", ".join(parts)


@query(
    "i6_category_access", "edge origin dest",
    WITH_REACH + f", d as (select node_id as node, cat, count(*) as n from dest where snap_status<>'QUESTIONABLE' group by 1,2) select o.grid_id, {_access_sql()} from origin o left join (select source, cat, n, m from best join d using (node)) h on h.source=o.node_id group by 1",
)
def i6(w):
    return gr.category_summary(walk_times(w, ends=gr.category_ends(w.dest)), w.origin, CATS, [5, 10, 15])


@query("i2c_cycle_reach", "edge origin", WITH_CYCLE + "select source, node, round_even(m/(15/3.6e0),3) as t from best")
def i2c(w):
    return cycle_times(w).select("source", "node", F.bround("t", 3).alias("t"))


@query(
    "i6c_cycle_category_access", "edge origin dest",
    WITH_CYCLE + f", d as (select node_id as node, cat, count(*) as n from dest where snap_status<>'QUESTIONABLE' group by 1,2) select o.grid_id, {_access_sql(15)} from origin o left join (select source, cat, n, m from best join d using (node)) h on h.source=o.node_id group by 1",
)
def i6c(w):
    return gr.category_summary(cycle_times(w, ends=gr.category_ends(w.dest)), w.origin, CATS, [5, 10, 15])


def _system_sql(kmh):
    return f""", sn as (select cast(floor(y/160)*120+least(floor(x/160),119) as bigint) as node, count(*) as na, count(case when mode_name in ('metro','tram','rail','metrobus') then 1 end) as nb from stop where floor(y/160)*120+least(floor(x/160),119)<=(select max(o_orderkey) from orders) group by 1)
    select o.grid_id, round_even(min(case when na>0 then m end)/({kmh}/3.6e0)/60,3) as all_nearest_min, cast(coalesce(sum(case when m<=10*60*{kmh}/3.6e0+1e-6 then na end),0) as bigint) as all_count_10, cast(coalesce(sum(na),0) as bigint) as all_count_15,
    round_even(min(case when nb>0 then m end)/({kmh}/3.6e0)/60,3) as fixed_nearest_min, cast(coalesce(sum(case when m<=10*60*{kmh}/3.6e0+1e-6 then nb end),0) as bigint) as fixed_count_10, cast(coalesce(sum(nb),0) as bigint) as fixed_count_15
    from origin o left join (select source, na, nb, m from best join sn using (node)) h on h.source=o.node_id group by 1"""


def _system_access(w, times_of):
    nid = F.floor(F.col("y") / 160) * 120 + F.least(F.floor(F.col("x") / 160), F.lit(119))
    st = w.stop.withColumn("node_id", nid).join(w.node.select("node_id"), "node_id", "left_semi")
    systems = {"all": F.lit(True), "fixed": F.col("mode_name").isin("metro", "tram", "rail", "metrobus")}
    return gr.system_summary(times_of(w, ends=gr.system_ends(st, systems)), w.origin, systems, [10, 15])


@query("i7_system_access", "edge origin stop node", WITH_REACH + _system_sql(5))
def i7(w):
    return _system_access(w, walk_times)


@query("i7c_cycle_system_access", "edge origin stop node", WITH_CYCLE + _system_sql(15))
def i7c(w):
    return _system_access(w, cycle_times)


# Pairs about 20 to 30 blocks apart, forwards or, near the end, backwards; the lattice falls into two halves, so some have no route, and some targets are no node.
_OFF = "((c_custkey%7)*3+(3+c_custkey%9)*120)"
PAIRS = f"(select c_custkey as pair_id, c_custkey*10+1 as source, c_custkey*10+1+case when c_custkey%20=0 or c_custkey*10+1+{_OFF}<=(select max(o_orderkey) from orders) then {_OFF} else -{_OFF} end as target from customer)"


# Edges weigh their length in millionths of a metre plus one node, so the least weight is the shortest route, fewest nodes on a tie.
@query(
    "i8_route_report", "edge node",
    f"""with recursive w2 as (select src, dst, cast(length_m as bigint)*1000000+1 as c from {WALK2} w), p as (select * from {PAIRS} p),
    r(pair_id, node, c) using key (pair_id, node) as (select pair_id, source, cast(1 as bigint) from p join node on node_id=source
     union select r.pair_id, e.dst, min(r.c+e.c) from r join w2 e on e.src=r.node left join recurring.r k on k.pair_id=r.pair_id and k.node=e.dst
     where r.c+e.c<=9000999999 and (k.c is null or r.c+e.c<k.c) group by 1,2),
    d as (select p.*, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as s, r.c//1000000 as m, r.c%1000000 as n from p left join node a on a.node_id=source left join node b on b.node_id=target left join r on r.pair_id=p.pair_id and r.node=target)
    select pair_id, source, target, case when s is null then 'NODE_NOT_IN_GRAPH' when m is null then 'ROUTE_NOT_FOUND' else 'OK' end as status,
     round_even(s,1) as straight_line_m, round_even(m*1e0,1) as network_m, round_even(m/nullif(s,0),3) as ratio, round_even(m/(5/3.6e0)/60,2) as time_min, cast(n as integer) as n_path_nodes from d""",
)
def i8(w):
    off = (F.col("c_custkey") % 7) * 3 + (3 + F.col("c_custkey") % 9) * 120
    source, last = F.col("c_custkey") * 10 + 1, w.orders.agg(F.max("o_orderkey")).scalar()
    target = source + F.when((F.col("c_custkey") % 20 == 0) | (source + off <= last), off).otherwise(-off)
    p = w.customer.select(F.col("c_custkey").alias("pair_id"), source.alias("source"), target.alias("target"))
    return gr.route_report(walk_graph(w), w.node, p)


def _flood_sql(edges: str, nodes: str = "select node_id as n from node") -> str:
    """Smallest reachable id of every node: c(node, component)."""
    return f"""with recursive g as ({edges}), c(node, component) using key (node) as (select n, n from ({nodes}) s
     union select g.dst, min(c.component) from c join g on g.src=c.node join recurring.c k on k.node=g.dst where c.component<k.component group by 1)"""


_STATS = """, z as (select count(*) as n from c group by component), t as (select string_agg(n::varchar, ',' order by n desc) as top10 from (select n from z order by n desc limit 10) u)
    select count(*) as n_components, max(n) as largest, round(max(n)*1e0/sum(n),4) as largest_share, count(case when n=1 then 1 end) as n_singletons, any_value(top10) as top10 from z, t"""


@query("i9_components", "edge node", _flood_sql(f"select src, dst from {WALK2} w") + _STATS)
def i9(w):
    return gr.component_stats(gr.components(walk_graph(w), w.node.select("node_id")))


# Strips of the lattice with known components: horizontal edges only, cut by the removed ones.
ROWS_SQL = """(select node_id as node, max(case when is_start then node_id end) over (order by node_id) as component from (
 select n.node_id, not exists (select 1 from edge e where e.d=0 and e.dst=n.node_id) as is_start from node n) s)"""


@query("i9b_components_of_rows", "edge node", f"select node, component from {ROWS_SQL} r")
def i9b(w):
    rows = w.edge.where(F.col("d") == 0)
    return gr.components(rows, w.node.select("node_id"))


@query("i10_strong_components", "edge node")
def i10(w):
    comp = gr.scc(cycle_graph(w), w.node.select("node_id"))
    return gr.component_stats(comp)


def anchored(w):
    return w.origin.join(w.features.select("grid_id", "pop"), "grid_id")


@query(
    "i11_component_audit", "edge node origin features",
    f"""with c as {ROWS_SQL}, n as (select component, count(*) as n_nodes, (max(x)-min(x))*(max(y)-min(y))/1e6 as bbox_km2 from node join c on node=node_id group by 1), e as (select component, count(*) as n_edges, sum(length_m)/1000 as length_km from edge join c on src=node where d=0 group by 1),
    a as (select component, count(*) as n_cells, sum(pop) as pop, count(distinct o.district) as n_districts, min(o.district) as od from origin o join features f using (grid_id) join c on node=node_id group by 1)
    select component, n_nodes, round(bbox_km2,4) as bbox_km2, coalesce(n_edges,0) as n_edges, round(coalesce(length_km,0),3) as length_km, coalesce(n_cells,0) as n_cells, coalesce(pop,0) as pop, coalesce(n_districts,0) as n_districts, case when n_districts=1 then od end as only_district from n left join e using (component) left join a using (component)""",
)
def i11(w):
    rows = w.edge.where(F.col("d") == 0)
    a = gr.component_audit(gr.components(rows, w.node.select("node_id")), w.node, rows, anchored(w))
    return a.withColumn("bbox_km2", F.round("bbox_km2", 4)).withColumn("length_km", F.round("length_km", 3))


@query(
    "i12_component_class", "edge node origin features",
    f"""with c as {ROWS_SQL}, n as (select component, count(*) as n_nodes from c group by 1), a as (select component, count(*) as n_cells, sum(pop) as pop, count(distinct o.district) as nd, min(o.district) as od from origin o join features f using (grid_id) join c on node=node_id group by 1)
    select case when n_nodes>=40 then 'MAJOR_VALID_COMPONENT' when nd=1 and od=3 then 'KNOWN_NETWORK_LIMITATION' when coalesce(n_cells,0)=0 or coalesce(pop,0)=0 then 'QUESTIONABLE_FRAGMENT' when pop>=500 then 'LARGE_LOCAL_VALID_COMPONENT' else 'SMALL_LOCAL_COMPONENT' end as component_class, count(*) as n from n left join a using (component) group by 1""",
)
def i12(w):
    rows = w.edge.where(F.col("d") == 0)
    a = gr.component_audit(gr.components(rows, w.node.select("node_id")), w.node, rows, anchored(w))
    return gr.component_class(a, 40, 3, 500).groupBy("component_class").agg(F.count("*").alias("n"))


@query(
    "i13_quality_flags", "edge node origin features",
    f"""with c as {ROWS_SQL}, n as (select component, count(*) as n_nodes from c group by 1), a as (select component, count(*) as n_cells, sum(pop) as pop, count(distinct o.district) as nd, min(o.district) as od from origin o join features f using (grid_id) join c on node=node_id group by 1),
    k as (select component, n_nodes, case when n_nodes>=40 then 'MAJOR' when nd=1 and od=3 then 'KNOWN' when coalesce(n_cells,0)=0 or coalesce(pop,0)=0 then 'FRAG' else 'LOCAL' end as cls from n left join a using (component)), big as (select component from n order by n_nodes desc, component limit 1),
    f as (select o.grid_id, case when o.district=3 then 'KNOWN_NETWORK_LIMITATION' when o.grid_id%17=0 then 'QUESTIONABLE_ANCHOR' when k.component<>(select component from big) then 'ISOLATED_NETWORK_COMPONENT' else 'RELIABLE' end as first_flag,
    case when o.district=3 then 'KNOWN_NETWORK_LIMITATION' when o.grid_id%17=0 then 'QUESTIONABLE_ANCHOR' when cls='MAJOR' and k.component=(select component from big) then 'RELIABLE' when cls in ('MAJOR','LOCAL') then 'RELIABLE_SEPARATE_COMPONENT' when cls='KNOWN' then 'KNOWN_NETWORK_LIMITATION' else 'SMALL_COMPONENT_CAUTION' end as flag from origin o join c on c.node=o.node_id join k on k.component=c.component)
    select first_flag, flag, count(*) as n, round(round_even(count(*)*1e0/sum(count(*)) over (partition by first_flag),4)*100,2) as row_pct from f group by 1,2""",
)
def i13(w):
    rows = w.edge.where(F.col("d") == 0)
    comp = gr.cut(gr.components(rows, w.node.select("node_id")))
    a = gr.component_class(gr.component_audit(comp, w.node, rows, anchored(w)), 40, 3, 500)
    c = w.origin.join(comp.withColumnRenamed("node", "node_id"), "node_id").join(a.select("component", "component_class"), "component")
    largest = a.orderBy(F.desc("n_nodes"), "component").limit(1).select("component").scalar()
    c = c.withColumn("snap_quality", F.when(F.col("grid_id") % 17 == 0, "QUESTIONABLE").otherwise("DIRECT")).withColumn("_big", largest)
    c = c.select(gr.first_quality_flag(F.col("_big"), 3).alias("first_flag"), gr.quality_flag(F.col("_big"), 3).alias("flag"))
    return sm.crosstab(c, "first_flag", "flag").withColumn("row_pct", F.round("row_pct", 2))


@query("i14_network_coverage", "node grid", "select district, count(*) as n_cells, count(case when has then 1 end) as n_covered from (select g.district, g.grid_id in (select cast(floor(y/500)*40+floor(x/500) as bigint) from node) as has from grid g) t group by 1")
def i14(w):
    local = sp.point_to_cell(w.node, 500.0).select("ix", "iy").distinct().withColumn("has", F.lit(True))
    c = cells(w, "district").join(local, ["ix", "iy"], "left")
    return c.groupBy("district").agg(F.count("*").alias("n_cells"), F.count("has").alias("n_covered"))


@query("i15_graph_stats", "node edge", "select count(*) as n_edges, round(sum(length_m)/1000,1) as total_km, (select count(*) from node) as n_nodes from edge")
def i15(w):
    return gr.graph_stats(w.node, w.edge)


@query("i16_intersections", "node edge", "select cast(floor(y/500)*40+floor(x/500) as bigint) as grid_id, count(*) as n_intersections from node join (select n, count(*) as k from (select src as n from edge union all select dst from edge) u group by 1 having count(*)>=3) d on node_id=n group by 1")
def i16(w):
    hubs = w.node.join(gr.intersections(w.edge), "node_id")
    per = sp.point_to_cell(hubs, 500.0).groupBy("ix", "iy").agg(F.count("*").alias("n_intersections"))
    return per.join(cells(w), ["ix", "iy"]).select("grid_id", "n_intersections")


_KEY = "concat_ws('_', cast(round_even({0}/500,0) as bigint), cast(round_even({1}/500,0) as bigint))"
_SNAPPED = f"""(select least(a,b) as src, greatest(a,b) as dst, arg_max(len, (line_id, len)) as len from (select line_id, {_KEY.format("x1", "y1")} as a, {_KEY.format("x2", "y2")} as b, sqrt((x2-x1)**2+(y2-y1)**2) as len from cycleway) k group by 1,2)"""


@query(
    "i17_line_connectivity", "cycleway",
    _flood_sql(f"select src, dst from {_SNAPPED} e union all select dst, src from {_SNAPPED} e", f"select src as n from {_SNAPPED} e union select dst from {_SNAPPED} e")
    + f", z as (select component, count(*) as n_edges, round(sum(len)/1000,3) as length_km from {_SNAPPED} e join c on c.node=e.src group by 1) select count(*) as n_components, max(length_km) as largest_km, cast(sum(n_edges) as bigint) as n_edges from z",
)
def i17(w):
    c = gr.line_connectivity(w.cycleway, 500.0)
    return c.agg(F.count("*").alias("n_components"), F.max("length_km").alias("largest_km"), F.sum("n_edges").alias("n_edges"))


ADJ_FAST = "(select a.grid_id as src, b.grid_id as dst from grid a, (select unnest([-1,0,1]) as dx) p, (select unnest([-1,0,1]) as dy) q, grid b where b.ix=a.ix+dx and b.iy=a.iy+dy and not (dx=0 and dy=0))"


@query("i18_queen", "grid", f"select src, dst from {ADJ_FAST} a")
def i18(w):
    """Contiguity among all cells."""
    return ce.queen(w.grid)


@query("i19_fragmentation", "cell_labels", "select la, count(*) as n_cells, cast(1 as bigint) as n_patches, 1e0 as largest_share from cell_labels group by 1")
def i19(w):
    return gr.fragmentation(ce.queen(w.grid), w.cell_labels, "la")


@query(
    "i19b_fragmentation_mixed", "cell_labels grid",
    _flood_sql(f"select a.src, a.dst from {{ADJ_FAST}} a join cell_labels x on x.grid_id=a.src join cell_labels y on y.grid_id=a.dst where x.lb=y.lb".replace("{ADJ_FAST}", ADJ_FAST), "select grid_id as n from cell_labels")
    + ", z as (select lb, component, count(*) as n from c join cell_labels on grid_id=node group by 1,2) select lb, cast(sum(n) as bigint) as n_cells, count(*) as n_patches, round(max(n)*1e0/sum(n),4) as largest_share from z group by 1",
)
def i19b(w):
    return gr.fragmentation(ce.queen(w.grid), w.cell_labels, "lb").withColumn("largest_share", F.round("largest_share", 4))


def _moran(val, groups="", table="features"):
    return f"""(with v as (select grid_id, {val} as v{groups} from {table}), z as (select *, v-avg(v) over ({'partition by class' if groups else ''}) as z from v), lag as (select {'z.class,' if groups else ''} a.src as grid_id, avg(z.z) as lag from {ADJ_FAST} a join z on z.grid_id=a.dst group by {'1,2' if groups else '1'})
    select {'z.class,' if groups else ''} count(*)*sum(z.z*coalesce(lag,0))/(count(lag)*sum(z.z*z.z)) as i, count(*) as n from z left join lag using (grid_id{',class' if groups else ''}) {'group by 1' if groups else ''})"""


@query("i20_morans_i", "features grid", f"select round(i,8) as moran_i, n as n_cells from {_moran('n_trip')} m")
def i20(w):
    return gr.morans_i(w.features.select("grid_id", "n_trip"), ce.queen(w.grid), "n_trip").withColumn("moran_i", F.round("moran_i", 8))


@query("i20b_moran_permutation", "features grid")
def i20b(w):
    return gr.moran_permutation(w.features.select("grid_id", "n_poi"), ce.queen(w.grid), "n_poi", 999)


@query("i21_morans_by_label", "cell_labels grid", f"select class, round(i,8) as moran_i, n as n_cells from {_moran('case when lb=class then 1e0 else 0e0 end', ', class', 'cell_labels, (select unnest([0,1,2,3]) as class) k')} m")
def i21(w):
    return gr.morans_by_label(w.cell_labels, ce.queen(w.grid), "lb", [0, 1, 2, 3]).withColumn("moran_i", F.round("moran_i", 8))
