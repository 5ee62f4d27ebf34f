"""Projections, filters, row rules."""

from pyspark.sql import functions as F

from gridreach.functions import scalars as s
from gridreach.functions import geometry as g
from gridreach.operators import ordered as o
from gridreach.operators import relational as rel
from gridreach.plans.registry import query

POI_CASE = """case when amenity='hospital' or healthcare='hospital' then 'hospital_count' when amenity='university' then 'university_count'
 when amenity='school' then 'school_count' when healthcare is not null or amenity='clinic' then 'healthcare_count' when amenity='cafe' then 'cafe_count'
 when amenity in ('restaurant','fast_food') then 'restaurant_count' when amenity in ('bar','pub','biergarten') then 'bar_pub_count'
 when shop='supermarket' then 'supermarket_count' when shop is not null then 'retail_count' when office is not null then 'office_count'
 when tourism is not null then 'tourism_count' when leisure is not null then 'leisure_count' end"""
EVERYDAY_CASE = """case when shop='supermarket' or amenity='marketplace' then 'A_food_groceries' when amenity in ('hospital','clinic') then 'B_healthcare'
 when amenity in ('school','university','library') then 'C_education' when amenity='bank' or shop='hairdresser' then 'D_daily_services'
 when shop is not null then 'E_retail_shopping' when amenity in ('cafe','fast_food','pub') then 'F_leisure_social'
 when leisure in ('park','garden') then 'G_green_recreation' when leisure is not null then 'F_leisure_social' end"""


@query("b1_poi_category", "poi", f"select poi_id, {POI_CASE} as category from poi")
def b1(w):
    return w.poi.select("poi_id", s.first_match(s.POI_RULES, F.col).alias("category"))


@query("b2_everyday_category", "poi stop", f"select concat('POI_', element, '_', poi_id) as destination_id, {EVERYDAY_CASE} as category from poi union all select concat('TRANSIT_', stop_id), 'H_public_transport_access' from stop")
def b2(w):
    p = w.poi.select(F.concat(F.lit("POI_"), "element", F.lit("_"), "poi_id").alias("destination_id"), s.first_match(s.EVERYDAY_RULES, F.col).alias("category"))
    t = w.stop.select(F.concat(F.lit("TRANSIT_"), "stop_id").alias("destination_id"), F.lit("H_public_transport_access").alias("category"))
    return p.unionByName(t)


@query("b3_exclude_edges", "edge", "select src, dst, highway from edge where highway not in ('motorway','cycleway') and (foot is null or foot<>'no')")
def b3(w):
    e = w.edge.select("src", "dst", "highway", F.create_map(F.lit("foot"), F.col("foot")).alias("tags"))
    return rel.exclude_edges(e, s.WALK_EXCLUDE, "tags").select("src", "dst", "highway")


@query(
    "b4_road_flags", "road",
    """select hw, bool_or(is_major) as is_major, bool_or(is_local) as is_local, bool_or(is_walkable) as is_walkable, bool_or(is_cycle) as is_cycle, count(*) as n from (
    select highway as hw, highway in ('primary','motorway') as is_major, highway in ('residential','tertiary') as is_local,
    highway<>'motorway' as is_walkable, highway not in ('motorway','steps') as is_cycle from road) r group by hw""",
)
def b4(w):
    listed = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("['"), "highway", F.lit("', 'service']"))).otherwise(F.col("highway"))
    r = w.road.select(s.first_class(listed).alias("hw"))
    flags = s.road_flags(F.col("hw"))
    return r.groupBy("hw").agg(*[F.bool_or(c).alias(n) for n, c in flags.items()], F.count("*").alias("n"))


@query("b5_green_select", "building", "select b_id from building where leisure='park' or natural_kind='wood'")
def b5(w):
    tags = {"leisure": F.col("leisure"), "landuse": F.col("landuse"), "natural": F.col("natural_kind")}
    return w.building.where(s.any_in(s.GREEN, lambda k: tags[k])).select("b_id")


@query(
    "b6_cycleway_category", "road",
    """select seg_id, tag_key, category, count(*) as n from (
    select seg_id, 'standalone' as tag_key, case when l_orderkey%3=0 then 'protected_separated' when l_orderkey%3=1 then 'shared_path' else 'other_unknown' end as category from road where highway='cycleway'
    union all select seg_id, 'cycleway:left', case l_orderkey%5 when 1 then 'protected_separated' when 2 then 'dedicated_lane' when 3 then 'painted_on_road' else 'other_unknown' end from road where highway<>'cycleway' and l_orderkey%5 in (1,2,3,4)
    union all select seg_id, 'cycleway:right', case l_orderkey%4 when 1 then 'dedicated_lane' else 'other_unknown' end from road where highway<>'cycleway' and l_orderkey%4 in (1,2)) u group by 1,2,3""",
)
def b6(w):
    foot = F.element_at(F.array(F.lit("no"), F.lit("yes"), F.lit("maybe")), (F.col("l_orderkey") % 3 + 1).cast("int"))
    left = F.element_at(F.array(*[F.lit(v) for v in ("no", "track", "lane", "shared_lane", "odd")]), (F.col("l_orderkey") % 5 + 1).cast("int"))
    right = F.element_at(F.array(*[F.lit(v) for v in ("separate", "lane", "odd", "crossing")]), (F.col("l_orderkey") % 4 + 1).cast("int"))
    r = w.road.select("seg_id", "highway", foot.alias("foot"), F.create_map(F.lit("cycleway:left"), left, F.lit("cycleway:right"), right).alias("tags"))
    return cycleway_categories(r).groupBy("seg_id", "tag_key", "category").agg(F.count("*").alias("n"))


def cycleway_categories(roads):
    """Standalone cycleways by their foot tag, other roads once per side tag that says something."""
    own = F.when(F.col("foot") == "no", "protected_separated").when(F.col("foot").isin("designated", "yes"), "shared_path").otherwise("other_unknown")
    alone = roads.where(F.col("highway") == "cycleway").select("seg_id", F.lit("standalone").alias("tag_key"), own.alias("category"))
    sides = F.array(*[F.struct(F.lit(k).alias("tag_key"), F.col("tags")[k].alias("v")) for k in s.CYCLEWAY_KEYS])
    side = roads.where(F.col("highway") != "cycleway").select("seg_id", F.inline(sides)).where(F.col("v").isNotNull() & ~F.col("v").isin(*s.CYCLEWAY_SKIP))
    mapped = F.lit("other_unknown")
    for k, v in s.CYCLEWAY_CATEGORY.items():
        mapped = F.when(F.col("v") == k, v).otherwise(mapped)
    return alone.unionByName(side.select("seg_id", "tag_key", mapped.alias("category")))


@query(
    "b6b_official_stage", "cycleway",
    """select stage, category, count(*) as n from (select case line_id%4 when 0 then 'existing separated' when 1 then 'existing shared' when 2 then 'planned' else 'under construction' end as stage,
    case line_id%4 when 0 then 'protected_separated' when 1 then 'shared_path' end as category from cycleway) c where category is not null group by 1,2""",
)
def b6b(w):
    stage = F.element_at(F.array(*[F.lit(v) for v in ("existing separated", "existing shared", "planned", "under construction")]), (F.col("line_id") % 4 + 1).cast("int"))
    stages = {"existing separated": "protected_separated", "existing shared": "shared_path"}
    cat = F.lit(None).cast("string")
    for k, v in stages.items():
        cat = F.when(F.col("stage") == k, v).otherwise(cat)
    c = w.cycleway.select(stage.alias("stage")).withColumn("category", cat)
    return c.where(F.col("category").isNotNull()).groupBy("stage", "category").agg(F.count("*").alias("n"))


ROUTE_MODE_SQL = """select route_id, case when agency='BUILDING' and route_type='0' then 'tram' when agency='BUILDING' and route_type='1' then 'metro'
 when agency='MACHINERY' and route_type='2' then 'rail' when agency='HOUSEHOLD' and route_type='3' then 'ferry'
 when lower(route_long_name) like '%metrob%' then 'metrobus' end as mode from route"""


def mode_rules(w):
    rows = [("BUILDING", "0", "tram"), ("BUILDING", "1", "metro"), ("MACHINERY", "2", "rail"), ("HOUSEHOLD", "3", "ferry")]
    return w.spark.createDataFrame(rows, "agency string, route_type string, mode string")


@query("b7_route_mode", "route", ROUTE_MODE_SQL)
def b7(w):
    return rel.route_mode(w.route, mode_rules(w)).select("route_id", "mode")


@query("b8_platform_stops", "stop", "select stop_id from stop where location_type is null or location_type in ('0','')")
def b8(w):
    t = F.col("location_type")
    return w.stop.where(t.isNull() | t.isin("0", "")).select("stop_id")


FIXED_SQL = """case when length(raw)-length(replace(raw,'.',''))<=1 then try_cast(raw as double)
 when regexp_full_match(replace(raw,'.',''),'[0-9]+') and length(replace(raw,'.',''))>2
 then try_cast(concat(substr(replace(raw,'.',''),1,2),'.',substr(replace(raw,'.',''),3)) as double) end"""


@query("b9_fix_coordinate", "dirty", f"select stop_id, {FIXED_SQL} as fixed from dirty")
def b9(w):
    return w.dirty.select("stop_id", s.fix_coordinate(F.col("raw")).alias("fixed"))


@query("b10_valid_coordinates", "dirty", f"select count(*) as n, count_if(coalesce(v between 39.5 and 42, false)) as n_valid, count_if(not coalesce(v between 39.5 and 42, false)) as n_invalid from (select {FIXED_SQL} as v from dirty) d")
def b10(w):
    ok = F.coalesce(s.fix_coordinate(F.col("raw")).between(39.5, 42), F.lit(False))
    return w.dirty.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid"))


@query("b11_drop_degenerate", "", "select count(*) as n_all, count_if(k>=2) as n_kept, count_if(k<2) as n_dropped from (select l_orderkey, count(*) as k from lineitem group by 1) l")
def b11(w):
    paths = w.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("k")).select(F.array_repeat(g.point(F.lit(0), F.lit(0)), F.col("k").cast("int")).alias("path"))
    ok = F.size("path") >= 2
    return paths.agg(F.count("*").alias("n_all"), F.count_if(ok).alias("n_kept"), F.count_if(~ok).alias("n_dropped"))


CAT_COLS = ", ".join(f"cast(count_if(cat={i}) as bigint) as c{i}" for i in range(4))
ENT = "+".join(f"case when c{i}>0 then -(c{i}*1e0/t)*log2(c{i}*1e0/t) else 0 end" for i in range(4))


@query("b12_entropy_bits", "poi_cell", f"select grid_id, case when t>0 then round({ENT},6) else 0 end as entropy from (select *, c0+c1+c2+c3 as t from (select grid_id, {CAT_COLS} from poi_cell group by 1) a) b")
def b12(w):
    c = w.poi_cell.groupBy("grid_id").agg(*[F.count_if(F.col("cat") == i).alias(f"c{i}") for i in range(4)])
    return c.select("grid_id", F.round(s.entropy_bits([F.col(f"c{i}") for i in range(4)]), 6).alias("entropy"))


@query("b13_density", "features", "select grid_id, round(n_poi/(land_area_m2/1e6),6) as per_km2 from features")
def b13(w):
    return w.features.select("grid_id", F.round(s.density_km2(F.col("n_poi"), F.col("land_area_m2")), 6).alias("per_km2"))


@query(
    "b14_entropy_if_covered", "features",
    """select grid_id, case when (select avg(least(n_poi*30,100)) from features)>=50 then e end as entropy_gated, case when (select avg(least(n_poi*5,100)) from features)>=50 then e end as entropy_blocked
    from (select grid_id, n_poi, case when n_poi+n_trip>0 then round((case when n_poi>0 then -(n_poi/(n_poi+n_trip))*log2(n_poi/(n_poi+n_trip)) else 0 end)+(case when n_trip>0 then -(n_trip/(n_poi+n_trip))*log2(n_trip/(n_poi+n_trip)) else 0 end),6) else 0 end as e from features) f""",
)
def b14(w):
    f = w.features.select("grid_id", "n_poi", s.entropy_bits([F.col("n_poi"), F.col("n_trip")]).alias("e"))
    f = o.with_global(f, cover=F.avg(F.least(F.col("n_poi") * 30, F.lit(100.0))), thin=F.avg(F.least(F.col("n_poi") * 5, F.lit(100.0))))
    e = F.round("e", 6)
    return f.select("grid_id", F.when(F.col("cover") >= 50, e).alias("entropy_gated"), F.when(F.col("thin") >= 50, e).alias("entropy_blocked"))


@query("b15_piecewise_cost", "features", "select grid_id, round(case when v<=3 then 1e0 when v<=10 then 1-(v-3)/7*0.5 when v>10 then 0.5e0 end,6) as c from (select grid_id, elev/10 as v from features) f")
def b15(w):
    return w.features.select("grid_id", F.round(s.piecewise_cost(F.col("elev") / 10, 3.0, 10.0, 0.5), 6).alias("c"))


@query("b16_share_cost", "features", "select grid_id, round(1-(noise/1009)*0.5,6) as c from features")
def b16(w):
    return w.features.select("grid_id", F.round(s.share_cost_floor(F.col("noise") / 1009 * 100), 6).alias("c"))


@query("b17_target_range", "features", "select grid_id, round(case when r<0.3 then r/0.3 when r<=0.7 then 1e0 else 1-(r-0.7)/0.3*0.6 end,6) as v from (select grid_id, noise/1008 as r from features) f")
def b17(w):
    return w.features.select("grid_id", F.round(s.target_range(F.col("noise") / 1008, 0.3, 0.7, 0.4), 6).alias("v"))


@query("b18_inverted_u", "features", "select grid_id, round(case when r>=0.4 then 0.1+(1-r)/0.6*0.9 else 0.5+(r/0.4)*0.5 end,6) as v from (select grid_id, noise/1008 as r from features) f")
def b18(w):
    return w.features.select("grid_id", F.round(s.inverted_u(F.col("noise") / 1008, 0.4, 0.5, 0.1), 6).alias("v"))


@query("b19_snap_class", "features", "select grid_id, case when d<=100 then 'DIRECT' when d<=300 then 'NEARBY' when d<=1000 then 'LARGE_SNAP' else 'QUESTIONABLE' end as snap from (select grid_id, round(noise*1.2e0,2) as d from features) f")
def b19(w):
    return w.features.select("grid_id", s.snap_class(F.col("noise") * 1.2).alias("snap"))


@query("b20_masked_weighted_mean", "features", "select grid_id, round((coalesce(elev*0.4e0,0)+n_poi*0.6e0)/(case when elev is not null then 0.4e0 else 0 end+0.6e0),6) as m from features")
def b20(w):
    return w.features.select("grid_id", F.round(s.masked_weighted_mean([(F.col("elev"), 0.4), (F.col("n_poi"), 0.6)]), 6).alias("m"))


@query("b21_row_mean_min_sum", "access15", "select grid_id, round((coalesce(walk_food,0)+coalesce(walk_healthcare,0)+coalesce(walk_education,0))/nullif((walk_food is not null)::int+(walk_healthcare is not null)::int+(walk_education is not null)::int,0),6) as mean_v, least(walk_food,walk_healthcare,walk_education) as min_v, round(coalesce(walk_food,0)+coalesce(walk_healthcare,0)+coalesce(walk_education,0),6) as sum_v from access15")
def b21(w):
    c = [F.col(f"walk_{n}") for n in ("food", "healthcare", "education")]
    return w.access15.select("grid_id", F.round(s.row_mean(c), 6).alias("mean_v"), F.least(*c).alias("min_v"), F.round(sum((F.coalesce(x, F.lit(0.0)) for x in c), F.lit(0.0)), 6).alias("sum_v"))


@query("b22_count_true", "access15", "select grid_id, cast(coalesce(walk_food<=15,false)::int+coalesce(walk_healthcare<=15,false)::int+coalesce(walk_education<=15,false)::int as bigint) as n from access15")
def b22(w):
    return w.access15.select("grid_id", s.count_true([F.col(f"walk_{n}") <= 15 for n in ("food", "healthcare", "education")]).alias("n"))


@query("b23_argmin_column", "features", "select grid_id, case when n_poi<=n_trip and n_poi<=n_stop then 'n_poi' when n_trip<=n_stop then 'n_trip' else 'n_stop' end as weakest from features")
def b23(w):
    return w.features.select("grid_id", s.argmin_name({c: F.col(c) for c in ("n_poi", "n_trip", "n_stop")}).alias("weakest"))


@query("b24_severity", "access15", "select grid_id, case when walk_food is not null then round(case when walk_food>5 then walk_food-5 else 0 end,6) end as excess_min, case when walk_food is not null then round(case when walk_food<5 then 5-walk_food else 0 end,6) end as headroom_min from access15")
def b24(w):
    t = F.col("walk_food")
    return w.access15.select("grid_id", F.round(s.excess(t, 5.0), 6).alias("excess_min"), F.round(s.headroom(t, 5.0), 6).alias("headroom_min"))


@query("b25_bottleneck_label", "access15", "select grid_id, coalesce(nullif(concat_ws('+', case when not coalesce(walk_food<=15,false) then 'FOOD' end, case when not coalesce(walk_healthcare<=15,false) then 'HEALTHCARE' end, case when not coalesce(walk_education<=15,false) then 'EDUCATION' end),''),'COMPLETE') as bottleneck from access15")
def b25(w):
    return w.access15.select("grid_id", s.join_labels(missing_flags(), "COMPLETE").alias("bottleneck"))


def missing_flags(limit: float = 15.0):
    return {n.upper(): ~F.coalesce(F.col(f"walk_{n}") <= limit, F.lit(False)) for n in ("food", "healthcare", "education")}


@query("b26_slope_bins", "features", "select grid_id, case when v>=10 then 'gt10' when v>=6 then '6_10' when v>=3 then '3_6' when v>=0 then 'lt3' end as bin from (select grid_id, elev/12 as v from features) f")
def b26(w):
    return w.features.select("grid_id", s.bin_label(F.col("elev") / 12, [0, 3, 6, 10], ["lt3", "3_6", "6_10", "gt10"]).alias("bin"))


@query("b27_time_parts", "trip", "select trip_id, dayname(start_time) as weekday_name, cast(hour(start_time) as integer) as hour, isodow(start_time)>=6 as is_weekend, cast(start_time as date) as day from trip")
def b27(w):
    return w.trip.select("trip_id", *[c.alias(n) for n, c in s.time_parts(F.col("start_time")).items()])


@query("b28_sanitize_names", "", "select distinct replace(replace(replace(p_name,' ',''),'&',''),'/','') as clean from part")
def b28(w):
    return w.part.select(s.sanitize(F.col("p_name")).alias("clean")).distinct()


@query(
    "b29_variant_factors", "cell_scores",
    """select a as f1, b as f2, c as f3, count(*) as n, round(avg(v),6) as mean_score from (
    select 't1' as a,'lin' as b,'uf0' as c,t1__lin__uf0 as v from cell_scores union all select 't1','sqrt','uf0',t1__sqrt__uf0 from cell_scores
    union all select 't2','lin','uf0',t2__lin__uf0 from cell_scores union all select 't2','sqrt','uf0',t2__sqrt__uf0 from cell_scores) u group by 1,2,3""",
)
def b29(w):
    long = o.unpivot(w.cell_scores, [], ["t1__lin__uf0", "t1__sqrt__uf0", "t2__lin__uf0", "t2__sqrt__uf0"], "variant")
    parts = F.split("variant", "__")
    return long.groupBy(*[parts[i].alias(f"f{i + 1}") for i in range(3)]).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_score"))


@query("b30_log1p", "features", "select grid_id, round(ln(1+greatest(n_trip-3,0)),6) as v from features")
def b30(w):
    return w.features.select("grid_id", F.round(s.log1p_clip(F.col("n_trip") - 3), 6).alias("v"))
