"""Sources and sinks (round trips through the shared scratch folder)."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridreach.functions import geometry as g
from gridreach.operators import relational as rel
from gridreach.plans.registry import query
from gridreach.sources import files as src


TURKISH = "ğüşıİöçĞŞ€"  # letters that cp1254 and Latin-1 write differently or alike


@query("a1b_gtfs_cp1254", "stop", f"select cast(stop_id as varchar) as stop_id, concat(stop_name, ' {TURKISH}') as stop_name from stop")
def a1b(w):
    cols = ["stop_id", "stop_name"]
    folder = src.scratch(w.spark, "feed")
    named = w.stop.select("stop_id", src.recoded(F.concat("stop_name", F.lit(f" {TURKISH}")), "cp1254", back=True).alias("stop_name"))
    named.write.csv(f"{folder}/stops", header=True, sep=",", encoding="ISO-8859-1")
    return src.read_gtfs(w.spark, folder, {"stops": cols}, encoding="cp1254")["stops"]


@query("a1_gtfs_scan", "stop", "select cast(stop_id as varchar) as stop_id, stop_name, location_type, cast(mode as varchar) as mode from (select stop_id, stop_name, nullif(location_type,'') as location_type, mode from stop) s")
def a1(w):
    cols = ["stop_id", "stop_name", "location_type", "mode"]
    folder = src.scratch(w.spark, "feed")
    w.stop.select(*cols).write.csv(f"{folder}/stops", header=True, sep=";")
    return src.read_gtfs(w.spark, folder, {"stops": cols}, sep=";")["stops"]


@query("a2_geojson_scan", "poi", "select poi_id, amenity, 'Point' as geometry_type, round(x,3) as x, round(y,3) as y from poi")
def a2(w):
    path = src.scratch(w.spark, "geojson")
    f = F.struct(
        F.lit("Feature").alias("type"),
        F.struct("poi_id", "amenity").alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"),
    )
    w.poi.select(F.to_json(f)).write.text(path)
    props = T.StructType([T.StructField("poi_id", T.LongType()), T.StructField("amenity", T.StringType())])
    out = src.read_geojson(w.spark, path, props, sequence=True).withColumn("p", src.coordinates_point(F.col("coordinates")))
    return out.select("poi_id", "amenity", "geometry_type", F.round(F.col("p")[0], 3).alias("x"), F.round(F.col("p")[1], 3).alias("y"))


# A building of two parts, the first with a hole: boxes (sign, x0, y0, x1, y1).
PARTS_SQL = """(select b_id, 1 as s, x0, y0, x0+w as x1, y0+h as y1 from building union all select b_id, -1, x0+w/4, y0+h/4, x0+w*3/4, y0+h*3/4 from building
 union all select b_id, 1, x0+w+5, y0, x0+2*w+5, y0+h from building where b_id%3<>0)"""


def two_part_buildings(w):
    """Buildings as FeatureCollections of Polygons (every third) and MultiPolygons, written and read again.

    A collection is written by one task, so each holds at most 500 features; it is read in byte ranges.
    """
    x0, y0, x1, y1, dx, dy = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h"), F.col("w") / 4, F.col("h") / 4
    ring = lambda a, b, c, d: F.array(F.array(a, b), F.array(c, b), F.array(c, d), F.array(a, d), F.array(a, b))
    holed = F.array(ring(x0, y0, x1, y1), ring(x0 + dx, y0 + dy, x1 - dx, y1 - dy))
    plain = F.array(ring(x1 + 5, y0, x1 + 5 + F.col("w"), y1))
    is_multi = F.col("b_id") % 3 != 0
    geometry = lambda kind, c: F.struct(F.lit(kind).alias("type"), F.to_json(c).alias("coordinates"))
    geo = F.when(is_multi, geometry("MultiPolygon", F.array(holed, plain))).otherwise(geometry("Polygon", holed))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("b_id").alias("properties"), geo.alias("geometry"))
    doc = w.building.select(F.floor(F.col("b_id") / 500).alias("chunk"), F.to_json(feature).alias("f")).groupBy("chunk").agg(F.concat_ws(",", F.collect_list("f")).alias("fs"))
    # coordinates went through to_json as text: put them back as a JSON value
    bare = F.regexp_replace("fs", r'"coordinates":"([^"]*)"', r'"coordinates":$1')
    path = src.scratch(w.spark, "collections")
    doc.select("chunk", F.concat(F.lit('{"type":"FeatureCollection","features":['), bare, F.lit("]}"))).write.partitionBy("chunk").text(path)
    props = T.StructType([T.StructField("b_id", T.LongType())])
    out = src.read_geojson(w.spark, path, props).withColumn("parts", src.coordinates_parts(F.col("geometry_type"), F.col("coordinates"))).drop("coordinates")
    points = F.flatten(F.transform("parts", lambda p: p.ring))
    return out.select("*", *[f(F.transform(points, lambda p: p[c])).alias(n) for n, f, c in (("x0", F.array_min, "x"), ("y0", F.array_min, "y"), ("x1", F.array_max, "x"), ("y1", F.array_max, "y"))])


@query("a2b_feature_collection", "building", f"select b_id, case when b_id%3=0 then 'Polygon' else 'MultiPolygon' end as geometry_type, case when b_id%3=0 then 2 else 3 end as n_rings, round(sum(s*(x1-x0)*(y1-y0)),4) as area from {PARTS_SQL} p group by 1")
def a2b(w):
    return two_part_buildings(w).select("b_id", "geometry_type", F.size("parts").alias("n_rings"), F.round(g.parts_area(F.col("parts")), 4).alias("area"))


@query("a3_parquet_pruned", "", "select l_returnflag, count(*) as n, round(sum(l_quantity),2) as qty from lineitem where l_quantity > 10 group by 1")
def a3(w):
    df = w.lineitem.select("l_returnflag", "l_quantity").where(F.col("l_quantity") > 10)
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("a4_csv_roundtrip", "features", "select district, count(*) as n_cells, round(sum(land_area_m2),1) as land, round(sum(pop),1) as pop, round(sum(n_poi),1) as n_poi from features group by district")
def a4(w):
    path = src.scratch(w.spark, "summary")
    sums = [F.round(F.sum(c), 1).alias(n) for c, n in (("land_area_m2", "land"), ("pop", "pop"), ("n_poi", "n_poi"))]
    w.features.groupBy("district").agg(F.count("*").alias("n_cells"), *sums).write.csv(path, header=True)
    return w.spark.read.csv(path, header=True, schema="district long, n_cells long, land double, pop double, n_poi double")


@query(
    "a5_official_population", "",
    """select case when o_orderpriority='5-LOW' then 'LOWEST' else o_orderpriority end as district,
    cast(sum(o_custkey%10 + o_orderkey%7 + coalesce(nullif(o_orderkey%5,0),0)) as bigint) as population
    from orders where year(o_orderdate)=1997 group by 1""",
)
def a5(w):
    df = w.orders.select(
        F.col("o_orderpriority").alias("district"), F.year("o_orderdate").alias("year"),
        (F.col("o_custkey") % 10).alias("male_0_4"), (F.col("o_orderkey") % 7).alias("female_0_4"),
        F.nullif(F.col("o_orderkey") % 5, F.lit(0)).alias("male_5_9"),
    )
    return src.official_population(df, 1997, ["male_0_4", "female_0_4", "male_5_9"], {"5-LOW": "LOWEST"})


@query(
    "a6_trip_csv_clean", "trip",
    "select trip_id, date_trunc('second', start_time) as start_time, x as start_lng, y as start_lat from trip where x between 1000 and 18000 and y between 500 and 1000000000",
)
def a6(w):
    path = src.scratch(w.spark, "trips")
    w.trip.select(
        "trip_id", F.date_trunc("second", "start_time").alias("start_time"), F.col("x").alias("start_lng"), F.col("y").alias("start_lat"),
        F.col("start_time").alias("end_time"), F.col("x").alias("end_lng"), F.col("y").alias("end_lat"),
    ).write.csv(path, header=True)
    t = src.read_trips(w.spark, path, {"start_lng": (1000, 18000), "start_lat": (500, 1e9)})
    return t.select("trip_id", "start_time", "start_lng", "start_lat")


@query("a7_sample_rows", "", "select o_orderkey, o_totalprice from orders order by (o_orderkey*7919)%100003, o_orderkey limit 500")
def a7(w):
    return src.sample_rows(w.orders.select("o_orderkey", "o_totalprice"), 500, "o_orderkey", draw=(F.col("o_orderkey") * 7919) % 100003)


@query("a8_raster_window", "pixel", "select r, c, pop as value, 160e0*c as x0, 160e0*r as y0, 160e0*(c+1) as x1, 160e0*(r+1) as y1 from pixel where pop<>7 and pop>=0")
def a8(w):
    """Every valid pixel of the raster."""
    return src.pixels_in_window(w.pixel.withColumnRenamed("pop", "value"), 160.0, 7.0)


@query("a9_parquet_by_district", "features", "select grid_id, district, land_area_m2, pop, elev from features")
def a9(w):
    path = src.scratch(w.spark, "grid")
    src.write_by_district(w.features.select("grid_id", "district", "land_area_m2", "pop", "elev"), path)
    return w.spark.read.schema("grid_id long, land_area_m2 double, pop double, elev double, district long").parquet(path)


@query("a10_geojson_export", "grid")
def a10(w):
    return src.geojson_lines(w.grid, ["grid_id", "district"], 500.0, 6, 35, (660000.0, 4540000.0))


@query(
    "a11_map_layers", "features",
    """select grid_id, 'pop' as field, cast(cast(pop as bigint) as varchar) as value from features
    union all select grid_id, 'n_poi', cast(cast(n_poi as bigint) as varchar) from features
    union all select grid_id, 'elev', cast(cast(floor(elev) as bigint) as varchar) from features""",
)
def a11(w):
    f = w.features.select("grid_id", "district", F.col("pop").cast("long").alias("pop"), F.col("n_poi").cast("long").alias("n_poi"), F.floor("elev").alias("elev"))
    path = src.scratch(w.spark, "layers")
    src.layers(f, ["pop", "n_poi", "elev"]).write.partitionBy("field").json(path, ignoreNullFields=False)
    return w.spark.read.schema("grid_id long, value string, field string").json(path)


@query("a12_fingerprint", "", """select count(*) as n_rows, not exists (select o_orderkey, o_custkey from orders except all select o_orderkey, o_custkey from orders) as unchanged,
    not exists (select o_orderkey, o_custkey from orders except all select o_orderkey, o_custkey+case when o_orderkey=(select min(o_orderkey) from orders) then 1 else 0 end from orders) as changed_is_unchanged from orders""")
def a12(w):
    df = w.orders
    a, b = rel.fingerprint(df), rel.fingerprint(df.repartition(5, "o_custkey"))
    first = df.agg(F.min("o_orderkey")).scalar()
    c = rel.fingerprint(df.withColumn("o_custkey", F.col("o_custkey") + F.when(F.col("o_orderkey") == first, 1).otherwise(0)))
    both = a.join(b.select(F.col("n_rows").alias("n2"), F.struct("hash_a", "hash_b").alias("h2")), F.col("n_rows") == F.col("n2"))
    both = both.join(c.select(F.col("n_rows").alias("n3"), F.struct("hash_a", "hash_b").alias("h3")), F.col("n_rows") == F.col("n3"))
    mine = F.struct("hash_a", "hash_b")
    return both.select("n_rows", (mine == F.col("h2")).alias("unchanged"), (mine == F.col("h3")).alias("changed_is_unchanged"))


@query(
    "a13_merge_chunks", "poi",
    """select poi_id, cast(min(chunk) as integer) as chunk from (select poi_id, 0 as chunk from poi where x < 8000 union all select poi_id, 1 from poi where x >= 6000) u group by poi_id""",
)
def a13(w):
    p = w.poi.select("poi_id", "x")
    m = rel.merge_chunks([p.where(F.col("x") < 8000), p.where(F.col("x") >= 6000)], ["poi_id"])
    return m.select("poi_id", "chunk")
