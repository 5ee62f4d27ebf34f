"""Scans and sinks: timetable CSV folders, GeoJSON, trip CSV, map layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridreach.functions.projection import utm_inverse
from gridreach.session import scratch
from gridreach.sources.collections import feature_texts

TRIP_SCHEMA = "trip_id long, start_time timestamp, start_lng double, start_lat double, end_time timestamp, end_lng double, end_lat double"
GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])


def read_gtfs(spark: SparkSession, folder: str, columns: Mapping[str, Sequence[str]], encoding: str = "UTF-8", sep: str = ",") -> dict[str, DataFrame]:
    """Each listed table of a timetable feed, every column a string; columns fixes the schema (no inference pass).

    Spark reads a few encodings itself; a one-byte encoding such as cp1254 is read as Latin-1, byte by byte, and then mapped.
    """
    own = encoding.upper() in SPARK_ENCODINGS
    out = {}
    for table, cols in columns.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
        raw = spark.read.csv(f"{folder}/{table}", header=True, sep=sep, encoding=encoding if own else "ISO-8859-1", schema=schema, enforceSchema=False)
        out[table] = raw if own else raw.select(*[recoded(F.col(c), encoding).alias(c) for c in cols])
    return out


# The encodings that Spark reads.
SPARK_ENCODINGS = ("US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32")


def recoded(text: Column, encoding: str, back: bool = False) -> Column:
    """Text that was read as Latin-1, as it reads in a one-byte encoding (or back, for writing); bytes without a character stay."""
    pairs = [(chr(b), bytes([b]).decode(encoding, "replace")) for b in range(128, 256)]
    pairs = [(a, c) for a, c in pairs if len(c) == 1 and c not in (a, "\ufffd")]
    if back:
        pairs = [(c, a) for a, c in pairs]
    return F.translate(text, "".join(a for a, _ in pairs), "".join(c for _, c in pairs))


def read_geojson(spark: SparkSession, path: str, properties: T.StructType, sequence: bool = False) -> DataFrame:
    """Features as property columns plus geometry_type and coordinates (JSON text).

    sequence=True reads one feature per line; otherwise each file is a FeatureCollection, whose byte ranges are read by
    many tasks and cut into features (see `collections`).
    """
    feature = T.StructType([T.StructField("properties", properties), T.StructField("geometry", GEOMETRY)])
    if sequence:
        f = spark.read.schema(feature).json(path).select(F.struct("properties", "geometry").alias("f"))
    else:
        typed = T.StructType([T.StructField("type", T.StringType()), *feature.fields])
        f = feature_texts(spark, path).select(F.from_json("text", typed).alias("f")).where("f.type = 'Feature'")
    return f.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def coordinates_point(coordinates: Column) -> Column:
    return F.from_json(coordinates, "array<double>")


def coordinates_path(coordinates: Column) -> Column:
    """array<struct<x,y>> of a LineString's coordinates."""
    pts = F.from_json(coordinates, "array<array<double>>")
    return F.transform(pts, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def coordinates_parts(geometry_type: Column, coordinates: Column) -> Column:
    """array<struct<hole, ring>> of a Polygon or MultiPolygon: in each polygon the first ring is the outline, the others are holes."""
    one = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.when(geometry_type == "MultiPolygon", F.from_json(coordinates, "array<array<array<array<double>>>>")).when(geometry_type == "Polygon", F.array(one))
    path = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return F.flatten(F.transform(many, lambda rings: F.transform(rings, lambda r, i: F.struct((i > 0).alias("hole"), path(r).alias("ring")))))


def read_trips(spark: SparkSession, path: str, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Trip CSV with a fixed schema; rows outside any bound are dropped."""
    df = spark.read.csv(path, header=True, schema=TRIP_SCHEMA)
    for c, (lo, hi) in bounds.items():
        df = df.where(F.col(c).between(lo, hi))
    return df


def official_population(df: DataFrame, year: int, value_cols: Sequence[str], aliases: Mapping[str, str]) -> DataFrame:
    """Total of all age and sex columns per district of one year, with district names mapped."""
    name = F.col("district")
    for old, new in aliases.items():
        name = F.when(F.col("district") == old, new).otherwise(name)
    total = sum((F.coalesce(F.col(c), F.lit(0)).cast("long") for c in value_cols), F.lit(0).cast("long"))
    return df.where(F.col("year") == year).groupBy(name.alias("district")).agg(F.sum(total).alias("population"))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42, draw: Column | None = None) -> DataFrame:
    """n rows with the smallest hash of (key, seed): a repeatable sample, taken as a top-k."""
    h = F.xxhash64(F.col(key), F.lit(seed)) if draw is None else draw
    return df.orderBy(h, F.col(key)).limit(n)


def pixels_in_window(px: DataFrame, size: float, nodata: float, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """Valid pixels of a window with their footprint box; a window reaches the scan as a filter, None leaves that axis whole."""
    v = F.col("value")
    keep = v.isNotNull() & ~F.isnan(v) & (v != nodata) & (v >= 0)
    for axis, window in (("r", rows), ("c", cols)):
        keep = keep if window is None else keep & F.col(axis).between(*window)
    box = [(F.col("c") * size).alias("x0"), (F.col("r") * size).alias("y0"), ((F.col("c") + 1) * size).alias("x1"), ((F.col("r") + 1) * size).alias("y1")]
    return px.where(keep).select("r", "c", "value", *box)


def write_by_district(df: DataFrame, path: str, fmt: str = "parquet", files_per_district: int = 1) -> None:
    """Partitioned sink.  A salt spreads each district over files_per_district tasks, so a large district is not one writer."""
    salt = F.pmod(F.xxhash64("grid_id"), F.lit(files_per_district))
    df.repartition(F.col("district"), salt).write.mode("overwrite").partitionBy("district").format(fmt).save(path)


def geojson_lines(df: DataFrame, props: Sequence[str], size: float, decimals: int = 6, zone: int = 35, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """One GeoJSON feature per cell (x0, y0) with lon/lat corners."""
    x, y = F.col("x0") + origin[0], F.col("y0") + origin[1]
    corners = [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]

    def lonlat(cx, cy):
        p = utm_inverse(cx, cy, zone)
        return F.array(F.round(p["lon"], decimals), F.round(p["lat"], decimals))

    ring = F.array(*[lonlat(cx, cy) for cx, cy in corners])
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*props).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    return df.select("grid_id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def layers(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, grid_id, value as text) for every cell and field, nulls kept."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select("grid_id", F.inline(pairs))
