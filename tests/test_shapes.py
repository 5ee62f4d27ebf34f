"""General-polygon unions, dense nearest neighbours and collections read in byte ranges."""

import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridreach.operators import spatial, sweep
from gridreach.sources import collections, files

RING = "array<struct<hole:boolean,ring:array<struct<x:double,y:double>>>>"


def polygons(spark, shapes):
    """shapes: lists of (hole, [(x, y), ...]) with open rings."""
    rows = []
    for parts in shapes:
        xs, ys = zip(*[p for _, r in parts for p in r])
        rows.append(([(h, [(float(x), float(y)) for x, y in [*r, r[0]]]) for h, r in parts], float(min(xs)), float(min(ys)), float(max(xs)), float(max(ys))))
    return spark.createDataFrame(rows, f"parts {RING}, x0 double, y0 double, x1 double, y1 double")


def inside(x, y, ring):
    odd = np.zeros(x.shape, bool)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
        with np.errstate(divide="ignore", invalid="ignore"):
            odd ^= ((ay <= y) != (by <= y)) & (ax + (y - ay) / (by - ay) * (bx - ax) <= x)
    return odd


def raster_area(shapes, step=0.05, size=40.0):
    """Covered area by pixel centres."""
    c = np.arange(step / 2, size, step)
    x, y = np.meshgrid(c, c)
    any_ = np.zeros(x.shape, bool)
    for parts in shapes:
        one = np.zeros(x.shape, bool)
        for _, r in parts:
            one ^= inside(x, y, r)
        any_ |= one
    return any_.sum() * step * step


def star(rng, cx, cy, r, n=7):
    a = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(cx + r * rng.uniform(0.4, 1) * math.cos(t), cy + r * rng.uniform(0.4, 1) * math.sin(t)) for t in a]
    return ring if rng.random() < 0.5 else ring[::-1]


def test_union_of_slanted_rings_with_holes(spark):
    rng = random.Random(1)
    shapes = []
    for _ in range(25):
        cx, cy = rng.uniform(8, 32), rng.uniform(8, 32)
        parts = [(False, [(cx + 7 * math.cos(t), cy + 7 * math.sin(t)) for t in np.linspace(0.1, 0.1 + 2 * math.pi, 8)[:-1]])]
        parts.append((True, [(cx + 3 * math.cos(t), cy + 3 * math.sin(t)) for t in np.linspace(0, 2 * math.pi, 6)[:-1]]))
        shapes += [parts, [(False, star(rng, rng.uniform(5, 35), rng.uniform(5, 35), 4))]]
    shapes.append(shapes[0])
    for some in (shapes, shapes[:3], shapes[:1]):
        got = sweep.union_area_of_parts(polygons(spark, some), 10.0).agg(F.sum("union_area")).first()[0]
        assert got == pytest.approx(raster_area(some), rel=2e-3)


def test_crowded_tiles_are_cut(spark, monkeypatch):
    monkeypatch.setattr(sweep, "LEAF", 4)
    rng = random.Random(2)
    shapes = [[(False, star(rng, rng.uniform(10, 30), rng.uniform(10, 30), 6))] for _ in range(60)]
    few = sweep.union_area_of_parts(polygons(spark, shapes), 20.0).collect()
    monkeypatch.setattr(sweep, "LEAF", 1000)
    whole = {(r["ix"], r["iy"]): r["union_area"] for r in sweep.union_area_of_parts(polygons(spark, shapes), 20.0).collect()}
    assert {(r["ix"], r["iy"]): pytest.approx(r["union_area"], rel=1e-9) for r in few} == whole


def test_multipolygon_and_touching_parts(spark):
    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    shapes = [
        [(False, box(1, 1, 9, 9)), (True, box(3, 3, 6, 6)), (False, box(11, 1, 14, 4))],
        [(False, box(4, 4, 5, 5))],  # in the hole
        [(False, box(9, 1, 11, 4))],  # between the parts
        [(False, [(0, 0), (20, 0), (0, 0.5)])],
    ]
    got = sweep.union_area_of_parts(polygons(spark, shapes), 100.0).first()["union_area"]
    assert got == pytest.approx(64 - 9 + 9 + 1 + 6 + 5, abs=1e-9)
    assert sweep.union_area_of_parts(polygons(spark, shapes).limit(0), 100.0).count() == 0


def brute_nearest(o, p, k):
    d = np.sqrt(((o[:, None] - p[None]) ** 2).sum(2))
    return np.argsort(np.round(d, 9) + 1e-12 * np.arange(len(p)), axis=1, kind="stable")[:, :k], d


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_in_mixed_density(spark, k):
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.uniform(0, 5000, (60, 2)), rng.uniform(2000, 2010, (700, 2)), np.repeat(rng.uniform(2003, 2004, (2, 2)), 50, 0)])
    o = np.concatenate([rng.uniform(0, 5000, (40, 2)), rng.uniform(1995, 2015, (150, 2)), p[60:90]])
    pts = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "item long, x double, y double")
    org = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(o)], "id long, x double, y double")
    got = spatial.nearest(org, "id", pts, "item", k, 1000.0).collect()
    at, d = brute_nearest(o, p, k)
    assert sorted((r["id"], r["rank"], r["item"]) for r in got) == sorted((i, j + 1, int(at[i, j])) for i in range(len(o)) for j in range(k))
    assert all(abs(r["dist"] - d[r["id"], r["item"]]) < 1e-9 for r in got)


def test_nearest_by_group_is_one_search(spark):
    rng = np.random.default_rng(8)
    p, g = rng.uniform(0, 3000, (300, 2)), rng.integers(0, 4, 300)
    o = rng.uniform(0, 3000, (50, 2))
    pts = spark.createDataFrame([(i, *map(float, r), f"g{c}") for i, (r, c) in enumerate(zip(p, g))], "item long, x double, y double, kind string")
    org = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(o)], "id long, x double, y double")
    got = spatial.nearest_by_group(org, "id", pts, "kind", ["g0", "g2", "none"], "item").collect()
    d = np.sqrt(((o[:, None] - p[None]) ** 2).sum(2))
    want = {(i, f"g{c}"): int(np.where(g == c, d[i], np.inf).argmin()) for i in range(50) for c in (0, 2)}
    assert {(r["id"], r["kind"]): r["item"] for r in got} == want
    assert spatial.nearest_by_group(org, "id", pts, "kind", ["none"], "item").count() == 0


def test_nearest_segment_in_a_knot(spark):
    rng = np.random.default_rng(9)
    s = np.concatenate([rng.uniform(990, 1010, (300, 4)), rng.uniform(0, 3000, (30, 4))])
    o = np.concatenate([rng.uniform(985, 1015, (80, 2)), rng.uniform(0, 3000, (40, 2))])
    seg = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(s)], "item long, x1 double, y1 double, x2 double, y2 double")
    org = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(o)], "id long, x double, y double")
    got = {r["id"]: r["dist"] for r in spatial.nearest_segment(org, "id", seg, "item", 1000.0).collect()}
    a, b = s[:, :2], s[:, 2:]
    t = np.clip(((o[:, None] - a) * (b - a)).sum(2) / ((b - a) ** 2).sum(1), 0, 1)
    d = np.sqrt(((o[:, None] - a - t[..., None] * (b - a)) ** 2).sum(2)).min(1)
    assert got == {i: pytest.approx(v, abs=1e-9) for i, v in enumerate(d)}


def test_dense_square_ends_in_seconds(spark):
    """As many origins as points, all in a square of 100 m: time grows with their number, not its square."""
    took = {}
    for n in (5_000, 20_000):
        xy = [((F.xxhash64("id", F.lit(s)) % 1_000_000 + 1_000_000) / 20_000.0).alias(c) for s, c in ((1, "x"), (2, "y"))]
        pts, org = spark.range(n).select(F.col("id").alias("item"), *xy), spark.range(n, 2 * n).select("id", *xy)
        began = time.monotonic()
        assert spatial.nearest(org, "id", pts, "item", 1, 1000.0).count() == n
        took[n] = time.monotonic() - began
    assert took[20_000] < 8 * max(took[5_000], 3)


def test_collection_in_byte_ranges(spark, tmp_path):
    odd = ["plain", "}{][", 'quote " and \\ slash', "\\", "{\"type\":\"Feature\"}", "é日本", "\n}\n", "", "]}"]
    feats = []
    for i in range(400):
        geo = {"type": "Polygon", "coordinates": [[[i, 0], [i + 1, 0], [i + 1, 1.5], [i, 0]]]} if i % 3 else {"type": "Point", "coordinates": [i, 2]}
        feats.append({"type": "Feature", "properties": {"k": i, "name": odd[i % len(odd)], "more": {"a": [{"b": "}"}], "c": {}}}, "geometry": geo})
    feats[7]["properties"]["name"] = "x}" * 3000  # one feature over many ranges
    doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:{x}"}}, "features": feats, "tail": {"n": 1}}
    (tmp_path / "a.geojson").write_text(json.dumps(doc, ensure_ascii=False))
    (tmp_path / "b.geojson").write_text(json.dumps({"features": [dict(f, properties=dict(f["properties"], k=1000 + f["properties"]["k"])) for f in feats[:50]], "type": "FeatureCollection"}, indent=1) + "\n")
    (tmp_path / "c.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1009")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert len({(r[0], r[1]) for r in spark.read.text(str(tmp_path), lineSep="}").select("_metadata.file_path", "_metadata.file_block_start").distinct().collect()}) > 60
        texts = sorted((json.loads(r["text"]) for r in collections.feature_texts(spark, str(tmp_path)).collect() if '"Feature"' in r["text"]), key=lambda f: f["properties"]["k"])
        assert texts == feats + [dict(f, properties=dict(f["properties"], k=1000 + f["properties"]["k"])) for f in feats[:50]]
        from pyspark.sql import types as T

        got = files.read_geojson(spark, str(tmp_path), T.StructType([T.StructField("k", T.LongType()), T.StructField("name", T.StringType())])).collect()
    finally:
        for k, v in zip(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), was):
            spark.conf.set(k, v)
    assert sorted((r["k"], r["name"], r["geometry_type"]) for r in got) == sorted((f["properties"]["k"], f["properties"]["name"], f["geometry"]["type"]) for f in texts)


def test_turkish_feed(spark, tmp_path):
    (tmp_path / "stops").mkdir()
    (tmp_path / "stops" / "stops.csv").write_bytes("stop_id,stop_name\n1,Şişli Ğüneş €5\n2,İstinye ığdır\n".encode("cp1254"))
    got = files.read_gtfs(spark, str(tmp_path), {"stops": ["stop_id", "stop_name"]}, encoding="cp1254")["stops"].collect()
    assert [tuple(r) for r in got] == [("1", "Şişli Ğüneş €5"), ("2", "İstinye ığdır")]
