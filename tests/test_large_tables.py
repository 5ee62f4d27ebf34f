"""Joins, searches and statistics whose cost shows on large tables only."""

import shutil
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridreach.functions import geometry as g
from gridreach.operators import cells as ce
from gridreach.operators import dedup as dd
from gridreach.operators import graph as gr
from gridreach.operators import ordered
from gridreach.operators import overlap
from gridreach.operators import permute
from gridreach.operators import scoring
from gridreach.operators import spatial as sp
from gridreach.plans import all_queries
from gridreach.plans.world import BASE, World
from tests.check import compare

SF = "/root/testdata/sf0.001"


def _oracle_count(name):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con, con.execute(f"select count(*) from ({all_queries()[name].oracle()}) t").fetchall()[0][0]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_raster_window_is_whole(spark):
    con, n = _oracle_count("a8_raster_window")
    q = all_queries()["a8_raster_window"]
    assert compare(q.build(World(spark, SF)), con, q.oracle()) is None
    assert n == World(spark, SF).pixel.where("pop <> 7 and pop >= 0").count()


def test_queen_takes_every_cell(spark):
    con, n = _oracle_count("i18_queen")
    q, w = all_queries()["i18_queen"], World(spark, SF)
    assert compare(q.build(w), con, q.oracle()) is None
    wide, tall = 40, w.grid.count() // 40
    assert n == 2 * (tall * (wide - 1) + wide * (tall - 1) + 2 * (wide - 1) * (tall - 1))


def test_near_pairs_are_not_broadcast(spark):
    p = spark.range(200).select(F.col("id").alias("poi_id"), (F.col("id") * 37 % 500).cast("double").alias("x"), (F.col("id") * 91 % 500).cast("double").alias("y"))
    out = sp.near_pairs(p, "poi_id", 50.0)
    assert "Broadcast" not in _plan(out)
    rows = {(r.poi_id, r.x, r.y) for r in p.collect()}
    want = {(a, b) for a, ax, ay in rows for b, bx, by in rows if a < b and (ax - bx) ** 2 + (ay - by) ** 2 <= 2500}
    assert {(r.a_id, r.b_id) for r in out.collect()} == want


def test_line_overlap_makes_no_pair_rows(spark):
    # 400 parallel lines, each within reach of all references: rows between stages stay near the lines and references
    lines = spark.range(400).select(F.col("id").alias("line_id"), F.lit(0.0).alias("x1"), (F.col("id") / 100).alias("y1"), F.lit(450.0).alias("x2"), (F.col("id") / 100).alias("y2"))
    ref = spark.range(400).select((F.col("id") + 0.5).alias("x1"), F.lit(1.0).alias("y1"), (F.col("id") + 1.0).alias("x2"), F.lit(1.0).alias("y2"))
    parts = dd.near_parts(sp.segment_parts(lines, 500.0), ref, 15.0, 500.0)
    assert parts.count() == 400 and "Generate" not in _plan(dd.near_parts(sp.segment_parts(lines, 500.0), ref, 15.0, 500.0)).split("ShuffledHashJoin")[0]
    got = dd.near_share(lines, ["line_id"], ref, 15.0)
    assert got.count() == 400
    worst = got.agg(F.min("covered"), F.max("covered")).first()
    reach = 400 + (15.0**2 - 3.0**2) ** 0.5  # the least and the most a line 0 to 3 m away can have
    assert reach / 450 - 1e-9 <= worst[0] and worst[1] <= 415 / 450 + 1e-9


def test_near_intervals_equal_the_expression(spark):
    rng = np.random.default_rng(5)
    rows = rng.choice([0.0, 10.0, 15.0, 25.0, 40.25], (600, 8)) + rng.choice([0.0, 0.1], (600, 8)) * rng.random((600, 8))  # parallel, touching and zero-length ones too
    names = ["ax", "ay", "bx", "by", "cx", "cy", "dx", "dy"]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i long, " + ", ".join(f"{c} double" for c in names))
    want = df.select("i", g.near_interval(*[F.col(c) for c in names], 15.0).alias("t")).orderBy("i").collect()
    each, got = np.arange(600), {}
    for i, a, b in zip(*overlap.near_intervals(overlap.directed(tuple(rows.T[:4])), overlap.directed(tuple(rows.T[4:])), each, each, 15.0)):
        got[i] = (None, None) if a > b else (a, b)
    assert [got.get(i, (None, None)) for i in each] == [(w.t.t0, w.t.t1) for w in want] and len(got) < 600
    assert 50 < sum(w.t.t0 is None for w in want) < 550


def test_crowded_lines_take_seconds(spark):
    # each of 2,500 lines of one tile within reach of all 2,500 references: 6 million intervals
    lines = spark.range(2500).select(F.col("id").alias("line_id"), F.lit(0.0).alias("x1"), (F.col("id") / 1000).alias("y1"), F.lit(450.0).alias("x2"), (F.col("id") / 1000).alias("y2"))
    ref = spark.range(2500).select((F.col("id") * 0.1).alias("x1"), F.lit(1.0).alias("y1"), (F.col("id") * 0.1 + 1).alias("x2"), F.lit(1.0).alias("y2"))
    start = time.time()
    got = {r.line_id: r.covered for r in dd.near_share(lines, ["line_id"], ref, 15.0).collect()}
    assert time.time() - start < 20
    assert len(got) == 2500 and all(abs(c * 450 - 250.9 - (225 - (i / 1000 - 1) ** 2) ** 0.5) < 1e-6 for i, c in got.items())


def test_near_sums_count_equal_parts_once(spark):
    # 600 parts in one tile, each within reach of all 600 references
    at = lambda c: (F.col("id") % 300 / 100).alias(c)
    parts = spark.range(600).select(F.lit(0).cast("long").alias("_bx"), F.lit(0).cast("long").alias("_by"), F.lit(0.0).alias("x1"), at("y1"), F.lit(450.0).alias("x2"), at("y2"), F.lit(2).cast("long").alias("copies"), F.lit(450.0).alias("piece_m"))
    ref = spark.range(600).select((F.col("id") * 0.5).alias("x1"), F.lit(1.0).alias("y1"), (F.col("id") * 0.5 + 1).alias("x2"), F.lit(1.0).alias("y2"))
    out = dd.near_sums(parts, ref, 15.0, 500.0)
    assert "collect_list" not in _plan(out) and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
    r = out.where("whole > 0").collect()
    near = 300 * 300.5 + sum((225 - (i / 100 - 1) ** 2) ** 0.5 for i in range(300))  # each part stands twice and counts once
    assert len(r) == 1 and r[0].whole == 600 * 900 and abs(r[0].near - 2 * near) < 1e-6


def test_near_sums_go_on_over_batches(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PAIRS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        q, (con, _) = all_queries()["f15_pct_road_near_cycleway"], _oracle_count("f15_pct_road_near_cycleway")
        assert compare(q.build(World(spark, SF)), con, q.oracle()) is None
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("lines", [
    "l.* replace (case when l_orderkey%4<>0 then l_partkey end as l_partkey, case when l_orderkey%5<>0 then l_suppkey end as l_suppkey) from l",
    "l.* replace (l_orderkey%7 as l_orderkey, (l_linenumber%2*2+3)::int as l_linenumber, l_partkey*37%600 as l_partkey, l_suppkey*700 as l_suppkey) from l",  # many on one line
    "* from l union all select * from l where l_orderkey%3=0",
])
def test_near_roads_of_odd_tables_follow_sql(spark, tmp_path, lines):
    con = duckdb.connect()
    con.execute(f"create view l as select * from '{SF}/lineitem.parquet'")
    con.execute(f"copy (select {lines}) to '{tmp_path}/lineitem.parquet'")
    shutil.copy(f"{SF}/part.parquet", tmp_path)
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    q = all_queries()["f15_pct_road_near_cycleway"]
    assert compare(q.build(World(spark, str(tmp_path))), con, q.oracle()) is None


@pytest.mark.parametrize("n", [1, 2, 7, 64, 5000])
def test_keyed_shuffle_is_a_permutation(n):
    at = np.arange(n)
    for p in range(1, 6):
        to = permute.shuffled(at, n, p, 42)
        assert sorted(to) == list(at)
        assert (permute.shuffled(to, n, p, 42, back=True) == at).all()


def test_permuted_products_in_blocks_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(permute, "BLOCK", 16)
    cells = spark.createDataFrame([(i * 12 + j, i, j, float((i * 5 + j * j) % 7)) for i in range(12) for j in range(12)], "grid_id long, ix long, iy long, v double")
    adj = ce.queen(cells)
    got = {r.perm: r.num for r in permute.neighbour_products(cells, adj, "v", 30, 1).collect()}
    v = np.array([r.v for r in cells.orderBy("grid_id").collect()])
    pairs = np.array([(r.src, r.dst) for r in adj.collect()])
    degree = np.bincount(pairs[:, 0])
    for p in range(1, 31):
        z = np.empty(144)
        z[permute.shuffled(np.arange(144), 144, p, 1)] = v - v.mean()
        assert abs(got[p] - (z[pairs[:, 0]] * z[pairs[:, 1]] / degree[pairs[:, 0]]).sum()) < 1e-9
    halves = spark.createDataFrame([(r.grid_id, r.v + 0.5) for r in cells.collect()], "grid_id long, v double")
    assert all(abs(r.num - got[r.perm]) < 1e-9 for r in permute.neighbour_products(halves, adj, "v", 30, 1).collect())


def test_permutation_moments_follow_theory(spark):
    cells = spark.createDataFrame([(i * 20 + j, i, j, float((i * 31 + j * 17) % 10)) for i in range(20) for j in range(20)], "grid_id long, ix long, iy long, v double")
    r = gr.moran_permutation(cells.select("grid_id", "v"), ce.queen(cells), "v", 999).first()
    assert r.n_perms == 999 and abs(r.sim_mean + 1 / 399) < 0.004 and 0.02 < r.sim_std < 0.035
    assert abs(r.moran_i - gr.morans_i(cells, ce.queen(cells), "v").first().moran_i) < 1e-12


def test_nearest_search_shuffles_its_tiles(spark, monkeypatch):
    plain, plans = sp._on_tiles, []

    def seen(left, right, keys):
        out = plain(left, right, keys)
        plans.append(_plan(out))
        return out

    monkeypatch.setattr(sp, "_on_tiles", seen)
    at = lambda n, m, name: spark.range(n).select(F.col("id").alias(name), (F.col("id") * m % 997).cast("double").alias("x"), (F.col("id") * 7 * m % 991).cast("double").alias("y"))
    a, b = at(50, 37, "a"), at(80, 61, "b")
    got = {r.a: r.dist for r in sp.nearest(a, "a", b, "b").collect()}
    assert len(plans) >= 2 and not any("BroadcastHashJoin" in p for p in plans)
    points = [(r.x, r.y) for r in b.collect()]
    assert all(abs(got[r.a] - min(((r.x - x) ** 2 + (r.y - y) ** 2) ** 0.5 for x, y in points)) < 1e-9 for r in a.collect())


@pytest.mark.parametrize("name", ["d6_centroid", "d7_clip_concave", "d14b_union_area_parts"])
def test_geometry_of_a_small_file_is_spread(spark, name):
    shapes = all_queries()[name].build(World(spark, SF))
    con, _ = _oracle_count(name)
    assert compare(shapes, con, all_queries()[name].oracle()) is None


def test_overlay_and_centroids_are_dealt_to_tasks(spark):
    one = spark.range(0, 400, 1, 1).select(F.col("id").alias("b"), (F.col("id") * 3.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") * 3.0 + 2).alias("x1"), F.lit(2.0).alias("y1"))
    pieces = sp.overlay_rings(sp.box_ring_col(one), None, 500.0)
    assert pieces.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert abs(pieces.agg(F.sum("piece_area")).first()[0] - 1600) < 1e-6
    assert "RoundRobinPartitioning" in _plan(all_queries()["d6_centroid"].build(World(spark, SF)))


def test_ranks_are_pivoted_in_many_tasks(spark):
    df = spark.range(0, 3000, 1, 1).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    out = ordered.wide_pct_ranks(df, "k", ["a", "b"], "avg")
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    got = out.where("k = 5").first()
    assert abs(got.a - sum(1 if i % 7 < 5 else 0.5 if i % 7 == 5 else 0 for i in range(3000)) / 3000) < 1e-3 and out.count() == 3000


@pytest.mark.parametrize("build", [scoring.cell_stability, scoring.pair_metrics])
def test_scores_out_of_joins_are_made_once(spark, build):
    a = spark.range(600).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"))
    b = spark.range(600).select(F.col("id").alias("k"), F.col("id").cast("string").alias("big"), (F.col("id") % 11).cast("double").alias("b"))
    out = build(a.join(b.hint("merge"), "k"), "k", ["a", "b"])
    assert "Range (0, 600" not in _plan(out)
    assert out.count() == (600 if build is scoring.cell_stability else 1)
