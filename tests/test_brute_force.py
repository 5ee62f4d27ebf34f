"""Operators without a SQL twin against plain Python on small frames, and invariants."""

import heapq
import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from gridreach.functions import geometry as g
from gridreach.functions import projection as pj
from gridreach.operators import cells as ce
from gridreach.operators import clustering as cl
from gridreach.operators import dedup as dd
from gridreach.operators import graph as gr
from gridreach.operators import ordered as o
from gridreach.operators import scoring as so
from gridreach.operators import spatial as sp


def random_edges(n, m, seed):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), float(r.randrange(1, 9))) for _ in range(m)]


def dijkstra(adj, s, cutoff=math.inf):
    best, heap = {}, [(0.0, s)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in best:
            continue
        best[u] = d
        for v, w in adj.get(u, []):
            if v not in best and d + w <= cutoff:
                heapq.heappush(heap, (d + w, v))
    return best


def adjacency(edges):
    adj = {}
    for u, v, w in edges:
        adj.setdefault(u, []).append((v, w))
    return adj


def test_reach_with_and_without_longer_edges(spark):
    edges = random_edges(60, 150, 1)
    e = spark.createDataFrame(edges, "src long, dst long, time_s double")
    src = spark.createDataFrame([(i,) for i in range(0, 60, 7)], "node_id long")
    want = {(s, n, t) for s in range(0, 60, 7) for n, t in dijkstra(adjacency(edges), s, 12.0).items()}
    for d in (0, 1):
        got = {(r.source, r.node, r.t) for r in gr.reach(e, src, 12.0, doublings=d).collect()}
        assert got == want


def test_components_and_strong_components(spark):
    n, edges = 80, random_edges(80, 90, 2)
    e = spark.createDataFrame(edges, "src long, dst long, length_m double")
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node_id long")
    und = adjacency(edges + [(v, u, w) for u, v, w in edges])
    weak = {i: min(dijkstra(und, i)) for i in range(n)}
    got = {r.node: r.component for r in gr.components(e, nodes).collect()}
    assert got == weak
    hit = {i: set(dijkstra(adjacency(edges), i)) for i in range(n)}
    strong = {i: min(j for j in hit[i] if i in hit[j]) for i in range(n)}
    assert {r.node: r.component for r in gr.scc(e, nodes).collect()} == strong


def test_route_report(spark):
    xy = [(i * 6 + j, 100.0 * i, 100.0 * j) for i in range(6) for j in range(6)]
    r = random.Random(5)
    edges = []
    for a, ax, ay in xy:
        for b, bx, by in xy:
            if abs(ax - bx) + abs(ay - by) == 100.0 and a < b and r.random() < 0.75:
                w = 100.0 * r.choice([1, 1.25, 2])
                edges += [(a, b, w, w / 2), (b, a, w, w / 2)]
    e = spark.createDataFrame(edges, "src long, dst long, length_m double, time_s double")
    nodes = spark.createDataFrame(xy, "node_id long, x double, y double")
    pairs = [(k, r.randrange(36), r.randrange(36)) for k in range(25)] + [(99, 0, 777)]
    got = {x.pair_id: x for x in gr.route_report(e, nodes, spark.createDataFrame(pairs, "pair_id long, source long, target long")).collect()}
    adj = adjacency([(u, v, w) for u, v, w, _ in edges])
    assert len(got) == len(pairs) and got[99].status == "NODE_NOT_IN_GRAPH"
    for k, s, t in pairs[:-1]:
        d = dijkstra(adj, s).get(t)
        if d is None:
            assert got[k].status == "ROUTE_NOT_FOUND"
        else:
            assert got[k].network_m == round(d, 1) and got[k].time_min == round(d / 2 / 60, 2)


def test_line_overlap_share(spark):
    r = random.Random(3)
    seg = lambda: [r.uniform(0, 400) for _ in range(4)]
    cand, ref = [(i, *seg()) for i in range(40)], [(i, *seg()) for i in range(25)]
    schema = "line_id long, x1 double, y1 double, x2 double, y2 double"
    got = {x.line_id: x.covered for x in dd.near_share(spark.createDataFrame(cand, schema), ["line_id"], spark.createDataFrame(ref, schema), 15.0, 100.0).collect()}

    def dist(px, py, s):
        _, a, b, c, d = s
        u = ((px - a) * (c - a) + (py - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)
        u = min(1, max(0, u))
        return math.hypot(px - a - u * (c - a), py - b - u * (d - b))

    for i, x1, y1, x2, y2 in cand:
        k = 2000
        near = sum(any(dist(x1 + (j + 0.5) / k * (x2 - x1), y1 + (j + 0.5) / k * (y2 - y1), s) <= 15 for s in ref) for j in range(k)) / k
        assert abs(near - got.get(i, 0.0)) < 0.003


def test_dense_spots_stay_exact(spark):
    r = random.Random(4)
    pts = [(i, r.choice([0.0, 1.0, 2.5, 40.0]) + r.random() * 3, r.random() * 4, i % 2) for i in range(150)] + [(200 + i, 1.0, 1.0, 0) for i in range(60)]
    df = spark.createDataFrame(pts, "id long, x double, y double, mode long")
    near = lambda a, b, rad: (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= rad * rad
    kept = []
    for p in sorted(pts):
        if not any(q[3] == p[3] and near(p, q, 1.5) for q in kept):
            kept.append(p)
    assert {x.id for x in dd.dedup_greedy(df, "id", "mode", 1.5).collect()} == {p[0] for p in kept}
    assert sp.near_pair_count(df, 1.5).first()[0] == sum(near(a, b, 1.5) for a, b in itertools.combinations(pts, 2))
    a, b = df.where("id % 3 = 0"), df.where("id % 3 = 1")
    want = {p[0] for p in pts if p[0] % 3 == 0 and any(q[0] % 3 == 1 and near(p, q, 0.7) for q in pts)}
    assert {x.id for x in sp.near_any(a, "id", b, 0.7).collect()} == want


def test_nearest_is_exact_far_and_near(spark):
    r = random.Random(6)
    targets = [(i, r.gauss(0, 30), r.gauss(0, 30)) for i in range(300)] + [(900, 5000.0, 5000.0)]
    origins = [(i, r.uniform(-3000, 3000), r.uniform(-3000, 3000)) for i in range(60)]
    got = {}
    for x in sp.nearest(spark.createDataFrame(origins, "oid long, x double, y double"), "oid", spark.createDataFrame(targets, "tid long, x double, y double"), "tid", k=3, start=20.0).collect():
        got.setdefault(x.oid, []).append((round(x.dist, 9), x.tid))
    for oid, ox, oy in origins:
        want = sorted((round(math.hypot(ox - x, oy - y), 9), t) for t, x, y in targets)[:3]
        assert sorted(got[oid]) == want


def test_union_area_in_a_crowd(spark):
    r = random.Random(8)
    boxes = [(i, float(x), float(y), float(x + r.randrange(1, 9)), float(y + r.randrange(1, 9))) for i in range(400) for x, y in [(r.randrange(0, 60), r.randrange(0, 60))]]
    seen = np.zeros((80, 80), bool)
    for _, a, b, c, d in boxes:
        seen[int(a) : int(c), int(b) : int(d)] = True
    df = spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double")
    got = {(x.ix, x.iy): x.union_area for x in sp.union_area_per_cell(df, 16.0).collect()}
    for i in range(5):
        for j in range(5):
            assert abs(got.get((i, j), 0.0) - seen[i * 16 : i * 16 + 16, j * 16 : j * 16 + 16].sum()) < 1e-9


def test_projection_known_point_and_round_trip(spark):
    df = spark.createDataFrame([(27.0, 0.0), (28.9784, 41.0082), (26.2, 39.6)], "lon double, lat double")
    p = df.select("lon", "lat", pj.utm_forward(F.col("lon"), F.col("lat")).alias("p"))
    rows = p.select("lon", "lat", "p", pj.utm_inverse(F.col("p.x"), F.col("p.y")).alias("q")).collect()
    assert abs(rows[0].p.x - 500000) < 1e-6 and abs(rows[0].p.y) < 1e-6
    for r in rows:
        assert abs(r.q.lon - r.lon) < 1e-9 and abs(r.q.lat - r.lat) < 1e-9


def test_hot_group_ranks_and_quantiles(spark):
    r = random.Random(9)
    rows = [("hot", float(r.randrange(50))) for _ in range(3000)] + [("cold", float(r.randrange(5))) for _ in range(40)]
    df = spark.createDataFrame(rows, "k string, v double")
    for x in o.quantiles(df, "v", [0.1, 0.5, 0.93], ["k"]).collect():
        assert abs(x.q - np.quantile([v for k, v in rows if k == x.k], x.p)) < 1e-9
    ranks = {(x.k, x.v): (x.rank_min, x.rank_avg, x.n) for x in o.value_ranks(df, "v", ["k"]).collect()}
    hot = sorted(v for k, v in rows if k == "hot")
    for v in set(hot):
        first, cnt = hot.index(v) + 1, hot.count(v)
        assert ranks[("hot", v)] == (first, first + (cnt - 1) / 2, len(hot))


def test_fragmentation_counts_patches(spark):
    cells = spark.createDataFrame([(i * 4 + j, i, j, "a" if (i < 1 or i > 2) else "b") for i in range(4) for j in range(4)], "grid_id long, ix long, iy long, lab string")
    f = {x.lab: (x.n_cells, x.n_patches, x.largest_share) for x in gr.fragmentation(ce.queen(cells), cells.select("grid_id", "lab"), "lab").collect()}
    assert f == {"a": (8, 2, 0.5), "b": (8, 1, 1.0)}


def test_moran_permutation_finds_structure(spark):
    cells = spark.createDataFrame([(i * 8 + j, i, j, float(i)) for i in range(8) for j in range(8)], "grid_id long, ix long, iy long, v double")
    r = gr.moran_permutation(cells.select("grid_id", "v"), ce.queen(cells), "v", 19).first()
    assert r.moran_i > 0.7 and r.p_sim == 0.05 and abs(r.sim_mean) < 0.2


def test_monte_carlo_is_repeatable_and_bounded(spark):
    dims = spark.createDataFrame([(i, i / 20, 1 - i / 20, 0.5) for i in range(21)], "grid_id long, a double, b double, c double")
    a = {x.grid_id: x for x in so.monte_carlo(dims, "grid_id", ["a", "b", "c"], 200).collect()}
    b = {x.grid_id: x for x in so.monte_carlo(dims, "grid_id", ["a", "b", "c"], 200).collect()}
    assert a == b and all(0 <= x.mean_score <= 1 for x in a.values()) and abs(a[10].mean_score - 0.5) < 1e-9


def test_line_connectivity_and_kmeans_labels(spark):
    lines = [(1, 0.0, 0.0, 100.0, 0.0), (2, 101.0, 1.0, 200.0, 0.0), (3, 900.0, 900.0, 950.0, 900.0)]
    c = gr.line_connectivity(spark.createDataFrame(lines, "line_id long, x1 double, y1 double, x2 double, y2 double"), 5.0).collect()
    assert sorted(x.n_edges for x in c) == [1, 2]
    pts = spark.createDataFrame([(i, float(i % 2) * 50 + i * 0.01, 0.0) for i in range(40)], "id long, a double, b double")
    lab = {x.id: x.label for x in cl.kmeans_labels(cl.matrix(pts, "id", ["a", "b"]), "id", 2, 1, 2).collect()}
    assert len({lab[i] for i in range(0, 40, 2)}) == 1 and lab[0] != lab[1]


def test_mass_is_conserved(spark):
    boxes = spark.createDataFrame([(i, i * 3.7, i * 2.9, i * 3.7 + 5, i * 2.9 + 4) for i in range(50)], "id long, x0 double, y0 double, x1 double, y1 double")
    pieces = sp.overlay_boxes(boxes, None, 10.0).agg(F.sum("piece_area")).first()[0]
    ring = sp.overlay_rings(sp.box_ring_col(boxes), None, 10.0).agg(F.sum("piece_area")).first()[0]
    assert abs(pieces - 50 * 20) < 1e-9 and abs(ring - 50 * 20) < 1e-9


def test_clip_matches_area_of_concave_ring(spark):
    star = [(0, 0), (10, 0), (10, 10), (5, 3), (0, 10), (0, 0)]
    df = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in star],)], "ring array<struct<x double, y double>>")
    whole = df.select(g.ring_area(F.col("ring"))).first()[0]
    halves = df.select(
        g.ring_area(g.clip_ring(F.col("ring"), F.lit(-1.0), F.lit(-1.0), F.lit(20.0), F.lit(6.0))), g.ring_area(g.clip_ring(F.col("ring"), F.lit(-1.0), F.lit(6.0), F.lit(20.0), F.lit(20.0)))
    ).first()
    assert abs(sum(halves) - whole) < 1e-9


def test_crowded_spot_is_not_paired(spark):
    """Twenty thousand distinct points in one square of 100 m: counts stay exact and no tile is paired point by point."""
    import numpy as np

    rng = np.random.default_rng(5)
    xy = rng.uniform(0, 100, (20_000, 2))
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    got = {r.id: r.n_within for r in sp.count_within(pts, "id", pts, 30.0).collect()}
    for i in range(0, 20_000, 997):
        assert got[i] == int((((xy - xy[i]) ** 2).sum(1) <= 900).sum())
    assert sp.near_pair_count(pts, 30.0).first()[0] == (sum(got.values()) - len(got)) // 2


def test_union_area_of_a_crowd(spark):
    """Hundreds of boxes over one cell: nested, crossing and sharing corners."""
    rnd = random.Random(11)
    boxes = [(float(a), float(b), float(a + rnd.randrange(1, 9)), float(b + rnd.randrange(1, 9))) for a, b in ((rnd.randrange(14), rnd.randrange(14)) for _ in range(300))]
    boxes += [(0.5, 0.5, 0.5 + i / 64, 0.5 + i / 32) for i in range(1, 100)]
    got = sp.union_area_per_cell(spark.createDataFrame(boxes, "x0 double, y0 double, x1 double, y1 double"), 32.0).first().union_area
    step = 1 / 64
    covered = np.zeros((int(24 / step), int(24 / step)), bool)
    for x0, y0, x1, y1 in boxes:
        covered[int(round(x0 / step)) : int(round(x1 / step)), int(round(y0 / step)) : int(round(y1 / step))] = True
    assert abs(got - covered.sum() * step * step) < 1e-9
