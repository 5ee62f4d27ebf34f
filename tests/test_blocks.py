"""Shortest paths searched block by block."""

import heapq
import random
import re

import pytest

from gridreach.operators import blocks
from gridreach.operators import graph as gr
from gridreach.plans import all_queries
from gridreach.plans.world import World


def _cheapest(adj, a, limit=float("inf")):
    best, heap = {}, [(0.0, 1, a)]
    while heap:
        d, h, u = heapq.heappop(heap)
        if u in best:
            continue
        best[u] = (d, h)
        for v, w in adj.get(u, ()):
            if d + w <= limit:
                heapq.heappush(heap, (d + w, h + 1, v))
    return best


def _city(n, seed):
    """A lattice with holes and lengths of whole metres, and a wall of missing streets that forces detours."""
    r = random.Random(seed)
    xy = {i * n + j: (100.0 * i, 100.0 * j) for i in range(n) for j in range(n)}
    edges = []
    for a in xy:
        for b in (a + n, a + 1 if a % n < n - 1 else None):
            if b in xy and r.random() < 0.85 and not (a // n == n // 2 and b // n == n // 2 + 1 and a % n > 1):
                edges.append((a, b, float(100 * r.randint(1, 3))))
    adj = {}
    for a, b, w in edges:
        adj.setdefault(a, []).append((b, w))
        adj.setdefault(b, []).append((a, w))
    return xy, edges, adj


@pytest.mark.parametrize("pairs_each, streets, states", [(1024, 1_000_000, 1 << 22), (3, 1_000_000, 900), (3, 150, 1 << 22)])
def test_routes_in_blocks_equal_plain_search(spark, monkeypatch, pairs_each, streets, states):
    monkeypatch.setattr(gr, "PAIRS", pairs_each)
    monkeypatch.setattr(gr, "STREETS", streets)  # the last case sends wide blocks through the rounds
    monkeypatch.setattr(blocks, "STATES", states)
    n = 12
    xy, edges, adj = _city(n, 3)
    r = random.Random(8)
    pairs = [(i, r.randrange(n * n), r.randrange(n * n)) for i in range(40)] + [(40, 5, 5), (41, 0, n * n + 7)]
    e = spark.createDataFrame([(a, b, w, w / 2) for a, b, w in edges] + [(b, a, w, w / 2) for a, b, w in edges], "src long, dst long, length_m double, time_s double")
    nodes = spark.createDataFrame([(k, x, y) for k, (x, y) in xy.items()], "node_id long, x double, y double")
    got = {x.pair_id: x for x in gr.route_report(e, nodes, spark.createDataFrame(pairs, "pair_id long, source long, target long")).collect()}
    assert len(got) == len(pairs) and got[41].status == "NODE_NOT_IN_GRAPH"
    for i, a, b in pairs[:41]:
        want = _cheapest(adj, a).get(b)
        linked = want is not None and (a in adj or a != b)
        assert (got[i].network_m, got[i].n_path_nodes) == ((want[0], want[1]) if linked else (None, None)), (i, a, b)


def test_long_routes_take_few_tables(spark, monkeypatch):
    tables, plain = [], gr.cut
    monkeypatch.setattr(gr, "cut", lambda df: tables.append(1) or plain(df))
    e = spark.range(70).select("id", (gr.F.col("id") + 1).alias("dst")).select(gr.F.col("id").alias("src"), "dst", gr.F.lit(100.0).alias("length_m"), gr.F.lit(72.0).alias("time_s"))
    e = gr.both_ways(e, "length_m", "time_s")
    nodes = spark.range(71).select(gr.F.col("id").alias("node_id"), (gr.F.col("id") * 100.0).alias("x"), gr.F.lit(0.0).alias("y"))
    got = gr.route_report(e, nodes, spark.createDataFrame([(1, 0, 70)], "pair_id long, source long, target long")).first()
    assert got.network_m == 7000.0 and got.n_path_nodes == 71
    assert len(tables) < 40  # one table for each of the 70 steps before


@pytest.mark.parametrize("block, arrivals, states", [(7, 5, 60), (16, 1_000_000, 1 << 22), (4096, 1_000_000, 100)])
def test_reach_in_blocks_equals_plain_search(spark, monkeypatch, block, arrivals, states):
    monkeypatch.setattr(gr, "BLOCK", block)
    monkeypatch.setattr(gr, "ARRIVALS", arrivals)
    monkeypatch.setattr(blocks, "STATES", states)
    r = random.Random(4)
    edges = [(r.randrange(50), r.randrange(60), r.random() * 5) for _ in range(160)]
    edges += [(a, b, w + 1) for a, b, w in edges[:40]]  # dearer copies; nodes 50 to 59 lead nowhere
    adj = {}
    for a, b, w in edges:
        adj.setdefault(f"n{a:02}", []).append((f"n{b:02}", w))
    sources = [f"n{i:02}" for i in range(0, 60, 3)] + ["far"]
    e = spark.createDataFrame([(f"n{a:02}", f"n{b:02}", w) for a, b, w in edges], "src string, dst string, time_s double")
    got = {(x.source, x.node, x.t) for x in gr.reach(e, spark.createDataFrame([(s,) for s in sources], "s string"), 11.0).collect()}
    assert got == {(s, v, d) for s in sources for v, (d, _) in _cheapest(adj, s, 11.0).items()}


def test_reach_takes_few_tables(spark, monkeypatch):
    tables, plain = [], gr.cut
    monkeypatch.setattr(gr, "cut", lambda df: tables.append(1) or plain(df))
    e = spark.range(60).select(gr.F.col("id").alias("src"), (gr.F.col("id") + 1).alias("dst"), gr.F.lit(1.0).alias("time_s"))
    assert gr.reach(e, spark.range(1), 60.0).count() == 61
    assert len(tables) < 15  # one table for each of the 60 steps before


@pytest.mark.parametrize("near, load, states", [(1_000_000, 1 << 24, 1 << 22), (1_000_000, 40, 60), (90, 1 << 24, 1 << 22)])
def test_reach_ends_where_it_is_wanted(spark, monkeypatch, near, load, states):
    monkeypatch.setattr(gr, "BLOCK", 9)
    monkeypatch.setattr(gr, "NEAR", near)  # the last case sends most sources through the rounds
    monkeypatch.setattr(gr, "LOAD", load)
    monkeypatch.setattr(blocks, "STATES", states)
    _, edges, adj = _city(9, 5)
    ends = [(k, f"d{k % 3}", k * 7) for k in (0, 3, 3, 17, 40, 41, 80, 500, 999)] + [(None, "none", 1)]
    sources = [*range(0, 81, 4), 500, None]  # 500 has no street, 999 is no node at all
    e = gr.both_ways(spark.createDataFrame(edges, "src long, dst long, time_s double"), "time_s")
    s = spark.createDataFrame([(x,) for x in sources], "s long")
    want = {(a, v, d) for a in sources if a is not None for v, (d, _) in _cheapest(adj, a, 700.0).items()}
    assert {tuple(x) for x in gr.reach(e, s, 700.0).collect()} == want | {(None, None, 0.0)}
    got = gr.reach(e, s, 700.0, ends=spark.createDataFrame(ends, "node long, kind string, n long"))
    assert got.columns == ["source", "node", "t", "kind", "n"]
    assert sorted(map(tuple, got.collect())) == sorted((a, v, d, k, n) for a, v, d in want for x, k, n in ends if x == v)


def _shuffled_by(plan):
    """Columns by which the final plan deals rows to tasks."""
    return re.findall(r"hashpartitioning\(([^#]*)#", plan)


@pytest.mark.parametrize("name", ["i3_thresholds", "i6_category_access", "i6c_cycle_category_access", "i7_system_access", "i7c_cycle_system_access", "i5_reachable_cells", "n4_extend_threshold"])
def test_states_are_not_shuffled(spark, name):
    plan = all_queries()[name].build(World(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    states = [c.lower() for c in _shuffled_by(plan)]
    assert "MapInArrow" in plan and "node" not in states  # a join on the states' nodes before
