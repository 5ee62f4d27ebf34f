"""Street graphs as edge tables: building, shortest times, components, contiguity statistics.

Iterative operators keep their state in checkpointed tables (the shared folder
of the session), so a lost executor costs a re-read and plans stay short.  Each
loop stops on an empty frontier or an unchanged state.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from gridreach.operators import blocks
from gridreach.operators import ordered as o
from gridreach.operators import permute
from gridreach.operators import relational as rel
from gridreach.operators.dedup import to_undirected
from gridreach.session import cut, settled, shuffle_width

WALK_KMH, CYCLE_KMH = 5.0, 15.0


def both_ways(edges: DataFrame, *cols: str) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols)
    return edges.select("src", "dst", *cols).unionByName(back)


def build_mode_graph(edges: DataFrame, exclude: Mapping[str, Sequence[str]], speed_kmh: float, directed: bool) -> DataFrame:
    """Routable edges (src, dst, length_m, time_s): tag filter, no null or zero length, both ways unless directed.

    A directed edge is also usable backwards unless oneway is 'yes'.
    """
    e = rel.exclude_edges(edges, exclude).where(F.col("length_m") > 0)
    if directed:
        back = e.where(F.coalesce(F.col("oneway"), F.lit("no")) != "yes").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length_m")
        e = e.select("src", "dst", "length_m").unionByName(back)
    else:
        e = both_ways(to_undirected(e.select("src", "dst", "length_m")), "length_m")
    return e.withColumn("time_s", F.col("length_m") / (speed_kmh / 3.6))


def used_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that touch an edge."""
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst"))
    return nodes.join(ends, "node_id", "left_semi")


def _longer_edges(e: DataFrame, cutoff: float) -> DataFrame:
    """Edges plus all two-edge steps, cheapest per pair: halves the rounds of a relaxation."""
    two = e.select("src", F.col("dst").alias("_mid"), F.col("_w").alias("_a")).join(e.select(F.col("src").alias("_mid"), "dst", F.col("_w").alias("_b")), "_mid")
    two = two.select("src", "dst", (F.col("_a") + F.col("_b")).alias("_w")).where((F.col("src") != F.col("dst")) & (F.col("_w") <= cutoff))
    return e.unionByName(two).groupBy("src", "dst").agg(F.min("_w").alias("_w"))


#: Nodes that go to a task together in a search for reach, and arrivals one task takes at once.
BLOCK, ARRIVALS = 4096, 1_000_000
#: Edges that a search in one task may hold, and its sources times its edges.
NEAR, LOAD = 1_000_000, 1 << 24


def reach(edges: DataFrame, sources: DataFrame, cutoff: float, weight: str = "time_s", doublings: int = 0, max_rounds: int = 10_000, ends: DataFrame | None = None) -> DataFrame:
    """(source, node, t) for every node within `cutoff` (inclusive) of each source node; a source reaches itself at 0.

    Nodes are cut into blocks of BLOCK neighbouring ids.  Rounds find the blocks around each block that any of its sources can
    reach; their edges travel to the block, compressed, and one task finds all nodes in reach of its sources
    (`blocks.search`), so no state is shuffled, merged or written.  Sources with more than NEAR edges around them go on in rounds
    of states instead (`_relaxed`), as ids that do not number neighbours near each other ask for.  The search runs
    each time the result is read; `settled` keeps it.  With `ends` (node, ...) only states at their nodes are given, one row for each
    end, with its other columns: a join in the task that finds the states.  With `doublings` the edges are first extended to two, four,
    ... steps.
    """
    spark = edges.sparkSession
    start = sources.select(F.col(sources.columns[0]).alias("source")).distinct()
    tasks = settled(spark, lambda: _searches(edges, start, cutoff, weight, doublings, max_rounds, ends))
    node = tasks.schema["node"].dataType
    more = [] if ends is None else [f for f in ends.schema if f.name != "node"]
    schema = StructType([StructField("source", start.schema["source"].dataType), StructField("node", node), StructField("t", DoubleType()), *more])
    out, at_ends = to_arrow_schema(schema), ends is not None
    found = tasks.where("sources is not null").drop("source", "node").mapInArrow(lambda batches: blocks.search(batches, cutoff, out, at_ends), schema)
    wide = tasks.where("sources is null")
    if not wide.isEmpty():
        far = settled(spark, lambda: _relaxed(edges, wide.select("source"), cutoff, weight, doublings, max_rounds))
        found = found.unionByName(far if ends is None else far.join(ends, "node"))
    if ends is None:
        found = found.unionByName(start.where("source is null").select("source", F.lit(None).cast(node).alias("node"), F.lit(0.0).alias("t")))
    return found


def _blocks(edges: DataFrame, start: DataFrame, cutoff: float, weight: str, doublings: int) -> tuple[DataFrame, DataFrame]:
    """(node, block) of all nodes and sources, and the streets of the blocks as rows of `blocks.packed`."""
    width = shuffle_width(edges.sparkSession)
    e = edges.where(F.col(weight) <= cutoff).select("src", "dst", F.col(weight).cast("double").alias("_w"))
    for _ in range(doublings):
        e = _longer_edges(e, cutoff)
    e = cut(e)
    named = e.select(F.col("src").alias("node")).union(e.select("dst")).union(start).distinct().where("node is not null")
    # numbers run on inside each range of ids, so a block is a run of at most BLOCK ids
    named = cut(named.repartitionByRange("node").sortWithinPartitions("node").withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK)))
    home, goes = named.select(F.col("node").alias("src"), F.col("block").alias("home")), named.select(F.col("node").alias("dst"), F.col("block").alias("goes"))
    e = cut(e.join(home, "src").join(goes, "dst").select("home", "goes", "src", "dst", F.col("_w").alias("w")))
    entries = e.where(F.col("home") != F.col("goes")).select(F.col("goes").alias("home"), F.col("dst").alias("node")).distinct()
    streets = e.repartition(width, "home").groupBy("home").cogroup(entries.repartition(width, "home").groupBy("home"))
    return named, cut(streets.applyInArrow(blocks.packed, "block bigint, edges binary, entries binary, n bigint"))


def _rounds(streets: DataFrame, arrived: DataFrame, cutoff: float, max_rounds: int, inner: bool) -> tuple[DataFrame, DataFrame]:
    """States (source, node, t), inside of blocks too if `inner`, and the blocks (source, block) that each source comes to, from states (source, node, block, t).

    A round carries the states that arrived in a block as far as its edges go (`blocks.spread`, one task a block); what crosses into
    another block travels there if no state as good is known at that node.  Rounds grow with the borders crossed, not with the edges,
    and only crossings are shuffled.
    """
    width = shuffle_width(streets.sparkSession)
    schema = ", ".join(f"{c} {arrived.schema[c].dataType.simpleString()}" for c in ("source", "node", "block", "t")) + ", kind int"
    found, met = arrived.select("source", "node", "t"), arrived.select("source", "block").distinct()
    known: DataFrame | None = None
    for _ in range(max_rounds):
        if arrived.isEmpty():
            return found, met.distinct()
        parts = cut(arrived.groupBy("block").agg(F.ceil(F.count("*") / ARRIVALS).cast("int").alias("_parts")))
        mine = arrived.join(parts, "block").withColumn("_part", F.pmod(F.xxhash64("source"), F.col("_parts")).cast("int")).drop("_parts")
        near = streets.join(parts.select("block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")), "block")
        pieces = mine.repartition(width, "block", "_part").groupBy("block", "_part").cogroup(near.repartition(width, "block", "_part").groupBy("block", "_part"))
        moved = pieces.applyInArrow(lambda arrived, near: blocks.spread(arrived, near, cutoff), schema)
        moved = cut(moved if inner else moved.where("kind > 0"))
        found = found.unionByName(moved.where("kind < 2").select("source", "node", "t"))
        here = moved.where("kind = 1").select("source", "node", F.lit(None).cast("bigint").alias("block"), "t")
        known = here if known is None else known.unionByName(here)
        both = moved.where("kind = 2").select("source", "node", "block", "t", F.lit(1).alias("_new")).unionByName(known.withColumn("_new", F.lit(0)))
        best = both.groupBy("source", "node").agg(F.min(F.struct("t", "_new")).alias("_b"), F.max("block").alias("block"))  # a tie stays with the older state
        arrived = cut(best.where(F.col("_b._new") == 1).select("source", "node", "block", F.col("_b.t").alias("t")))
        met = met.unionByName(arrived.select("source", "block").distinct())
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def _searches(edges: DataFrame, start: DataFrame, cutoff: float, weight: str, doublings: int, max_rounds: int, ends: DataFrame | None) -> DataFrame:
    """Rows of `blocks.task`, one for each search, and one row with its source and no `sources` for each source with too much around it."""
    named, streets = _blocks(edges, start, cutoff, weight, doublings)
    at = cut(start.join(named, F.col("source") == F.col("node")).select("source", "node", "block"))
    _, around = _rounds(streets, at.select(F.col("block").alias("source"), "node", "block", F.lit(0.0).alias("t")), cutoff, max_rounds, False)
    around = cut(around.select(F.col("source").alias("block"), F.col("block").alias("other")))
    streets = streets.select(F.col("block").alias("other"), "edges", "n")
    size = around.join(streets.select("other", "n"), "other", "left").groupBy("block").agg(F.sum("n").alias("_edges"))
    size = size.join(at.groupBy("block").agg(F.count("*").alias("_sources")), "block")
    size = cut(size.select("block", F.coalesce("_edges", F.lit(0)).alias("_edges"), F.greatest(F.ceil(F.col("_edges") * F.col("_sources") / LOAD), F.lit(1)).cast("int").alias("_parts")))
    calm = size.where(F.col("_edges") <= NEAR)
    near = around.join(calm.select("block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")), "block").join(streets.drop("n"), "other", "left")
    if ends is None:
        near = near.withColumn("ends", F.lit(None).cast("binary"))
    else:
        packed = ends.join(named, "node").groupBy("block").applyInArrow(blocks.packed_ends, "block bigint, ends binary")
        near = near.join(cut(packed).withColumnRenamed("block", "other"), "other", "left")
    width = shuffle_width(edges.sparkSession)
    mine = at.join(calm, "block").withColumn("_part", F.pmod(F.xxhash64("source"), F.col("_parts")).cast("int")).select("source", "node", "block", "_part")
    near = near.select("block", "_part", "edges", "ends").repartition(width, "block", "_part").groupBy("block", "_part")
    tasks = mine.repartition(width, "block", "_part").groupBy("block", "_part").cogroup(near).applyInArrow(blocks.task, "block bigint, sources binary, edges binary, ends binary")
    return tasks.unionByName(at.join(size.where(F.col("_edges") > NEAR), "block", "left_semi"), allowMissingColumns=True)


def _relaxed(edges: DataFrame, sources: DataFrame, cutoff: float, weight: str, doublings: int, max_rounds: int) -> DataFrame:
    """What `reach` gives, in rounds of states that are merged at the end."""
    named, streets = _blocks(edges, sources, cutoff, weight, doublings)
    arrived = cut(sources.join(named, F.col("source") == F.col("node")).select("source", "node", "block", F.lit(0.0).alias("t")))
    found, _ = _rounds(streets, arrived, cutoff, max_rounds, True)
    return found.groupBy("source", "node").agg(F.min("t").alias("t"))


def by_threshold(times: DataFrame, minutes: Sequence[float]) -> DataFrame:
    """One row per reached (source, node) and threshold it meets, from the single widest run."""
    ok = F.array_compact(F.array(*[F.when(F.col("t") <= m * 60, F.lit(m)) for m in minutes]))
    return times.withColumn("minutes", F.explode(ok))


def reachable_edges(edges: DataFrame, times: DataFrame) -> DataFrame:
    """(source, src, dst) of edges whose two ends are both reached from the source."""
    times = cut(times)  # read twice
    a = times.select("source", F.col("node").alias("src"))
    b = times.select("source", F.col("node").alias("dst"))
    return edges.select("src", "dst").join(a, "src").join(b, ["source", "dst"]).select("source", "src", "dst")


def reachable_cells(times: DataFrame, anchors: DataFrame) -> DataFrame:
    return times.join(cell_ends(anchors), "node").select("source", "grid_id", "t")


def cell_ends(anchors: DataFrame) -> DataFrame:
    """Cells as ends of a `reach`."""
    return anchors.select(F.col("node_id").alias("node"), "grid_id")


def category_ends(dest: DataFrame) -> DataFrame:
    """Destinations, added up per (node, category), as ends of a `reach`."""
    return dest.where(F.col("snap_status") != "QUESTIONABLE").groupBy(F.col("node_id").alias("node"), "cat").agg(F.count("*").alias("_n"))


def category_access(times: DataFrame, origins: DataFrame, dest: DataFrame, cats: Mapping[str, object], minutes: Sequence[int]) -> DataFrame:
    """Per origin and category: nearest time in minutes, destination count and flag at each threshold."""
    return category_summary(times.join(category_ends(dest), "node"), origins, cats, minutes)


def category_summary(hit: DataFrame, origins: DataFrame, cats: Mapping[str, object], minutes: Sequence[int]) -> DataFrame:
    """`category_access` from a reach that ended at the destinations.

    Sources are distinct anchor nodes, and the category list is closed, so one aggregate does it all.
    """
    aggs = []
    for name, v in cats.items():
        mine = F.col("cat") == v
        aggs.append(F.bround(F.min(F.when(mine, F.col("t"))) / 60, 3).alias(f"{name}_nearest_min"))
        aggs += [F.sum(F.when(mine & (F.col("t") <= m * 60), F.col("_n")).otherwise(0)).alias(f"{name}_count_{m}") for m in minutes]
    per = hit.groupBy("source").agg(*aggs)
    out = origins.select("grid_id", F.col("node_id").alias("source")).join(per, "source", "left").drop("source")
    counts = [f"{n}_count_{m}" for n in cats for m in minutes]
    out = out.na.fill(0, counts)
    return out.select("*", *[(F.col(c) > 0).alias(c.replace("_count_", "_access_")) for c in counts])


def system_ends(stops: DataFrame, systems: Mapping[str, Column]) -> DataFrame:
    """Stops of each system, counted per node, as ends of a `reach`."""
    return stops.groupBy(F.col("node_id").alias("node")).agg(*[F.count_if(c).alias(f"_n_{n}") for n, c in systems.items()])


def system_access(times: DataFrame, origins: DataFrame, stops: DataFrame, systems: Mapping[str, Column], minutes: Sequence[int]) -> DataFrame:
    """Several overlapping stop systems from one run: nearest time, nearest flag and count per system and threshold."""
    return system_summary(times.join(system_ends(stops, systems), "node"), origins, systems, minutes)


def system_summary(hit: DataFrame, origins: DataFrame, systems: Sequence[str] | Mapping[str, Column], minutes: Sequence[int]) -> DataFrame:
    """`system_access` from a reach that ended at the stops."""
    aggs = []
    for n in systems:
        aggs.append(F.bround(F.min(F.when(F.col(f"_n_{n}") > 0, F.col("t"))) / 60, 3).alias(f"{n}_nearest_min"))
        aggs += [F.sum(F.when(F.col("t") <= m * 60, F.col(f"_n_{n}")).otherwise(0)).alias(f"{n}_count_{m}") for m in minutes]
    per = hit.groupBy("source").agg(*aggs)
    out = origins.select("grid_id", F.col("node_id").alias("source")).join(per, "source", "left").drop("source")
    return out.na.fill(0, [f"{n}_count_{m}" for n in systems for m in minutes])


def _routes_by_rounds(edges: DataFrame, pairs: DataFrame, floor: float, max_rounds: int) -> DataFrame:
    """(pair_id, cost, hops) as `_best_routes` gives them, for pairs whose surroundings are too large for one task.

    Rounds relax all pairs together.  Once a pair's target has a cost, states
    that cannot beat it by straight-line distance are dropped, so the search
    ends soon after the target is met.  `pairs` must be connected pairs.
    """
    e = edges.select("src", "dst", F.col("w").alias("_w"), F.col("dx").alias("x"), F.col("dy").alias("y"))
    p = pairs.select("pair_id", "target", "tx", "ty")
    state = cut(pairs.select("pair_id", F.col("source").alias("node"), F.lit(0.0).alias("c"), F.lit(1).alias("h"), F.lit(1).alias("new")))
    for _ in range(max_rounds):
        at_target = state.join(p.select("pair_id", F.col("target").alias("node"), "tx", "ty"), ["pair_id", "node"], "right")
        goal = at_target.select("pair_id", F.col("c").alias("_met"), "tx", "ty")
        front = state.where("new = 1").drop("new").join(goal, "pair_id")
        step = front.join(e, front.node == e.src).select("pair_id", F.col("dst").alias("node"), (F.col("c") + F.col("_w")).alias("c"), (F.col("h") + 1).alias("h"), "_met", F.sqrt((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2).alias("_line"))
        # a hair of slack keeps equal-cost routes in spite of rounding
        step = step.where(F.col("_met").isNull() | (F.col("c") + F.col("_line") * floor <= F.col("_met") * (1 + 1e-12)))
        both = step.select("pair_id", "node", "c", "h", F.lit(1).alias("new")).unionByName(state.withColumn("new", F.lit(0)))
        best = both.groupBy("pair_id", "node").agg(F.min(F.struct("c", "h", "new")).alias("_b"))  # a tie stays with the older state
        state = cut(best.select("pair_id", "node", "_b.c", "_b.h", "_b.new"))
        if state.where("new = 1").isEmpty():
            break
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    return state.join(p.select("pair_id", F.col("target").alias("node")), ["pair_id", "node"]).select("pair_id", F.col("c").alias("cost"), F.col("h").alias("hops"))


#: Pairs searched together, and the edges that one task may hold.
PAIRS, STREETS = 1024, 1_000_000


def _best_routes(edges: DataFrame, pairs: DataFrame, weight: str, max_rounds: int) -> DataFrame:
    """(pair_id, cost, hops) of the cheapest route, fewest hops on a tie.

    A route of cost r stays inside the ellipse around its ends that r allows by the straight line, so pairs are searched
    in square blocks that hold the ellipses of their pairs, each block in one task (`blocks.routes`).  A pair without a
    route of cost r is searched again with twice the r, until one is found or the block holds all edges.  Pairs whose
    block has more than STREETS edges go on in rounds over the whole graph.  `pairs` must be connected pairs.
    """
    e = cut(edges.groupBy("src", "dst").agg(F.min(weight).alias("w"), F.min(F.col(weight) / F.col("chord")).alias("_k"), *[F.first(c).alias(c) for c in ("ax", "ay", "dx", "dy")]))
    places = [F.col(c) for c in ("ax", "ay", "dx", "dy")]
    # cost per metre of straight line is never below the smallest edge ratio
    seen = e.agg(F.min("_k").alias("k"), F.avg("w").alias("w"), F.count("*").alias("n"), F.count_if(F.greatest(*[F.coalesce(F.abs(c), F.lit(float("inf"))) for c in places]) == float("inf")).alias("lost")).first()
    floor, n_edges = seen["k"], seen["n"]
    here = pairs.where(F.col("source") == F.col("target")).select("pair_id", F.lit(0.0).alias("cost"), F.lit(1).alias("hops"))
    todo = pairs.where(F.col("source") != F.col("target"))
    if not n_edges:
        return here
    if seen["lost"] or not 0 < floor < float("inf"):
        return here.unionByName(_routes_by_rounds(e, todo, floor or 0.0, max_rounds))
    line = F.sqrt((F.col("sx") - F.col("tx")) ** 2 + (F.col("sy") - F.col("ty")) ** 2)
    todo = cut(todo.where(line.isNotNull()).withColumn("r", 2 * F.greatest(line * floor, F.lit(seen["w"]))))
    keys, done = ["_level", "_bx", "_by", "_part"], [here]
    for _ in range(max_rounds):
        if todo.isEmpty():
            break
        # the ellipse lies within r / 2 metres of its middle and a block's side is twice that or more; short routes share
        # the blocks of the others, as each size of blocks is another copy of the edges
        level = F.ceil(F.log2(F.col("r") / floor * (1 + 1e-9))).cast("int")
        usual = todo.agg(F.percentile_approx(level, 0.9)).scalar()
        level = F.greatest(level, usual)
        at = todo.withColumn("_level", level).withColumn("_side", F.pow(F.lit(2.0), "_level"))
        for b, s, t in (("_bx", "sx", "tx"), ("_by", "sy", "ty")):
            at = at.withColumn(b, F.floor((F.col(s) + F.col(t)) / 2 / F.col("_side")))
        at = cut(at.drop("_side"))
        square = at.groupBy(*keys[:3]).agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("_parts"))
        levels = [row["_level"] for row in at.select("_level").distinct().collect()]  # one for each power of two
        # edges of a block and of half a block around it: each belongs to 2 x 2 blocks
        near = e.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels])))
        for b, a in (("_bx", "ax"), ("_by", "ay")):
            half = F.floor(F.col(a) * 2 / F.pow(F.lit(2.0), "_level"))
            near = near.withColumn(b, F.explode(F.array(F.floor((half - 1) / 2), F.floor((half + 1) / 2))))
        sizes = near.groupBy(*keys[:3]).agg(F.count("*").alias("_edges"))
        square = cut(square.join(sizes, keys[:3], "left"))
        at = at.join(square, keys[:3]).withColumn("_part", F.pmod(F.xxhash64("pair_id"), F.col("_parts")).cast("int"))
        at = cut(at.withColumn("r", F.when(F.col("_edges") == n_edges, F.lit(float("inf"))).otherwise(F.col("r"))))
        calm = square.where(F.col("_edges") <= STREETS)
        streets = near.join(calm.select(*keys[:3], F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")), keys[:3])
        width = shuffle_width(e.sparkSession)
        mine = at.where(F.col("_edges") <= STREETS).select(*keys, "pair_id", "source", "target", "tx", "ty", "r").repartition(width, *keys)
        streets = streets.select(*keys, "src", "dst", "w", "dx", "dy").repartition(width, *keys)
        kind = at.schema["pair_id"].dataType.simpleString()
        met = cut(mine.groupBy(*keys).cogroup(streets.groupBy(*keys)).applyInArrow(lambda mine, streets: blocks.routes(mine, streets, floor), f"pair_id {kind}, cost double, hops int"))
        done.append(met)
        wide = at.where(F.col("_edges") > STREETS)
        if not wide.isEmpty():
            done.append(_routes_by_rounds(e, wide, floor, max_rounds))
        again = at.where((F.col("_edges") <= STREETS) & (F.col("r") < float("inf"))).join(met, "pair_id", "left_anti")
        todo = cut(again.select(*todo.columns[:-1], (F.col("r") * 2).alias("r")))
    else:
        raise RuntimeError(f"routes left after {max_rounds} rounds")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every


def route_report(edges: DataFrame, nodes: DataFrame, pairs: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """Per (pair_id, source, target): straight line, network length, ratio, time, path size and status.

    The ratio of a pair without distance is null.  Where every edge has the same speed, the shortest route is the
    fastest, and one search gives both.
    """
    xy = nodes.select("node_id", "x", "y")
    p = pairs.join(xy.select(F.col("node_id").alias("source"), F.col("x").alias("sx"), F.col("y").alias("sy")), "source", "left")
    p = p.join(xy.select(F.col("node_id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty")), "target", "left")
    e = edges.join(xy.select(F.col("node_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay")), "src")
    e = e.join(xy.select(F.col("node_id").alias("dst"), F.col("x").alias("dx"), F.col("y").alias("dy")), "dst")
    chord = F.sqrt((F.col("ax") - F.col("dx")) ** 2 + (F.col("ay") - F.col("dy")) ** 2)
    e = cut(e.select("src", "dst", "length_m", "time_s", "ax", "ay", "dx", "dy", F.greatest(chord, F.lit(1e-9)).alias("chord")))
    comp = components(edges)
    a, b = comp.select(F.col("node").alias("source"), F.col("component").alias("_ca")), comp.select(F.col("node").alias("target"), F.col("component").alias("_cb"))
    linked = p.join(a, "source").join(b, "target").where(F.col("_ca") == F.col("_cb")).select("pair_id", "source", "target", "sx", "sy", "tx", "ty")
    linked = cut(linked)
    search = lambda weight: settled(e.sparkSession, lambda: _best_routes(e, linked, weight, max_rounds))
    by_len = search("length_m").select("pair_id", F.col("cost").alias("_len"), F.col("hops").alias("n_path_nodes"))
    speed = e.agg(F.min(F.col("time_s") / F.col("length_m")).alias("lo"), F.max(F.col("time_s") / F.col("length_m")).alias("hi")).first()
    if speed["lo"] is not None and speed["hi"] - speed["lo"] <= 1e-12 * speed["hi"]:
        by_time = by_len.select("pair_id", (F.col("_len") * speed["lo"]).alias("_time"))
    else:
        by_time = search("time_s").select("pair_id", F.col("cost").alias("_time"))
    straight = F.sqrt((F.col("sx") - F.col("tx")) ** 2 + (F.col("sy") - F.col("ty")) ** 2)
    r = p.join(by_len, "pair_id", "left").join(by_time, "pair_id", "left").withColumn("_s", straight)
    status = F.when(F.col("_s").isNull(), "NODE_NOT_IN_GRAPH").when(F.col("_len").isNull(), "ROUTE_NOT_FOUND").otherwise("OK")
    return r.select(
        "pair_id", "source", "target", status.alias("status"), F.bround("_s", 1).alias("straight_line_m"), F.bround("_len", 1).alias("network_m"),
        F.bround(F.try_divide("_len", "_s"), 3).alias("ratio"), F.bround(F.col("_time") / 60, 2).alias("time_min"), "n_path_nodes",
    )


def components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 200) -> DataFrame:
    """(node, component) with component = smallest node id, by randomised contraction.

    Each round every node merges into the neighbour (or itself) with the
    smallest hash for that round, and edges are rewritten between the merged
    nodes.  A round removes a constant share of the nodes whatever the shape of
    the graph, so rounds grow with the logarithm of its size and the total work
    stays near that of the first round.  Rounds go on until no edge is left, at every
    size; the merge maps are composed at the end.  `max_rounds` only guards
    against a graph that changes between rounds: passing it is an error.  The
    tables of the rounds are removed at the end.
    """
    return settled(edges.sparkSession, lambda: _contracted(edges, nodes, max_rounds))


def _contracted(edges: DataFrame, nodes: DataFrame | None, max_rounds: int) -> DataFrame:
    live = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).where(F.col("u") != F.col("v")).distinct()
    live = cut(live)
    maps: list[DataFrame] = []
    for i in range(max_rounds):
        if live.isEmpty():
            break
        ends = live.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(live.select(F.col("v").alias("a"), F.col("u").alias("b")))
        # the first round merges by the ids themselves, which settles stars around a smallest node at once
        rank = lambda c: F.struct((F.xxhash64(F.lit(i), F.col(c)) if i else F.lit(0)).alias("h"), F.col(c).alias("id"))
        near = ends.groupBy("a").agg(F.min(rank("b")).alias("_m"))
        into = cut(near.select("a", F.least(F.col("_m"), rank("a"))["id"].alias("r")))
        maps.append(into)
        ru, rv = into.select(F.col("a").alias("u"), F.col("r").alias("ru")), into.select(F.col("a").alias("v"), F.col("r").alias("rv"))
        moved = live.join(ru, "u").join(rv, "v").where(F.col("ru") != F.col("rv"))
        live = cut(moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
    else:
        raise RuntimeError(f"not contracted after {max_rounds} rounds")
    if not maps:
        ids = edges.select(F.col("src").alias("node")) if nodes is None else nodes.select(F.col(nodes.columns[0]).alias("node"))
        return ids.distinct().select("node", F.col("node").alias("component"))
    label = maps[-1]
    for m in reversed(maps[:-1]):
        up = label.select(F.col("a").alias("r"), F.col("r").alias("_top"))
        label = m.join(up, "r", "left").select("a", F.coalesce("_top", "r").alias("r"))
    label = cut(label)
    low = label.groupBy("r").agg(F.min("a").alias("component"))
    out = label.join(low, "r").select(F.col("a").alias("node"), "component")
    if nodes is None:
        return out
    alone = nodes.select(F.col(nodes.columns[0]).alias("node")).join(label.select(F.col("a").alias("node")), "node", "left_anti")
    return out.unionByName(alone.select("node", F.col("node").alias("component")))


def component_stats(comp: DataFrame) -> DataFrame:
    """Count, largest size and share, singletons and the ten largest sizes (as text)."""
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "component").limit(10).agg(F.array_sort(F.collect_list("n"), lambda a, b: (b - a).cast("int")).alias("t"))
    s = sizes.agg(F.count("*").alias("n_components"), F.max("n").alias("largest"), F.sum("n").alias("_all"), F.count_if(F.col("n") == 1).alias("n_singletons"))
    s = s.withColumn("_top", top.scalar())
    return s.select("n_components", "largest", F.round(F.col("largest") / F.col("_all"), 4).alias("largest_share"), "n_singletons", F.concat_ws(",", F.col("_top").cast("array<string>")).alias("top10"))


def _flood(edges: DataFrame, colour: DataFrame, combine, stop: int) -> DataFrame:
    """Push colours along edges until nothing changes; combine is F.max or F.min."""
    state, frontier = colour, colour
    for _ in range(stop):
        sent = frontier.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(combine("colour").alias("_new"))
        moved = cut(state.join(sent, "node").where(F.greatest("colour", "_new") != F.col("colour")).select("node", F.col("_new").alias("colour")))
        if moved.isEmpty():
            return state
        state = cut(state.join(moved, "node", "left_anti").unionByName(moved))
        frontier = moved
    raise RuntimeError(f"no fixpoint after {stop} rounds")


def scc(edges: DataFrame, nodes: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node, component) of strongly connected components, component = smallest node id.

    Two-way edges join their ends for certain, so they are contracted first with
    `components`; what is left is trimmed (no way in or no way out) and coloured:
    the largest id that can reach a node is its colour, and the part of a colour
    that can reach back to that id is one component.
    """
    e = cut(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct())
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    two_way = e.join(back, ["src", "dst"], "left_semi")
    merged = cut(components(two_way, nodes))
    done: list[DataFrame] = []

    def relabel(df: DataFrame) -> DataFrame:
        s = merged.select(F.col("node").alias("src"), F.col("component").alias("a"))
        d = merged.select(F.col("node").alias("dst"), F.col("component").alias("b"))
        return df.join(s, "src").join(d, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")).where(F.col("src") != F.col("dst")).distinct()

    rest = cut(relabel(e))
    for _ in range(max_rounds):
        while True:  # trim: a node without an edge in or out is alone
            n_before = rest.count()
            rest = cut(rest.join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
            if rest.count() == n_before:
                break
        if rest.isEmpty():
            break
        members = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
        colour = _flood(rest, cut(members.withColumn("colour", F.col("node"))), F.max, max_rounds)
        # backward search inside each colour from its root
        cs = colour.select(F.col("node").alias("src"), F.col("colour").alias("_a"))
        cd = colour.select(F.col("node").alias("dst"), F.col("colour").alias("_b"))
        inside = cut(rest.join(cs, "src").join(cd, "dst").where(F.col("_a") == F.col("_b")).select("src", "dst"))
        found = cut(colour.where(F.col("node") == F.col("colour")))
        frontier = found
        while True:
            nxt = frontier.join(inside, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "colour").distinct().join(found, "node", "left_anti")
            frontier = cut(nxt)
            if frontier.isEmpty():
                break
            found = cut(found.unionByName(frontier))
        done.append(found)
        gone = found.select("node")
        rest = cut(rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if not done:
        return merged
    groups = done[0]
    for d in done[1:]:
        groups = groups.unionByName(d)
    low = groups.groupBy("colour").agg(F.min("node").alias("_low"))
    names = groups.join(low, "colour").select(F.col("node").alias("component"), "_low")
    return merged.join(names, "component", "left").select("node", F.coalesce("_low", "component").alias("component"))


def component_audit(comp: DataFrame, nodes: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per component: nodes, edges, km, anchored cells, population, districts and box area.

    anchors has (grid_id, node_id, district, pop).  The single district's name is
    given when there is just one.
    """
    n = nodes.select(F.col("node_id").alias("node"), "x", "y").join(comp, "node").groupBy("component").agg(
        F.count("*").alias("n_nodes"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")) / 1e6).alias("bbox_km2")
    )
    e = edges.join(comp.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count("*").alias("n_edges"), (F.sum("length_m") / 1000).alias("length_km"))
    a = anchors.join(comp.withColumnRenamed("node", "node_id"), "node_id")
    per = a.groupBy("component", "district").agg(F.count("*").alias("_c"), F.sum("pop").alias("_p"))
    d = per.groupBy("component").agg(F.sum("_c").alias("n_cells"), F.sum("_p").alias("pop"), F.count("*").alias("n_districts"), F.min("district").alias("_one"))
    out = n.join(e, "component", "left").join(d, "component", "left").na.fill(0, ["n_edges", "length_km", "n_cells", "pop", "n_districts"])
    return out.withColumn("only_district", F.when(F.col("n_districts") == 1, F.col("_one"))).drop("_one")


def component_class(audit: DataFrame, major_nodes, known_district, large_pop) -> DataFrame:
    """Class per component; thresholds are numbers or columns (for data-driven ones)."""
    cls = (
        F.when(F.col("n_nodes") >= major_nodes, "MAJOR_VALID_COMPONENT")
        .when(F.col("only_district") == known_district, "KNOWN_NETWORK_LIMITATION")
        .when((F.col("n_cells") == 0) | (F.col("pop") == 0), "QUESTIONABLE_FRAGMENT")
        .when(F.col("pop") >= large_pop, "LARGE_LOCAL_VALID_COMPONENT")
        .otherwise("SMALL_LOCAL_COMPONENT")
    )
    return audit.withColumn("component_class", cls)


def largest_log_gap(sizes: DataFrame, col: str, min_dex: float = 1.0) -> DataFrame:
    """The widest gap in log10 between neighbouring distinct sizes, largest first; a break when above min_dex.

    Distinct sizes are few: at most the square root of twice the total, so one ordered pass is enough.
    """
    d = sizes.select(F.col(col).alias("n")).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"))
    g = d.select("n", F.lead("n").over(w).alias("below"))
    g = g.withColumn("gap", F.log10(F.col("n")) - F.log10(F.col("below")))
    g = g.orderBy(F.desc_nulls_last("gap"), F.desc("n")).limit(1)
    return g.select("n", "below", F.round("gap", 6).alias("gap"), (F.col("gap") > min_dex).alias("is_break"))


def quality_flag(largest: Column, known_district) -> Column:
    """Reliability of a cell from its snap class and component class."""
    cls = F.col("component_class")
    return (
        F.when(F.col("district") == known_district, "KNOWN_NETWORK_LIMITATION")
        .when(F.col("snap_quality") == "QUESTIONABLE", "QUESTIONABLE_ANCHOR")
        .when((cls == "MAJOR_VALID_COMPONENT") & (F.col("component") == largest), "RELIABLE")
        .when(cls.isin("MAJOR_VALID_COMPONENT", "LARGE_LOCAL_VALID_COMPONENT", "SMALL_LOCAL_COMPONENT"), "RELIABLE_SEPARATE_COMPONENT")
        .when(cls == "KNOWN_NETWORK_LIMITATION", "KNOWN_NETWORK_LIMITATION")
        .otherwise("SMALL_COMPONENT_CAUTION")
    )


def first_quality_flag(largest: Column, known_district) -> Column:
    """The simpler flag: anything outside the largest component is isolated."""
    return (
        F.when(F.col("district") == known_district, "KNOWN_NETWORK_LIMITATION")
        .when(F.col("snap_quality") == "QUESTIONABLE", "QUESTIONABLE_ANCHOR")
        .when(F.coalesce(F.col("component") != largest, F.lit(True)), "ISOLATED_NETWORK_COMPONENT")
        .otherwise("RELIABLE")
    )


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("n"))
    e = edges.agg(F.count("*").alias("n_edges"), F.round(F.sum("length_m") / 1000, 1).alias("total_km"))
    return e.withColumn("n_nodes", n.scalar())


def intersections(edges: DataFrame, min_degree: int = 3) -> DataFrame:
    """(node_id, degree) of nodes where at least min_degree undirected edge ends meet."""
    ends = edges.select(F.col("src").alias("node_id")).unionAll(edges.select("dst"))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree")).where(F.col("degree") >= min_degree)


def line_connectivity(lines: DataFrame, tol: float = 5.0) -> DataFrame:
    """Components of lines whose ends snap to the same tol grid; per component the summed straight end-to-end length.

    Parallel lines between the same snapped ends count once (the last one given by line_id).
    """
    key = lambda x, y: F.concat_ws("_", F.rint(F.col(x) / tol).cast("long"), F.rint(F.col(y) / tol).cast("long"))
    e = lines.select("line_id", key("x1", "y1").alias("src"), key("x2", "y2").alias("dst"), F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2).alias("len"))
    e = e.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max(F.struct("line_id", "len")).alias("_l"))
    e = cut(e.select("src", "dst", F.col("_l.len").alias("len")))
    ends = e.select("src").union(e.select("dst")).distinct()
    comp = components(e, ends)
    return e.join(comp.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count("*").alias("n_edges"), F.round(F.sum("len") / 1000, 3).alias("length_km"))


def fragmentation(adj: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Per label: cells, number of connected patches, share of the largest patch."""
    a = labels.select(F.col("grid_id").alias("src"), F.col(label).alias("_a"))
    b = labels.select(F.col("grid_id").alias("dst"), F.col(label).alias("_b"))
    same = adj.join(a, "src").join(b, "dst").where(F.col("_a") == F.col("_b")).select("src", "dst")
    comp = components(same, labels.select("grid_id"))
    patch = comp.withColumnRenamed("node", "grid_id").join(labels.select("grid_id", label), "grid_id").groupBy(label, "component").agg(F.count("*").alias("n"))
    return patch.groupBy(label).agg(F.sum("n").alias("n_cells"), F.count("*").alias("n_patches"), (F.max("n") / F.sum("n")).alias("largest_share"))


def morans_i(values: DataFrame, adj: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Moran's I with row-standardised contiguity, per group `by` (e.g. one per label or permutation).

    values holds (by..., grid_id, value); cells without neighbours carry no weight.
    """
    m = values.groupBy(*by).agg(F.avg(value).alias("_mean"), F.count("*").alias("_n"))
    if by:
        z = values.join(m, list(by)).select(*by, "grid_id", (F.col(value) - F.col("_mean")).alias("z"), "_n")
    else:
        z = values.withColumn("_g", o.scalar_row(m)).select("grid_id", (F.col(value) - F.col("_g._mean")).alias("z"), F.col("_g._n").alias("_n"))
    zd = z.select(*by, F.col("grid_id").alias("dst"), F.col("z").alias("zj"))
    lag = adj.join(zd, "dst").groupBy(*by, F.col("src").alias("grid_id")).agg(F.avg("zj").alias("lag"))
    j = z.join(lag, [*by, "grid_id"], "left")
    num, s0 = F.sum(F.col("z") * F.coalesce("lag", F.lit(0.0))), F.count("lag")
    return j.groupBy(*by).agg(F.try_divide(F.max("_n") * num, s0 * F.sum(F.col("z") * F.col("z"))).alias("moran_i"), F.max("_n").alias("n_cells"))


def morans_by_label(labels: DataFrame, adj: DataFrame, label: str, classes: Sequence) -> DataFrame:
    """Moran's I of each class's 0/1 membership."""
    marks = F.array(*[F.struct(F.lit(c).alias("class"), (F.col(label) == c).cast("double").alias("v")) for c in classes])
    return morans_i(labels.select("grid_id", F.inline(marks)), adj, "v", ["class"])


def moran_permutation(values: DataFrame, adj: DataFrame, value: str, perms: int, seed: int = 42) -> DataFrame:
    """Observed I, permutation mean and deviation, z and pseudo p.

    A permutation leaves the values' mean and squares and the cells with neighbours as they are, so only the sum of products
    is taken anew for each.  Cells without a value take no part.
    """
    base = cut(values.select("grid_id", F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull()))
    adj = cut(adj.join(base.select(F.col("grid_id").alias("src")), "src", "left_semi").join(base.select(F.col("grid_id").alias("dst")), "dst", "left_semi"))
    fixed = base.agg(F.count("*").alias("_n"), F.var_pop("v").alias("_var")).withColumn("_s0", adj.agg(F.count_distinct("src")).scalar())
    sums = permute.neighbour_products(base, adj, "v", perms, seed).withColumn("_f", o.scalar_row(fixed))
    # n * num / (s0 * sum of squares), and the sum of squares is n times the variance
    sim = sums.select("perm", F.try_divide("num", F.col("_f._s0") * F.col("_f._var")).alias("moran_i"))
    obs = morans_i(base, adj, "v")
    s = sim.withColumn("_o", obs.select("moran_i").scalar())
    s = s.agg(F.max("_o").alias("moran_i"), F.avg("moran_i").alias("sim_mean"), F.stddev_pop("moran_i").alias("sim_std"), F.count_if(F.col("moran_i") >= F.col("_o")).alias("_ge"), F.count("*").alias("n_perms"))
    tail = F.least(F.col("_ge"), F.col("n_perms") - F.col("_ge"))
    return s.select("moran_i", "sim_mean", "sim_std", F.try_divide(F.col("moran_i") - F.col("sim_mean"), F.col("sim_std")).alias("z"), ((tail + 1) / (F.col("n_perms") + 1)).alias("p_sim"), "n_perms")
