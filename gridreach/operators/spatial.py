"""Spatial joins as equi-joins on bucket keys, and ring-search nearest neighbours.

No geometry index and no cross join: both sides get integer tile keys, Spark
hashes on those keys, and an exact predicate filters the candidates.  Copies of
a coordinate are collapsed before the shuffle wherever the result only depends
on coordinates, and AQE splits tiles that stay hot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridreach.functions import geometry as g
from gridreach.session import cut, shuffle_width


def tile(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size)))


def spread_rows(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to as many tasks as a shuffle has: a small file is read by one task, however much work its rows make."""
    return df.repartition(shuffle_width(df.sparkSession))


def fishnet(bounds: DataFrame, size: float) -> DataFrame:
    """All size x size cells covering each (x0, y0, x1, y1) row; ix, iy are absolute tile numbers.

    Columns of cells are spread over tasks before rows are exploded, so one
    bounds row does not mean one task.
    """
    last_x, last_y = F.ceil(F.col("x1") / size) - 1, F.ceil(F.col("y1") / size) - 1
    rows = bounds.select(
        tile(F.col("x0"), size).alias("_a"), last_x.alias("_b"), F.explode(F.sequence(tile(F.col("y0"), size), last_y)).alias("iy")
    )
    cells = rows.repartition("iy").select("iy", F.explode(F.sequence("_a", "_b")).alias("ix"))
    return cells.select("ix", "iy", (F.col("ix") * float(size)).alias("x0"), (F.col("iy") * float(size)).alias("y0"))


def point_to_cell(points: DataFrame, size: float) -> DataFrame:
    """Adds (ix, iy); a point on a shared border goes to the cell above and to the right."""
    return points.withColumn("ix", tile(F.col("x"), size)).withColumn("iy", tile(F.col("y"), size))


def join_cells(points: DataFrame, grid: DataFrame, size: float, how: str = "inner") -> DataFrame:
    """Points with the columns of the grid row they fall in."""
    return point_to_cell(points, size).join(grid.select("ix", "iy", *[c for c in grid.columns if c not in ("ix", "iy", *points.columns)]), ["ix", "iy"], how)


def _box_tiles(df: DataFrame, size: float, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """One row per tile a box touches, as (_bx, _by)."""
    return df.withColumn("_bx", F.explode(F.sequence(tile(x0, size), tile(x1, size)))).withColumn(
        "_by", F.explode(F.sequence(tile(y0, size), tile(y1, size)))
    )


def _around(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """One row per tile in the 3 x 3 block around a point."""
    bx, by = tile(F.col(x), size), tile(F.col(y), size)
    return df.withColumn("_bx", F.explode(F.sequence(bx - 1, bx + 1))).withColumn("_by", F.explode(F.sequence(by - 1, by + 1)))


def _on_tiles(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join of rows spread over tiles, always shuffled: Spark's size estimate knows nothing of the spreading, so a side it would broadcast can be many times larger."""
    return left.join(right.hint("merge"), list(keys))


def radius_pairs(a: DataFrame, b: DataFrame, r: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs within r (inclusive). a has (x, y); b's columns must not clash except `on`; b has (bx, by)."""
    left = _around(a, r)
    right = b.withColumn("_bx", tile(F.col("b_x"), r)).withColumn("_by", tile(F.col("b_y"), r))
    dx, dy = F.col("x") - F.col("b_x"), F.col("y") - F.col("b_y")
    return _on_tiles(left, right, [*on, "_bx", "_by"]).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= float(r) ** 2).drop("_bx", "_by")


def as_target(df: DataFrame, *keep: str, **renamed: str) -> DataFrame:
    """Rename x, y to b_x, b_y and pick columns for the right side of a spatial join."""
    return df.select(F.col("x").alias("b_x"), F.col("y").alias("b_y"), *keep, *[F.col(c).alias(n) for n, c in renamed.items()])


#: A tile with more distinct spots is opened into its four quarters rather than compared spot by spot.
LEAF = 32


def _counted(origins: DataFrame, key: str, piles: DataFrame, counts: Sequence[str], r: float) -> DataFrame:
    """Sums of the pile columns `counts` within r (inclusive) of each origin that has any.

    Tiles wholly inside the circle are added by their sums, tiles outside are dropped, and only tiles on the rim are opened:
    crowded ones into quarters, level by level, the others into their spots.  An origin in a crowd of n spots thus meets
    about the square root of n tiles instead of n spots.
    """
    r2, size, parts = float(r) ** 2, float(r), []
    at = lambda d: d.withColumn("_bx", tile(F.col("x"), size)).withColumn("_by", tile(F.col("y"), size))
    piles = cut(piles)
    pairs = _around(origins.select(key, "x", "y"), size)
    while True:
        tiles = at(piles).groupBy("_bx", "_by").agg(*[F.sum(c).alias(c) for c in counts], F.count("*").alias("_spots"))
        x0, y0 = F.col("_bx") * size, F.col("_by") * size
        far = F.greatest(F.abs(F.col("x") - x0), F.abs(F.col("x") - x0 - size)) ** 2 + F.greatest(F.abs(F.col("y") - y0), F.abs(F.col("y") - y0 - size)) ** 2
        out_x, out_y = F.greatest(x0 - F.col("x"), F.col("x") - x0 - size, F.lit(0.0)), F.greatest(y0 - F.col("y"), F.col("y") - y0 - size, F.lit(0.0))
        met = pairs.join(tiles, ["_bx", "_by"]).where(out_x * out_x + out_y * out_y <= r2 * (1 + 1e-9))
        met = cut(met.withColumn("_in", far <= r2 * (1 - 1e-9)))
        parts.append(met.where("_in").select(key, *counts))
        rim = met.where(~F.col("_in"))
        spots = at(piles).select("_bx", "_by", F.col("x").alias("b_x"), F.col("y").alias("b_y"), *counts)
        dx, dy = F.col("x") - F.col("b_x"), F.col("y") - F.col("b_y")
        parts.append(rim.where(F.col("_spots") <= LEAF).select(key, "x", "y", "_bx", "_by").join(spots, ["_bx", "_by"]).where(dx * dx + dy * dy <= r2).select(key, *counts))
        crowded = rim.where(F.col("_spots") > LEAF)
        if crowded.isEmpty():
            break
        size /= 2
        half = F.array(F.lit(0), F.lit(1))
        pairs = crowded.select(key, "x", "y", (F.col("_bx") * 2).alias("_bx"), (F.col("_by") * 2).alias("_by"))
        pairs = pairs.withColumn("_i", F.explode(half)).withColumn("_j", F.explode(half)).select(key, "x", "y", (F.col("_bx") + F.col("_i")).alias("_bx"), (F.col("_by") + F.col("_j")).alias("_by"))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy(key).agg(*[F.sum(c).alias(c) for c in counts])


def count_within(origins: DataFrame, key: str, points: DataFrame, r: float, counts: dict[str, Column] | None = None) -> DataFrame:
    """Number of points within r of each origin, 0 when none; `counts` names conditional counts.

    Points are first added up per coordinate, so a pile of copies is one row.
    """
    counts = counts or {"n_within": F.lit(True)}
    piles = points.groupBy("x", "y").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    summed = _counted(origins, key, piles, list(counts), r)
    return origins.select(key).join(summed, key, "left").na.fill(0, list(counts))


def near_pair_count(points: DataFrame, r: float) -> DataFrame:
    """Number of point pairs within r of each other; neither copies of a spot nor crowded spots are paired one by one."""
    piles = cut(points.groupBy("x", "y").agg(F.count("*").alias("n")).withColumn("spot", F.monotonically_increasing_id()))
    around = _counted(piles, "spot", piles.select("x", "y", F.col("n").alias("m")), ["m"], r)
    # every unordered pair of points shows up twice, a point with itself once
    twice = F.sum(F.col("n") * (F.col("m") - 1))
    return piles.join(around, "spot").agg(F.floor(F.coalesce(twice, F.lit(0)) / 2).alias("n_pairs"))


def near_pairs(points: DataFrame, key: str, r: float) -> DataFrame:
    """Pairs (a_id < b_id) of points within r of each other."""
    p = radius_pairs(points.select(F.col(key).alias("a_id"), "x", "y"), as_target(points, b_id=key), r)
    return p.where(F.col("a_id") < F.col("b_id")).select("a_id", "b_id", F.sqrt("d2").alias("dist"))


def near_any(a: DataFrame, key: str, b: DataFrame, r: float, on: Sequence[str] = (), keep: bool = True) -> DataFrame:
    """Rows of a that have (keep) or lack (not keep) a point of b within r, matching `on`.

    In tiles of side r / sqrt(2) any two points are within r, so rows that share
    a tile with b are settled by a key join; only the others are compared point
    by point.  However many points pile up in one spot, they never form pairs
    with each other.
    """
    side = r / 1.4143  # a hair under r / sqrt(2), so a shared tile always means within r
    spots = b.select("x", "y", *on).distinct()
    mini = lambda d: d.withColumn("_mx", tile(F.col("x"), side)).withColumn("_my", tile(F.col("y"), side))
    full = mini(spots).select("_mx", "_my", *on).distinct()
    left = mini(a.select(key, "x", "y", *on))
    shared = left.join(full, ["_mx", "_my", *on], "left_semi").select(key)
    rest = left.join(full, ["_mx", "_my", *on], "left_anti").drop("_mx", "_my")
    hit = radius_pairs(rest, as_target(spots, *on), r, on).select(key).union(shared).distinct()
    return a.join(hit, key, "left_semi" if keep else "left_anti")


#: Times a crowded tile is opened into 4 x 4 smaller ones in a nearest-neighbour search.
DEEPEST = 16


def _ring_search(
    origins: DataFrame,
    keys: Sequence[str],
    tiles_at: Callable[[float], DataFrame],
    opened: Callable[[DataFrame, float], DataFrame],
    dist: Column,
    item: str,
    k: int,
    start: float,
    reach: float,
    skip: Column | None,
    on: Sequence[str] = (),
) -> DataFrame:
    """k nearest items per origin, exact; `on` columns of origins and items must agree.

    Level l looks at the 3 x 3 block of tiles of size s = start * 4^l around an origin.  The k-th distance is final once it is
    <= s.  Within a level the search goes down a quadtree from counts: from the borders of tiles we get a radius that surely
    holds k items, tiles beyond it go, and tiles with more than LEAF items are opened into 4 x 4 smaller ones, for the origins that
    still need them, until tiles are small enough to have their items fetched.  `opened` cuts items of tiles of a size into those.
    """
    todo, done, level = origins, None, 0
    enough = k + (0 if skip is None else 1)
    leaf = max(LEAF, 4 * enough)
    tiles = [*on, "_bx", "_by"]
    while True:
        s = start * 4**level
        fine = s / 4
        items = tiles_at(fine)
        near = _around(todo.select(*keys, "x", "y", *[c for c in on if c not in keys]), s).withColumn("_cut", F.lit(None).cast("double"))
        found_items: list[DataFrame] = []
        for depth in range(DEEPEST + 1):
            summary = items.groupBy(*tiles).agg(F.count("*").alias("_n")).select(
                *on, F.col("_bx").alias("_fx"), F.col("_by").alias("_fy"), "_n", F.floor(F.col("_bx") / 4).alias("_bx"), F.floor(F.col("_by") / 4).alias("_by")
            )
            near = cut(_within_cut(_on_tiles(near, summary, tiles).drop("_bx", "_by"), keys, fine, enough))
            named = near.withColumnsRenamed({"_fx": "_bx", "_fy": "_by"})
            crowded = named.where(F.col("_n") > leaf) if depth < DEEPEST else named.where(F.lit(False))
            calm = named.where(F.col("_n") <= leaf) if depth < DEEPEST else named
            found_items.append(_on_tiles(calm.select(*keys, "x", "y", *[c for c in tiles if c not in keys]), items, tiles).drop(*[c for c in on if c not in keys]))
            if depth == DEEPEST or crowded.isEmpty():
                break
            items = cut(opened(items.join(crowded.select(*tiles).distinct(), tiles, "left_semi"), fine))
            near = crowded.select(*keys, "x", "y", *[c for c in tiles if c not in keys], "_cut")
            fine = fine / 4
        cand = found_items[0]
        for more in found_items[1:]:
            cand = cand.unionByName(more)
        if skip is not None:
            cand = cand.where(~skip)
        cand = cand.withColumn("dist", dist).groupBy(*keys, item).agg(F.min("dist").alias("dist"))
        if k == 1:
            best = cand.groupBy(*keys).agg(F.array(F.min(F.struct("dist", item))).alias("_best"))
        else:
            ranked = cand.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("dist", item)))
            best = ranked.where(F.col("_rank") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("dist", item))).alias("_best"))
        final = s >= reach
        if final:
            found = best
        else:
            sure = (F.size("_best") == k) & (F.element_at("_best", -1)["dist"] <= s)
            state = cut(todo.join(best, list(keys), "left").withColumn("_sure", F.coalesce(sure, F.lit(False))))
            found = state.where("_sure").select(*keys, "_best")
            todo = state.where(~F.col("_sure")).drop("_best", "_sure")
        done = found if done is None else done.unionByName(found)
        if final or todo.isEmpty():
            out = done.select(*keys, F.posexplode("_best").alias("_i", "_b"))
            return out.select(*keys, F.col("_b")[item].alias(item), F.col("_b.dist").alias("dist"), (F.col("_i") + 1).alias("rank"))
        level += 1


def _within_cut(near: DataFrame, keys: Sequence[str], fine: float, enough: int) -> DataFrame:
    """Tiles (_fx, _fy, _n) of each origin that can hold one of its `enough` nearest; `_cut` is the squared radius known so far."""
    fx0, fy0 = F.col("_fx") * fine, F.col("_fy") * fine
    gx = F.greatest(fx0 - F.col("x"), F.col("x") - fx0 - fine, F.lit(0.0))
    gy = F.greatest(fy0 - F.col("y"), F.col("y") - fy0 - fine, F.lit(0.0))
    hx = F.greatest(F.abs(fx0 - F.col("x")), F.abs(fx0 + fine - F.col("x")))
    hy = F.greatest(F.abs(fy0 - F.col("y")), F.abs(fy0 + fine - F.col("y")))
    near = near.withColumn("_lo", (gx * gx + gy * gy) * (1 - 1e-12)).withColumn("_hi", (hx * hx + hy * hy) * (1 + 1e-12))
    w = Window.partitionBy(*keys)  # an origin's tiles: 12 x 12 at first, then 4 x 4 for each opened one within its radius
    cum = F.sum("_n").over(w.orderBy("_hi", "_fx", "_fy").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("_cum", cum).withColumn("_cut", F.least("_cut", F.min(F.when(F.col("_cum") >= enough, F.col("_hi"))).over(w)))
    return near.where(F.col("_cut").isNull() | (F.col("_lo") <= F.col("_cut"))).drop("_cum", "_lo", "_hi")


def _point_tiles(items: DataFrame, size: float) -> DataFrame:
    return items.withColumn("_bx", tile(F.col("b_x"), size)).withColumn("_by", tile(F.col("b_y"), size))


def extent(*frames: DataFrame) -> float:
    """Side of the square holding all (x, y) rows; one aggregate job."""
    box = None
    for f in frames:
        one = f.select(F.col("x").alias("x"), F.col("y").alias("y"))
        box = one if box is None else box.unionByName(one)
    r = box.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    return 1.0 + max(r[0] or 0.0, r[1] or 0.0)


def nearest(origins: DataFrame, key: str, points: DataFrame, item: str, k: int = 1, start: float = 500.0, exclude_self: bool = False) -> DataFrame:
    """(key, item, dist, rank) of the k nearest points; ties go to the lowest item id.

    Origins keep their own row; copies of a point coordinate beyond the k lowest ids cannot
    be among the k nearest and are dropped exactly.
    """
    skip = (F.col(key) == F.col("_item")) if exclude_self else None
    found = _nearest(origins.select(key, "x", "y"), [key], points, item, k, start, skip)
    return found.withColumnRenamed("_item", item if item != key else f"near_{item}")


def _nearest(origins: DataFrame, keys: Sequence[str], points: DataFrame, item: str, k: int, start: float, skip: Column | None, on: Sequence[str] = ()) -> DataFrame:
    need = k + (0 if skip is None else 1)
    pts = points.select(F.col("x").alias("b_x"), F.col("y").alias("b_y"), F.col(item).alias("_item"), *on)
    if need == 1:
        pts = pts.groupBy("b_x", "b_y", *on).agg(F.min("_item").alias("_item"))
    else:
        w = Window.partitionBy("b_x", "b_y", *on).orderBy("_item")
        pts = pts.withColumn("_c", F.row_number().over(w)).where(F.col("_c") <= need).drop("_c")
    dist = g.distance(F.col("x"), F.col("y"), F.col("b_x"), F.col("b_y"))
    return _ring_search(origins, keys, lambda size: _point_tiles(pts, size), lambda items, size: _point_tiles(items, size / 4), dist, "_item", k, start, extent(origins, points), skip, on)


def nearest_by_group(origins: DataFrame, key: str, points: DataFrame, group: str, groups: Sequence, item: str, start: float = 500.0) -> DataFrame:
    """Nearest point of each listed group, long form (key, group, item, dist); groups with no point give no row.

    One search keyed by (origin, group), however many groups there are.
    """
    listed = points.where(F.col(group).isin(list(groups)))
    there = listed.select(group).distinct().agg(F.sort_array(F.collect_set(group)).alias("g")).first()["g"]  # listed groups at most
    if not there:
        return origins.select(key, F.lit(None).cast(points.schema[group].dataType).alias(group), F.lit(None).cast(points.schema[item].dataType).alias(item), F.lit(None).cast("double").alias("dist"), F.lit(1).alias("rank")).limit(0)
    each = origins.select(key, "x", "y", F.explode(F.array(*[F.lit(v) for v in there]).cast(f"array<{points.schema[group].dataType.simpleString()}>")).alias(group))
    found = _nearest(each, [key, group], listed, item, 1, start, None, [group])
    return found.select(key, F.col("_item").alias(item), "dist", "rank", group)


def nearest_segment(origins: DataFrame, key: str, segs: DataFrame, item: str, start: float = 500.0) -> DataFrame:
    """Nearest segment (x1, y1, x2, y2) of each origin by true point-to-segment distance."""
    ends = segs.select(F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(segs.select(F.col("x2").alias("x"), F.col("y2").alias("y")))
    reach = extent(origins, ends)
    s = segs.groupBy("x1", "y1", "x2", "y2").agg(F.min(item).alias("_item"))
    quarter = F.explode(F.sequence(F.lit(0), F.lit(3)))

    def opened(items: DataFrame, size: float) -> DataFrame:
        small = items.withColumn("_i", quarter).withColumn("_j", quarter)
        small = small.withColumn("_bx", F.col("_bx") * 4 + F.col("_i")).withColumn("_by", F.col("_by") * 4 + F.col("_j")).drop("_i", "_j")
        return _passing(small, size / 4)

    dist = g.point_segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    found = _ring_search(origins.select(key, "x", "y"), [key], lambda size: segment_tiles(s, size), opened, dist, "_item", 1, start, reach, None)
    return found.withColumnRenamed("_item", item)


def _passing(rows: DataFrame, size: float) -> DataFrame:
    """Rows whose segment passes through their tile."""
    t = g.clip_segment(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.col("_bx") * size, F.col("_by") * size, (F.col("_bx") + 1) * size, (F.col("_by") + 1) * size)
    return rows.withColumn("_t", t).where(F.col("_t.t0") <= F.col("_t.t1")).drop("_t")


def segment_tiles(segs: DataFrame, size: float) -> DataFrame:
    """One row per tile a segment passes through (candidate tiles of its box, exactly clipped)."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    out = _box_tiles(segs, size, F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))
    return _passing(out, size)


def point_in_polygon(points: DataFrame, polys: DataFrame, size: float, poly_id: str, key: str) -> DataFrame:
    """Left join of points to the polygon (column `ring` or, with holes and several outlines, `parts`; box x0..y1) that holds them; lowest id if several."""
    shape = "parts" if "parts" in polys.columns else "ring"
    cand = _box_tiles(polys.select(poly_id, shape, "x0", "y0", "x1", "y1"), size, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    pts = points.withColumn("_bx", tile(F.col("x"), size)).withColumn("_by", tile(F.col("y"), size))
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    hit = pts.select(key, "x", "y", "_bx", "_by").join(cand, ["_bx", "_by"]).where(inside)
    holds = g.point_in_parts if shape == "parts" else g.point_in_ring
    hit = hit.where(holds(F.col("x"), F.col("y"), F.col(shape))).groupBy(key).agg(F.min(poly_id).alias(poly_id))
    return points.join(hit, key, "left")


def box_ring_col(df: DataFrame) -> DataFrame:
    return df.withColumn("ring", g.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


def overlay_boxes(boxes: DataFrame, grid_cols: DataFrame | None, size: float) -> DataFrame:
    """Rectangle x cell pieces with `piece_area`; boxes have x0, y0, x1, y1, the grid has ix, iy.

    Leave grid_cols out to aggregate by (ix, iy) first and join the grid to the few result rows.
    """
    cand = _box_tiles(boxes, size, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    cell = (F.col("_bx") * size, F.col("_by") * size, (F.col("_bx") + 1) * size, (F.col("_by") + 1) * size)
    area = g.rect_overlap_area((F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), cell)
    pieces = cand.withColumn("piece_area", area).where(F.col("piece_area") > 0)
    pieces = pieces.withColumnRenamed("_bx", "ix").withColumnRenamed("_by", "iy")
    return pieces if grid_cols is None else pieces.join(grid_cols, ["ix", "iy"])


def overlay_rings(polys: DataFrame, grid_cols: DataFrame | None, size: float) -> DataFrame:
    """General polygon x cell pieces: candidate cells from the box, exact clip, shoelace area; `parts` or `ring` as in point_in_polygon."""
    cand = spread_rows(_box_tiles(polys, size, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    clip = lambda r: g.clip_ring(r, F.col("_bx") * size, F.col("_by") * size, (F.col("_bx") + 1) * size, (F.col("_by") + 1) * size)
    area = g.parts_area(F.col("parts"), clip) if "parts" in polys.columns else g.ring_area(clip(F.col("ring")))
    pieces = cand.withColumn("piece_area", area).where(F.col("piece_area") > 0)
    pieces = pieces.withColumnRenamed("_bx", "ix").withColumnRenamed("_by", "iy").drop("ring", "parts")
    return pieces if grid_cols is None else pieces.join(grid_cols, ["ix", "iy"])


def segment_parts(segs: DataFrame, size: float) -> DataFrame:
    """One row per tile (_bx, _by) that holds a part t0 < t1 of a segment."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    cand = _box_tiles(segs, size, F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))
    t = g.clip_segment(x1, y1, x2, y2, F.col("_bx") * size, F.col("_by") * size, (F.col("_bx") + 1) * size, (F.col("_by") + 1) * size)
    parts = cand.withColumn("_t", t).where(F.col("_t.t0") < F.col("_t.t1"))
    return parts.select("*", F.col("_t.t0").alias("t0"), F.col("_t.t1").alias("t1")).drop("_t")


def overlay_segments(segs: DataFrame, grid_cols: DataFrame | None, size: float) -> DataFrame:
    """Segment x cell pieces with t0, t1 and `piece_m`."""
    length = g.distance(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    pieces = segment_parts(segs, size).withColumn("piece_m", (F.col("t1") - F.col("t0")) * length)
    pieces = pieces.withColumnRenamed("_bx", "ix").withColumnRenamed("_by", "iy")
    return pieces if grid_cols is None else pieces.join(grid_cols, ["ix", "iy"])


def union_area_per_cell(boxes: DataFrame, size: float, by: Sequence[str] = ()) -> DataFrame:
    """Exact area of the union of axis-parallel boxes per cell: (ix, iy, by..., union_area).

    Boxes are cut by tiles.  A tile that one box covers is full, whatever else
    lies in it.  A tile with more than LEAF pieces left is cut into 8 x 8
    smaller ones, again and again, so pieces are only compared within small
    crowds: deep inside a crowd pieces either cover their tile or coincide.
    """
    todo = boxes.select(*by, "x0", "y0", "x1", "y1").distinct()
    parts: list[DataFrame] = []
    fine = size
    while True:
        cut_up = _box_tiles(todo, fine, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
        tx, ty = F.col("_bx") * fine, F.col("_by") * fine
        p = cut_up.select(
            *by, "_bx", "_by",
            F.greatest("x0", tx).alias("x0"), F.greatest("y0", ty).alias("y0"), F.least("x1", tx + fine).alias("x1"), F.least("y1", ty + fine).alias("y1"),
        ).where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).distinct()
        covers = (F.col("x1") - F.col("x0") >= fine) & (F.col("y1") - F.col("y0") >= fine)
        keys = [*by, "_bx", "_by"]
        tiles = cut(p.groupBy(*keys).agg(F.count("*").alias("_n"), F.bool_or(covers).alias("_full")))
        cell = [F.floor(F.col("_bx") * fine / size).alias("ix"), F.floor(F.col("_by") * fine / size).alias("iy")]
        parts.append(tiles.where("_full").select(*by, *cell, F.lit(fine * fine).alias("area")))
        crowded = F.col("_n") > LEAF
        calm = p.join(tiles.where(~F.col("_full") & ~crowded).select(*keys), keys, "left_semi")
        parts.append(_slab_area(calm, keys).select(*by, *cell, "area"))
        hot = tiles.where(~F.col("_full") & crowded).select(*keys)
        if hot.isEmpty():
            break
        todo = cut(p.join(hot, keys, "left_semi").select(*by, "x0", "y0", "x1", "y1").distinct())
        fine = fine / 8
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("ix", "iy", *by).agg(F.sum("area").alias("union_area"))


def _slab_area(p: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union area of boxes per key: vertical slabs between x borders times the covered height over each."""
    cuts = p.select(*keys, F.explode(F.array("x0", "x1")).alias("s")).distinct()
    w = Window.partitionBy(*keys).orderBy("s")
    slabs = cuts.withColumn("e", F.lead("s").over(w)).where(F.col("e").isNotNull())
    over = slabs.join(p, list(keys)).where((F.col("x0") <= F.col("s")) & (F.col("x1") >= F.col("e")))
    merged = covered_length(over, [*keys, "s", "e"], "y0", "y1")
    return merged.groupBy(*keys).agg(F.sum((F.col("e") - F.col("s")) * F.col("covered")).alias("area"))


def covered_length(df: DataFrame, by: Sequence[str], lo: str, hi: str) -> DataFrame:
    """Length covered by the union of intervals per group (gaps and islands)."""
    firsts = df.groupBy(*by, lo).agg(F.max(hi).alias(hi))  # one interval per start, combined before the shuffle
    w = Window.partitionBy(*by).orderBy(lo).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(hi).over(w)
    fresh = F.greatest(F.col(hi) - F.greatest(F.col(lo), F.coalesce(seen, F.col(lo))), F.lit(0.0))
    return firsts.withColumn("_fresh", fresh).groupBy(*by).agg(F.sum("_fresh").alias("covered"))


def covered_share(df: DataFrame, by: Sequence[str], slices: int = 16) -> DataFrame:
    """Like covered_length for [t0, t1] inside [0, 1], with each group spread over `slices` tasks."""
    k = float(slices)
    first = F.least(F.floor(F.col("t0") * k), F.lit(slices - 1))
    last = F.least(F.floor(F.col("t1") * k), F.lit(slices - 1))
    cutup = df.select(*by, "t0", "t1", F.explode(F.sequence(first, last)).alias("_s"))
    cutup = cutup.select(*by, "_s", F.greatest("t0", F.col("_s") / k).alias("t0"), F.least("t1", (F.col("_s") + 1) / k).alias("t1"))
    return covered_length(cutup, [*by, "_s"], "t0", "t1").groupBy(*by).agg(F.sum("covered").alias("covered"))
