"""Union area of general polygons (holes, several outlines, slanted sides) per cell.

Polygons are clipped to tiles.  A tile that one polygon covers is full, a tile with one piece has that piece's area, and tiles with a few
pieces are swept: between two neighbouring ends or crossings of sides their order along a vertical line is fixed, so the covered height in
its middle, found by adding up windings from below, gives the exact area.  Crowded tiles are cut into 8 x 8 smaller ones, again and
again, so that only small crowds are swept.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridreach.functions import geometry as g
from gridreach.operators.spatial import LEAF, _box_tiles, spread_rows
from gridreach.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Times a tile may be cut before its crowd, which then shares one spot, is swept whole.
DEEPEST = 6


def covered_area(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, w: np.ndarray) -> float:
    """Area where windings add up to one or more; sides run left to right (x1 < x2), w is +1 where the inside lies above."""
    x0, y0 = x1.min(), y1.min()  # near the origin, where crossings keep their digits
    x1, x2, y1, y2 = x1 - x0, x2 - x0, y1 - y0, y2 - y0
    slope = (y2 - y1) / (x2 - x1)
    at = [x1, x2]
    for i in range(0, len(x1), 256):  # crossings, in blocks of sides against all
        a = slice(i, i + 256)
        lo, hi = np.maximum(x1[a, None], x1), np.minimum(x2[a, None], x2)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = ((y1 - slope * x1) - (y1 - slope * x1)[a, None]) / (slope[a, None] - slope)
        at.append(x[np.isfinite(x) & (x > lo) & (x < hi)])
    cuts = np.unique(np.concatenate(at))
    total = 0.0
    for i in range(0, len(cuts) - 1, 1024):
        s, e = cuts[i : i + 1024], cuts[i + 1 : i + 1025]
        s = s[: len(e)]
        mid = (s + e) / 2
        y = np.where((x1 <= mid[:, None]) & (x2 >= mid[:, None]), y1 + slope * (mid[:, None] - x1), np.inf)
        order = np.argsort(y, 1, kind="stable")
        y = np.take_along_axis(y, order, 1)
        depth = np.cumsum(w[order], 1)[:, :-1]
        with np.errstate(invalid="ignore"):
            height = np.where((depth >= 1) & np.isfinite(y[:, 1:]), y[:, 1:] - y[:, :-1], 0.0)
        total += float((np.where(np.isfinite(height), height, 0.0).sum(1) * (e - s)).sum())
    return total


def _swept(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, area) of the union of each key's pieces; `sides` holds (x1, y1, x2, y2, w)."""
    kinds = ", ".join(f"`{k}` {pieces.schema[k].dataType.simpleString()}" for k in keys)

    def one(group: pa.Table) -> pa.Table:
        flat = group.column("sides").combine_chunks().flatten()
        x1, y1, x2, y2, w = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
        area = covered_area(x1, y1, x2, y2, w) if len(x1) else 0.0
        return pa.table({**{k: group.column(k).slice(0, 1) for k in keys}, "area": pa.array([area])})

    return pieces.groupBy(*keys).applyInArrow(one, f"{kinds}, area double")


def _sides(parts):
    """Non-vertical sides of oriented rings, left to right, with the side on which the inside lies."""

    def of(p):
        turn = F.when(g.signed_area(p.ring) >= 0, 1.0).otherwise(-1.0) * F.when(p.hole, -1.0).otherwise(1.0)
        es = F.filter(g.edges(p.ring), lambda e: e.a.x != e.b.x)
        return F.transform(
            es,
            lambda e: F.when(e.a.x < e.b.x, F.struct(e.a.x.alias("x1"), e.a.y.alias("y1"), e.b.x.alias("x2"), e.b.y.alias("y2"), turn.alias("w"))).otherwise(
                F.struct(e.b.x.alias("x1"), e.b.y.alias("y1"), e.a.x.alias("x2"), e.a.y.alias("y2"), (-turn).alias("w"))
            ),
        )

    return F.flatten(F.transform(parts, of))


def union_area_of_parts(polys: DataFrame, size: float, by: Sequence[str] = ()) -> DataFrame:
    """Exact union area per cell: (ix, iy, by..., union_area) of polygons with `parts` (hole, ring) or `ring` and a box x0..y1.

    Polygons must not cross themselves; equal ones count once.  Null shapes and shapes without area are left out.
    """
    shape = F.col("parts") if "parts" in polys.columns else F.array(F.struct(F.lit(False).alias("hole"), F.col("ring").alias("ring")))
    todo = polys.select(*by, shape.alias("parts"), "x0", "y0", "x1", "y1")
    found: list[DataFrame] = []
    fine, depth, keys = size, 0, [*by, "_bx", "_by"]
    while True:
        tx, ty = F.col("_bx") * fine, F.col("_by") * fine
        cand = spread_rows(_box_tiles(todo, fine, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
        clipped = F.transform("parts", lambda p: F.struct(p.hole.alias("hole"), g.clip_ring(p.ring, tx, ty, tx + fine, ty + fine).alias("ring")))
        p = cand.select(*keys, F.filter(clipped, lambda p: F.size(p.ring) > 3).alias("parts"), *[f(a, b).alias(n) for n, f, a, b in (("x0", F.greatest, "x0", tx), ("y0", F.greatest, "y0", ty), ("x1", F.least, "x1", tx + fine), ("y1", F.least, "y1", ty + fine))])
        p = cut(p.withColumn("area", g.parts_area(F.col("parts"))).where(F.col("area") > 0).distinct())
        tiles = cut(p.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("area").alias("_most")))
        cell = [F.floor(F.col("_bx") * fine / size).alias("ix"), F.floor(F.col("_by") * fine / size).alias("iy")]
        full = F.col("_most") >= fine * fine * (1 - 1e-12)
        limit = F.col("_n") > LEAF if depth < DEEPEST else F.lit(False)
        found.append(tiles.where(full).select(*by, *cell, F.lit(fine * fine).alias("area")))
        found.append(tiles.where(~full & (F.col("_n") == 1)).select(*by, *cell, F.col("_most").alias("area")))
        few = p.join(tiles.where(~full & (F.col("_n") > 1) & ~limit).select(*keys), keys, "left_semi")
        found.append(_swept(few.select(*keys, _sides(F.col("parts")).alias("sides")), keys).select(*by, *cell, "area"))
        hot = tiles.where(~full & limit).select(*keys)
        if depth == DEEPEST or hot.isEmpty():
            break
        todo = p.join(hot, keys, "left_semi").select(*by, "parts", "x0", "y0", "x1", "y1")
        fine, depth = fine / 8, depth + 1
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("ix", "iy", *by).agg(F.sum("area").alias("union_area"))
