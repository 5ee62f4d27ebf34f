"""Duplicate removal for points, stops and lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridreach.functions import geometry as g
from gridreach.operators import overlap
from gridreach.operators import spatial as sp
from gridreach.operators.ordered import first_row
from gridreach.session import cut, narrow_batches


def dedup_points_near_ways(pois: DataFrame, key: str, category: str, is_point: Column, r: float = 15.0) -> DataFrame:
    """Drop a point that lies within r of a non-point of its category."""
    flagged = pois.withColumn("_p", is_point)
    points, others = flagged.where("_p").drop("_p"), flagged.where(~F.col("_p")).drop("_p")
    return sp.near_any(points, key, others, r, [category], keep=False).unionByName(others)


def dedup_greedy(stops: DataFrame, key: str, by: str, r: float = 20.0) -> DataFrame:
    """Keep a stop unless an earlier kept stop (lower key) of the same `by` lies within r.

    Tiles of side r / sqrt(2) hold at most one kept stop.  Each round looks only
    at the earliest undecided stop of every tile: it is kept when no earlier
    undecided stop lies within r, and what lies within r of a kept stop is
    dropped.  A stop meets at most one candidate per tile of the 5 x 5 block
    around it, so a round is linear in the stops, however dense they lie.
    """
    side = r / 1.4143
    keys = [by, "_mx", "_my"]
    home = lambda d: d.withColumn("_mx", sp.tile(F.col("x"), side)).withColumn("_my", sp.tile(F.col("y"), side))

    def block(d: DataFrame) -> DataFrame:
        span = lambda c: F.explode(F.sequence(F.col(c) - 2, F.col(c) + 2))
        return d.withColumn("_mx", span("_mx")).withColumn("_my", span("_my"))

    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    near = dx * dx + dy * dy <= float(r) ** 2
    todo = cut(home(stops.select(key, by, "x", "y")))
    kept: list[DataFrame] = []
    while not todo.isEmpty():
        lead = todo.groupBy(*keys).agg(F.min(F.struct(key, "x", "y")).alias("_l"))
        lead = lead.select(*keys, F.col(f"_l.{key}").alias("c_key"), F.col("_l.x").alias("cx"), F.col("_l.y").alias("cy"))
        spread = block(lead)
        beaten = todo.join(spread, keys).where(near & (F.col(key) < F.col("c_key"))).select("c_key").distinct()
        now = cut(lead.join(beaten, "c_key", "left_anti"))
        kept.append(now.select(F.col("c_key").alias(key)))
        gone = todo.join(block(now), keys).where(near).select(key).distinct()
        todo = cut(todo.join(gone, key, "left_anti"))
    if not kept:
        return stops
    ids = kept[0]
    for k in kept[1:]:
        ids = ids.unionByName(k)
    return stops.join(ids, key, "left_semi")


def _ref_tiles(ref: DataFrame, buf: float, size: float) -> DataFrame:
    """Distinct reference segments, once for every tile (_bx, _by) that their buffer touches; one with a single known end is a spot there."""
    x1, y1, x2, y2 = (F.col(c) for c in overlap.ENDS)
    first, second = x1.isNotNull() & y1.isNotNull(), x2.isNotNull() & y2.isNotNull()
    ends = (F.when(first, x1).otherwise(x2), F.when(first, y1).otherwise(y2), F.when(second, x2).otherwise(x1), F.when(second, y2).otherwise(y1))
    known = ref.where(first | second).select(*[e.alias(c) for e, c in zip(ends, overlap.ENDS)]).distinct()
    r = sp._box_tiles(known, size, F.least(x1, x2) - buf, F.least(y1, y2) - buf, F.greatest(x1, x2) + buf, F.greatest(y1, y2) + buf)
    # keep only tiles the reference's buffer can touch: distance of the tile centre to the segment
    half_diag = size * 0.7072
    away = g.point_segment_distance((F.col("_bx") + 0.5) * size, (F.col("_by") + 0.5) * size, x1, y1, x2, y2)
    return r.where(away <= half_diag + buf)


def near_parts(parts: DataFrame, ref: DataFrame, buf: float, size: float) -> DataFrame:
    """Adds `covered`: how much of a segment's length lies in the part t0 to t1 and within buf of a reference.

    parts has (_bx, _by, x1, y1, x2, y2, t0, t1), each part inside its tile.
    Reference segments are listed once for every tile their buffer touches.  A
    part meets the list of its own tile, and its intervals are worked out and
    merged in arrays over a batch of rows (`overlap`): no row for a pair,
    nothing to merge between tiles.
    """
    lists = _ref_tiles(ref, buf, size).groupBy("_bx", "_by").agg(F.collect_list(F.struct(*overlap.ENDS)).alias("_refs"))
    # hashed, as the parts need no order; never broadcast, as the size of the lists is not known beforehand
    met = parts.join(lists.hint("shuffle_hash"), ["_bx", "_by"], "left").select(*parts.columns, "_refs")
    schema = StructType([*parts.schema.fields, StructField("covered", DoubleType())])
    return met.mapInArrow(lambda batches: overlap.add_covered(batches, buf), schema)


def near_sums(parts: DataFrame, ref: DataFrame, buf: float, size: float) -> DataFrame:
    """Metres of each tile's parts, `whole` and within buf of a reference, `near`: (_bx, _by, whole, near).

    parts has (_bx, _by, x1, y1, x2, y2, copies, piece_m), each part inside its tile; equal rows add to `near` once.  Parts and
    references of a tile meet in one sorted run, the references, marked by 0 copies, at its head: no list travels with the parts,
    and a batch of rows is worked off at a time (`overlap.sums`), however many share a tile.
    """
    tile, rest = ["_by", "_bx"], ["copies", *overlap.ENDS, "piece_m"]
    refs = _ref_tiles(ref, buf, size).withColumn("copies", F.lit(0).cast("long")).withColumn("piece_m", F.lit(0.0))
    rows = parts.select(*tile, *rest).unionByName(refs).repartition(*tile).sortWithinPartitions(*tile, *rest)
    found = rows.mapInArrow(lambda batches: overlap.sums(batches, buf), "_bx long, _by long, whole double, near double")
    with narrow_batches(parts.sparkSession):
        found = cut(found)
    return found.groupBy("_bx", "_by").agg(F.sum("whole").alias("whole"), F.sum("near").alias("near"))


def near_share(segs: DataFrame, ids: Sequence[str], ref: DataFrame, buf: float, size: float = 500.0) -> DataFrame:
    """Covered share of each segment that lies within buf of any reference segment."""
    segs = segs.select(*ids, *[c for c in ("x1", "y1", "x2", "y2") if c not in ids])
    parts = near_parts(sp.segment_parts(segs, size), ref, buf, size).where(F.col("covered") > 0)
    return parts.groupBy(*ids).agg(F.sum("covered").alias("covered"))


def drop_overlapping(cand: DataFrame, line_id: str, ref: DataFrame, buf: float = 15.0, share: float = 0.5) -> DataFrame:
    """Drop candidate lines with more than `share` of their length within buf of the reference."""
    segs = cand.withColumn("_len", g.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    segs = segs.groupBy(line_id, "x1", "y1", "x2", "y2").agg(F.sum("_len").alias("_len"))  # repeated pieces once
    near = near_parts(sp.segment_parts(segs, 500.0), ref, buf, 500.0).where(F.col("covered") > 0).groupBy(line_id).agg(F.sum(F.col("covered") * F.col("_len")).alias("_near"))
    total = segs.groupBy(line_id).agg(F.sum("_len").alias("_all"))
    bad = total.join(near, line_id).where(F.try_divide("_near", "_all") > share).select(line_id)
    return cand.join(bad, line_id, "left_anti")


def dup_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    per = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return per.agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_distinct"), (F.sum("_n") - F.count("*")).alias("n_duplicates"))


def to_undirected(edges: DataFrame, geometry: Sequence[str] = ("length_m",)) -> DataFrame:
    """One row per undirected edge; reciprocal edges merge when their geometry columns agree."""
    e = edges.withColumn("_a", F.least("src", "dst")).withColumn("_b", F.greatest("src", "dst"))
    rest = [c for c in edges.columns if c not in ("src", "dst", *geometry)]
    out = first_row(e.select("_a", "_b", *geometry, *rest, "src"), ["_a", "_b", *geometry], [F.col("src")])
    return out.select(F.col("_a").alias("src"), F.col("_b").alias("dst"), *geometry, *rest)
