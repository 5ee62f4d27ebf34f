"""Raster operators over a long pixel table (r, c, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridreach.functions import scalars as s
from gridreach.operators import ordered as o


def zonal_stats(px: DataFrame, key: str, value: str) -> DataFrame:
    """min, max, mean, median, sample deviation and range per zone; zones with no valid pixel give no row."""
    ok = px.where(F.col(value).isNotNull())
    a = ok.groupBy(key).agg(
        F.round(F.min(value), 6).alias("min_v"), F.round(F.max(value), 6).alias("max_v"), F.round(F.avg(value), 6).alias("mean_v"),
        F.round(F.stddev_samp(value), 5).alias("std_v"), F.round(F.max(value) - F.min(value), 6).alias("range_v"),
    )
    med = o.quantiles(ok, value, [0.5], [key]).select(key, F.round("q", 6).alias("median_v"))
    return a.join(med, key)


def bin_shares(px: DataFrame, key: str, value: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Percent of a zone's pixels per left-closed bin."""
    b = px.withColumn("_b", s.bin_label(F.col(value), edges, labels))
    return b.groupBy(key).agg(*[F.round(F.count_if(F.col("_b") == x) / F.count("*") * 100, 6).alias(x) for x in labels])


def weighted_grade_stats(pieces: DataFrame, key: str, grade: str, length: str) -> DataFrame:
    g, n = F.col(grade), F.col(length)
    share = lambda lim: F.round(F.sum(F.when(g > lim, n).otherwise(0.0)) / F.sum(n) * 100, 6)
    a = pieces.groupBy(key).agg(
        F.round(F.sum(g * n) / F.sum(n), 6).alias("mean_grade"), share(5).alias("pct_gt5"), share(8).alias("pct_gt8"), F.round(F.sum(n), 4).alias("sample_m")
    )
    med = o.weighted_quantiles(pieces, grade, length, [0.5], [key]).select(key, F.col("q").alias("median_grade"))
    return a.join(med, key)


def mosaic(tiles: Sequence[DataFrame], window: tuple[int, int, int, int]) -> DataFrame:
    """First valid tile wins per pixel, inside (r0, r1, c0, c1); an aggregate, so overlaps combine early."""
    r0, r1, c0, c1 = window
    out = None
    for i, t in enumerate(tiles):
        t = t.where(F.col("r").between(r0, r1) & F.col("c").between(c0, c1) & F.col("value").isNotNull()).select("r", "c", "value", F.lit(i).alias("tile"))
        out = t if out is None else out.unionByName(t)
    return out.groupBy("r", "c").agg(F.min(F.struct("tile", "value")).alias("_m")).select("r", "c", F.col("_m.tile").alias("tile"), F.col("_m.value").alias("value"))


def _corners(pts: DataFrame, keys: Sequence[str], fr: Column, fc: Column, px: DataFrame) -> DataFrame:
    """Join each fractional position with its four neighbour pixels and sum the weighted values.

    A missing neighbour makes the result null.
    """
    base = pts.select(*keys, fr.alias("_fr"), fc.alias("_fc"))
    r0, c0 = F.floor("_fr"), F.floor("_fc")
    dr, dc = F.col("_fr") - r0, F.col("_fc") - c0
    corner = F.array(
        F.struct(r0.alias("r"), c0.alias("c"), ((1 - dr) * (1 - dc)).alias("_w")),
        F.struct(r0.alias("r"), (c0 + 1).alias("c"), ((1 - dr) * dc).alias("_w")),
        F.struct((r0 + 1).alias("r"), c0.alias("c"), (dr * (1 - dc)).alias("_w")),
        F.struct((r0 + 1).alias("r"), (c0 + 1).alias("c"), (dr * dc).alias("_w")),
    )
    wanted = base.select(*keys, F.inline(corner)).where(F.col("_w") > 0)
    hit = wanted.join(px.select("r", "c", "value"), ["r", "c"], "left")
    return hit.groupBy(*keys).agg(F.when(F.count("value") == F.count("*"), F.sum(F.col("_w") * F.col("value"))).alias("value"))


def _bounds(px: DataFrame) -> Column:
    return o.scalar_row(px.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1")))


def sample_bilinear(px: DataFrame, pts: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """Bilinear value at (x, y); pixel (r, c) has its centre at ((c + .5) size, (r + .5) size).

    Positions beyond the outer pixel centres are clamped to them.
    """
    p = pts.withColumn("_b", _bounds(px))
    fr = F.greatest(F.least(F.col("y") / size - 0.5, F.col("_b.r1").cast("double")), F.col("_b.r0").cast("double"))
    fc = F.greatest(F.least(F.col("x") / size - 0.5, F.col("_b.c1").cast("double")), F.col("_b.c0").cast("double"))
    spots = p.withColumn("_fr", fr).withColumn("_fc", fc)
    return _corners(spots, keys, F.col("_fr"), F.col("_fc"), px)


def resample_bilinear(px: DataFrame, target: DataFrame, size: float) -> DataFrame:
    """Values of a target pixel table (r, c, x, y of its centres) from a source raster."""
    t = target.select(F.col("r").alias("tr"), F.col("c").alias("tc"), "x", "y")
    return sample_bilinear(px, t, ["tr", "tc"], size).select(F.col("tr").alias("r"), F.col("tc").alias("c"), "value")


def horn_slope(px: DataFrame, size: float) -> DataFrame:
    """Slope in degrees from the 3 x 3 Horn kernel; border pixels repeat the edge, any invalid cell gives null."""
    p = px.withColumn("_b", _bounds(px))
    near = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    want = p.select("r", "c", "_b", F.inline(near))
    want = want.select(
        "r", "c", "di", "dj",
        F.least(F.greatest(F.col("r") + F.col("di"), F.col("_b.r0")), F.col("_b.r1")).alias("nr"),
        F.least(F.greatest(F.col("c") + F.col("dj"), F.col("_b.c0")), F.col("_b.c1")).alias("nc"),
    )
    src = px.select(F.col("r").alias("nr"), F.col("c").alias("nc"), "value")
    j = want.join(src, ["nr", "nc"], "left")
    wx = F.col("dj") * F.when(F.col("di") == 0, 2).otherwise(1)
    wy = F.col("di") * F.when(F.col("dj") == 0, 2).otherwise(1)
    a = j.groupBy("r", "c").agg(F.count("value").alias("n"), F.sum(wx * F.col("value")).alias("gx"), F.sum(wy * F.col("value")).alias("gy"))
    gx, gy = F.col("gx") / (8 * size), F.col("gy") / (8 * size)
    return a.select("r", "c", F.when(F.col("n") == 9, F.degrees(F.atan(F.sqrt(gx * gx + gy * gy)))).alias("slope"))


def segment_grade(segs: DataFrame, px: DataFrame, ids: Sequence[str], size: float, min_len: float = 30.0, suspicious: float = 30.0) -> DataFrame:
    """Absolute grade in percent of straight segments from the height at both ends; short or unsampled ones are dropped."""
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    sg = segs.withColumn("len", length).where(F.col("len") >= min_len)
    ends = F.array(F.struct(F.lit(0).alias("end"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.lit(1).alias("end"), F.col("x2").alias("x"), F.col("y2").alias("y")))
    spots = sg.select(F.inline(ends)).select("x", "y").distinct()  # shared ends are sampled once
    z = sample_bilinear(px, spots, ["x", "y"], size)
    a = z.select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("value").alias("z1"))
    b = z.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("value").alias("z2"))
    j = sg.join(a, ["x1", "y1"]).join(b, ["x2", "y2"]).where(F.col("z1").isNotNull() & F.col("z2").isNotNull())
    grade = F.abs(F.col("z2") - F.col("z1")) / F.col("len") * 100
    return j.select(*ids, "len", grade.alias("grade_pct")).withColumn("is_suspicious", F.col("grade_pct") > suspicious)
