"""Plane geometry as Column expressions.

A ring is array<struct<x,y>> with the first point repeated at the end; a path is
the same without closure; a segment is four double columns; a rectangle is
(x0, y0, x1, y1) with x0 <= x1 and y0 <= y1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and use it many times in `body`."""
    return F.transform(F.array(value), body)[0]


def edges(path: Column) -> Column:
    """Consecutive point pairs as array<struct<a,b>>."""

    def pairs(p):
        n = F.greatest(F.size(p) - 1, F.lit(0))
        return F.zip_with(F.slice(p, 1, n), F.slice(p, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return let(path, pairs)


def _sum(arr: Column, f) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, e: acc + f(e))


def signed_area(ring: Column) -> Column:
    return _sum(edges(ring), lambda e: e.a.x * e.b.y - e.b.x * e.a.y) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    return F.sqrt(dx * dx + dy * dy)


def path_length(path: Column) -> Column:
    return _sum(edges(path), lambda e: distance(e.a.x, e.a.y, e.b.x, e.b.y))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Crossing number; a point on the lower or left border counts as inside."""

    def crosses(e):
        spans = (e.a.y <= y) != (e.b.y <= y)
        at = e.a.x + (y - e.a.y) / F.nullif(e.b.y - e.a.y, F.lit(0.0)) * (e.b.x - e.a.x)
        return F.when(spans & (at <= x), 1.0).otherwise(0.0)

    return _sum(edges(ring), crosses) % 2 == 1


def point_in_parts(x: Column, y: Column, parts: Column) -> Column:
    """Point in a polygon of several rings (hole, ring): inside an odd number of them."""
    return F.size(F.filter(parts, lambda p: point_in_ring(x, y, p.ring))) % 2 == 1


def parts_area(parts: Column, ring=lambda r: r) -> Column:
    """Area of outlines less holes, each ring first passed through `ring` (for instance a clip)."""
    return _sum(parts, lambda p: F.when(p.hole, -1.0).otherwise(1.0) * ring_area(ring(p.ring)))


def centroid(ring: Column) -> Column:
    """Area-weighted centroid; null for a zero-area ring."""
    return let(ring, _centroid)


def _centroid(ring: Column) -> Column:
    a = signed_area(ring)
    base_x, base_y = ring[0].x, ring[0].y  # relative to the first point to keep precision
    area2 = F.nullif(a * 6, F.lit(0.0))

    def cross(e):
        return (e.a.x - base_x) * (e.b.y - base_y) - (e.b.x - base_x) * (e.a.y - base_y)

    cx = _sum(edges(ring), lambda e: (e.a.x + e.b.x - 2 * base_x) * cross(e)) / area2
    cy = _sum(edges(ring), lambda e: (e.a.y + e.b.y - 2 * base_y) * cross(e)) / area2
    return point(cx + base_x, cy + base_y)


def rep_point(ring: Column) -> Column:
    """A point inside the ring: the centroid if inside, else the middle of the widest chord at its height."""
    return let(F.struct(ring.alias("ring"), centroid(ring).alias("c")), lambda v: _rep_point(v.ring, v.c))


def _rep_point(ring: Column, c: Column) -> Column:
    def cut_x(e):
        return e.a.x + (c.y - e.a.y) / F.nullif(e.b.y - e.a.y, F.lit(0.0)) * (e.b.x - e.a.x)

    hits = F.array_sort(F.transform(F.filter(edges(ring), lambda e: (e.a.y <= c.y) != (e.b.y <= c.y)), cut_x))

    def widest(h):
        chord = lambda i: F.struct(
            (F.get(h, i * 2 - 1) - F.get(h, i * 2 - 2)).alias("w"),
            ((F.get(h, i * 2 - 1) + F.get(h, i * 2 - 2)) / 2).alias("m"),
        )
        return F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.size(h) / 2), F.lit(1)).cast("int")), chord))

    return F.when(point_in_ring(c.x, c.y, ring), c).otherwise(point(F.coalesce(let(hits, widest).m, c.x), c.y))


def _clip_half(ring: Column, inside, cross) -> Column:
    def step(e):
        ia, ib = inside(e.a), inside(e.b)
        return F.when(ia & ib, F.array(e.b)).when(ia, F.array(cross(e))).when(ib, F.array(cross(e), e.b)).otherwise(F.array_remove(F.array(e.b), e.b))

    pts = F.flatten(F.transform(edges(ring), step))
    return let(pts, lambda p: F.concat(p, F.slice(p, 1, 1)))


def clip_ring(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Sutherland-Hodgman against a rectangle; the area is exact for concave rings too."""

    def at_x(v):
        return lambda e: point(v, e.a.y + (v - e.a.x) / F.nullif(e.b.x - e.a.x, F.lit(0.0)) * (e.b.y - e.a.y))

    def at_y(v):
        return lambda e: point(e.a.x + (v - e.a.y) / F.nullif(e.b.y - e.a.y, F.lit(0.0)) * (e.b.x - e.a.x), v)

    r = _clip_half(ring, lambda p: p.x >= x0, at_x(x0))
    r = _clip_half(r, lambda p: p.x <= x1, at_x(x1))
    r = _clip_half(r, lambda p: p.y >= y0, at_y(y0))
    return _clip_half(r, lambda p: p.y <= y1, at_y(y1))


def rect_overlap_area(a: tuple, b: tuple) -> Column:
    """Shared area of two rectangles given as 4-tuples of columns."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def clip_segment(x1, y1, x2, y2, rx0, ry0, rx1, ry1) -> Column:
    """Liang-Barsky: struct(t0, t1) of the part inside the rectangle; t0 >= t1 when there is none."""
    lows, highs = [F.lit(0.0)], [F.lit(1.0)]
    for p0, d, lo, hi in ((x1, x2 - x1, rx0, rx1), (y1, y2 - y1, ry0, ry1)):
        a, b = F.try_divide(lo - p0, d), F.try_divide(hi - p0, d)
        outside = (p0 < lo) | (p0 >= hi)  # parallel to this side: lower-left border belongs to the cell
        lows.append(F.when(d != 0, F.least(a, b)).when(outside, 2.0).otherwise(0.0))
        highs.append(F.when(d != 0, F.greatest(a, b)).when(outside, -1.0).otherwise(1.0))
    return F.struct(F.greatest(*lows).alias("t0"), F.least(*highs).alias("t1"))


def point_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return distance(px, py, x1 + t * dx, y1 + t * dy)


def near_interval(ax, ay, bx, by, cx, cy, dx, dy, r: float) -> Column:
    """Part of segment AB within r of segment CD, as struct(t0, t1) in [0, 1]; null fields when none.

    The distance to a segment is convex along AB, so that part is one interval:
    the hull of the parts near either end of CD and near its inner strip.  Each
    step is bound once with `let`, so a filter on the result stays small.
    """
    names = ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")
    given = F.struct(*[c.cast("double").alias(n) for n, c in zip(names, (ax, ay, bx, by, cx, cy, dx, dy))])

    def directions(p):
        vx, vy = p.dx - p.cx, p.dy - p.cy
        length = F.sqrt(vx * vx + vy * vy)
        s = F.struct(
            p.ax.alias("ax"), p.ay.alias("ay"), p.cx.alias("cx"), p.cy.alias("cy"), p.dx.alias("dx"), p.dy.alias("dy"),
            (p.bx - p.ax).alias("ux"), (p.by - p.ay).alias("uy"), length.alias("l"),
            F.try_divide(vx, length).alias("nx"), F.try_divide(vy, length).alias("ny"),
        )
        return let(s, products)

    def products(p):
        def end(ex, ey):
            wx, wy = p.ax - ex, p.ay - ey
            return wx * p.ux + wy * p.uy, wx * wx + wy * wy - r * r

        (b0, c0), (b1, c1) = end(p.cx, p.cy), end(p.dx, p.dy)
        s = F.struct(
            (p.ux * p.ux + p.uy * p.uy).alias("uu"), p.l.alias("l"), b0.alias("b0"), c0.alias("c0"), b1.alias("b1"), c1.alias("c1"),
            ((p.ax - p.cx) * p.ny - (p.ay - p.cy) * p.nx).alias("pa"), (p.ux * p.ny - p.uy * p.nx).alias("sa"),
            ((p.ax - p.cx) * p.nx + (p.ay - p.cy) * p.ny).alias("pl"), (p.ux * p.nx + p.uy * p.ny).alias("sl"),
        )
        return let(s, spans)

    def spans(p):
        def disc(b, c):
            d = b * b - p.uu * c
            root = F.when(d >= 0, F.sqrt(F.abs(d)))
            return F.struct(F.try_divide(-b - root, p.uu).alias("lo"), F.try_divide(-b + root, p.uu).alias("hi"))

        def strip(p0, slope, lo, hi):
            u, v = F.try_divide(lo - p0, slope), F.try_divide(hi - p0, slope)
            flat_ok = (p0 >= lo) & (p0 <= hi)
            start = F.when(slope != 0, F.least(u, v)).when(flat_ok, 0.0).otherwise(2.0)
            return start, F.when(slope != 0, F.greatest(u, v)).when(flat_ok, 1.0).otherwise(-1.0)

        across, along = strip(p.pa, p.sa, F.lit(-r), F.lit(r)), strip(p.pl, p.sl, F.lit(0.0), p.l)
        inner = F.struct(F.greatest(across[0], along[0]).alias("lo"), F.least(across[1], along[1]).alias("hi"))
        all3 = F.array(disc(p.b0, p.c0), disc(p.b1, p.c1), F.when(p.l > 0, inner))
        clipped = F.transform(
            F.filter(all3, lambda i: i.lo.isNotNull()),  # greatest and least would skip a null
            lambda i: F.struct(F.greatest(i.lo, F.lit(0.0)).alias("lo"), F.least(i.hi, F.lit(1.0)).alias("hi")),
        )
        return let(F.filter(clipped, lambda i: i.lo <= i.hi), hull)

    def hull(parts):
        return F.struct(F.array_min(F.transform(parts, lambda i: i.lo)).alias("t0"), F.array_max(F.transform(parts, lambda i: i.hi)).alias("t1"))

    return let(given, directions)


def self_crossing(ring: Column) -> Column:
    """True when two non-adjacent edges of the ring cross properly (rings are small, edge pairs stay in the row)."""
    es = edges(ring)

    def side(p, q, s):
        return F.signum((q.x - p.x) * (s.y - p.y) - (q.y - p.y) * (s.x - p.x))

    def hits(e, f):
        return (side(e.a, e.b, f.a) * side(e.a, e.b, f.b) < 0) & (side(f.a, f.b, e.a) * side(f.a, f.b, e.b) < 0)

    return F.exists(es, lambda e: F.exists(es, lambda f: hits(e, f)))


def validity(ring: Column) -> Column:
    """First problem of a ring, or 'VALID'."""
    return let(ring, _validity)


def _validity(ring: Column) -> Column:
    return (
        F.when(F.size(ring) < 4, "TOO_FEW_POINTS")
        .when(ring[0] != F.element_at(ring, -1), "NOT_CLOSED")
        .when(self_crossing(ring), "SELF_CROSSING")
        .when(ring_area(ring) == 0, "ZERO_AREA")
        .otherwise("VALID")
    )


def hex_key(x: Column, y: Column, size: float) -> Column:
    """Axial (q, r) key of the pointy-top hexagon of side `size` that holds the point."""
    q = (x * (3**0.5) / 3 - y / 3) / size
    r = y * (2 / 3) / size
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fix_q = (dq > dr) & (dq > ds)
    fix_r = ~fix_q & (dr > ds)
    return F.struct(
        F.when(fix_q, -rr - rs).otherwise(rq).alias("q"),
        F.when(fix_r, -rq - rs).otherwise(rr).alias("r"),
    )
