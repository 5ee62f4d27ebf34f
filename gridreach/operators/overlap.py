"""How much of each line lies near other lines, for all pairs of a batch of rows at once.

Spark joins lines with the references around them (`dedup.near_parts`); here the pairs of a batch are plain arrays.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

ENDS = ("x1", "y1", "x2", "y2")
SUMS = pa.schema([("_bx", pa.int64()), ("_by", pa.int64()), ("whole", pa.float64()), ("near", pa.float64())])
#: Pairs whose intervals are worked out at once.
PAIRS = 1 << 15

Segments = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def directed(s: Segments) -> tuple[np.ndarray, ...]:
    """Ends of segments, the way from the first to the second, its length and unit vector."""
    x1, y1, x2, y2 = s
    dx, dy = x2 - x1, y2 - y1
    length = np.sqrt(dx * dx + dy * dy)
    with np.errstate(invalid="ignore"):
        return x1, y1, x2, y2, dx, dy, length, dx / length, dy / length


def near_intervals(a: tuple[np.ndarray, ...], c: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`geometry.near_interval`, step by step the same, for the pairs (i, j) of rows of `directed` segments a and c: places of pairs that can have one, t0 and t1; t0 > t1 when there is none."""
    ux, uy, nx, ny, length = a[4][i], a[5][i], c[7][j], c[8][j], c[6][j]
    wx, wy = a[0][i] - c[0][j], a[1][i] - c[1][j]
    pa, sa = wx * ny - wy * nx, ux * ny - uy * nx
    other, far = pa + sa, r + 1e-6 * max(1.0, r)
    # both ends well beyond r on the same side of the reference's line: nothing is near it
    at = np.flatnonzero(~((np.minimum(pa, other) > far) | (np.maximum(pa, other) < -far)))
    ux, uy, nx, ny, length, wx, wy, pa, sa = (v[at] for v in (ux, uy, nx, ny, length, wx, wy, pa, sa))
    i, j = i[at], j[at]
    uu, t0, t1 = ux * ux + uy * uy, np.full(len(at), np.inf), np.full(len(at), -np.inf)

    def add(lo: np.ndarray, hi: np.ndarray) -> None:
        lo, hi = np.maximum(lo, 0.0), np.minimum(hi, 1.0)
        some = lo <= hi  # not so for NaN, which stands for null
        np.minimum(t0, np.where(some, lo, np.inf), out=t0)
        np.maximum(t1, np.where(some, hi, -np.inf), out=t1)

    def strip(p0: np.ndarray, slope: np.ndarray, lo: float, hi: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, v = (lo - p0) / slope, (hi - p0) / slope
        start, end = np.minimum(u, v), np.maximum(u, v)
        flat = np.flatnonzero(slope == 0)
        if len(flat):
            ok = ((p0 >= lo) & (p0 <= hi))[flat]
            start[flat], end[flat] = np.where(ok, 0.0, 2.0), np.where(ok, 1.0, -1.0)
        return start, end

    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for ex, ey in ((wx, wy), (a[0][i] - c[2][j], a[1][i] - c[3][j])):
            b, away = ex * ux + ey * uy, ex * ex + ey * ey - r * r
            root = np.sqrt(b * b - uu * away)
            add((-b - root) / uu, (-b + root) / uu)
        across = strip(pa, sa, -r, r)
        along = strip(wx * nx + wy * ny, ux * nx + uy * ny, 0.0, length)
        add(np.maximum(across[0], along[0]), np.minimum(across[1], along[1]))
    return at, t0, t1


def _ordered(row: np.ndarray, t0: np.ndarray, t1: np.ndarray) -> np.ndarray:
    """Order by row, t0 and t1, all of the latter in 0 to 1; `row` ascends, so sums of both are nearly sorted."""
    by = np.argsort(row + t1 / 2, kind="stable")
    by = by[np.argsort((row + t0 / 2)[by], kind="stable")]
    a, b = t0[by], t1[by]
    wrong = (row[1:] == row[:-1]) & ((a[1:] < a[:-1]) | ((a[1:] == a[:-1]) & (b[1:] < b[:-1])))
    return np.lexsort((t1, t0, row)) if wrong.any() else by  # sums that rounding made equal


def _union(row: np.ndarray, t0: np.ndarray, t1: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Length of the union of the intervals of each row 0, 1, ... within lo to hi; `row` ascends."""
    out, n = np.zeros(len(lo)), len(lo)
    whole = row[(t0 <= lo[row]) & (t1 >= hi[row])]
    out[whole] = (hi - lo)[whole]
    left = np.ones(n, bool)
    left[whole] = False
    rest = np.flatnonzero(left[row])
    row, t0, t1 = row[rest], t0[rest], t1[rest]
    by = _ordered(row, t0, t1)
    t0, t1 = t0[by], t1[by]
    reach, step = t1.copy(), 1  # the farthest end so far within a row, over twice as many intervals each time
    while True:
        same = np.flatnonzero(row[step:] == row[:-step])
        if not len(same):
            break
        reach[same + step] = np.maximum(reach[same + step], reach[same])
        step *= 2
    seen = np.zeros(len(t0))
    later = np.flatnonzero(row[1:] == row[:-1]) + 1
    seen[later] = reach[later - 1]
    return out + np.bincount(row, np.maximum(t1 - np.maximum(t0, seen), 0.0), n)


def covered(parts: Segments, t0: np.ndarray, t1: np.ndarray, first: np.ndarray, n_refs: np.ndarray, refs: Segments, buf: float) -> np.ndarray:
    """Share of each segment that lies in its part t0 to t1 and within buf of one of its references, the n_refs rows of refs from `first` on."""
    x1, y1, x2, y2 = parts
    px, py = (x1 + t0 * (x2 - x1), x1 + t1 * (x2 - x1)), (y1 + t0 * (y2 - y1), y1 + t1 * (y2 - y1))
    box = [np.minimum(*px) - buf, np.maximum(*px) + buf, np.minimum(*py) - buf, np.maximum(*py) + buf]
    ref_box = [np.minimum(refs[0], refs[2]), np.maximum(refs[0], refs[2]), np.minimum(refs[1], refs[3]), np.maximum(refs[1], refs[3])]
    a, c = directed(parts), directed(refs)
    ends = np.cumsum(n_refs)
    starts, found = ends - n_refs, []
    for lo in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        hi = min(lo + PAIRS, int(ends[-1]))
        some = slice(np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi))
        i = np.repeat(np.arange(some.start, some.stop), np.minimum(ends[some], hi) - np.maximum(starts[some], lo))
        j = np.arange(lo, hi) + (first - starts)[i]
        for b in (0, 2):
            close = np.flatnonzero((ref_box[b][j] <= box[b + 1][i]) & (ref_box[b + 1][j] >= box[b][i]))
            i, j = i[close], j[close]
        at, s0, s1 = near_intervals(a, c, i, j, buf)
        i = i[at]
        from0, to1 = np.maximum(s0, t0[i]), np.minimum(s1, t1[i])
        kept = np.flatnonzero((s0 < s1) & (from0 < to1))
        found.append((i[kept], from0[kept], to1[kept]))
    if not found:
        return np.zeros(len(x1))
    return _union(*(np.concatenate(v) for v in zip(*found)), t0, t1)


def _plain(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def add_covered(batches: Iterator[pa.RecordBatch], buf: float) -> Iterator[pa.RecordBatch]:
    """The rows with `covered` in place of their references `_refs`, a list of segments."""
    for batch in batches:
        n_refs = pc.fill_null(pc.list_value_length(batch["_refs"]), 0).to_numpy().astype(np.int64)
        refs = tuple(_plain(c) for c in batch["_refs"].flatten().flatten())
        parts = tuple(_plain(batch[c]) for c in ENDS)
        share = covered(parts, _plain(batch["t0"]), _plain(batch["t1"]), np.cumsum(n_refs) - n_refs, n_refs, refs, buf)
        yield batch.drop_columns(["_refs"]).append_column("covered", pa.array(share))


def sums(batches: Iterator[pa.RecordBatch], buf: float) -> Iterator[pa.RecordBatch]:
    """(_bx, _by, whole, near) of rows (_bx, _by, x1, y1, x2, y2, copies, piece_m) sorted by tile, copies, and the rest; references have 0 copies.

    A tile's sums come in several rows where it goes over several batches; its references and the last row are kept from one to the next.
    """
    last, refs = None, tuple(np.zeros(0) for _ in ENDS)
    for batch in batches:
        # a part without an end or length adds to no sum; asked in Spark, this makes the method that cuts the parts too long to be compiled
        batch = pc.drop_null(batch)
        if not batch.num_rows:
            continue
        rows = [c.to_numpy() for c in batch.select(["_bx", "_by", *ENDS, "copies", "piece_m"]).columns]
        before = [np.concatenate([v[:1] if last is None else last[i], v[:-1]]) for i, v in enumerate(rows)]
        other = [v != b for v, b in zip(rows, before)]
        begins = other[0] | other[1]
        fresh = np.logical_or.reduce(other)
        if last is None:
            fresh[0] = True
        tile = np.cumsum(begins)  # 0: the tile that the batch before ended with
        at_ref, at_part = np.flatnonzero(fresh & (rows[6] == 0)), np.flatnonzero(rows[6] > 0)
        n_old, n_tiles = len(refs[0]), int(tile[-1]) + 1
        refs = tuple(np.concatenate([old, v[at_ref]]) for old, v in zip(refs, rows[2:6]))
        bounds = np.searchsorted(np.concatenate([np.zeros(n_old, tile.dtype), tile[at_ref]]), np.arange(n_tiles + 1))
        once = at_part[fresh[at_part]]
        parts, of = tuple(v[once] for v in rows[2:6]), tile[once]
        share = covered(parts, np.zeros(len(once)), np.ones(len(once)), bounds[of], (bounds[1:] - bounds[:-1])[of], refs, buf)
        metres = rows[6] * rows[7]
        whole, near = np.bincount(tile[at_part], metres[at_part], n_tiles), np.bincount(of, share * metres[once], n_tiles)
        head = np.flatnonzero(np.diff(tile[at_part], prepend=-1))
        mine = at_part[head]
        got = [rows[0][mine], rows[1][mine], whole[tile[mine]], near[tile[mine]]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got, SUMS.types)], schema=SUMS)
        refs, last = tuple(v[bounds[-2] :].copy() for v in refs), [v[-1:].copy() for v in rows]
