"""Many k-means fits in one scan for each step.

All centre sets of a sweep (values of k x seeds x starts) travel together as one bounded array.  A step reads the rows once: every task adds
up counts, sums and costs of every unfinished set in its own arrays and sends one row per set, and Spark adds these rows up.  A sweep of
400 fits thus takes as many scans as its slowest fit has iterations.  Starts are k-means++: the next centre of every set is the
row with the least -ln(u) / d^2, u a hash of row and set, which draws rows in proportion to their squared distance without sorting.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

#: Rows whose distances to all centres are held at once.
ROWS = 1024
#: Rows of a Lloyd step, few enough for their distances to stay in a core's cache.
STEP_ROWS = 128
_U = np.uint64


@dataclass
class CentreSet:
    """One fit: its k, seed and start, the centres (k x features), and once fitted its cost and number of steps."""

    k: int
    seed: int
    start: int
    centres: np.ndarray
    cost: float = float("inf")
    steps: int = 0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row hashes, row vectors) of at most ROWS rows."""
    for batch in batches:
        h, vec = batch.column("h").to_numpy(), batch.column("vec")
        for i in range(0, batch.num_rows, ROWS):
            part = vec.slice(i, ROWS)
            yield h[i : i + ROWS], part.flatten().to_numpy().reshape(len(part), -1)


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    return np.maximum(d, 0)


def _rows(m: DataFrame, key: str) -> DataFrame:
    return m.select(F.xxhash64(key).alias("h"), "vec")


def _summed(rows: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Arrays that `each` makes of a task's rows, added up by their number; as many come to the driver as there are numbers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = each(batches)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.list_(pa.float64()))], ["id", "x"])

    def add(group: pa.Table) -> pa.Table:
        x = np.sort(np.stack(group.column("x").to_pylist()), 0).sum(0)  # in one order, whatever order tasks ended in
        return pa.table({"id": group.column("id").slice(0, 1), "x": pa.array([x], pa.list_(pa.float64()))})

    out = rows.mapInArrow(scan, "id long, x array<double>").groupBy("id").applyInArrow(add, "id long, x array<double>").toArrow()
    return {i: np.array(x) for i, x in zip(out.column("id").to_pylist(), out.column("x").to_pylist(), strict=True)}


def plus_plus(m: DataFrame, key: str, wanted: Sequence[tuple[int, int, int]]) -> list[CentreSet]:
    """k-means++ centres of each wanted (k, seed, start): one scan for each centre, for all sets together."""
    rows = _rows(m, key)
    sets = [CentreSet(k, seed, start, np.zeros((0, 0))) for k, seed, start in wanted]
    for turn in range(max((s.k for s in sets), default=0)):
        open_ = [(i, s.centres, _mixed(np.array([s.seed * 1_000_003 + s.start * 1009 + turn], np.int64).view(np.uint64))[0]) for i, s in enumerate(sets) if s.k > turn]

        def draw(batches: Iterator[pa.RecordBatch], open_=open_, turn=turn) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, np.ndarray]] = {}
            every = np.concatenate([c for _, c, _ in open_]) if turn else None
            for h, x in _chunks(batches):
                d = _squared(x, every).reshape(len(x), len(open_), turn).min(2) if turn else np.ones((len(x), len(open_)))
                for at, (i, _, salt) in enumerate(open_):
                    u = ((_mixed(h.view(np.uint64) ^ salt) >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)
                    with np.errstate(divide="ignore"):
                        score = np.minimum(-np.log(u) / d[:, at], 1e300)  # no weight left: any row
                    r = int(score.argmin())
                    if i not in best or score[r] < best[i][0]:
                        best[i] = (float(score[r]), x[r].copy())
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array([b[0] for b in best.values()]), pa.array([b[1] for b in best.values()], pa.list_(pa.float64()))], ["id", "score", "vec"])

        drawn = rows.mapInArrow(draw, "id long, score double, vec array<double>").groupBy("id").agg(F.min(F.struct("score", "vec")).alias("b")).select("id", "b.vec").toArrow()
        for i, v in zip(drawn.column("id").to_pylist(), drawn.column("vec").to_pylist(), strict=True):
            sets[i].centres = np.vstack([sets[i].centres, [v]]) if turn else np.array([v])
    return [s for s in sets if len(s.centres) == s.k]  # none of an empty table


def _step(rows: DataFrame, sets: Sequence[CentreSet], dims: int) -> dict[int, np.ndarray]:
    """Per set: counts, sums and cost of its centres' rows, as one array.

    Sets stand by k, largest first, so the sets that have a j-th centre are the first ones: the j-th distances of all sets are one
    product, and the nearest centre so far is kept while j runs on.  The first of equally near centres wins.
    """
    by_k = sorted(range(len(sets)), key=lambda i: -sets[i].k)
    ks = np.array([sets[i].k for i in by_k])
    ends = np.cumsum(ks)
    jth = []
    for j in range(ks[0]):
        c = np.array([sets[i].centres[j] for i in by_k if sets[i].k > j])
        jth.append((-2 * c, (c * c).sum(1)[:, None]))

    def each(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        sums, cost, seen = np.zeros((dims + 1, ends[-1])), np.zeros(len(ks)), False
        room = np.empty((len(ks), STEP_ROWS))
        for _, every in _chunks(batches):
            seen = True
            for at in range(0, len(every), STEP_ROWS):
                x = every[at : at + STEP_ROWS]
                cols = np.ascontiguousarray(x.T)
                best = jth[0][0] @ cols + jth[0][1]
                near = np.zeros(best.shape, np.uint8 if ks[0] < 256 else np.int64)
                for j, (c, norm) in enumerate(jth[1:], 1):
                    n = len(c)
                    d = np.matmul(c, cols, out=room[:n, : len(x)])
                    d += norm
                    np.maximum(near[:n], (d < best[:n]) * near.dtype.type(j), out=near[:n])
                    np.minimum(best[:n], d, out=best[:n])
                cost += np.maximum(best + (x * x).sum(1), 0).sum(1)
                flat = (near + (ends - ks)[:, None]).ravel()
                sums[0] += np.bincount(flat, minlength=ends[-1])
                for j in range(dims):
                    best[:] = cols[j]
                    sums[j + 1] += np.bincount(flat, best.ravel(), ends[-1])
        if not seen:
            return {}
        return {i: np.append(sums[:, end - k : end].ravel(), c) for i, k, end, c in zip(by_k, ks, ends, cost, strict=True)}

    return _summed(rows, each)


def fit(m: DataFrame, key: str, sets: Sequence[CentreSet], max_iter: int = 100, tol: float = 1e-4) -> None:
    """Lloyd steps for all sets together until each has moved by less than tol x mean variance (squared shift), or max_iter.

    Sets that have settled drop out of later scans.  A centre without rows stays.  Costs are those of the last centres.
    """
    if not sets:
        return
    rows, dims = _rows(m, key), sets[0].centres.shape[1]
    one = _summed(rows, lambda batches: _moments(batches, dims))[0]
    mean, spread = one[1 : dims + 1] / one[0], one[dims + 1 :] / one[0]
    least = tol * float(np.maximum(spread - mean * mean, 0).mean())
    moving = list(sets)
    for _ in range(max_iter):
        sums = _step(rows, moving, dims)
        still = []
        for i, s in enumerate(moving):
            n, total = sums[i][: s.k], sums[i][s.k : -1].reshape(dims, s.k).T
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], s.centres)
            shift, s.centres, s.steps = float(((new - s.centres) ** 2).sum()), new, s.steps + 1
            if shift > least:
                still.append(s)
        moving = still
        if not moving:
            break
    for i, x in _step(rows, sets, dims).items():
        sets[i].cost = float(x[-1])


def _moments(batches: Iterator[pa.RecordBatch], dims: int) -> dict[int, np.ndarray]:
    out = np.zeros(1 + 2 * dims)
    for _, x in _chunks(batches):
        out += np.concatenate(([len(x)], x.sum(0), (x * x).sum(0)))
    return {0: out} if out[0] else {}


def labels(m: DataFrame, key: str, fit_: CentreSet) -> DataFrame:
    """(key, label) of each row's nearest centre, the first one on a tie."""
    centres = fit_.centres

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                x = part.column("vec").flatten().to_numpy().reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(_squared(x, centres).argmin(1), pa.int32())], [key, "label"])

    return m.select(key, "vec").mapInArrow(one, f"{key} {m.schema[key].dataType.simpleString()}, label int")


def agreement(table: np.ndarray) -> float:
    """Adjusted Rand index of a contingency table."""
    pairs = lambda c: float((c * (c - 1) / 2).sum())
    both, a, b, n = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), float(table.sum())
    expected = a * b / (n * (n - 1) / 2) if n > 1 else 0.0
    return 1.0 if (a + b) / 2 == expected else (both - expected) / ((a + b) / 2 - expected)


def diagnostics(m: DataFrame, key: str, by_k: dict[int, list[CentreSet]]) -> list[dict[str, float]]:
    """Quality of each k's first set and agreement of its sets, in two scans for all of them."""
    rows = _rows(m, key)
    ks = list(by_k)
    dims = by_k[ks[0]][0].centres.shape[1]
    every = np.concatenate([s.centres for k in ks for s in by_k[k]])
    counts = [len(by_k[k]) for k in ks]

    def tables(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for _, x in _chunks(batches):
            d, a, norm = _squared(x, every), 0, (x * x).sum(1)
            for q, (k, c) in enumerate(zip(ks, counts, strict=True)):
                lab = [d[:, a + k * i : a + k * (i + 1)].argmin(1) for i in range(c)]
                a += k * c
                parts = [np.bincount(lab[0], minlength=k), np.bincount(lab[0], norm, k), *[np.bincount(lab[0], x[:, j], k) for j in range(dims)]]
                parts += [np.bincount(lab[i] * k + lab[j], minlength=k * k) for i in range(c) for j in range(i + 1, c)]
                out[q] = out.get(q, 0) + np.concatenate(parts).astype(np.float64)
        return out

    first = _summed(rows, tables)
    shape = []
    for q, k in enumerate(ks):
        n, norm, sums = first[q][:k], first[q][k : 2 * k], first[q][2 * k : (2 + dims) * k].reshape(dims, k).T
        shape.append((n, norm, sums, sums / np.maximum(n, 1)[:, None]))
    lead = np.concatenate([by_k[k][0].centres for k in ks])

    def spreads(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for _, x in _chunks(batches):
            d, a, norm = _squared(x, lead), 0, (x * x).sum(1)
            for q, k in enumerate(ks):
                lab = d[:, a : a + k].argmin(1)
                a += k
                n, psi, sums, mean = shape[q]
                d2 = ((x - mean[lab]) ** 2).sum(1)
                size = np.maximum(n, 1)
                far = norm[:, None] + psi / size - 2 * x @ (sums / size[:, None]).T  # mean squared distance to each cluster's rows
                far[:, n == 0] = np.inf
                own = far[np.arange(len(x)), lab] * n[lab] / np.maximum(n[lab] - 1, 1)
                far[np.arange(len(x)), lab] = np.inf
                other = far.min(1) if k > 1 else np.full(len(x), np.inf)
                top = np.maximum(own, other)
                score = np.where((n[lab] > 1) & np.isfinite(other) & (top > 0), (other - own) / np.where(np.isfinite(top) & (top > 0), top, 1), 0.0)
                out[q] = out.get(q, 0) + np.concatenate([np.bincount(lab, d2, k), np.bincount(lab, np.sqrt(d2), k), [score.sum()]])
        return out

    second = _summed(rows, spreads)
    found = []
    for q, (k, c) in enumerate(zip(ks, counts, strict=True)):
        n, _, sums, mean = shape[q]
        live = n > 0
        n, mean, total = n[live], mean[live], n.sum()
        within, spread = second[q][:k][live], second[q][k : 2 * k][live] / n
        between = float((n[:, None] * (mean - sums.sum(0) / total) ** 2).sum())
        gap = np.sqrt(((mean[:, None] - mean[None]) ** 2).sum(2))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (spread[:, None] + spread[None]) / gap
        np.fill_diagonal(ratio, -np.inf)
        start, aris = (2 + dims) * k, []
        for _ in range(c * (c - 1) // 2):
            aris.append(agreement(first[q][start : start + k * k].reshape(k, k)))
            start += k * k
        kk = len(n)
        found.append({
            "k": k,
            "silhouette": float(second[q][-1] / total),
            "calinski_harabasz": float(between / (kk - 1) / (within.sum() / (total - kk))) if 1 < kk < total and within.sum() > 0 else float("nan"),
            "davies_bouldin": float(ratio.max(1).mean()) if kk > 1 else float("nan"),
            "min_pct": round(float(n.min() / total * 100), 2),
            "max_pct": round(float(n.max() / total * 100), 2),
            "size_ratio": round(float(n.max() / n.min()), 2),
            "mean_seed_ari": float(np.mean(aris)) if aris else 1.0,
            "min_seed_ari": float(min(aris)) if aris else 1.0,
        })
    return found
