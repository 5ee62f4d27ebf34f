"""Scores under many random weight draws, without a row for each cell and draw.

A draw's weights are hashes, so they are one small array (draws x dimensions) that goes along with the tasks; a task scores a few
hundred rows against all draws at once.  Each draw's quantile over all rows is exact: its bracket is narrowed by counts of the rows in
BUCKETS parts, with the least and greatest score of each part, until few values are left, which are then looked at.  What a pass
sends is bounded by draws x BUCKETS for a task, however many rows there are.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows scored at once, parts of a bracket, and values left in it that are looked at one by one.
ROWS, BUCKETS, FEW = 256, 64, 256


def dirichlet(spark: SparkSession, dims: int, draws: int, seed: int) -> np.ndarray:
    """Weights (draws x dims) that are uniform on the simplex: exponential variates of hashes, scaled to one."""
    # uniform in (0, 1] from the top 53 bits of a hash; -log of it is an exponential variate
    unit = lambda i: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("draw"), F.lit(i)), 11) + 1) / float(2**53)
    rows = spark.range(1, draws + 1).select(F.col("id").cast("int").alias("draw"))
    got = rows.select("draw", *[(-F.ln(unit(i))).alias(f"w{i}") for i in range(dims)]).orderBy("draw").collect()  # draws x dims
    w = np.array([r[1:] for r in got], float).reshape(draws, dims)
    return w / w.sum(1, keepdims=True)


def scores(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(rows x draws), added up dimension by dimension, so that a row scores the same in every pass."""
    out = np.zeros((len(x), len(w)))
    for i in range(w.shape[1]):
        out += x[:, i, None] * w[None, :, i]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], cols: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, vectors, which are complete)."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            x = np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols], 1)
            yield part, x, ~np.isnan(x).any(1)


def _narrow(df: DataFrame, cols: Sequence[str], w: np.ndarray, lo: np.ndarray, hi: np.ndarray, todo: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per open draw: rows, least and greatest score in each part of its bracket."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(todo), BUCKETS), np.int64)
        least, most = np.full(n.shape, np.inf), np.full(n.shape, -np.inf)
        width = np.where(hi[todo] > lo[todo], hi[todo] - lo[todo], 1.0)
        at = np.arange(len(todo)) * BUCKETS
        for _, x, ok in _blocks(batches, cols):
            s = scores(x[ok], w[todo])
            inside = (s >= lo[todo]) & (s <= hi[todo])
            part = np.clip(((s - lo[todo]) / width * BUCKETS).astype(np.int64), 0, BUCKETS - 1) + at
            n += np.bincount(part[inside], minlength=n.size).reshape(n.shape)
            np.minimum.at(least.reshape(-1), part[inside], s[inside])
            np.maximum.at(most.reshape(-1), part[inside], s[inside])
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array(todo, pa.int64()), *[pa.array(list(a), pa.list_(t)) for a, t in ((n, pa.int64()), (least, pa.float64()), (most, pa.float64()))]], ["draw", "n", "least", "most"])

    def add(group: pa.Table) -> pa.Table:
        n, least, most = (np.stack(group.column(c).to_pylist()) for c in ("n", "least", "most"))
        return pa.table({"draw": group.column("draw").slice(0, 1), "n": pa.array([n.sum(0)], pa.list_(pa.int64())), "least": pa.array([least.min(0)], pa.list_(pa.float64())), "most": pa.array([most.max(0)], pa.list_(pa.float64()))})

    kinds = "draw long, n array<long>, least array<double>, most array<double>"
    got = df.select(*cols).mapInArrow(scan, kinds).groupBy("draw").applyInArrow(add, kinds).toArrow()
    return {d: (np.array(n), np.array(a), np.array(z)) for d, n, a, z in zip(*(got.column(c).to_pylist() for c in ("draw", "n", "least", "most")), strict=True)}


def _values(df: DataFrame, cols: Sequence[str], w: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[int, list[tuple[float, int]]]:
    """Distinct scores inside each draw's bracket with their numbers of rows: FEW of a draw, or a few copied ones."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, ok in _blocks(batches, cols):
            s = scores(x[ok], w)
            row, draw = np.nonzero((s >= lo) & (s <= hi))
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(draw, pa.int64()), pa.array(s[row, draw])], ["draw", "v"])

    out: dict[int, list[tuple[float, int]]] = {}
    for r in df.select(*cols).mapInArrow(scan, "draw long, v double").groupBy("draw", "v").count().orderBy("draw", "v").collect():
        out.setdefault(r["draw"], []).append((r["v"], r["count"]))
    return out


def quantiles(df: DataFrame, cols: Sequence[str], w: np.ndarray, q: float) -> np.ndarray:
    """Exact linear-interpolation quantile of every draw's scores over the complete rows; NaN for an empty table."""
    draws = len(w)
    lo, hi, below, n = np.full(draws, -1e300), np.full(draws, 1e300), np.zeros(draws, np.int64), 0
    todo = np.arange(draws)
    while len(todo):
        found = _narrow(df, cols, w, lo, hi, todo)
        if not found:
            return np.full(draws, np.nan)
        n = n or int(next(iter(found.values()))[0].sum())
        first, last = int(np.floor(q * (n - 1))), int(np.ceil(q * (n - 1)))
        still = []
        for d in todo:
            count, least, most = found[int(d)]
            cum = below[d] + np.cumsum(count)
            a, z = int(np.searchsorted(cum, first, "right")), int(np.searchsorted(cum, last, "right"))
            left = int(cum[z] - (cum[a] - count[a]))
            shrunk = least[a] > lo[d] or most[z] < hi[d]
            below[d] = cum[a] - count[a]
            lo[d], hi[d] = least[a], most[z]
            if left > FEW and lo[d] < hi[d] and shrunk:
                still.append(d)
        todo = np.array(still, np.int64)
    values, h = _values(df, cols, w, lo, hi), q * (n - 1)
    out = np.empty(draws)
    for d in range(draws):
        v, c = zip(*values[d], strict=True)
        cum = below[d] + np.cumsum(c)
        x, y = (v[int(np.searchsorted(cum, i, "right"))] for i in (int(np.floor(h)), int(np.ceil(h))))
        out[d] = x + (y - x) * (h - np.floor(h))
    return out


def over_draws(df: DataFrame, key: str, cols: Sequence[str], w: np.ndarray, limit: np.ndarray) -> DataFrame:
    """(key, mean_score, std_score, cv, pct_top) of each row over all draws; nulls where a dimension is null."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, ok in _blocks(batches, cols):
            s = scores(x, w)
            mean, std = s.mean(1), s.std(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                cv = std / mean
            columns: list[tuple[np.ndarray, np.ndarray]] = [(mean, ok), (std, ok), (cv, ok & (mean > 0)), ((s >= limit).mean(1) * 100, ok)]
            yield pa.RecordBatch.from_arrays([part.column(key), *[pa.array(v, pa.float64(), mask=~there) for v, there in columns]], [key, "mean_score", "std_score", "cv", "pct_top"])

    return df.select(key, *cols).mapInArrow(one, f"{key} {df.schema[key].dataType.simpleString()}, mean_score double, std_score double, cv double, pct_top double")


def scored(df: DataFrame, key: str, cols: Sequence[str], draws: int, seed: int, q: float, ready: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Statistics of every row over the draws; `ready` writes the narrow table that the passes read."""
    table = ready(df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]))
    w = dirichlet(df.sparkSession, len(cols), draws, seed)
    return over_draws(table, key, cols, w, quantiles(table, cols, w, q))
