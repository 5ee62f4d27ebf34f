"""Full-batch fits of linear models whose sums Spark gathers: the driver holds one vector of the model's width."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def summed(rows: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """Sum over all batches of fn(batch), an array of `width` numbers: summed inside a task, then by Spark."""

    def run(batches):
        total = np.zeros(width)
        for b in batches:
            total += fn(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["k", "v"])

    got = rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # `width` rows
    out = np.zeros(width)
    for r in got:
        out[r["k"]] = r["v"]
    return out


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int, memory: int = 8, tol: float = 1e-5) -> np.ndarray:
    """Limited-memory quasi-Newton descent with step halving; each call of f is one pass over the data."""
    loss, g = f(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    calls = 1
    while calls < rounds and np.abs(g).max() > tol:
        d, alphas = g.copy(), []
        for s, y in reversed(pairs):
            alphas.append(s @ d / (y @ s))
            d -= alphas[-1] * y
        if pairs:
            s, y = pairs[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            d += s * (a - y @ d / (y @ s))
        slope = -(g @ d)
        step = 1.0 if pairs else 1.0 / max(1e-12, np.abs(g).sum()) * 4
        for _ in range(12):
            new = w - step * d
            new_loss, new_g = f(new)
            calls += 1
            if new_loss <= loss + 1e-4 * step * slope or calls >= rounds:
                break
            step *= 0.4
        if new_loss > loss:
            break
        s, y = new - w, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = loss - new_loss < 1e-7 * max(1.0, abs(loss))
        w, loss, g = new, new_loss, new_g
        if done:
            break
    return w
