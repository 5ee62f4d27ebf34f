"""Quality rules: fixed counts of each text, and a calibrated logistic regression on hashed word and character n-grams.

The regression is fitted on a bounded sample of labelled rows (`fit_rows`); a fifth of the sample only calibrates its
probabilities (Platt).  Every whole text is scored in Arrow batches against fixed thresholds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridreach.llm.fit import minimise, sigmoid, softplus, summed
from gridreach.llm.text import SPACE, as_bytes, hash_runs, keyed, over_batches, raw, windows
from gridreach.session import cut

#: Buckets of hashed word n-grams (one and two words) and of hashed character trigrams.
WORDS, CHARS = 1 << 13, 1 << 13
WIDTH = WORDS + CHARS
#: Labelled rows used at most; rounds and L2 weight of the fit.
FIT_ROWS, ROUNDS, L2 = 20_000, 25, 2e-5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_U = np.uint64
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(text: bytes) -> tuple[tuple[int, int, int, int, int], np.ndarray]:
    """The BASE figures of a text, and its word hashes."""
    b = as_bytes(text)
    word = ~SPACE[b]
    w = hash_runs(b, word)
    code_points = (b & 0xC0) != 0x80
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    repeated = 0
    if len(w) >= 3:
        _, at, times = np.unique(windows(w, 3), return_inverse=True, return_counts=True)
        twice = times[at] > 1
        cover = np.zeros(len(w), bool)
        for j in range(3):
            cover[j : j + len(twice)] |= twice
        repeated = int(cover.sum())
    return (len(w), int((word & code_points).sum()), int(_SYMBOL[b].sum()), len(lines) - len(set(lines)), repeated), w


def failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def features(text: bytes, w: np.ndarray) -> np.ndarray:
    """Root shares of the hashed word n-grams and of the hashed character trigrams."""
    b = as_bytes(text)
    out = np.zeros(WIDTH, np.float32)
    if len(w):
        two = windows(w, 2) if len(w) > 1 else w[:0]
        c = np.bincount((np.concatenate((w, two)) & _U(WORDS - 1)).astype(np.int64), minlength=WORDS)
        out[:WORDS] = np.sqrt(c / c.sum())
    if len(b) > 2:
        g = b.astype(np.uint32)
        h = (g[:-2] * np.uint32(2654435761)) ^ (g[1:-1] * np.uint32(2246822519)) ^ (g[2:] * np.uint32(3266489917))
        c = np.bincount(((h ^ (h >> np.uint32(15))) >> np.uint32(3)) & np.uint32(CHARS - 1), minlength=CHARS)
        out[WORDS:] = np.sqrt(c / c.sum())
    return out


class Model:
    """Weights with the bias last, and the calibration p = sigmoid(a z + b)."""

    def __init__(self, w: np.ndarray, a: float = 1.0, b: float = 0.0):
        self.w, self.bias, self.a, self.b = w[:-1].astype(np.float32), float(w[-1]), a, b

    def margin(self, x: np.ndarray) -> float:
        return float(x @ self.w) + self.bias

    def probability(self, z: float) -> float:
        return float(sigmoid(np.float64(self.a * z + self.b)))


def _loss(w: np.ndarray):
    def fn(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(2 + len(w))
        for k, v, y in zip(batch.column("k").to_pylist(), batch.column("v").to_pylist(), batch.column("y").to_pylist(), strict=True):
            k, v = np.frombuffer(k, np.uint16), np.frombuffer(v, np.float32)
            z = float(v @ w[k]) + w[-1]
            out[0] += 1
            out[1] += softplus(-z if y else z)
            d = float(sigmoid(np.float64(z))) - y
            out[2:][k] += d * v
            out[-1] += d
        return out

    return fn


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) that minimise the logistic loss of a z + b, with smoothed targets."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))

    def f(p: np.ndarray) -> tuple[float, np.ndarray]:
        m = p[0] * z + p[1]
        d = sigmoid(m) - t
        return float((softplus(m) - t * m).mean()), np.array([(d * z).mean(), d.mean()])

    a, b = minimise(f, np.array([1.0, 0.0]), 200, tol=1e-7)
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """Model from at most `fit_rows` labelled rows; None without rows of both labels."""
    y = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("y"), F.max("quality").alias("y2"))
    sample = cut(y.where("y = y2").orderBy(F.xxhash64("_id"), "_id").limit(fit_rows).select("_id", F.col("y").cast("int").alias("y")))
    d = keyed(docs, "doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))  # fit_rows ids at most

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        k, v = [], []
        for t in raw(batch, "text"):
            x = features(t or b"", base_counts(t or b"")[1])
            on = np.flatnonzero(x)
            k.append(on.astype(np.uint16).tobytes())
            v.append(x[on].tobytes())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(k, pa.binary()), pa.array(v, pa.binary())], ["doc_id", "y", "k", "v"])

    rows = cut(over_batches(d.select("doc_id", "text", "y"), extract, "doc_id long, y int, k binary, v binary"))
    last = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    train = rows.where(~last)
    if train.select("y").distinct().count() < 2:
        return None

    def f(w: np.ndarray) -> tuple[float, np.ndarray]:
        t = summed(train, _loss(w), 2 + len(w))
        return t[1] / t[0] + L2 * w @ w, t[2:] / t[0] + 2 * L2 * w

    model = Model(minimise(f, np.zeros(WIDTH + 1), ROUNDS))

    def margins(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = [float(np.frombuffer(v, np.float32) @ model.w[np.frombuffer(k, np.uint16)]) + model.bias for k, v in zip(batch.column("k").to_pylist(), batch.column("v").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), batch.column("y")], ["z", "y"])

    held = over_batches(rows.where(last), margins, "z double, y int").toPandas()  # a fifth of fit_rows
    if held["y"].nunique() == 2:
        model.a, model.b = _platt(held["z"].to_numpy(), held["y"].to_numpy())
    return model


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, the BASE figures, base_failed, kept, probability of good quality.

    A null text has no words and fails the base rules, as does an empty one.  Without labels of both kinds the regression
    keeps every text (probability null).  An id with contradicting labels is not learned from; a null id is judged like any other;
    repeated rows return as often as they come; extra columns are ignored; an empty table gives an empty result.
    """
    model = fit(docs, labels, fit_rows)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for d, t in zip(batch.column("doc_id").to_pylist(), raw(batch, "text"), strict=True):
            counts, w = base_counts(t or b"")
            bad = failed(counts[0], counts[-1])
            p = model.probability(model.margin(features(t or b"", w))) if model else None
            rows.append((d, *counts, bad, not bad and (p is None or p >= threshold), p))
        kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()]
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", *BASE, "base_failed", "kept", "probability"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, probability double"
    return over_batches(keyed(docs, "doc_id", "text"), one, schema)
