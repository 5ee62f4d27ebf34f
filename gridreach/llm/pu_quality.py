"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled good; the unlabelled side is the whole corpus outside the held-out fold.  A
linear model minimises the non-negative unbiased risk  p R+(P) + max(0, R-(U) - p R-(P))  with logistic losses, over
all rows, by full-batch descent whose sums Spark gathers.  The class prior p is estimated first: a classifier of
positives against unlabelled text orders all rows, and p is the least ratio of the two tails (best bin).
The text is read once, into a fixed-width feature row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridreach.llm.fit import minimise, sigmoid, softplus, summed
from gridreach.llm.text import SPACE, as_bytes, keyed, over_batches, raw, spans, words
from gridreach.session import cut

#: Feature blocks: hashed byte pairs, pairs and triples of character classes, thermometers of document figures.
PAIRS, SHAPES, STEPS = 192, 256, 8
FIGURES = 8
WIDTH = PAIRS + SHAPES + FIGURES * STEPS
#: Rounds of the prior's and of the classifier's fit; L2 weight; bins of the prior's tails.
PRIOR_ROUNDS, ROUNDS, L2, BINS = 8, 16, 5e-4, 1024

_CLASS = np.full(256, 1, np.uint8)  # other signs
_CLASS[[9, 32]] = 2
_CLASS[[10, 11, 12, 13]] = 3
_CLASS[48:58] = 4
_CLASS[65:91] = 5
_CLASS[97:123] = 6
_CLASS[128:] = 7
_CLASS[[ord(c) for c in ".,;:"]] = 8
_CLASS[[ord(c) for c in "!?"]] = 9
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 10
_CLASS[[ord(c) for c in "\"'()-"]] = 11


#: Letters and digits read as one of their kind, so that pairs tell signs, case and spacing but not the language.
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[48:58], _FOLD[65:91], _FOLD[97:123], _FOLD[128:] = 48, 65, 97, 97


def _spread(counts: np.ndarray) -> np.ndarray:
    return np.rint(255 * np.sqrt(counts / max(1, counts.sum()))).astype(np.uint8)


def figures(text: bytes, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Document figures in 0 to 1."""
    n = max(1, len(b))
    c = _CLASS[b]
    starts, ends = spans(~SPACE[b])
    size = ends - starts
    distinct, times = np.unique(w, return_counts=True)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = max(1, int(((c == 5) | (c == 6)).sum()))
    return np.array([
        1 - len(distinct) / max(1, len(w)),
        times.max() / len(w) if len(w) else 0,
        1 - len(set(lines)) / max(1, len(lines)),
        (c == 10).sum() / n * 4,
        (c == 5).sum() / letters,
        (c == 4).sum() / n * 2,
        np.log1p(len(w)) / 12,
        (size.mean() / 16 if len(size) else 0),
    ])


def features(text: bytes | None) -> bytes:
    """WIDTH bytes: root shares of hashed byte pairs and class shapes, then thermometers of the figures."""
    text = text or b""
    b = as_bytes(text)
    c = _CLASS[b].astype(np.int64)
    f = _FOLD[b]
    pair = np.bincount((f[:-1] * 31 + f[1:] * 7) % PAIRS, minlength=PAIRS) if len(b) > 1 else np.zeros(PAIRS)
    shape = np.bincount((c[:-2] * 144 + c[1:-1] * 12 + c[2:]) * 53 % 1021 % SHAPES, minlength=SHAPES) if len(b) > 2 else np.zeros(SHAPES)
    level = np.clip(figures(text, b, words(text))[:, None] * STEPS - np.arange(STEPS), 0, 1)
    return np.concatenate((_spread(pair), _spread(shape), np.rint(255 * level.ravel()).astype(np.uint8))).tobytes()


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(-1, WIDTH).astype(np.float32) / 255
    return np.concatenate((x, np.ones((len(x), 1), np.float32)), 1)


def _parts(w: np.ndarray):
    """Sums over rows (x, positive): for P losses as positive and as negative with gradients, for U as negative."""
    w32 = w.astype(np.float32)

    def fn(batch: pa.RecordBatch) -> np.ndarray:
        x, p = _matrix(batch), batch.column("positive").to_numpy(zero_copy_only=False)
        z = (x @ w32).astype(np.float64)
        s = sigmoid(z)
        u = ~p
        grads = [(-(1 - s[p])) @ x[p], s[p] @ x[p], s[u] @ x[u]]
        return np.concatenate(([p.sum(), u.sum(), softplus(-z[p]).sum(), softplus(z[p]).sum(), softplus(z[u]).sum()], *grads))

    return fn


def _sums(rows: DataFrame, w: np.ndarray):
    t = summed(rows, _parts(w), 5 + 3 * len(w))
    n_p, n_u = max(1.0, t[0]), max(1.0, t[1])
    g = t[5:].reshape(3, -1)
    return t[2] / n_p, t[3] / n_p, t[4] / n_u, g[0] / n_p, g[1] / n_p, g[2] / n_u


def nn_risk(rows: DataFrame, prior: float):
    """Non-negative unbiased risk and its gradient as a function of the weights."""

    def f(w: np.ndarray) -> tuple[float, np.ndarray]:
        pos, neg_p, neg_u, g_pos, g_neg_p, g_neg_u = _sums(rows, w)
        rest = neg_u - prior * neg_p
        loss, g = prior * pos + max(0.0, rest), prior * g_pos
        if rest > 0:
            g = g + g_neg_u - prior * g_neg_p
        return loss + L2 * w @ w, g + 2 * L2 * w

    return f


def pu_contrast(rows: DataFrame):
    """Logistic loss of positives against unlabelled rows, both sides weighing the same."""

    def f(w: np.ndarray) -> tuple[float, np.ndarray]:
        pos, _, neg_u, g_pos, _, g_neg_u = _sums(rows, w)
        return (pos + neg_u) / 2 + L2 * w @ w, (g_pos + g_neg_u) / 2 + 2 * L2 * w

    return f


def class_prior(rows: DataFrame, w: np.ndarray) -> float:
    """Least ratio of the unlabelled to the positive tail of the scores, each tail with its sampling error."""

    def fn(batch: pa.RecordBatch) -> np.ndarray:
        z = _matrix(batch) @ w.astype(np.float32)
        bin_ = np.minimum((sigmoid(z.astype(np.float64)) * BINS).astype(np.int64), BINS - 1)
        p = batch.column("positive").to_numpy(zero_copy_only=False)
        return np.concatenate((np.bincount(bin_[p], minlength=BINS), np.bincount(bin_[~p], minlength=BINS))).astype(float)

    t = summed(rows, fn, 2 * BINS).reshape(2, BINS)
    n = np.maximum(1, t.sum(1))
    q_p, q_u = (np.cumsum(t[i][::-1]) / n[i] for i in (0, 1))
    slack = np.sqrt(np.log(40) / 2 / n[1]) + np.sqrt(np.log(40) / 2 / n[0])
    with np.errstate(divide="ignore"):
        at = int(np.argmin(np.where(q_p > 0, (q_u + slack) / q_p, np.inf)))
    return float(np.clip(q_u[at] / max(q_p[at], 1e-12), 0.01, 0.99))


def held_out(folds: int = 5, fold: int = 0) -> Column:
    """Fold membership by crc32 of the id's text; a row without an id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(True))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, prior: probability that a document is of good quality.

    Labels are learned from the folds that are not held out; an id with contradicting or null labels is not trusted.
    Null and empty texts have all-zero features and get a score like any other.  Without a trusted positive or without
    unlabelled rows nothing can be learned and every score is 0.5.  Repeated rows weigh and return as often as they come;
    extra columns are ignored; an empty table gives an empty result.
    """

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([features(t) for t in raw(batch, "text")], pa.binary())], ["doc_id", "x"])

    x = cut(over_batches(keyed(docs, "doc_id", "text"), extract, "doc_id long, x binary").withColumn("held_out", held_out()))
    good = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("lo"), F.count_if(F.col("quality").isNull()).alias("none")).where("lo = 1 and none = 0")
    unlabelled = x.where(~F.col("held_out")).select("x", F.lit(False).alias("positive"))
    positive = cut(x.where(~F.col("held_out")).join(good, F.col("doc_id") == F.col("_id"), "left_semi").select("x", F.lit(True).alias("positive")))
    w = np.zeros(WIDTH + 1)
    trained = not positive.isEmpty()
    if trained:
        rows = positive.unionByName(unlabelled)
        w = minimise(pu_contrast(rows), w, PRIOR_ROUNDS)
        prior = class_prior(rows, w) if prior is None else prior
        w[-1] += np.log(prior / (1 - prior))
        w = minimise(nn_risk(rows, prior), w, ROUNDS)
    known = float(prior) if trained else float("nan")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sigmoid((_matrix(b) @ w.astype(np.float32)).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(np.full(len(s), known))],
                ["doc_id", "held_out", "score", "predicted", "prior"],
            )

    return x.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int, prior double")
