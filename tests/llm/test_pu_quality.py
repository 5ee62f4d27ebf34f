import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridreach.llm import pu_quality as p

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_prior(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = p.score(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and not got.isna().any().any()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    out = both[both.held_out]
    assert (out.predicted == out.quality).mean() >= 0.93
    assert abs(got.prior.iloc[0] - both.quality.mean()) < 0.15


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(string(doc_id)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic", "'x' AS text", "1 AS x")
    a, b = ({(r.doc_id, round(r.score, 6)) for r in p.score(docs.selectExpr("*", "1 AS x", "2 AS positive"), y).collect()} for y in (labels, flipped))
    assert a == b


def test_gradient_of_the_risk():
    rng = np.random.default_rng(0)
    x = [rng.integers(0, 255, p.WIDTH, dtype=np.uint8).tobytes() for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array([i % 3 == 0 for i in range(40)])], ["x", "positive"])
    w = rng.normal(0, 0.02, p.WIDTH + 1)

    def parts(v):
        t = p._parts(v)(batch)
        return t[2:5], t[5:].reshape(3, -1)

    (_, grads), at = parts(w), [0, 100, p.WIDTH]
    for k in at:
        step = np.zeros_like(w)
        step[k] = 1e-2
        near = (parts(w + step)[0] - parts(w - step)[0]) / 2e-2
        assert np.allclose(near, grads[:, k], rtol=2e-2, atol=2e-2)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "word " * 50_000), (3, "word " * 50_000), (4, "fine text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = p.score(docs, none).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    odd = spark.createDataFrame([(3, 1), (4, 1), (4, 0), (1, None), (None, 1), (2, 0)], "doc_id long, quality int")
    got = p.score(docs, odd).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert p.score(docs.limit(0), odd).count() == 0


@pytest.mark.parametrize("text", [b"", b"a", b"ab", b"a\n\n\nb", "é!".encode() * 3, b" \n "])
def test_features_of_short_texts(text):
    assert len(p.features(text)) == p.WIDTH


def test_risk_and_prior_equal_plain_sums(spark):
    """The clamped risk with its gradient, on both sides of the clamp, and the best-bin prior, row by row."""
    rng = np.random.default_rng(8)
    n = 300
    x = rng.integers(0, 60, (n, p.WIDTH), dtype=np.uint8)
    pos = rng.random(n) < 0.4
    x[pos, :20] += 120
    rows = spark.createDataFrame([(bytearray(r.tobytes()), bool(q)) for r, q in zip(x, pos)], "x binary, positive boolean").repartition(4)
    full = np.concatenate((x.astype(float) / 255, np.ones((n, 1))), 1)
    soft, sig = lambda z: np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0), lambda z: 1 / (1 + np.exp(-z))
    clamped = set()
    for prior, apart in ((0.3, 0.0), (0.6, 0.0), (0.9, 3.0)):
        w = rng.normal(0, 0.01, p.WIDTH + 1)
        w[:20] += apart  # told apart well, the second term is negative and clamped
        w[-1] -= 20 if apart else 0
        z = full @ w
        a, b, u = soft(-z[pos]).mean(), soft(z[pos]).mean(), soft(z[~pos]).mean()
        rest = u - prior * b
        clamped.add(rest <= 0)
        want = prior * a + max(0.0, rest) + p.L2 * w @ w
        grad = prior * (-(1 - sig(z[pos]))) @ full[pos] / pos.sum() + 2 * p.L2 * w
        if rest > 0:
            grad = grad + sig(z[~pos]) @ full[~pos] / (~pos).sum() - prior * sig(z[pos]) @ full[pos] / pos.sum()
        loss, g = p.nn_risk(rows, prior)(w)
        assert loss == pytest.approx(want, rel=1e-5) and np.allclose(g, grad, rtol=1e-3, atol=1e-5)
    w = np.zeros(p.WIDTH + 1)
    w[:20] = 1.0
    s = np.minimum((sig(full @ w) * p.BINS).astype(int), p.BINS - 1)
    slack = np.sqrt(np.log(40) / 2 / (~pos).sum()) + np.sqrt(np.log(40) / 2 / pos.sum())
    tails = [((s[~pos] >= t).mean(), (s[pos] >= t).mean()) for t in range(p.BINS - 1, -1, -1)]
    best = min(((qu + slack) / qp, -i, qu / qp) for i, (qu, qp) in enumerate(tails) if qp > 0)
    same = [qu / qp for qu, qp in tails if qp > 0 and abs((qu + slack) / qp - best[0]) < 1e-12]
    assert any(p.class_prior(rows, w) == pytest.approx(np.clip(v, 0.01, 0.99)) for v in same)
    assert clamped == {True, False}
