"""Weight draws inside rows and rank correlations by null pattern against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridreach.operators import draws, scoring, screening


@pytest.mark.parametrize("few", [256, 3])
def test_monte_carlo_equals_plain_scores(spark, monkeypatch, few):
    monkeypatch.setattr(draws, "FEW", few)
    monkeypatch.setattr(draws, "BUCKETS", 8)
    rng = np.random.default_rng(1)
    x = np.round(rng.random((300, 3)), 2)
    x[:120] = x[0]  # a third of all rows alike
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double").repartition(5)
    got = {r["id"]: r for r in scoring.monte_carlo(df, "id", ["a", "b", "c"], draws=40, seed=3).collect()}
    w = draws.dirichlet(spark, 3, 40, 3)
    assert np.allclose(w.sum(1), 1) and (w > 0).all()
    s = draws.scores(x, w)
    limit = np.quantile(s, 0.9, axis=0)
    assert np.allclose(draws.quantiles(df, ["a", "b", "c"], w, 0.9), limit)
    near = np.abs(s - limit).min(1) > 1e-12
    for i in range(300):
        assert got[i]["mean_score"] == pytest.approx(s[i].mean()) and got[i]["std_score"] == pytest.approx(s[i].std()) and got[i]["cv"] == pytest.approx(s[i].std() / s[i].mean())
        assert not near[i] or got[i]["pct_top"] == pytest.approx((s[i] >= limit).mean() * 100)


def test_draws_of_odd_rows(spark):
    df = spark.createDataFrame([(1, 0.5, None), (2, 0.5, 1.0), (2, 0.5, 1.0)], "id long, a double, b double")
    got = scoring.monte_carlo(df, "id", ["a", "b"], draws=10).collect()
    assert sorted((r["id"], r["pct_top"]) for r in got if r["id"] == 2) == [(2, 100.0)] * 2
    assert [r["mean_score"] for r in got if r["id"] == 1] == [None]
    assert scoring.monte_carlo(df.limit(0), "id", ["a", "b"], draws=10).count() == 0


def test_rank_correlation_by_null_pattern(spark):
    rng = np.random.default_rng(2)
    d = pd.DataFrame({c: np.round(rng.normal(size=200), 1) for c in "abcdef"})
    d.loc[d.index % 3 == 0, ["c", "d"]] = None
    d.loc[d.index % 5 == 0, "e"] = None
    d.loc[40:, "f"] = None
    df = spark.createDataFrame([(i, *[None if v != v else float(v) for v in r]) for i, r in enumerate(d.to_numpy())], "id long, " + ", ".join(f"{c} double" for c in "abcdef"))
    assert sorted(map(sorted, screening.null_classes(df, "id", list("abcdef")))) == [["a", "b"], ["c", "d"], ["e"], ["f"]]
    got = {(r["a"], r["b"]): (r["n"], r["rho"]) for r in screening.spearman_matrix(df, "id", list("abcdef"), 30).collect()}
    want = {}
    for i, a in enumerate("abcdef"):
        for b in "abcdef"[i + 1 :]:
            both = d[[a, b]].dropna()
            if len(both) >= 30:
                want[a, b] = (len(both), both.rank().corr().iloc[0, 1])
    assert set(got) == set(want) and ("d", "f") not in want
    for k, (n, rho) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(rho)
