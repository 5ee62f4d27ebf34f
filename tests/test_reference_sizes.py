"""Fits and sweeps are registered at the reference's size."""

from types import SimpleNamespace

from gridreach.plans import q_k_screening as qk
from gridreach.plans import q_p_demand as qp


class Stop(Exception):
    pass


def called(monkeypatch, module, name, run):
    """Arguments of the first call of module.name."""
    seen = []

    def spy(*args, **kwargs):
        seen.append((args, kwargs))
        raise Stop

    monkeypatch.setattr(module, name, spy)
    try:
        run()
    except Stop:
        pass
    return seen[0]


def test_boosting_and_search(spark, monkeypatch):
    w = SimpleNamespace(features=spark.range(5).selectExpr("id as grid_id", "id as n_trip", *[f"id as {x}" for x in qp.XS]))
    for q in (qp.p2, qp.p5):
        assert called(monkeypatch, qp.dm, "gbt_fit", lambda q=q: q(w))[1] == {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3}
    args, more = called(monkeypatch, qp.dm, "random_search", lambda: qp.p4(w))
    assert {k: list(v) for k, v in args[3].items()} == {"maxDepth": [4, 5, 6, 7, 8, 9], "stepSize": [0.001, 0.01], "maxIter": [100, 200, 300, 400]}
    assert more == {"n": 5, "folds": 3}


def test_kmeans_sweep(monkeypatch):
    monkeypatch.setattr(qk, "scaled", lambda w: None)
    monkeypatch.setattr(qk.cl, "matrix", lambda *a: None)
    args, more = called(monkeypatch, qk.cl, "kmeans_sweep", lambda: qk.l1(None))
    assert (list(args[2]), args[3], more) == (list(range(3, 11)), [42, 1, 7, 123, 2024], {"n_init": 10})
