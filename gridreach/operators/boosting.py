"""Boosted regression trees on a table of binned rows.

Trees only see a row's bins, one of `bins` per feature, cut at quantiles.  Rows with the same bins are alike to every tree, so one
aggregation to (bins, count, sum of y, sum of y^2) keeps all that squared-loss boosting needs, exactly.  That table has at most
bins^features rows, however long the input is.  Where it is small (counted first), each fit is one task over it and fits run side
by side; fits that share depth and rate are one run, read at several numbers of trees.  Beyond that size Spark ML's
boosted trees take over, rows spread over the cluster.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridreach.operators import ordered as o
from gridreach.session import SMALL, cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

#: Shrinks leaf values; least rows of a leaf.
L2, LEAST = 1.0, 1.0


@dataclass
class Tree:
    """Nodes by number: feature (-1 in a leaf), last bin that goes left, children, value."""

    feature: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaf(self) -> int:
        self.feature.append(-1)
        self.last.append(0)
        self.left.append(0)
        self.value.append(0.0)
        return len(self.feature) - 1


def edges(df: DataFrame, xs: Sequence[str], bins: int = 32) -> list[np.ndarray]:
    """Rising cut points of each feature at exact quantiles: at most bins - 1, fewer where values repeat."""
    ps = {f"p{i}": i / bins for i in range(1, bins)}
    got = {r["feature"]: r for r in o.wide_quantiles(df, list(xs), ps).collect()}  # one row a feature
    return [np.unique([got[x][p] for p in ps if got[x][p] is not None]) if x in got else np.zeros(0) for x in xs]


def binned(df: DataFrame, xs: Sequence[str], cuts: Sequence[np.ndarray]) -> DataFrame:
    """Adds `bin` (one number a feature, its count of cut points below the value; 0 for null)."""
    one = lambda x, c: F.coalesce(F.size(F.filter(F.array(*[F.lit(float(v)) for v in c]), lambda v: v < F.col(x).cast("double"))), F.lit(0)) if len(c) else F.lit(0)
    return df.withColumn("bin", F.array(*[one(x, c) for x, c in zip(xs, cuts, strict=True)]))


def grow(bin_: np.ndarray, n: np.ndarray, rest: np.ndarray, depth: int, bins: int) -> tuple[Tree, np.ndarray]:
    """A tree of squared-loss gain on residual sums `rest` of rows that stand for `n` rows each, and each row's node.

    Gain is G^2/(n + L2) of both sides less that of the whole; the first best feature and cut win a tie.
    """
    tree = Tree()
    tree.leaf()
    node = np.zeros(len(n), np.int64)
    level = [0]
    for step in range(depth + 1):
        slot = np.full(len(tree.feature), -1)
        slot[level] = np.arange(len(level))
        inside = np.flatnonzero(slot[node] >= 0)
        s, w, g, width = slot[node[inside]], n[inside], rest[inside], len(level)
        whole_n, whole_g = np.bincount(s, w, width), np.bincount(s, g, width)
        for k, at in enumerate(level):
            tree.value[at] = float(whole_g[k] / (whole_n[k] + L2))
        if step == depth:
            break
        best, which, where = np.full(width, 1e-12), np.full(width, -1), np.zeros(width, np.int64)
        for f in range(bin_.shape[1]):
            code = s * bins + bin_[inside, f]
            ln, lg = (np.bincount(code, x, width * bins).reshape(width, bins).cumsum(1) for x in (w, g))
            rn, rg = whole_n[:, None] - ln, whole_g[:, None] - lg
            gain = lg**2 / (ln + L2) + rg**2 / (rn + L2) - (whole_g**2 / (whole_n + L2))[:, None]
            gain[(ln < LEAST) | (rn < LEAST)] = -1
            top = gain.argmax(1)
            value = gain[np.arange(width), top]
            better = value > best
            best[better], which[better], where[better] = value[better], f, top[better]
        level_next = []
        for k, at in enumerate(level):
            if which[k] >= 0:
                tree.feature[at], tree.last[at] = int(which[k]), int(where[k])
                tree.left[at] = tree.leaf()
                level_next += [tree.left[at], tree.leaf()]
        if not level_next:
            break
        go = inside[which[s] >= 0]
        t = slot[node[go]]
        node[go] = np.array(tree.left)[node[go]] + (bin_[go, which[t]] > where[t])
        level = level_next
    return tree, node


def boost(bin_: np.ndarray, n: np.ndarray, sums: np.ndarray, trees: int, depth: int, rate: float, bins: int) -> tuple[float, list[Tree], np.ndarray]:
    """(base, trees, final prediction of each row) of squared-loss boosting on binned rows."""
    base = float(sums.sum() / n.sum()) if n.sum() else 0.0
    grown, now = [], np.full(len(n), base)
    for _ in range(trees):
        tree, node = grow(bin_, n, sums - n * now, depth, bins)
        grown.append(tree)
        now = now + rate * np.array(tree.value)[node]
    return base, grown, now


def predict(tree: Tree, bin_: np.ndarray) -> np.ndarray:
    feature, last, left, value = (np.array(x) for x in (tree.feature, tree.last, tree.left, tree.value))
    node = np.zeros(len(bin_), np.int64)
    while True:
        f = feature[node]
        go = np.flatnonzero(f >= 0)
        if not len(go):
            return value[node]
        node[go] = left[node[go]] + (bin_[go, f[go]] > last[node[go]])


@dataclass
class Boosted:
    """A fitted model; `transform` adds `prediction` to rows with the features as `xs` columns or a `features` vector."""

    xs: Sequence[str]
    cuts: list[np.ndarray]
    base: float
    trees: list[Tree]
    rate: float

    def score(self, bin_: np.ndarray) -> np.ndarray:
        out = np.full(len(bin_), self.base)
        for t in self.trees:
            out = out + self.rate * predict(t, bin_)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        names = [f"_x{i}" for i in range(len(self.xs))]
        arr = vector_to_array("features") if "features" in df.columns else F.array(*[F.col(x).cast("double") for x in self.xs])
        split = df.withColumn("_a", arr).select("*", *[F.col("_a")[i].alias(n) for i, n in enumerate(names)]).drop("_a")
        ready = binned(split, names, self.cuts).drop(*names)
        keep = [c for c in ready.columns if c not in ("bin", "features")]
        model = self

        def run(batches):
            for batch in batches:
                bin_ = batch.column("bin").flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(model.score(bin_), pa.float64())], [*keep, "prediction"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields if f.name in keep)
        return ready.drop("features").mapInArrow(run, f"{kinds}, prediction double")


def compressed(df: DataFrame, xs: Sequence[str], y: str, cuts: Sequence[np.ndarray], by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin, n, s, q): count, sum and sum of squares of y of each bin vector, written once.  Rows without y do not count."""
    v = F.col(y).cast("double")
    return cut(binned(df.where(v.isNotNull()), xs, cuts).groupBy(*by, "bin").agg(F.count("*").cast("double").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")))


def fit(df: DataFrame, xs: Sequence[str], y: str, trees: int = 100, depth: int = 6, rate: float = 0.3, bins: int = 32) -> Boosted | None:
    """A model of all rows, or None where the compressed table is not small: its fit would not be one task's work."""
    cuts = edges(df, xs, bins)
    table = compressed(df, xs, y, cuts)
    if table.count() > SMALL:
        return None
    got = table.orderBy("bin").toArrow()
    bin_ = np.array(got.column("bin").to_pylist(), np.int64).reshape(-1, len(xs))
    base, grown, _ = boost(bin_, got.column("n").to_numpy(), got.column("s").to_numpy(), trees, depth, rate, bins)
    return Boosted(list(xs), cuts, base, grown, rate)


def cross_validated(df: DataFrame, xs: Sequence[str], y: str, draws: Sequence[Mapping[str, float]], fold: str, folds: int, bins: int = 32) -> list[float] | None:
    """Mean R2 over the folds of each draw (maxDepth, stepSize, maxIter), or None where the compressed table is not small.

    Draws that differ in the number of trees only are one run.  Every run of a fold is one task; the table reaches it by a join
    on nothing but the list of runs, whose size the caller's search sets.
    """
    cuts = edges(df, xs, bins)
    table = compressed(df, xs, y, cuts, [fold])
    if table.count() > SMALL:
        return None
    stops: dict[tuple[int, float], list[int]] = {}
    for d in draws:
        stops.setdefault((int(d["maxDepth"]), float(d["stepSize"])), []).append(int(d["maxIter"]))
    runs = [(i, depth, rate, sorted(set(at)), out) for i, ((depth, rate), at) in enumerate(stops.items()) for out in range(folds)]
    spark = df.sparkSession
    asked = spark.createDataFrame(runs, "run int, depth int, rate double, stops array<int>, held int")
    rows = table.withColumn("_all", F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in (("run", r[0]), ("held", r[4]))]) for r in runs]))).select("_all.run", "_all.held", F.col(fold).alias("fold"), "bin", "n", "s", "q")
    jobs = rows.join(F.broadcast(asked), ["run", "held"])  # one row a run

    def one(group: pa.Table) -> pa.Table:
        bin_ = np.array(group.column("bin").to_pylist(), np.int64).reshape(group.num_rows, -1)
        order = np.lexsort(bin_.T)
        fold_, n, s, q = (group.column(c).to_numpy()[order] for c in ("fold", "n", "s", "q"))
        bin_ = bin_[order]
        depth, rate, wanted, held = (group.column(c)[0].as_py() for c in ("depth", "rate", "stops", "held"))
        train, test = fold_ != held, fold_ == held
        base = float(s[train].sum() / max(n[train].sum(), 1.0))
        now, scores = np.full(len(n), base), []
        for t in range(1, max(wanted) + 1):
            tree, node = grow(bin_[train], n[train], (s - n * now)[train], depth, bins)
            now[train] += rate * np.array(tree.value)[node]
            now[test] += rate * predict(tree, bin_[test])
            if t in wanted:
                miss = (q - 2 * now * s + n * now * now)[test].sum()
                total = q[test].sum() - s[test].sum() ** 2 / max(n[test].sum(), 1.0)
                scores.append(float(1 - miss / total) if total > 0 else float("nan"))
        k = len(wanted)
        return pa.table({"run": pa.array([group.column("run")[0].as_py()] * k, pa.int32()), "trees": pa.array(wanted, pa.int32()), "r2": pa.array(scores, pa.float64())})

    found = jobs.groupBy("run", "held").applyInArrow(one, "run int, trees int, r2 double").groupBy("run", "trees").agg(F.avg("r2").alias("r2")).collect()
    number = {key: i for i, key in enumerate(stops)}
    r2 = {(r["run"], r["trees"]): r["r2"] for r in found}
    return [r2[number[int(d["maxDepth"]), float(d["stepSize"])], int(d["maxIter"])] for d in draws]
