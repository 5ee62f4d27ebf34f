"""Demand models: trips per cell explained by place counts."""

from __future__ import annotations

import itertools
import random
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridreach.operators import boosting
from gridreach.operators import spatial as sp
from gridreach.session import cut, ensure_checkpoint_dir


def simple_fits(df: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    """Slope, intercept and R2 of y on each single feature, in one aggregate over the long form."""
    rows = F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).cast("double").alias("x")) for x in xs])
    long = df.select(F.col(y).cast("double").alias("y"), F.inline(rows))
    return long.groupBy("feature").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def assembled(df: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(xs), outputCol="features").transform(df).select("features", F.col(y).cast("double").alias("label"))


def linear_fit(df: DataFrame, xs: Sequence[str], y: str):
    """Least squares on several features (normal equations, no regularisation)."""
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(solver="normal").fit(assembled(df, xs, y))


def linear_table(df: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    m = linear_fit(df, xs, y)
    rows = [(n, float(v)) for n, v in zip([*xs, "intercept", "r2"], [*m.coefficients, m.intercept, m.summary.r2])]
    return df.sparkSession.createDataFrame(rows, "term string, value double")


def gbt_fit(df: DataFrame, xs: Sequence[str], y: str, seed: int = 42, **params):
    """Boosted trees (maxIter, maxDepth, stepSize as in Spark ML); over the table of binned rows where that is small, else Spark ML's."""
    from pyspark.ml.regression import GBTRegressor

    model = boosting.fit(df, xs, y, params.get("maxIter", 20), params.get("maxDepth", 5), params.get("stepSize", 0.1))
    if model is not None:
        return model
    ensure_checkpoint_dir(df.sparkSession)  # else the lineage grows with every tree
    return GBTRegressor(seed=seed, **params).fit(assembled(df, xs, y))


def split(df: DataFrame, draw: Column, fractions: Mapping[str, float]) -> DataFrame:
    """Adds `part` from a draw in [0, 1): the same row always lands in the same part."""
    out, edge = F.lit(list(fractions)[-1]), 1.0
    for name, share in reversed(list(fractions.items())):
        edge -= share
        if edge > 1e-9:
            out = F.when(draw < round(edge, 9), F.lit(_before(fractions, name))).otherwise(out)
    return df.withColumn("part", out)


def _before(fractions: Mapping[str, float], name: str) -> str:
    names = list(fractions)
    return names[names.index(name) - 1]


def hash_draw(key: Column, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000


def random_search(df: DataFrame, xs: Sequence[str], y: str, grid: Mapping[str, Sequence], n: int = 5, folds: int = 3, seed: int = 42) -> DataFrame:
    """Cross-validated R2 of n random parameter sets of the boosted trees; a row's fold is a hash of the row."""
    names = sorted(grid)
    every = [dict(zip(names, values, strict=True)) for values in itertools.product(*[list(grid[k]) for k in names])]
    picked = random.Random(seed).sample(every, min(n, len(every)))
    data = cut(df.select(*xs, y, F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(folds)).cast("int").alias("_fold")))
    scores = boosting.cross_validated(data, xs, y, [{"maxIter": 20, "maxDepth": 5, "stepSize": 0.1} | d for d in picked], "_fold", folds)
    if scores is None:
        scores = _spark_search(data, xs, y, picked, folds, seed)
    rows = [(",".join(f"{k}={d[k]}" for k in names), r) for d, r in zip(picked, scores, strict=True)]
    return df.sparkSession.createDataFrame(rows, "params string, mean_r2 double")


def _spark_search(data: DataFrame, xs: Sequence[str], y: str, picked: Sequence[Mapping], folds: int, seed: int) -> list[float]:
    """The same over Spark ML's trees, for data whose binned rows are many; fits of several draws run side by side."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import GBTRegressor
    from pyspark.ml.tuning import CrossValidator

    ensure_checkpoint_dir(data.sparkSession)
    est = GBTRegressor(seed=seed)
    maps = [{getattr(est, k): v for k, v in d.items()} for d in picked]
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=RegressionEvaluator(metricName="r2"), numFolds=folds, foldCol="_fold", parallelism=4)
    return [float(r) for r in cv.fit(assembled_with(data, xs, y, "_fold")).avgMetrics]


def r2_table(models: Mapping[str, object], df: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    """R2 of each fitted model on each `part` of df."""
    base = None
    for name, m in models.items():
        p = m.transform(assembled_with(df, xs, y, "part")).select("part", "label", "prediction", F.lit(name).alias("model"))
        base = p if base is None else base.unionByName(p)
    err = F.sum((F.col("label") - F.col("prediction")) ** 2)
    tot = F.var_pop("label") * F.count("label")
    return base.groupBy("model", "part").agg((1 - F.try_divide(err, tot)).alias("r2"), F.count("*").alias("n"))


def assembled_with(df: DataFrame, xs: Sequence[str], y: str, *keep: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(xs), outputCol="features").transform(df).select("features", F.col(y).cast("double").alias("label"), *keep)


def neighbour_features(df: DataFrame, key: str, k: int, cols: Sequence[str], start: float = 500.0) -> DataFrame:
    """Mean of each column over the k nearest other rows, as {col}_nb: a spatial lag in place of message passing."""
    near = sp.nearest(df, key, df, key, k=k, start=start, exclude_self=True).select(key, f"near_{key}")
    vals = df.select(F.col(key).alias(f"near_{key}"), *cols)
    return near.join(vals, f"near_{key}").groupBy(key).agg(*[F.avg(c).alias(f"{c}_nb") for c in cols])
