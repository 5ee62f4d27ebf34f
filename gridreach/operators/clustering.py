"""Clustering of the cell matrix and comparison of labelings.

Fits are Spark ML estimators.  Diagnostics are aggregates; only contingency
tables (labels x labels) and centroids (labels x features) reach the driver or
a scalar subquery, and both are bounded by the plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridreach.operators import lloyd
from gridreach.operators import ordered as o
from gridreach.operators import summary as sm
from gridreach.session import cut, shuffle_width


def matrix(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(key, vec array<double>, features vector), materialised once for repeated fits, in as many files as a shuffle has tasks, so no scan is one task's."""
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    return cut(df.select(key, vec.alias("vec")).repartition(shuffle_width(df.sparkSession), key)).withColumn("features", array_to_vector("vec"))


def kmeans_best(m: DataFrame, k: int, seed: int, n_init: int = 10):
    """The fit with the lowest cost among n_init starts."""
    from pyspark.ml.clustering import KMeans

    fits = [KMeans(k=k, seed=seed * 1000 + i, maxIter=100).fit(m) for i in range(n_init)]
    return min(fits, key=lambda f: f.summary.trainingCost)


def kmeans_labels(m: DataFrame, key: str, k: int, seed: int, n_init: int = 10) -> DataFrame:
    return kmeans_best(m, k, seed, n_init).transform(m).select(key, F.col("prediction").alias("label"))


def kmeans_sweep(m: DataFrame, key: str, ks: Sequence[int], seeds: Sequence[int], n_init: int = 10) -> DataFrame:
    """One row per k: quality of the first seed's labels and agreement between seeds; each seed's labels are its best start's.

    All fits run together, one scan for each step; see `lloyd`.  An empty table gives an empty result.
    """
    sets = lloyd.plus_plus(m, key, [(k, seed, i) for k in ks for seed in seeds for i in range(n_init)])
    lloyd.fit(m, key, sets)
    best = {(k, seed): min((s for s in sets if (s.k, s.seed) == (k, seed)), key=lambda s: (s.cost, s.start), default=None) for k in ks for seed in seeds}
    by_k = {k: [best[k, seed] for seed in seeds] for k in ks} if sets else {}
    names = ["silhouette", "calinski_harabasz", "davies_bouldin", "min_pct", "max_pct", "size_ratio", "mean_seed_ari", "min_seed_ari"]
    rows = [(r["k"], *[r[n] for n in names]) for r in (lloyd.diagnostics(m, key, by_k) if by_k else [])]
    return m.sparkSession.createDataFrame(rows, "k int, " + ", ".join(f"{n} double" for n in names))


def gmm_fit(m: DataFrame, key: str, k: int, seed: int, dims: int):
    """(labels, bic) of a full-covariance Gaussian mixture."""
    import math

    from pyspark.ml.clustering import GaussianMixture

    fit = GaussianMixture(k=k, seed=seed).fit(m)
    free = k * (dims + dims * (dims + 1) / 2) + k - 1
    bic = free * math.log(m.count()) - 2 * fit.summary.logLikelihood
    return fit.transform(m).select(key, F.col("prediction").alias("label")), bic


def bisecting_labels(m: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """Divisive hierarchy: splits the least compact part until k remain."""
    from pyspark.ml.clustering import BisectingKMeans

    return BisectingKMeans(k=k, seed=seed).fit(m).transform(m).select(key, F.col("prediction").alias("label"))


def silhouette(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Rows and mean silhouette by squared Euclidean distance, over all rows.

    Squared distances to a cluster follow from its size, sum and sum of squares, so the score is linear in the rows; the
    cluster figures are one row for each label.  A row alone in its cluster scores 0.
    """
    from pyspark.ml.evaluation import ClusteringEvaluator

    codes = df.groupBy(label).count().select(label, (F.row_number().over(Window.orderBy(label)) - 1).cast("double").alias("prediction"))  # one row a label
    m = df.join(codes, label).select(array_to_vector(vec).alias("features") if df.schema[vec].dataType.typeName() == "array" else F.col(vec).alias("features"), "prediction")
    value = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(m)
    return df.agg(F.count("*").alias("n")).withColumn("silhouette", F.lit(float(value)))


def _centroids(df: DataFrame, vec: str, label: str) -> DataFrame:
    """(label, n, centre array) from one long aggregate."""
    long = df.select(label, F.posexplode(vec).alias("i", "x"))
    per = long.groupBy(label, "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return per.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e.m).alias("centre"))


def _dist2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def ch_db(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin; centroids travel as one scalar map."""
    c = cut(_centroids(df, vec, label))
    table = c.agg(F.map_from_entries(F.collect_list(F.struct(label, "centre"))).alias("m"))
    d = df.withColumn("_c", F.element_at(table.scalar(), F.col(label)))
    d2 = _dist2(F.col(vec), F.col("_c"))
    within = d.groupBy(label).agg(F.sum(d2).alias("ss"), F.avg(F.sqrt(d2)).alias("spread"))
    k = c.join(within, label).select(F.struct("centre", "n", "ss", "spread").alias("e"))
    every = k.agg(F.collect_list("e").alias("g"))
    dims = F.size(F.col("g")[0]["centre"])
    n = F.aggregate("g", F.lit(0).cast("long"), lambda a, e: a + e.n)
    mean = F.transform(F.sequence(F.lit(0), dims - 1), lambda i: F.aggregate("g", F.lit(0.0), lambda a, e: a + e.n * F.get(e.centre, i)) / n)
    e2 = every.withColumn("mean", mean).withColumn("n", n).withColumn("k", F.size("g"))
    between = F.aggregate("g", F.lit(0.0), lambda a, e: a + e.n * _dist2(e.centre, F.col("mean")))
    inner = F.aggregate("g", F.lit(0.0), lambda a, e: a + e.ss)
    worst = F.transform("g", lambda e: F.array_max(F.transform(F.filter("g", lambda f: f != e), lambda f: (e.spread + f.spread) / F.sqrt(_dist2(e.centre, f.centre)))))
    db = F.aggregate(worst, F.lit(0.0), lambda a, v: a + v) / F.col("k")
    return e2.select("k", "n", ((between / (F.col("k") - 1)) / (inner / (F.col("n") - F.col("k")))).alias("calinski_harabasz"), db.alias("davies_bouldin"))


def size_balance(df: DataFrame, label: str) -> DataFrame:
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    pct = lambda x: F.round(x / F.sum("n") * 100, 2)
    return c.agg(F.count("*").alias("k"), pct(F.min("n")).alias("min_pct"), pct(F.max("n")).alias("max_pct"), F.round(F.max("n") / F.min("n"), 2).alias("size_ratio"))


def ari_nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information from the contingency table."""
    t = df.groupBy(a, b).agg(F.count("*").alias("n"))
    ra, rb = t.groupBy(a).agg(F.sum("n").alias("na")), t.groupBy(b).agg(F.sum("n").alias("nb"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    plogp = lambda c: F.sum(F.col(c) * F.ln(c))
    st = t.agg(pairs("n").alias("i"), F.sum("n").alias("n"), plogp("n").alias("l"))
    sa, sb = ra.agg(pairs("na").alias("p"), plogp("na").alias("l")), rb.agg(pairs("nb").alias("p"), plogp("nb").alias("l"))
    x = st.withColumn("_a", o.scalar_row(sa)).withColumn("_b", o.scalar_row(sb))
    n, pa, pb = F.col("n"), F.col("_a.p"), F.col("_b.p")
    expected = pa * pb / (n * (n - 1) / 2.0)
    ari = F.when((pa + pb) / 2 == expected, 1.0).otherwise((F.col("i") - expected) / ((pa + pb) / 2 - expected))
    ha, hb = F.ln(n) - F.col("_a.l") / n, F.ln(n) - F.col("_b.l") / n
    mi = F.ln(n) + (F.col("l") - F.col("_a.l") - F.col("_b.l")) / n
    return x.select(ari.alias("ari"), F.when(ha + hb == 0, 1.0).otherwise(2 * mi / (ha + hb)).alias("nmi"))


#: Labels of one side that an assignment takes: its table has that many squared numbers on the driver.
LABELS = 2000


def assignment(gain: Sequence[Sequence[float]]) -> list[int]:
    """Column of each row so that every column is used once at most and the total gain is largest; -1 for rows left over.

    Shortest augmenting paths with potentials, one row after the other: the work grows with rows^2 x columns.
    """
    g = np.asarray(gain, float)
    if g.size == 0:
        return [-1] * len(g)
    if g.shape[0] > g.shape[1]:
        of_column = assignment(g.T)
        out = [-1] * len(g)
        for c, r in enumerate(of_column):
            out[r] = c
        return out
    rows, cols = g.shape
    cost = g.max() - g
    u, v = np.zeros(rows), np.zeros(cols)
    row_of = np.full(cols, -1)
    for first in range(rows):
        dist, via, done = np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols, bool)
        r, base, last = first, 0.0, -1
        while True:
            reach = base + cost[r] - u[r] - v
            closer = ~done & (reach < dist)
            dist[closer], via[closer] = reach[closer], last
            last = int(np.where(done, np.inf, dist).argmin())
            base, done[last] = dist[last], True
            if row_of[last] < 0:
                break
            r = int(row_of[last])
        u[first] += base
        for c in np.flatnonzero(done):
            if c != last:
                u[row_of[c]] += base - dist[c]
                v[c] -= base - dist[c]
        while last >= 0:
            before = int(via[last])
            row_of[last] = row_of[before] if before >= 0 else first
            last = before
    out = [-1] * rows
    for c, r in enumerate(row_of):
        if r >= 0:
            out[r] = c
    return out


def best_match(df: DataFrame, a: str, b: str) -> DataFrame:
    """(b, a, overlap, pct_retained): the assignment of b labels to a labels with the largest total overlap.

    pct_retained is the share of all rows whose b label maps to their a label.  Only the contingency table comes to the driver;
    more than LABELS labels on one side are an error.  Labels without a partner are left out.
    """
    few = df.agg(F.count_distinct(a).alias("a"), F.count_distinct(b).alias("b")).first()
    if max(few["a"], few["b"]) > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    t = {(r[1], r[0]): r[2] for r in df.groupBy(a, b).count().where(F.col(a).isNotNull() & F.col(b).isNotNull()).collect()}
    bs, as_ = sorted({k[0] for k in t}), sorted({k[1] for k in t})
    at = assignment([[t.get((vb, va), 0) for va in as_] for vb in bs])
    picks = [(vb, as_[c], t.get((vb, as_[c]), 0)) for vb, c in zip(bs, at, strict=True) if c >= 0]
    kept, every = sum(x[2] for x in picks), sum(t.values())
    rows = [(int(vb), int(va), int(n), round(100 * kept / every, 2)) for vb, va, n in picks]
    return df.sparkSession.createDataFrame(rows, f"{b} long, {a} long, overlap long, pct_retained double")


def split_transitions(df: DataFrame, parent: str, child: str) -> DataFrame:
    """How each parent label spreads over child labels when k grows by one."""
    t = df.groupBy(parent, child).agg(F.count("*").alias("n"))
    g = t.groupBy(parent).agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), child))).alias("d"))
    s1 = -F.col("d")[0]["neg"] / F.col("size")
    s2 = F.coalesce(-F.get("d", F.lit(1))["neg"] / F.col("size"), F.lit(0.0))
    kind = F.when(s1 >= 0.9, "COHERENT_CARRYOVER").when((s1 + s2 >= 0.9) & (s2 >= 0.15), "CLEAN_SPLIT").otherwise("DISPERSED")
    g = o.with_global(g, _all=F.sum("size"))
    return g.select(
        parent, "size", F.col("d")[0][child].alias("first_child"), F.round(s1, 4).alias("first_share"), F.get("d", F.lit(1))[child].alias("second_child"),
        F.round(s2, 4).alias("second_share"), kind.alias("kind"), (F.col("size") / F.col("_all") < 0.03).alias("is_tiny"),
    )


def percentile_gap(df: DataFrame, cols: Sequence[str], label: str, ids: Sequence, min_gap: float = 15.0) -> DataFrame:
    """Per feature: spread of the listed labels' median percentiles; only gaps of at least min_gap are marked."""
    p = sm.percentile_profile(df, cols, label).where(F.col(label).isin(*ids))
    g = p.groupBy("feature").agg(F.round(F.max(F.round("percentile", 1)) - F.min(F.round("percentile", 1)), 1).alias("percentile_gap"))
    return g.withColumn("is_meaningful", F.col("percentile_gap") >= min_gap)


def ablation(df: DataFrame, key: str, cols: Sequence[str], groups: Mapping[str, Sequence[str]], k: int, seed: int = 42, n_init: int = 10) -> DataFrame:
    """Refit without each feature group and compare with the full fit.

    top2_min and top2_mean: share of a baseline cluster's cells that its two largest new clusters hold, least and mean over
    the baseline clusters; low values mean that the cluster is scattered.
    """
    base = cut(kmeans_labels(matrix(df, key, cols), key, k, seed, n_init)).withColumnRenamed("label", "a")
    rows = []
    for name, drop in groups.items():
        kept = [c for c in cols if c not in drop]
        lab = kmeans_labels(matrix(df, key, kept), key, k, seed, n_init).withColumnRenamed("label", "b")
        both = cut(base.join(lab, key))
        r = ari_nmi(both, "a", "b").first()
        top2 = split_transitions(both, "a", "b").select((F.col("first_share") + F.col("second_share")).alias("s")).agg(F.round(F.min("s"), 4).alias("lo"), F.round(F.avg("s"), 4).alias("mean")).first()
        rows.append((name, len(drop), len(kept), float(r["ari"]), float(r["nmi"]), top2["lo"], top2["mean"]))
    return df.sparkSession.createDataFrame(rows, "ablation string, n_dropped int, n_kept int, ari double, nmi double, top2_min double, top2_mean double")


def select_best(diag: DataFrame, max_share: float = 0.8, tolerance: float = 0.15) -> DataFrame:
    """Best silhouette; if its largest cluster is too big, the best Calinski-Harabasz with k >= 3 near that silhouette.

    diag: representation, algorithm, k, silhouette, calinski_harabasz, largest_share.
    """
    valid = diag.where(F.col("silhouette").isNotNull())
    ties = ["representation", "algorithm", "k"]
    top = valid.orderBy(F.desc("silhouette"), *ties).limit(1)
    v = valid.withColumn("_t", o.scalar_row(top))
    degenerate = F.col("_t.largest_share") > max_share
    ok = degenerate & (F.col("k") >= 3) & (F.col("silhouette") >= F.col("_t.silhouette") - tolerance)
    first = (F.col("silhouette") == F.col("_t.silhouette")) & (F.col("k") == F.col("_t.k")) & (F.col("algorithm") == F.col("_t.algorithm")) & (F.col("representation") == F.col("_t.representation"))
    v = v.withColumn("_rank", F.when(ok, 0).when(first, 1)).where(F.col("_rank").isNotNull())
    best = v.orderBy("_rank", F.when(F.col("_rank") == 0, -F.col("calinski_harabasz")).otherwise(0.0), *ties).limit(1)
    via = F.when(F.col("_rank") == 0, "secondary_calinski_harabasz").otherwise("primary_silhouette")
    return best.select(*diag.columns, via.alias("chosen_via"))


def label_change(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    c = F.count_if(F.col(a) != F.col(b))
    return df.groupBy(by).agg(F.count("*").alias("n_cells"), c.alias("n_changed"), F.round(c / F.count("*") * 100, 2).alias("pct_changed"))


def change_by_context(df: DataFrame, a: str, b: str) -> DataFrame:
    """Change share in the core, intermediate and peripheral third by distance to the mean cell position."""
    d = o.with_global(df, _cx=F.avg("ix"), _cy=F.avg("iy"))
    d = d.withColumn("_d", F.sqrt((F.col("ix") - F.col("_cx")) ** 2 + (F.col("iy") - F.col("_cy")) ** 2))
    d = o.quantile_bands(d, "_d", ["core", "intermediate", "peripheral"], "context")
    return label_change(d, a, b, "context")


def top_transitions(df: DataFrame, a: str, b: str, k: int = 20) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n_cells")).orderBy(F.desc("n_cells"), a, b).limit(k)


def changed_vs_stable(df: DataFrame, a: str, b: str, cols: Sequence[str], min_n: int = 20) -> DataFrame:
    """Medians of changed and stable cells per label of a, where both groups have min_n cells."""
    d = df.withColumn("is_changed", F.col(a) != F.col(b))
    n = d.groupBy(a).agg(F.count_if("is_changed").alias("n_changed"), F.count_if(~F.col("is_changed")).alias("n_stable"))
    n = n.where((F.col("n_changed") >= min_n) & (F.col("n_stable") >= min_n))
    m = o.wide_quantiles(d, cols, {"median": 0.5}, [a, "is_changed"])
    p = m.groupBy(a, "feature").agg(F.max(F.when(F.col("is_changed"), F.col("median"))).alias("median_changed"), F.max(F.when(~F.col("is_changed"), F.col("median"))).alias("median_stable"))
    return p.join(n, a)
