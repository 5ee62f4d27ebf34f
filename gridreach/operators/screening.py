"""Feature screening and scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridreach.functions import scalars as s
from gridreach.operators import graph as gr
from gridreach.operators import ordered as o
from gridreach.session import cut


def null_classes(df: DataFrame, key: str, cols: Sequence[str]) -> list[list[str]]:
    """Columns by the rows in which they are null: one pass, a count and an order-free hash of those rows' keys for each column."""
    marks = [F.struct(F.count_if(F.col(c).isNull()).alias("n"), F.bit_xor(F.when(F.col(c).isNull(), F.xxhash64(key))).alias("h")).alias(c) for c in cols]
    found = df.agg(*marks).first()
    classes: dict[tuple, list[str]] = {}
    for c in cols:
        classes.setdefault(tuple(found[c]), []).append(c)
    return list(classes.values())


def _rank_pairs(df: DataFrame, key: str, cols: Sequence[str], wanted: Sequence[tuple[str, str]]) -> list[tuple]:
    """(a, b, n, rho) of the wanted pairs over rows without nulls: columns are ranked once and correlated by one Gram matrix."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation

    vectors = cut(o.wide_pct_ranks(df, key, cols, "avg").select(F.array(*cols).alias("r"))).select(array_to_vector("r").alias("v"))
    n = vectors.count()
    rho = Correlation.corr(vectors, "v").first()[0].toArray().tolist() if n > 1 else None
    at = {c: i for i, c in enumerate(cols)}
    value = lambda a, b: None if rho is None or rho[at[a]][at[b]] != rho[at[a]][at[b]] else rho[at[a]][at[b]]
    return [(a, b, n, value(a, b)) for a, b in wanted]


def spearman_matrix(df: DataFrame, key: str, cols: Sequence[str], min_n: int = 30) -> DataFrame:
    """(a, b, n, rho) for all column pairs, pairwise complete.

    A pair's complete rows follow from the rows in which either column is null.  Columns that are null in the same rows form a class,
    and for two classes all pairs share their rows: these rows are ranked once, wide, and correlated by one Gram matrix (columns
    x columns, added up inside the tasks).  No row is repeated for a pair, whatever the number of columns.
    """
    classes = null_classes(df, key, cols)
    place = {c: i for i, c in enumerate(cols)}
    rows: list[tuple] = []
    for i, x in enumerate(classes):
        for y in classes[i:]:
            pairs = [tuple(sorted((a, b), key=place.get)) for a in x for b in y if (place[a] < place[b] if x is y else True)]
            if pairs:
                both = df.where(F.col(x[0]).isNotNull() & F.col(y[0]).isNotNull())
                rows += _rank_pairs(both, key, x if x is y else [*x, *y], pairs)
    rows.sort(key=lambda r: (place[r[0]], place[r[1]]))
    return df.sparkSession.createDataFrame([r for r in rows if r[2] >= min_n], "a string, b string, n long, rho double")


def redundant_pairs(matrix: DataFrame, threshold: float = 0.9) -> DataFrame:
    return matrix.where(F.abs("rho") >= threshold)


def redundancy_groups(pairs: DataFrame, protected: Sequence[str], preferences: Sequence[str]) -> DataFrame:
    """Groups of features linked by redundant pairs, with one representative each.

    Preference list first, then names with density, ratio or calibrated, then the shortest name.
    """
    free = pairs.where(~F.col("a").isin(*protected) & ~F.col("b").isin(*protected)) if protected else pairs
    comp = gr.components(free.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    pref = F.lit(len(preferences))
    for i, p in reversed(list(enumerate(preferences))):
        pref = F.when(F.col("node") == p, i).otherwise(pref)
    n = F.col("node")
    plain = F.when(n.contains("density") | n.contains("ratio") | n.contains("calibrated"), 0).otherwise(1)
    g = comp.groupBy("component").agg(
        F.sort_array(F.collect_list("node")).alias("members"),  # bounded by the number of columns
        F.min_by("node", F.struct(pref.alias("p"), plain.alias("d"), F.length(n).alias("l"), n.alias("n"))).alias("representative"),
    )
    drop = F.filter("members", lambda m: m != F.col("representative"))
    return g.select(F.array_join("members", ",").alias("members"), F.size("members").alias("n_members"), "representative", F.array_join(drop, ",").alias("to_drop"))


def screen_pairs(matrix: DataFrame, order: Sequence[str], preferred: Sequence[tuple[str, str]], threshold: float = 0.85) -> dict[str, str]:
    """{dropped: kept}: the preferred-over list first, then the first listed of each remaining pair.

    Only pairs above the threshold come to the driver: at most one per column pair.
    """
    high = {(r.a, r.b) for r in matrix.where(F.abs("rho") > threshold).select("a", "b").collect()}
    linked = lambda x, y: (x, y) in high or (y, x) in high
    dropped: dict[str, str] = {}
    for keep, drop in preferred:
        if drop not in dropped and linked(keep, drop):
            dropped[drop] = keep
    left = [c for c in order if c not in dropped]
    for i, a in enumerate(left):
        for b in left[i + 1 :]:
            if b not in dropped and linked(a, b):
                dropped[b] = a
    return dropped


def log1p_if_improves(df: DataFrame, col: str, name: str) -> DataFrame:
    """log1p of a column when that lowers |skewness|, else the column; the choice is a scalar subquery."""
    logged = s.log1p_clip(F.col(col))
    out = o.with_global(df, _raw=F.skewness(col), _log=F.skewness(logged))
    return out.withColumn(name, F.when(F.abs("_log") < F.abs("_raw"), logged).otherwise(F.col(col))).drop("_raw", "_log")


def log1p_table(df: DataFrame, cols: Sequence[str], min_skew: float = 1.0) -> DataFrame:
    """Skewness before and after log1p for right-skewed, non-negative features."""
    long = o.unpivot(df, [], cols).where(F.col("value").isNotNull())
    t = long.groupBy("feature").agg(F.min("value").alias("_min"), F.skewness("value").alias("skew_raw"), F.skewness(s.log1p_clip(F.col("value"))).alias("skew_log1p"))
    t = t.where((F.col("_min") >= 0) & (F.col("skew_raw") > min_skew)).drop("_min")
    return t.withColumn("recommendation", F.when(F.abs("skew_log1p") < F.abs("skew_raw"), "log1p").otherwise("keep_raw"))


def robust_scale(df: DataFrame, cols: Sequence[str], prefix: str = "") -> DataFrame:
    """(x - median) / IQR with IQR 0 read as 1; replaces the columns unless a prefix is given."""
    specs = {}
    for c in cols:
        specs |= {f"_m_{c}": (c, 0.5), f"_a_{c}": (c, 0.25), f"_b_{c}": (c, 0.75)}
    q = df.withColumn("_q", o.scalar_row(o.one_row_quantiles(df, specs)))
    scaled = {}
    for c in cols:
        iqr = F.col("_q")[f"_b_{c}"] - F.col("_q")[f"_a_{c}"]
        scaled[prefix + c] = (F.col(c) - F.col("_q")[f"_m_{c}"]) / F.when(iqr == 0, 1.0).otherwise(iqr)
    return q.withColumns(scaled).drop("_q")


def winsorize(df: DataFrame, col: str, name: str, p: float = 0.99) -> DataFrame:
    return o.with_quantiles(df, _cap=(col, p)).withColumn(name, F.least(F.col(col), F.col("_cap"))).drop("_cap")


def quantile_uniform(df: DataFrame, col: str, name: str) -> DataFrame:
    """Rank-based uniform transform: tied values get their mid rank, the smallest value 0 and the largest 1."""
    lo, hi = F.col("rank_min") - 1, F.col("rank_min") + F.col("ties") - 2
    top = F.col("n") - 1
    u = F.when(lo == 0, 0.0).when(hi == top, 1.0).otherwise((lo + hi) / 2 / top)
    return o._join_ranks(df, col, (), u, name)


def _floored(df: DataFrame, col: str, active: Column, inactive: Sequence[tuple[Column, int]], name: str) -> DataFrame:
    """Robust-scaled log1p where `active`; other rows sit 1, 2, ... below the smallest scaled value."""
    d = df.withColumn("_x", F.when(active, s.log1p_clip(F.col(col))))
    d = o.with_quantiles(d, _m=("_x", 0.5), _a=("_x", 0.25), _b=("_x", 0.75))
    iqr = F.col("_b") - F.col("_a")
    d = d.withColumn("_z", (F.col("_x") - F.col("_m")) / F.when(iqr == 0, 1.0).otherwise(iqr))
    d = o.with_global(d, _low=F.min("_z"))
    out = F.when(active, F.col("_z"))
    for cond, step in inactive:
        out = out.when(cond, F.col("_low") - step)
    return d.withColumn(name, out).drop("_x", "_m", "_a", "_b", "_z", "_low")


def two_part(df: DataFrame, col: str) -> DataFrame:
    """has_{col} flag and {col}_intensity: scaled among positives, zeros one below the smallest."""
    pos = F.col(col) > 0
    return _floored(df, col, pos, [(~pos, 1)], f"{col}_intensity").withColumn(f"has_{col}", pos.cast("double"))


def three_state(df: DataFrame, col: str, evidence: Column) -> DataFrame:
    """{col}_state3: scaled where there is evidence and a positive value, evidence with zero 1 below, no evidence 2 below."""
    pos = evidence & (F.col(col) > 0)
    return _floored(df, col, pos, [(evidence & (F.col(col) == 0), 1), (~evidence, 2)], f"{col}_state3")


def mask_undefined(df: DataFrame, masks: Mapping[str, str]) -> DataFrame:
    """Null a value where its denominator count is 0."""
    return df.withColumns({v: F.when(F.col(n) != 0, F.col(v)) for v, n in masks.items()})


def scaling_risk(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per feature: zero mass, IQRs, largest robust-scaled magnitude, skewness and risk flags joined by '+'."""
    q = o.wide_quantiles(df, cols, {"median": 0.5, "q1": 0.25, "q3": 0.75})
    long = o.unpivot(df, [], cols).where(F.col("value").isNotNull())
    nz = o.quantiles(long.where(F.col("value") != 0), "value", [0.25, 0.75], ["feature"])
    nz = nz.groupBy("feature").agg((F.max("q") - F.min("q")).alias("nonzero_iqr"))
    v = F.col("value")
    a = long.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.count_if(v == 0) / F.count("*") * 100, 2).alias("pct_zero"), F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.skewness(v).alias("skew"))
    t = a.join(q, "feature").join(nz, "feature", "left").withColumn("iqr", F.col("q3") - F.col("q1"))
    # the largest |x - median| sits at one of the two ends
    far = F.greatest(F.col("_hi") - F.col("median"), F.col("median") - F.col("_lo"))
    t = t.withColumn("max_abs_scaled", F.when(F.col("iqr") > 0, far / F.col("iqr")))
    flags = {
        "LARGE_ZERO_MASS": F.col("pct_zero") >= 40,
        "TINY_NONZERO_IQR": (F.col("nonzero_iqr") > 0) & (F.col("iqr") > 0) & (F.col("nonzero_iqr") / F.nullif("iqr", F.lit(0.0)) < 0.05),
        "ZERO_IQR": F.col("iqr") == 0,
        "EXTREME_MAGNITUDE": F.col("max_abs_scaled") > 20,
        "HIGH_SKEW": F.abs("skew") > 3,
    }
    return t.withColumn("risk_flags", s.join_labels(flags, "NONE")).drop("_lo", "_hi", "q1", "q3")


def reduced_set(audit: DataFrame, groups: DataFrame, protected: Sequence[str], manual: Mapping[str, str]) -> DataFrame:
    """Keep-or-drop decision and reason per feature."""
    drops = groups.select(F.explode(F.split("to_drop", ",")).alias("feature")).where(F.col("feature") != "").distinct().withColumn("_dup", F.lit(True))
    a = audit.select("feature", "flag_near_constant").join(drops, "feature", "left")
    why = F.when(F.coalesce("_dup", F.lit(False)), "REDUNDANT")
    for f, reason in manual.items():
        why = why.when(F.col("feature") == f, reason)
    why = why.when(F.col("flag_near_constant"), "NEAR_CONSTANT")
    # a protected feature is never dropped as redundant, but may still be near constant
    safe = F.when(F.col("feature").isin(*protected), F.when(F.col("flag_near_constant"), "NEAR_CONSTANT")).otherwise(why)
    return a.withColumn("exclusion_reason", safe).select("feature", F.col("exclusion_reason").isNull().alias("included"), "exclusion_reason")


def pca_summary(df: DataFrame, cols: Sequence[str], target: float = 0.85) -> DataFrame:
    """Explained variance per component of the standardised matrix and how many reach the target share."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    m = VectorAssembler(inputCols=list(cols), outputCol="_raw").transform(df.select(*cols).dropna())
    m = StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True).fit(m).transform(m)
    ratio = PCA(k=len(cols), inputCol="_std", outputCol="_pc").fit(m).explainedVariance.toArray()
    rows, total = [], 0.0
    for i, v in enumerate(ratio):  # one number per column
        reached = total >= target
        total += float(v)
        rows.append((i + 1, float(v), total, not reached))
    return df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double, is_kept boolean")
