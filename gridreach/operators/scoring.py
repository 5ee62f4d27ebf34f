"""Multi-criteria scores, sensitivity variants and consensus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridreach.functions import scalars as s
from gridreach.operators import ordered as o
from gridreach.operators import draws as random_draws
from gridreach.operators import relational as rel
from gridreach.operators import summary as sm
from gridreach.session import cut

# Weighting scenarios over (demand, urban form, transit, cycling, terrain).
SCENARIOS = {
    "balanced_equal_dimensions": {"demand": 0.20, "urban_form": 0.20, "transit": 0.20, "cycling": 0.20, "terrain": 0.20},
    "demand_oriented": {"demand": 0.40, "urban_form": 0.15, "transit": 0.15, "cycling": 0.15, "terrain": 0.15},
    "infrastructure_readiness_oriented": {"demand": 0.15, "urban_form": 0.15, "transit": 0.15, "cycling": 0.40, "terrain": 0.15},
    "first_last_mile_transit_integration_oriented": {"demand": 0.15, "urban_form": 0.10, "transit": 0.45, "cycling": 0.15, "terrain": 0.15},
}
# Perturbed weights of the five-dimension model.
PERTURBED = {"demand": 0.16, "transit": 0.20, "cycling": 0.24, "street": 0.24, "terrain": 0.16}

# value functions of a percentile rank; "raw" criteria are columns already in [0, 1]
VALUE_FUNCTIONS = {"benefit": s.benefit, "cost": s.cost, "linear": lambda r: r, "target": lambda r: s.target_range(r, 0.3, 0.7, 0.4), "inverted": lambda r: s.inverted_u(r, 0.4, 0.5, 0.1)}


def dimension_scores(df: DataFrame, key: str, spec: Mapping[str, Sequence[tuple[str, str]]], keep: Sequence[str] = ()) -> DataFrame:
    """Row mean of value functions per dimension; spec = {dimension: [(column, value function or 'raw')]}.

    All ranked columns share one prefix-sum pass.
    """
    ranked = sorted({c for parts in spec.values() for c, f in parts if f != "raw"})
    r = o.wide_pct_ranks(df, key, ranked).select(key, *[F.col(c).alias(f"_r_{c}") for c in ranked])
    j = df.join(r, key)
    value = lambda c, f: F.col(c) if f == "raw" else VALUE_FUNCTIONS[f](F.col(f"_r_{c}"))
    return j.select(key, *keep, *[s.row_mean([value(c, f) for c, f in parts]).alias(d) for d, parts in spec.items()])


def readiness(weights: Mapping[str, float], columns: Mapping[str, str] | None = None) -> Column:
    """Weighted mean of all dimensions but demand, weights rescaled to sum to 1."""
    dims = {d: w for d, w in weights.items() if d != "demand"}
    total = sum(dims.values())
    return sum((F.col((columns or {}).get(d, d)) * (w / total) for d, w in dims.items()), F.lit(0.0))


def opportunity(demand: Column, gap: Column, weights: Mapping[str, float]) -> Column:
    """demand^a * gap^(1-a); zero demand or zero gap forces zero."""
    a = weights["demand"] / (weights["demand"] + weights["cycling"])
    return F.pow(demand, F.lit(a)) * F.pow(gap, F.lit(1 - a))


def scenario_scores(dims: DataFrame, key: str, scenarios: Mapping[str, Mapping[str, float]], variants: Mapping[str, Mapping[str, str]], gap: str) -> DataFrame:
    """Long table (key, scenario, variant, readiness, opportunity), all built inside the row."""
    rows = [
        F.struct(F.lit(sc).alias("scenario"), F.lit(v).alias("variant"), readiness(w, cols).alias("readiness"), opportunity(F.col(cols.get("demand", "demand")), F.col(gap), w).alias("opportunity"))
        for sc, w in scenarios.items()
        for v, cols in variants.items()
    ]
    return dims.select(key, F.inline(F.array(*rows)))


def sensitivity_variants(dims: DataFrame, key: str, base: Mapping[str, float], variants: Mapping[str, tuple[Mapping[str, float], Mapping[str, str]]], gap: str) -> DataFrame:
    """Wide readiness__NAME and opportunity__NAME columns for named variants of weights and columns."""
    out = []
    for name, (weights, cols) in {"BASELINE": (base, {}), **variants}.items():
        out.append(readiness(weights, cols).alias(f"readiness__{name}"))
        out.append(opportunity(F.col("demand"), F.col(cols.get("gap", gap)), weights).alias(f"opportunity__{name}"))
    return dims.select(key, *out)


def pair_metrics(scores: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Per column pair: Spearman, top-decile Jaccard, mean absolute difference, rank displacement, entries, exits.

    One rank pass for all columns, pairs formed in the row, one aggregate.  The scores are written once: scores that come out of
    joins would otherwise be made again for ranks, limits and rows, and the last two inside one task.
    """
    scores = cut(scores.select(key, *cols))
    ranks = o.wide_pct_ranks(scores, key, cols, "avg").select(key, *[F.col(c).alias(f"_r_{c}") for c in cols])
    flagged = o.top_decile_flags(scores.select(key, *cols), cols, prefix="_t_")
    j = flagged.join(ranks, key)
    entries = [
        F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"), F.col(f"_r_{a}").alias("rx"), F.col(f"_r_{b}").alias("ry"),
            F.col(f"_t_{a}").alias("tx"), F.col(f"_t_{b}").alias("ty"),
        )
        for i, a in enumerate(cols)
        for b in cols[i + 1 :]
    ]
    both, either = F.count_if(F.col("tx") & F.col("ty")), F.count_if(F.col("tx") | F.col("ty"))
    return j.select(F.inline(F.array(*entries))).groupBy("a", "b").agg(
        F.round(F.corr("rx", "ry"), 4).alias("spearman"), F.round(F.coalesce(F.try_divide(both, either), F.lit(0.0)), 4).alias("jaccard"),
        F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 4).alias("mean_abs_diff"), F.round(F.avg(F.abs(F.col("rx") - F.col("ry"))), 4).alias("rank_displacement"),
        F.count_if(F.col("ty") & ~F.col("tx")).alias("entries"), F.count_if(F.col("tx") & ~F.col("ty")).alias("exits"),
    )


def vs_baseline(scores: DataFrame, key: str, base: str, others: Sequence[str]) -> DataFrame:
    p = pair_metrics(scores, key, [base, *others]).where(F.col("a") == base)
    return p.select(F.col("b").alias("variant"), "spearman", "jaccard", "mean_abs_diff")


def with_differing_factors(pairs: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Adds which factors of names like 'a__b__c' differ between the two variants of a pair."""
    a, b = F.split("a", "__"), F.split("b", "__")
    diff = F.array_compact(F.array(*[F.when(a[i] != b[i], F.lit(f)) for i, f in enumerate(factors)]))
    d = F.array_sort(diff)
    return pairs.select("*", F.array_join(d, ",").alias("differing_factors"), F.size(d).alias("n_differing"))


def isolated_factor_effect(pairs: DataFrame) -> DataFrame:
    one = pairs.where(F.col("n_differing") == 1)
    mean = lambda c: F.round(F.avg(c) + 1e-12, 4).alias(f"mean_{c}")  # noqa: E731  (a hair of slack: means of rounded values meet ties)
    return one.groupBy(F.col("differing_factors").alias("factor")).agg(F.count("*").alias("n_pairs"), mean("spearman"), mean("jaccard"), mean("mean_abs_diff"), mean("rank_displacement"))


def _moments(arr: Column, n: int) -> tuple[Column, Column]:
    mean = F.aggregate(arr, F.lit(0.0), lambda a, v: a + v) / n
    var = F.aggregate(F.transform(arr, lambda v: v * v), F.lit(0.0), lambda a, v: a + v) / n - mean * mean
    return mean, F.sqrt(F.greatest(var, F.lit(0.0)))


def cell_stability(scores: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Per cell over all variants: mean, median, range, population deviation, rank moments, top-decile share.

    The scores are written once, as in `pair_metrics`.
    """
    scores = cut(scores.select(key, *cols))
    ranks = o.wide_pct_ranks(scores, key, cols, "avg").select(key, *[F.col(c).alias(f"_r_{c}") for c in cols])
    j = o.top_decile_flags(scores.select(key, *cols), cols, prefix="_t_").join(ranks, key)
    k = len(cols)
    vals, rk = F.array(*cols), F.array(*[f"_r_{c}" for c in cols])
    srt = F.array_sort(vals)
    median = (srt[(k - 1) // 2] + srt[k // 2]) / 2
    mean, std = _moments(vals, k)
    rmean, rstd = _moments(rk, k)
    tops = s.count_true([F.col(f"_t_{c}") for c in cols])
    return j.select(
        key, mean.alias("mean_score"), median.alias("median_score"), F.array_min(vals).alias("min_score"), F.array_max(vals).alias("max_score"), std.alias("std_score"),
        (F.array_max(vals) - F.array_min(vals)).alias("range_score"), rmean.alias("mean_rank"), rstd.alias("std_rank"), tops.alias("n_top"), (tops / k * 100).alias("pct_top"),
    )


def joint_class(r: Column, op: Column) -> Column:
    simple = lambda c: F.when(c.isin("ROBUST_HIGH", "FREQUENT_HIGH"), "HIGH").when(c == "CONDITIONAL_HIGH", "MODERATE_SENSITIVE").otherwise("LOW")
    return F.concat(simple(r), F.lit("_readiness__"), simple(op), F.lit("_opportunity"))


def dominant_driver(scores: DataFrame, key: str, cols: Mapping[str, Mapping[str, str]], factors: Sequence[str], tol: float = 1e-6) -> DataFrame:
    """Factor with the largest eta squared per cell; NO_DISAGREEMENT when all variants agree.

    cols = {column: {factor: level}}.  Everything happens inside the row.
    """
    names = list(cols)
    n = len(names)
    grand = sum((F.col(c) for c in names), F.lit(0.0)) / n
    total = sum(((F.col(c) - F.col("_g")) ** 2 for c in names), F.lit(0.0))
    d = scores.withColumn("_g", grand).withColumn("_t", total)
    etas = {}
    for f in factors:
        between = F.lit(0.0)
        for level in sorted({cols[c][f] for c in names}):
            group = [c for c in names if cols[c][f] == level]
            m = sum((F.col(c) for c in group), F.lit(0.0)) / len(group)
            between = between + len(group) * (m - F.col("_g")) ** 2
        etas[f] = F.when(F.col("_t") > 1e-12, between / F.col("_t")).otherwise(0.0)
    spread = F.greatest(*names) - F.least(*names)
    d = d.withColumns({f"eta_{f}": e for f, e in etas.items()})
    # eta is rounded before the comparison so that equal factors tie in listed order
    driver = s.argmax_name({f: F.round(F.col(f"eta_{f}"), 9) for f in factors})
    return d.select(key, *[f"eta_{f}" for f in factors], F.when(spread < tol, "NO_DISAGREEMENT").otherwise(driver).alias("driver"))


def monte_carlo(dims: DataFrame, key: str, cols: Sequence[str], draws: int = 1000, seed: int = 42, q: float = 0.9) -> DataFrame:
    """Mean, deviation, variation and top-decile share of the score under random Dirichlet weights.

    Draws stay arrays inside a row; see `draws`.  A row with a null dimension has null results and does not count for the limits.
    """
    return random_draws.scored(dims, key, cols, draws, seed, q, cut)


def latent_opportunity(others: Sequence[str], infra: str) -> Column:
    return s.row_mean([F.col(c) for c in others]) - F.col(infra)


def pathological_cases(df: DataFrame, cases: Mapping[str, Column], scores: Sequence[str]) -> DataFrame:
    """Count and mean / max score per named predicate; rows may fall into several cases."""
    hit = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in cases.items()]))
    aggs = [F.count("*").alias("n_cells")]
    for c in scores:
        aggs += [F.round(F.avg(c), 4).alias(f"mean_{c}"), F.round(F.max(c), 4).alias(f"max_{c}")]
    return df.withColumn("case", F.explode(hit)).groupBy("case").agg(*aggs)


def critical_check(df: DataFrame, remote: Column, score: str) -> DataFrame:
    """Remote cells must hold no top-decile place and fewer than 25 % top-quartile places."""
    d = o.with_quantiles(df, _d=(score, 0.9), _q=(score, 0.75)).where(remote)
    a = d.agg(F.count("*").alias("n"), F.round(F.count_if(F.col(score) >= F.col("_d")) / F.count("*") * 100, 4).alias("pct_top_decile"), F.round(F.count_if(F.col(score) >= F.col("_q")) / F.count("*") * 100, 4).alias("pct_top_quartile"))
    return a.withColumn("is_ok", (F.col("pct_top_decile") == 0) & (F.col("pct_top_quartile") < 25))


def compare_versions(df: DataFrame, key: str, old: str, new: str, k: int = 500) -> DataFrame:
    """The k rows whose score changed most, with both percentile ranks."""
    r = o.wide_pct_ranks(df, key, [old, new], "avg").select(key, F.col(old).alias("rank_old"), F.col(new).alias("rank_new"))
    d = df.withColumn("change", F.col(new) - F.col(old))
    top = o.top_k(d.select(key, old, new, "change"), [F.desc(F.abs(F.round("change", 12))), F.col(key)], k)
    return top.join(r, key)


def criteria_audit(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Median of each criterion per label."""
    return o.wide_quantiles(df, cols, {"median": 0.5}, [label])


def group_profile(df: DataFrame, groups: Mapping[str, Column], cols: Sequence[str]) -> DataFrame:
    """Median, quartiles and whole-table percentile of the median for each (possibly overlapping) group."""
    hit = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in groups.items()]))
    q = o.wide_quantiles(df.withColumn("group", F.explode(hit)), cols, {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["group"])
    return q.join(sm.mid_percentile(df, cols, q.select("group", "feature", F.col("median").alias("at"))), ["group", "feature"])
