"""Aggregations: cell features, class summaries, audits, profiles.

Order statistics go through gridreach.operators.ordered, so no value list of a
group is ever collected in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridreach.operators import ordered as o


def category_pivot(points: DataFrame, base: DataFrame, key: str, category: str, cats: Mapping[str, object]) -> DataFrame:
    """Count per category for every row of base, 0 when none; `cats` maps output column to category value."""
    counts = points.groupBy(key).agg(*[F.count_if(F.col(category) == v).alias(n) for n, v in cats.items()])
    return base.join(counts, key, "left").na.fill(0, list(cats))


def weighted_class_summary(df: DataFrame, by: Sequence[str], weight: str) -> DataFrame:
    """n, share of rows, sum of weight and its share per class; the totals come from the class rows themselves."""
    c = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    t = o.with_global(c, _n=F.sum("n"), _w=F.sum("w"))
    return t.select(
        *by, "n", F.round(F.col("n") / F.col("_n") * 100, 2).alias("pct_n"),
        F.round("w", 1).alias("w"), F.round(F.try_divide("w", "_w") * 100, 2).alias("pct_w"),
    )


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """Long crosstab: count and row share in percent, half-even on the share."""
    c = df.groupBy(row, col).agg(F.count("*").alias("n"))
    tot = c.groupBy(row).agg(F.sum("n").alias("_t"))
    return c.join(tot, row).select(row, col, "n", (F.bround(F.col("n") / F.col("_t"), 4) * 100).alias("row_pct"))


def mode_per_group(df: DataFrame, by: str, col: str) -> DataFrame:
    """Most frequent value per group, the smallest on a tie: two combined aggregates."""
    c = df.groupBy(by, col).agg(F.count("*").alias("_n"))
    return c.groupBy(by).agg(F.min(F.struct((-F.col("_n")).alias("a"), F.col(col).alias("v"))).alias("_m")).select(by, F.col("_m.v").alias(col), (-F.col("_m.a")).alias("n"))


def median_member(df: DataFrame, cases: Mapping[str, Column], weight: str, key: str) -> DataFrame:
    """For each named predicate, the row at index n // 2 by (weight, key), among weight > 0 when there are any."""
    tagged = df.select(*dict.fromkeys([key, weight]), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in cases.items()]))).alias("case"))
    populated = tagged.groupBy("case").agg(F.max(F.col(weight) > 0).alias("_any"))
    pool = tagged.join(populated, "case").where(~F.col("_any") | (F.col(weight) > 0))
    idx = o.row_index(pool.select("case", weight, key), [weight, key], ["case"])
    return idx.where(F.col("row_index") == F.floor(F.col("n_rows") / 2)).select("case", key, weight)


def travel_time_stats(df: DataFrame, values: Sequence[str], weight: str, limits: Sequence[float] = (5, 10, 15)) -> DataFrame:
    """One row per time column: unreachable share, share within each limit for rows and weight, quantiles plain and weighted."""
    long = o.unpivot(df, [weight], values, "measure", "t")
    w, t = F.col(weight), F.col("t")
    aggs = [
        F.count("*").alias("n"), F.count("t").alias("n_reached"),
        F.round((F.count("*") - F.count("t")) / F.count("*") * 100, 2).alias("pct_unreachable"),
        F.round((F.sum(w) - F.sum(F.when(t.isNotNull(), w).otherwise(0.0))) / F.sum(w) * 100, 2).alias("pct_w_unreachable"),
    ]
    for lim in limits:
        aggs.append(F.round(F.count_if(t <= lim) / F.count("t") * 100, 2).alias(f"pct_within_{lim}"))
        aggs.append(F.round(F.sum(F.when(t <= lim, w).otherwise(0.0)) / F.sum(w) * 100, 2).alias(f"pct_w_within_{lim}"))
    base = long.groupBy("measure").agg(*aggs)
    ps = {"p25": 0.25, "median": 0.5, "p90": 0.9}
    q = o.quantiles(long, "t", list(ps.values()), ["measure"])
    wq = o.weighted_quantiles(long, "t", weight, list(ps.values()), ["measure"])
    pick = lambda d, pre: d.groupBy("measure").agg(*[F.round(F.max(F.when(F.col("p") == p, F.col("q"))), 2).alias(pre + n) for n, p in ps.items()])
    return base.join(pick(q, ""), "measure", "left").join(pick(wq, "w_"), "measure", "left")


def describe_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per feature: counts, moments, quantiles and quality flags."""
    long = o.unpivot(df, [], cols)
    v = F.col("value")
    base = long.groupBy("feature").agg(
        F.count("value").alias("n_valid"), F.count_if(v.isNull()).alias("n_missing"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.skewness(v).alias("skew"),
        (F.count_if(v == 0) / F.count("value") * 100).alias("zero_pct"),
    )
    unique = long.where(v.isNotNull()).groupBy("feature", "value").agg(F.lit(1).alias("_u")).groupBy("feature").agg(F.count("*").alias("n_unique"))
    q = o.wide_quantiles(df, cols, {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})
    out = base.join(unique, "feature").join(q, "feature")
    out = out.withColumn("iqr", F.col("p75") - F.col("p25"))
    return out.select(
        "*",
        (F.abs("skew") > 3).alias("flag_extreme_skew"),
        ((F.abs("mean") > 1e-9) & (F.col("std") / F.abs("mean") < 0.05) & (F.col("zero_pct") < 50)).alias("flag_near_constant"),
        (F.col("zero_pct") > 90).alias("flag_very_sparse"),
    )


def coverage_gate(df: DataFrame, cols: Sequence[str], by: str, subset: Column) -> DataFrame:
    """Per feature: null and zero counts, groups that are zero or null throughout, share held by a subset."""
    long = o.unpivot(df.withColumn("_s", subset), [by, "_s"], cols)
    v, some = F.col("value"), F.coalesce(F.col("value"), F.lit(0.0))
    g1 = long.groupBy("feature", by).agg(
        F.count("*").alias("n"), F.count_if(v.isNull()).alias("nn"), F.count_if(v == 0).alias("nz"),
        F.sum(some).alias("tot"), F.sum(F.when(F.col("_s"), some).otherwise(0.0)).alias("sub"),
    )
    g2 = g1.groupBy("feature").agg(
        F.sum("nn").alias("n_null"), F.sum("nz").alias("n_zero"), F.sum("n").alias("n"),
        F.count_if((F.col("nn") + F.col("nz")) / F.col("n") * 100 >= 99.9).alias("n_empty_groups"),
        F.sum("tot").alias("total"), F.sum("sub").alias("subset_total"),
    )
    share = F.try_divide("subset_total", "total")
    return g2.select(
        "feature", "n_null", "n_zero", F.round(F.col("n_zero") / F.col("n") * 100, 2).alias("pct_zero"), "n_empty_groups",
        F.round(share * 100, 2).alias("subset_share_pct"), F.coalesce(share > 0.5, F.lit(False)).alias("concentrated"),
    )


def concentration_bands(df: DataFrame, order: str, key: str, weight: str, flag: str, pcts: Sequence[int] = (10, 20, 30)) -> DataFrame:
    """Shares of weight and flagged weight in the top p percent of rows by `order` (ties by key)."""
    idx = o.row_index(df.select(*dict.fromkeys([key, order, weight, flag])), [F.col(order).desc(), key])
    tot = F.struct("*")
    sums = df.agg(F.sum(weight).alias("w"), F.sum(F.when(F.col(flag), F.col(weight)).otherwise(0.0)).alias("wf"))
    b = idx.select("*", F.explode(F.array(*[F.lit(p) for p in pcts])).alias("pct")).where(F.col("row_index") < F.floor(F.col("n_rows") * F.col("pct") / 100))
    b = b.groupBy("pct").agg(F.count("*").alias("n_cells"), F.sum(weight).alias("bw"), F.sum(F.when(F.col(flag), F.col(weight)).otherwise(0.0)).alias("bf"))
    b = b.withColumn("_t", sums.select(tot).scalar())
    return b.select(
        "pct", "n_cells", F.round(F.try_divide(F.col("bw"), F.col("_t.w")) * 100, 2).alias("pct_weight"),
        F.round(F.try_divide(F.col("bf"), F.col("_t.wf")) * 100, 2).alias("pct_flagged_weight"),
        F.round(F.try_divide("bf", "bw") * 100, 2).alias("pct_flagged_within"),
    )


def by_universe(df: DataFrame, universes: Mapping[str, Column], aggs: Sequence[Column]) -> DataFrame:
    """The same aggregates over several overlapping row sets in one pass."""
    inside = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in universes.items()]))
    return df.withColumn("universe", F.explode(inside)).groupBy("universe").agg(*aggs)


def growth_curve(df: DataFrame, cats: Mapping[str, str], limits: Sequence[float], weight: str) -> DataFrame:
    """Share of rows and weight with time <= limit per (category, limit), with the gain over the previous limit."""
    long = o.unpivot(df, [weight], list(cats.values()), "measure", "t")
    names = F.create_map(*[x for n, c in cats.items() for x in (F.lit(c), F.lit(n))])
    lim = F.explode(F.array(*[F.lit(float(x)) for x in limits])).alias("limit")
    ok = F.coalesce(F.col("t") <= F.col("limit"), F.lit(False))
    g1 = long.select(names[F.col("measure")].alias("category"), "t", weight, lim).groupBy("category", "limit").agg(
        F.round(F.count_if(ok) / F.count("*") * 100, 2).alias("pct_n"),
        F.round(F.sum(F.when(ok, F.col(weight)).otherwise(0.0)) / F.sum(weight) * 100, 2).alias("pct_w"),
    )
    w = Window.partitionBy("category").orderBy("limit")  # one row per limit
    return g1.withColumn("gain_n", F.round(F.col("pct_n") - F.lag("pct_n").over(w), 2)).withColumn("gain_w", F.round(F.col("pct_w") - F.lag("pct_w").over(w), 2))


def cliff_flags(curve: DataFrame, limits: tuple[float, float, float], ratio: float = 1.5, min_pp: float = 5.0) -> DataFrame:
    """True when the second jump is more than ratio times the first and more than min_pp points."""
    at = [F.max(F.when(F.col("limit") == float(x), F.col("pct_w"))) for x in limits]
    p = curve.groupBy("category").agg(F.round(at[1] - at[0], 2).alias("jump1"), F.round(at[2] - at[1], 2).alias("jump2"))
    return p.withColumn("is_cliff", (F.col("jump2") > F.col("jump1") * ratio) & (F.col("jump2") > min_pp))


def day_concentration(trips: DataFrame, ts: str, k: int = 5) -> DataFrame:
    d = trips.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    top = d.orderBy(F.desc("n"), "day").limit(k).agg(F.sum("n").alias("top"), F.max("n").alias("busiest"))
    out = d.agg(F.count("*").alias("n_days"), F.sum("n").alias("n_trips")).withColumn("_t", o.scalar_row(top))
    return out.select("n_days", "n_trips", F.round(F.col("_t.top") / F.col("n_trips") * 100, 1).alias("top_share_pct"), F.col("_t.busiest").alias("busiest"))


def sparse_count_stats(df: DataFrame, col: str) -> DataFrame:
    """Non-zero share and mean, median and maximum of the non-zero counts."""
    pos = df.where(F.col(col) > 0)
    med = o.quantiles(pos, col, [0.5]).agg(F.max("q").alias("m"))
    a = df.agg(F.count("*").alias("n"), F.count_if(F.col(col) > 0).alias("n_nonzero"), F.round(F.avg(F.when(F.col(col) > 0, F.col(col))), 4).alias("mean_nonzero"), F.max(col).alias("max_count"))
    return a.select("*", F.round(F.col("n_nonzero") / F.col("n") * 100, 2).alias("pct_nonzero")).withColumn("median_nonzero", med.scalar())


def zscore_outliers(df: DataFrame, key: str, cols: Sequence[str], z: float = 4.0, k: int = 20) -> DataFrame:
    """The k most extreme values per feature with |z| > z (sample deviation).

    The moments are one row for the whole table, so nothing is shuffled before the few hits.
    """
    m = o.scalar_row(df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_samp))]))
    score = lambda i, c: F.try_divide(F.col(c) - F.col("_m")[f"m{i}"], F.nullif(F.col("_m")[f"s{i}"], F.lit(0.0)))
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), score(i, c).alias("z")) for i, c in enumerate(cols)])
    hit = df.withColumn("_m", m).select(key, F.inline(rows)).where(F.abs("z") > z).select("feature", key, "value", "z")
    return o.top_k(hit, [F.desc(F.abs("z")), F.col(key)], k, ["feature"])


def bss_by_feature(df: DataFrame, cols: Sequence[str], label: str, family: Mapping[str, str], dominance: float = 20.0) -> DataFrame:
    """Between-group sum of squares per feature and family; the grand mean is rebuilt from the group rows."""
    g1 = o.unpivot(df, [label], cols).where(F.col("value").isNotNull()).groupBy("feature", label).agg(F.count("*").alias("_n"), F.avg("value").alias("_m"))
    # sum n (m - M)^2 = sum n m^2 - (sum n m)^2 / N
    f = g1.groupBy("feature").agg((F.sum(F.col("_n") * F.col("_m") * F.col("_m")) - F.sum(F.col("_n") * F.col("_m")) ** 2 / F.sum("_n")).alias("bss"))
    f = o.with_global(f, total=F.sum("bss"))
    fam = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(family[c]))])
    pct = F.col("bss") / F.col("total") * 100
    return f.select("feature", fam[F.col("feature")].alias("family"), F.round("bss", 4).alias("bss"), F.round(pct, 3).alias("pct"), (pct > dominance).alias("dominant"))


def family_bss(bss: DataFrame) -> DataFrame:
    g1 = bss.groupBy("family").agg(F.round(F.sum("pct"), 2).alias("pct"), F.count("*").alias("n_features"))
    return g1.withColumn("pct_per_feature", F.round(F.col("pct") / F.col("n_features"), 3))


def percentile_profile(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Per (label, feature): median, quartiles and the whole-table mid-percentile of that median."""
    q = o.wide_quantiles(df.where(F.col(label).isNotNull()), cols, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [label])
    return q.join(mid_percentile(df, cols, q.select(label, "feature", F.col("median").alias("at"))), [label, "feature"])


def mid_percentile(df: DataFrame, cols: Sequence[str], points: DataFrame) -> DataFrame:
    """Percent of values below plus half of those equal, for points (..., feature, at).

    Points are ranked together with the value counts, so the table is never
    compared with every point.
    """
    counts = o.unpivot(df, [], cols).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("_n"))
    marks = points.select("feature", F.col("at").alias("value")).distinct().withColumn("_n", F.lit(0))
    both = counts.unionByName(marks).groupBy("feature", "value").agg(F.sum("_n").alias("_n"))
    p = o.prefix_sums(both, ["feature"], ["value"], {"n": "_n"})
    pct = ((F.col("n_cum") - F.col("_n")) + F.col("n_cum")) / 2 / F.col("n_total") * 100
    p = p.select(F.col("feature"), F.col("value").alias("at"), pct.alias("percentile"))
    return points.join(p, ["feature", "at"]).drop("at")


def z_profile(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(group mean - mean) / population deviation per (label, feature)."""
    long = o.unpivot(df, [label], cols).where(F.col("value").isNotNull())
    m = long.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    g1 = long.groupBy(label, "feature").agg(F.avg("value").alias("_gm")).join(m, "feature")
    return g1.select(label, "feature", F.try_divide(F.col("_gm") - F.col("_m"), F.nullif("_s", F.lit(0.0))).alias("z"))


def feed_quality(stops: DataFrame, districts: DataFrame, suspects: Sequence) -> DataFrame:
    """Coverage class of each district from stop density against the median of served districts."""
    n = stops.groupBy("district").agg(F.count("*").alias("_n"))
    d = districts.join(n, "district", "left").withColumn("total_stops", F.coalesce("_n", F.lit(0))).drop("_n")
    d = d.withColumn("per_km2", F.round(F.col("total_stops") / F.col("area_km2"), 3))
    served = F.when(F.col("total_stops") > 0, F.col("per_km2"))
    d = o.with_quantiles(d.withColumn("_served", served), _med=("_served", 0.5)).drop("_served")
    cls = (
        F.when(F.col("total_stops") == 0, "NO_FEED_COVERAGE")
        .when(F.col("district").isin(*suspects), "SUSPECT_FEED_COVERAGE")
        .when(F.col("per_km2") < F.col("_med") * 0.25, "SUSPECT_FEED_COVERAGE")
        .when(F.col("per_km2") < F.col("_med") * 0.75, "USABLE_WITH_LIMITATION")
        .otherwise("GOOD_COVERAGE")
    )
    return d.withColumn("quality", cls).drop("_med")


def table_diff(a: DataFrame, b: DataFrame, key: str, cols: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """Per column: cells compared, cells that differ by more than tol or by nullness, keys on one side only."""
    j = a.select(key, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(True).alias("_a")).join(
        b.select(key, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(True).alias("_b")), key, "full_outer"
    )
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").cast("double").alias("x"), F.col(f"b_{c}").cast("double").alias("y")) for c in cols])
    long = j.select("_a", "_b", F.inline(rows))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    x, y = F.col("x"), F.col("y")
    changed = both & ((x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tol, F.lit(False)))
    return long.groupBy("column").agg(
        F.count_if(both).alias("n_compared"), F.count_if(changed).alias("n_changed"),
        F.count_if(F.col("_b").isNull()).alias("n_only_a"), F.count_if(F.col("_a").isNull()).alias("n_only_b"),
    )


def schema_diff(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Column names on one side only and columns whose type changed (metadata, no job)."""
    ta, tb = dict(a.dtypes), dict(b.dtypes)
    return {
        "only_a": sorted(set(ta) - set(tb)),
        "only_b": sorted(set(tb) - set(ta)),
        "retyped": sorted(c for c in set(ta) & set(tb) if ta[c] != tb[c]),
    }


def null_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    long = o.unpivot(df, [], cols)
    v = F.col("value")
    inf = v.isin(float("inf"), float("-inf"))
    return long.groupBy("feature").agg(
        F.count_if(v.isNull()).alias("n_null"), F.count_if(inf).alias("n_inf"),
        (F.min("value") == F.max("value")).alias("is_constant"), F.round(F.count_if(v == 0) / F.count("*") * 100, 2).alias("zero_pct"),
    )
