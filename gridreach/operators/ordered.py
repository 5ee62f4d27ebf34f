"""Ranks, running sums and exact quantiles without a one-task window.

Everything here is built on `prefix_sums`: rows are range-partitioned on
(group, order), each partition is summed on its own, and the per-partition
totals (one row per partition and group boundary) are turned into offsets.  A
group that holds a third of all rows is therefore spread over many tasks.
Inputs are aggregated to one row per distinct value first, so ties and repeated
values never travel more than once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridreach.session import cut, shuffle_width


def scalar_row(df: DataFrame) -> Column:
    """All columns of a one-row aggregate as one struct-valued scalar subquery."""
    return df.select(F.struct("*")).scalar()


def with_global(df: DataFrame, **aggs: Column) -> DataFrame:
    """Attach whole-table aggregates of df to each of its rows (no join, no window)."""
    one = df.agg(*[c.alias(n) for n, c in aggs.items()])
    out = df.withColumn("_g", scalar_row(one))
    return out.select(*df.columns, *[F.col("_g")[n].alias(n) for n in aggs])


def prefix_sums(df: DataFrame, by: Sequence[str], order: Sequence, weights: dict[str, str]) -> DataFrame:
    """Inclusive running sum and group total of each weight, per group `by` in `order`.

    weights maps an output stem to an input column; the output has `{stem}_cum`
    and `{stem}_total`.  (by, order) should identify a row.
    """
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    # no partition number: adaptive execution merges neighbouring ranges to a useful size, which keeps their order
    ranged = cut(df.repartitionByRange(*[F.col(b) for b in by], *order_cols).withColumn("_pid", F.spark_partition_id()))
    keys = ["_pid", *by]
    totals = ranged.groupBy(*keys).agg(*[F.sum(c).alias(f"_{s}_part") for s, c in weights.items()])
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_{s}_part").over(before), F.lit(0)).alias(f"_{s}_off") for s in weights],
        *[F.sum(f"_{s}_part").over(group).alias(f"{s}_total") for s in weights],
    )
    inside = Window.partitionBy(*keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = ranged.join(offsets, on)
    return joined.select(
        *df.columns,
        *[(F.sum(c).over(inside) + F.col(f"_{s}_off")).alias(f"{s}_cum") for s, c in weights.items()],
        *[f"{s}_total" for s in weights],
    )


def value_ranks(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct non-null value: rank_min, rank_avg, ties, n."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("ties"))
    p = prefix_sums(counts, by, [col], {"n": "ties"})
    return p.select(
        *by,
        col,
        "ties",
        (F.col("n_cum") - F.col("ties") + 1).alias("rank_min"),
        (F.col("n_cum") - (F.col("ties") - 1) / 2).alias("rank_avg"),
        F.col("n_total").alias("n"),
    )


def _join_ranks(df: DataFrame, col: str, by: Sequence[str], expr: Column, name: str) -> DataFrame:
    r = value_ranks(df, col, by).select(*[F.col(b).alias(f"_r_{b}") for b in by], F.col(col).alias("_r_v"), expr.alias(name))
    on = [F.col(b).eqNullSafe(F.col(f"_r_{b}")) for b in by] + [F.col(col) == F.col("_r_v")]
    return df.join(r, on, "left").drop("_r_v", *[f"_r_{b}" for b in by])


def pct_rank_min(df: DataFrame, col: str, name: str = "pct_rank", by: Sequence[str] = ()) -> DataFrame:
    """(rank_min - 1) / (n - 1): a big tied mass at the bottom maps to 0."""
    return _join_ranks(df, col, by, F.try_divide(F.col("rank_min") - 1, F.col("n") - 1), name)


def pct_rank_avg(df: DataFrame, col: str, name: str = "pct_rank", by: Sequence[str] = ()) -> DataFrame:
    """rank_avg / n."""
    return _join_ranks(df, col, by, F.col("rank_avg") / F.col("n"), name)


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long in one pass; all values as double, nulls kept."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])
    return df.select(*ids, F.inline(pairs))


def pivot_first(df: DataFrame, ids: Sequence[str], name: str, value: str, cols: Sequence[str]) -> DataFrame:
    """Long to wide for a known column list."""
    return df.groupBy(*ids).agg(*[F.max(F.when(F.col(name) == c, F.col(value))).alias(c) for c in cols])


def wide_pct_ranks(df: DataFrame, key: str, cols: Sequence[str], kind: str = "min") -> DataFrame:
    """Percentile rank of many columns at once: one long prefix-sum instead of one job per column.

    Rows are dealt by key to a fixed number of tasks: tables of cells compress so well that adaptive execution, which goes by
    bytes, would leave the pivot of millions of keys to one task.
    """
    long = unpivot(df.repartition(shuffle_width(df.sparkSession), key), [key], cols)
    fn = pct_rank_min if kind == "min" else pct_rank_avg
    ranked = fn(long, "value", "r", by=["feature"])
    return pivot_first(ranked, [key], "feature", "r", cols)


def quantiles(df: DataFrame, col: str, ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles, long form: (by..., p, q)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_n"))
    p = prefix_sums(counts, by, [col], {"n": "_n"})
    first, last, top = F.col("n_cum") - F.col("_n"), F.col("n_cum") - 1, F.col("n_total") - 1
    wanted = F.array(*[F.struct(F.lit(float(q)).alias("p"), (F.lit(float(q)) * top).alias("h")) for q in ps])
    hit = p.select(*by, F.col(col).cast("double").alias("_v"), first.alias("_a"), last.alias("_b"), F.inline(wanted))
    lo, hi = F.floor("h"), F.ceil("h")
    hit = hit.where((lo.between(F.col("_a"), F.col("_b"))) | (hi.between(F.col("_a"), F.col("_b"))))
    return (
        hit.groupBy(*by, "p")
        .agg(
            F.max(F.when(lo.between(F.col("_a"), F.col("_b")), F.col("_v"))).alias("_lo"),
            F.max(F.when(hi.between(F.col("_a"), F.col("_b")), F.col("_v"))).alias("_hi"),
            F.max("h").alias("_h"),
        )
        .select(*by, "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h"))).alias("q"))
    )


def wide_quantiles(df: DataFrame, cols: Sequence[str], ps: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of many columns: one row per (by..., feature), one column per name in ps."""
    q = quantiles(unpivot(df, by, cols), "value", list(ps.values()), [*by, "feature"])
    return q.groupBy(*by, "feature").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for n, p in ps.items()])


def one_row_quantiles(df: DataFrame, specs: dict[str, tuple[str, float]]) -> DataFrame:
    """A single row holding named quantiles of several columns, e.g. {'med_pop': ('pop', 0.5)}."""
    cols = sorted({c for c, _ in specs.values()})
    q = quantiles(unpivot(df, [], cols), "value", sorted({p for _, p in specs.values()}), ["feature"])
    return q.agg(
        *[F.max(F.when((F.col("feature") == c) & (F.col("p") == float(p)), F.col("q"))).alias(n) for n, (c, p) in specs.items()]
    )


def with_quantiles(df: DataFrame, **specs: tuple[str, float]) -> DataFrame:
    """Attach whole-table quantiles of df's columns to each row as scalar subqueries."""
    out = df.withColumn("_q", scalar_row(one_row_quantiles(df, specs)))
    return out.select(*df.columns, *[F.col("_q")[n].alias(n) for n in specs])


def weighted_quantiles(df: DataFrame, value: str, weight: str, ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """First value whose cumulative weight reaches p times the group's weight."""
    mass = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(F.col(weight).cast("double")).alias("_w"))
    p = prefix_sums(mass, by, [value], {"w": "_w"})
    q = p.select(*by, value, "w_cum", "w_total", F.explode(F.array(*[F.lit(float(x)) for x in ps])).alias("p"))
    reached = F.col("w_cum") >= F.col("p") * F.col("w_total")
    return q.groupBy(*by, "p").agg(F.coalesce(F.min(F.when(reached, F.col(value))), F.max(value)).alias("q"))


def row_index(df: DataFrame, order: Sequence, by: Sequence[str] = (), name: str = "row_index") -> DataFrame:
    """Zero-based position of each row in `order` (a total order) within `by`, and group size `n_rows`."""
    p = prefix_sums(df.withColumn("_one", F.lit(1)), by, order, {"_i": "_one"})
    return p.withColumn(name, F.col("_i_cum") - 1).withColumnRenamed("_i_total", "n_rows").drop("_one", "_i_cum")


def quantile_bands(df: DataFrame, col: str, labels: Sequence[str], name: str = "band") -> DataFrame:
    """Right-closed equal-count bands (lowest edge included); equal edges collapse into one band."""
    k = len(labels)
    edges = {f"_e{i}": (col, i / k) for i in range(1, k)}
    out = with_quantiles(df, **edges) if k > 1 else df
    band = F.lit(labels[-1])
    for i in range(k - 1, 0, -1):
        band = F.when(F.col(col) <= F.col(f"_e{i}"), labels[i - 1]).otherwise(band)
    return out.withColumn(name, F.when(F.col(col).isNotNull(), band)).drop(*edges)


def top_decile_flags(df: DataFrame, cols: Sequence[str], q: float = 0.9, prefix: str = "top_") -> DataFrame:
    """Boolean per column: value >= that column's own q-quantile."""
    out = with_quantiles(df, **{f"_q_{c}": (c, q) for c in cols})
    return out.select(*df.columns, *[(F.col(c) >= F.col(f"_q_{c}")).alias(prefix + c) for c in cols])


def top_k(df: DataFrame, order: Sequence[Column], k: int, by: Sequence[str] = ()) -> DataFrame:
    """First k rows in `order`, per group when `by` is given (pruned before the shuffle)."""
    if not by:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def first_row(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per group, the first in `order`; an aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    pick = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*by).agg(pick.alias("_r")).select(*by, *[F.col("_r")[c].alias(c) for c in rest])
