"""Joins and set operations with the guarantees the cell pipeline relies on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridreach.functions import scalars as s


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where(F.col("count") > 1)


def join_one_to_one(base: DataFrame, family: DataFrame, key: str) -> DataFrame:
    """Left join that fails instead of multiplying rows; the check runs once, on the key column only."""
    if not duplicate_keys(family.select(key), key).isEmpty():
        raise ValueError(f"{key} is not unique in the joined table")
    return base.join(family, key, "left")


def star_join(base: DataFrame, families: Sequence[DataFrame], key: str) -> DataFrame:
    """Chain of left joins on one key; all sides hash on it, so the base is shuffled once."""
    out = base
    for f in families:
        out = out.join(f, key, "left")
    return out


def full_outer_counts(a: DataFrame, b: DataFrame, keys: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Row counts of two tables per key, 0 where a side has none: one shuffle over the union."""
    both = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionAll(b.select(*keys, F.lit(0), F.lit(1)))
    return both.groupBy(*keys).agg(F.sum("_a").alias(names[0]), F.sum("_b").alias(names[1]))


def missing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).join(b.select(key), key, "left_anti")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left join of a keyed value with a default; Catalyst broadcasts the table only when its size allows."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def union_layers(layers: Mapping[str, DataFrame], name: str = "source") -> DataFrame:
    out = None
    for label, df in layers.items():
        df = df.withColumn(name, F.lit(label))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def in_row_pairs(ids: Sequence[str], cols: Sequence[str]) -> Column:
    """array<struct<a, b, x, y>> of all column pairs a before b, built inside the row (no self join)."""
    entries = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for i, a in enumerate(cols)
        for b in cols[i + 1 :]
    ]
    return F.array(*entries)


def jaccard_matrix(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Jaccard of every pair of boolean columns: (a, b, n_both, n_either, jaccard)."""
    long = df.select(F.inline(in_row_pairs([], flags)))
    on = (F.col("x") == 1, F.col("y") == 1)
    out = long.groupBy("a", "b").agg(F.count_if(on[0] & on[1]).alias("n_both"), F.count_if(on[0] | on[1]).alias("n_either"))
    return out.withColumn("jaccard", F.coalesce(F.try_divide("n_both", "n_either"), F.lit(0.0)))


def entries_exits(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(
        F.count_if(~F.col(a) & F.col(b)).alias("entries"),
        F.count_if(F.col(a) & ~F.col(b)).alias("exits"),
        F.count_if(F.col(a) & F.col(b)).alias("stay"),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and order-free content hash (two independent sums of row hashes, wrapped to 2^63)."""
    row = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    h1, h2 = F.xxhash64(row), F.xxhash64(F.lit(1), row)
    big = "decimal(38,0)"
    return df.agg(
        F.count("*").alias("n_rows"),
        F.sum(h1.cast(big)).cast("string").alias("hash_a"),
        F.sum(h2.cast(big)).cast("string").alias("hash_b"),
    )


def served_routes(stop_times: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Distinct (stop_id, route_id, mode) of in-scope routes (routes.mode not null).

    Visits shrink to distinct (trip, stop) and then (stop, route) pairs before
    anything is grouped, so a stop with a huge number of departures weighs one
    row per route.
    """
    visits = stop_times.select("trip_id", "stop_id").distinct()
    pairs = visits.join(trips.select("trip_id", "route_id"), "trip_id").select("stop_id", "route_id").distinct()
    return pairs.join(routes.where(F.col("mode").isNotNull()).select("route_id", "mode"), "route_id")


def stop_modes(stops: DataFrame, stop_times: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """One row per (stop, mode) with the stop's full in-scope route set, repeated for each of its modes."""
    served = served_routes(stop_times, trips, routes)
    per_mode = served.groupBy("stop_id", "mode").agg(F.count("*").alias("n_mode_routes"))
    sets = served.groupBy("stop_id").agg(F.sort_array(F.collect_set("route_id")).alias("route_ids"))
    return stops.join(per_mode, "stop_id").join(sets, "stop_id")


def route_mode(routes: DataFrame, rules: DataFrame) -> DataFrame:
    """Mode from an (agency, route_type) rule table; a route in no rule is 'metrobus' by name, else null."""
    named = F.when(F.lower("route_long_name").contains("metrob"), "metrobus")
    return routes.join(rules, ["agency", "route_type"], "left").withColumn("mode", F.coalesce(F.col("mode"), named))


def exclude_edges(edges: DataFrame, exclude: Mapping[str, Sequence[str]], tags: str | None = None) -> DataFrame:
    """Drop rows with a listed value; a flat column wins over the tag map, null never excludes."""

    def tag(key):
        flat = F.col(key) if key in edges.columns else F.lit(None).cast("string")
        return flat if tags is None else F.coalesce(flat, F.col(tags)[key])

    known = {k: v for k, v in exclude.items() if tags is not None or k in edges.columns}
    return edges.where(~s.any_in(known, tag))


def merge_chunks(chunks: Sequence[DataFrame], ids: Sequence[str]) -> DataFrame:
    """Union of district chunks; a row fetched by several chunks is kept once, from the first of them."""
    from gridreach.operators.ordered import first_row

    out = None
    for i, c in enumerate(chunks):
        c = c.withColumn("chunk", F.lit(i))
        out = c if out is None else out.unionByName(c, allowMissingColumns=True)
    return first_row(out, list(ids), [F.col("chunk")])
