"""Accessibility classes and the synthesis table, as column rules over one row per cell.

Input columns: walk_{food,healthcare,education} and cycle_{...} times in
minutes (null = unreachable), walk/cycle_transit_{a,b}, everyday_reliable,
transit_reliable.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridreach.functions import scalars as s
from gridreach.operators import ordered as o
from gridreach.operators import summary as sm

REQUIRED = ("food", "healthcare", "education")
TRANSIT_GAPS = ("GENERAL_ACCESS_GAP", "FIXED_GUIDEWAY_ACCESS_GAP", "BOTH_TRANSIT_ACCESS_GAPS")
RELIABLE_FLAGS = ("RELIABLE", "RELIABLE_SEPARATE_COMPONENT")


def within(col: str, limit: float) -> Column:
    return F.coalesce(F.col(col) <= limit, F.lit(False))


def missing(mode: str = "walk", limit: float = 15.0) -> dict[str, Column]:
    return {c.upper(): ~within(f"{mode}_{c}", limit) for c in REQUIRED}


def proximity_summary(df: DataFrame, cats: Sequence[str], required: Sequence[str], limits: Sequence[int], prefix: str = "walk_") -> DataFrame:
    """Per limit: categories reached, required reached, completeness and required share."""
    out = [F.col("grid_id")]
    for m in limits:
        req = s.count_true([within(prefix + c, m) for c in required])
        out += [
            s.count_true([within(prefix + c, m) for c in cats]).alias(f"n_categories_{m}"), req.alias(f"n_required_{m}"),
            (req == len(required)).alias(f"is_complete_{m}"), F.bround(req / len(required), 4).alias(f"required_ratio_{m}"),
        ]
    return df.select(*out)


def deficit_class(flags: Mapping[str, Column]) -> Column:
    n = s.count_true(list(flags.values()))
    out = F.when(n == 0, "NONE_COMPLETE_ACCESS").when(n >= 2, "MULTI_SERVICE_DEFICIT")
    for name, f in flags.items():
        out = out.when(f, f"{name}_DEFICIT")
    return out.otherwise("UNKNOWN")


def population_by_access(df: DataFrame, cats: Mapping[str, str], limits: Sequence[int], weight: str) -> DataFrame:
    """Cells and population with access per (category, limit), with shares."""
    rows = F.array(*[F.struct(F.lit(n).alias("category"), F.lit(m).alias("minutes"), within(c, m).alias("ok")) for n, c in cats.items() for m in limits])
    g = df.select(weight, F.inline(rows)).groupBy("category", "minutes").agg(
        F.count_if("ok").alias("n_cells"), F.round(F.sum(F.when(F.col("ok"), F.col(weight)).otherwise(0.0)), 1).alias("population"),
        F.round(F.count_if("ok") / F.count("*") * 100, 2).alias("pct_cells"), F.round(F.sum(F.when(F.col("ok"), F.col(weight)).otherwise(0.0)) / F.sum(weight) * 100, 2).alias("pct_population"),
    )
    return g


def access_class(walk: Column, cycle: Column, gain: str = "CYCLE_ONLY_GAIN") -> Column:
    return F.when(walk & cycle, "WALK_AND_CYCLE_ACCESS").when(walk, "WALK_ONLY_ACCESS").when(cycle, gain).otherwise("NEITHER_ACCESS")


def category_gain(df: DataFrame, cats: Sequence[str], weight: str) -> DataFrame:
    """Per category: cells that only cycling reaches, cells where cycling is faster, median reduction, population helped."""
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"walk_{c}").alias("wt"), F.col(f"cycle_{c}").alias("ct")) for c in cats])
    long = df.select(weight, F.inline(rows))
    new = F.col("wt").isNull() & F.col("ct").isNotNull()
    cutm = F.col("wt") - F.col("ct")
    better = F.coalesce(cutm > 0, F.lit(False))
    a = long.groupBy("category").agg(
        F.count_if(new).alias("n_newly_reached"), F.round(F.sum(F.when(new, F.col(weight)).otherwise(0.0)), 1).alias("pop_newly_reached"),
        F.count_if(better).alias("n_faster"), F.round(F.sum(F.when(new | better, F.col(weight)).otherwise(0.0)), 1).alias("pop_helped"),
    )
    med = o.quantiles(long.where(better).select("category", cutm.alias("m")), "m", [0.5], ["category"]).select("category", F.round("q", 2).alias("median_reduction"))
    return a.join(med, "category", "left")


def closure(walk_missing: Mapping[str, Column], cycle_ok: Mapping[str, Column], reliable: Column | None = None) -> tuple[Column, Column]:
    """(status, '+'-joined closed categories) of everyday gaps under cycling."""
    closed = {n: m & cycle_ok[n] for n, m in walk_missing.items()}
    still = {n: m & ~cycle_ok[n] for n, m in walk_missing.items()}
    n_miss, n_still, n_closed = (s.count_true(list(d.values())) for d in (walk_missing, still, closed))
    status = F.when(n_miss == 0, "NOT_APPLICABLE_NO_GAP").when(n_still == 0, "FULLY_CLOSED_BY_CYCLING").when(n_closed > 0, "PARTIALLY_CLOSED_BY_CYCLING").otherwise("UNCHANGED_BY_CYCLING")
    text = s.join_labels(closed, "NONE")
    if reliable is not None:
        status = F.when(reliable, status).otherwise("CYCLING_RESULT_UNCERTAIN")
        text = F.when(reliable, text).otherwise("UNCERTAIN")
    return status, text


def high_value_gain(df: DataFrame, weight: str) -> DataFrame:
    """Cells with at least the median population of populated cells where cycling adds a required category."""
    d = df.withColumn("_pop", F.when(F.col(weight) > 0, F.col(weight)))
    d = o.with_quantiles(d, _med=("_pop", 0.5))
    nw = s.count_true([within(f"walk_{c}", 15) for c in REQUIRED])
    nc = s.count_true([within(f"cycle_{c}", 15) for c in REQUIRED])
    gained = F.greatest(nc - nw, F.lit(0))
    big = F.col(weight) >= F.col("_med")
    return d.select("grid_id", gained.alias("categories_gained"), big.alias("meaningful_population"), (big & (gained >= 1)).alias("is_high_value"))


def time_savings(df: DataFrame, systems: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Per system: distribution of walk minus cycle time where both reach."""
    rows = F.array(*[F.struct(F.lit(n).alias("system"), (F.col(a) - F.col(b)).alias("saved")) for n, (a, b) in systems.items()])
    long = df.select(F.inline(rows))
    a = long.groupBy("system").agg(
        F.count("saved").alias("n_both"), F.round(F.count("saved") / F.count("*") * 100, 2).alias("pct_both"), F.round(F.count_if(F.col("saved") < 0) / F.count("saved") * 100, 2).alias("pct_slower")
    )
    q = o.quantiles(long, "saved", [0.25, 0.5, 0.75, 0.9], ["system"])
    q = q.groupBy("system").agg(*[F.round(F.max(F.when(F.col("p") == p, F.col("q"))), 2).alias(n) for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9))])
    return a.join(q, "system", "left")


def transit_gap(general_minutes: float = 10.0, fixed_minutes: float = 15.0) -> Column:
    general = within("walk_transit_a", general_minutes) | within("cycle_transit_a", general_minutes)
    fixed = within("walk_transit_b", fixed_minutes) | within("cycle_transit_b", fixed_minutes)
    return F.when(general & fixed, "NO_TRANSIT_GAP").when(general, "FIXED_GUIDEWAY_GAP").when(fixed, "GENERAL_TRANSIT_GAP").otherwise("BOTH_TRANSIT_GAPS")


def transit_uncertainty(feed_quality: Column, walk_flag: Column, cycle_flag: Column) -> Column:
    return (
        F.when(feed_quality.isin("SUSPECT_FEED_COVERAGE", "NO_FEED_COVERAGE"), "DATA_COVERAGE_UNCERTAIN")
        .when(~walk_flag.isin(*RELIABLE_FLAGS) | ~cycle_flag.isin(*RELIABLE_FLAGS), "NETWORK_QUALITY_UNCERTAIN")
        .otherwise("RELIABLE")
    )


def mapped_transit_gap(gap: Column, uncertainty: Column) -> Column:
    return (
        F.when(uncertainty == "DATA_COVERAGE_UNCERTAIN", "TRANSIT_DATA_UNCERTAIN")
        .when(uncertainty == "NETWORK_QUALITY_UNCERTAIN", "NETWORK_QUALITY_UNCERTAIN")
        .when(gap == "NO_TRANSIT_GAP", "NO_TRANSIT_ACCESS_GAP")
        .when(gap == "GENERAL_TRANSIT_GAP", "GENERAL_ACCESS_GAP")
        .when(gap == "FIXED_GUIDEWAY_GAP", "FIXED_GUIDEWAY_ACCESS_GAP")
        .when(gap == "BOTH_TRANSIT_GAPS", "BOTH_TRANSIT_ACCESS_GAPS")
        .otherwise("TRANSIT_DATA_UNCERTAIN")
    )


def population_summary(df: DataFrame, col: str, weight: str, reliable: Column, limits: Sequence[int] = (5, 10, 15)) -> DataFrame:
    """RAW over all rows and RELIABLE_ONLY over its own total."""
    aggs = []
    for m in limits:
        got = F.sum(F.when(within(col, m), F.col(weight)).otherwise(0.0))
        aggs += [F.round(got, 1).alias(f"pop_{m}"), F.round(got / F.sum(weight) * 100, 2).alias(f"pct_{m}")]
    lost = F.sum(F.when(F.col(col).isNull(), F.col(weight)).otherwise(0.0))
    aggs += [F.round(lost / F.sum(weight) * 100, 2).alias("pct_unreachable"), F.round(F.sum(weight), 1).alias("denominator")]
    return sm.by_universe(df, {"RAW": F.lit(True), "RELIABLE_ONLY": reliable}, aggs)


def everyday_gap(flags: Mapping[str, Column], reliable: Column) -> Column:
    n = s.count_true(list(flags.values()))
    names = s.join_labels(flags, "NO_REQUIRED")
    named = F.concat(F.replace(names, F.lit("+"), F.lit("_")), F.lit("_GAP"))
    return F.when(~reliable, "UNKNOWN_OR_QUALITY_LIMITED").when(n == len(flags), "ALL_REQUIRED_GAP").otherwise(named)


def multi_domain(everyday: Column, transit: Column, strict: Column) -> Column:
    e, t = everyday != "NO_REQUIRED_GAP", transit.isin(*TRANSIT_GAPS)
    return (
        F.when(~strict, "E_DATA_OR_NETWORK_UNCERTAIN").when(~e & ~t, "A_BROAD_ACCESS").when(e & ~t, "B_EVERYDAY_NEEDS_GAP_ONLY")
        .when(~e & t, "C_TRANSIT_ACCESS_GAP_ONLY").otherwise("D_BOTH_ACCESS_GAPS")
    )


def intervention(everyday: Column, transit: Column, strict: Column, closure_status: Column, transit_gain: Column) -> Column:
    e, t = everyday != "NO_REQUIRED_GAP", transit.isin(*TRANSIT_GAPS)
    full, closes_t = closure_status == "FULLY_CLOSED_BY_CYCLING", t & transit_gain
    return (
        F.when(~strict, "QUALITY_UNCERTAIN").when(~e & ~t, "WALKING_SUFFICIENT").when(full & closes_t, "CYCLING_CLOSES_BOTH").when(full, "CYCLING_CLOSES_EVERYDAY_GAP")
        .when(closes_t, "CYCLING_CLOSES_TRANSIT_GAP").when(closure_status == "PARTIALLY_CLOSED_BY_CYCLING", "CYCLING_PARTIAL_GAIN").otherwise("CYCLING_DOES_NOT_CLOSE_GAP")
    )


def synthesis(df: DataFrame) -> DataFrame:
    """All class columns of a cell in one projection chain (no join, no shuffle)."""
    status, closed = closure(missing("walk"), {n: ~m for n, m in missing("cycle").items()}, F.col("everyday_reliable"))
    uncertain = F.when(~F.col("transit_reliable"), "DATA_COVERAGE_UNCERTAIN").otherwise("RELIABLE")
    walk15 = {c: within(f"walk_{c}", 15) for c in REQUIRED}
    d = df.withColumns(
        {
            "strict_reliable": F.col("everyday_reliable") & F.col("transit_reliable"),
            "everyday_gap": everyday_gap(missing("walk"), F.col("everyday_reliable")),
            "closure_status": status,
            "closed_categories": closed,
            "gap_class": transit_gap(),
            "transit_gap": mapped_transit_gap(transit_gap(), uncertain),
            "walk_complete": walk15["food"] & walk15["healthcare"] & walk15["education"],
            "transit_gain": ~within("walk_transit_a", 10) & within("cycle_transit_a", 10),
        }
    )
    e, t, st = F.col("everyday_gap"), F.col("transit_gap"), F.col("strict_reliable")
    return d.withColumns({"multi_domain": multi_domain(e, t, st), "intervention": intervention(e, t, st, F.col("closure_status"), F.col("transit_gain"))})


def high_population_gaps(syn: DataFrame, weight: str) -> DataFrame:
    """Populated cells with any gap, in population quartiles."""
    gap = (F.col("everyday_gap") != "NO_REQUIRED_GAP") | F.col("transit_gap").isin(*TRANSIT_GAPS)
    return o.quantile_bands(syn.where(gap & (F.col(weight) > 0)), weight, ["Q1_LOWEST_POPULATION", "Q2", "Q3", "Q4_HIGHEST_POPULATION"])


def score_overlap(df: DataFrame, group: Column, score: str, gain: Column, q: float = 0.75) -> DataFrame:
    """Share of a group among the top quartile of another score against the share expected, and a Pearson correlation."""
    d = o.with_quantiles(df.withColumn("_in", group).withColumn("_gain", gain), _lim=(score, q))
    top = F.col(score) >= F.col("_lim")
    return d.agg(
        F.count_if("_in").alias("n_group"), F.count_if(F.col("_in") & top).alias("n_group_top"), F.round(F.try_divide(F.count_if(F.col("_in") & top), F.count_if("_in")) * 100, 2).alias("pct_group_top"),
        F.round(F.count_if(top) / F.count("*") * 100, 2).alias("pct_all_top"), F.round(F.corr(score, "_gain"), 4).alias("correlation"),
    )


def gain_overlap(everyday_gain: Column, transit_gain: Column) -> Column:
    return F.when(everyday_gain & transit_gain, "BOTH_GAINS").when(everyday_gain, "EVERYDAY_NEEDS_GAIN_ONLY").when(transit_gain, "TRANSIT_GAIN_ONLY").otherwise("NO_CYCLING_GAIN")


def convergence(intervention_class: Column, readiness_class: Column) -> Column:
    gain = intervention_class.isin("CYCLING_CLOSES_EVERYDAY_GAP", "CYCLING_CLOSES_TRANSIT_GAP", "CYCLING_CLOSES_BOTH")
    ready = readiness_class.isin("ROBUST_HIGH", "FREQUENT_HIGH")
    return F.when(gain & ready, "BOTH_SIGNALS").when(gain, "ACCESSIBILITY_GAIN_ONLY").when(ready, "HIGH_EBIKE_READINESS_ONLY").otherwise("NEITHER")


def confidence(walk_flag: Column, cycle_flag: Column, feed_quality: Column) -> Column:
    special = (walk_flag == "KNOWN_NETWORK_LIMITATION") | (cycle_flag == "KNOWN_NETWORK_LIMITATION")
    net = ~walk_flag.isin(*RELIABLE_FLAGS) | ~cycle_flag.isin(*RELIABLE_FLAGS)
    feed = feed_quality != "GOOD_COVERAGE"
    return F.when(special, "KNOWN_SPECIAL_CASE").when(net & feed, "MULTIPLE_LIMITATIONS").when(net, "NETWORK_LIMITATION").when(feed, "TRANSIT_DATA_LIMITATION").otherwise("RELIABLE")


def sanity_cases(df: DataFrame, cases: Mapping[str, Column], weight: str, key: str) -> DataFrame:
    """The most populous row of each named predicate (lowest key on a tie)."""
    hit = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in cases.items()]))
    long = df.select(key, weight, F.explode(hit).alias("case"))
    return o.first_row(long, ["case"], [-F.col(weight), F.col(key)])


def reconcile_kpis(stored: DataFrame, live: DataFrame, tol: float = 0.01) -> DataFrame:
    """kpi, stored, live, matches; a value on one side only does not match."""
    j = stored.select("kpi", F.col("value").alias("stored")).join(live.select("kpi", F.col("value").alias("live")), "kpi", "full_outer")
    return j.withColumn("matches", F.coalesce(F.abs(F.col("stored") - F.col("live")) <= tol, F.lit(False)))


def consistency_suite(syn: DataFrame, source: DataFrame, weight: str) -> DataFrame:
    """Cross-table invariants as (check, n_checked, n_bad, passed); every check is an aggregate."""
    rel = F.col("everyday_reliable")
    everyday_bad = rel & ((F.col("everyday_gap") == "NO_REQUIRED_GAP") != F.col("walk_complete"))
    full = F.col("closure_status") == "FULLY_CLOSED_BY_CYCLING"
    cyc = within("cycle_food", 15) & within("cycle_healthcare", 15) & within("cycle_education", 15)
    closed_bad = full & (F.col("walk_complete") | ~(cyc | (s.count_true([m & ~within(f"cycle_{n.lower()}", 15) for n, m in missing("walk").items()]) == 0)))
    unsure = ~F.col("transit_reliable")
    unsure_bad = unsure & F.col("transit_gap").isin(*TRANSIT_GAPS, "NO_TRANSIT_ACCESS_GAP")
    same_gap_bad = F.col("transit_reliable") & (F.col("transit_gap") != mapped_transit_gap(F.col("gap_class"), F.lit("RELIABLE")))
    checks = {
        "A_no_gap_matches_complete_access": (rel, everyday_bad),
        "B_fully_closed_is_cycle_gain": (full, closed_bad),
        "C_transit_gap_reproduced": (F.col("transit_reliable"), same_gap_bad),
        "E_no_uncertain_counted": (unsure, unsure_bad),
        "G_limited_cells_not_strict": (~rel, ~rel & F.col("strict_reliable")),
    }
    one = syn.agg(*[x for n, (base, bad) in checks.items() for x in (F.count_if(base).alias(f"{n}_n"), F.count_if(bad).alias(f"{n}_bad"))])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"{n}_n").alias("n_checked"), F.col(f"{n}_bad").alias("n_bad")) for n in checks])))
    totals = source.agg(F.count("*").alias("n"), F.sum(weight).alias("w"), F.count_if(F.col("walk_food").isNull()).alias("nulls"))
    mine = syn.agg(F.count("*").alias("n_checked"), F.sum(weight).alias("w"), F.count_if(F.col("walk_food").isNull()).alias("nulls")).withColumn("_s", o.scalar_row(totals))
    d = mine.select(F.lit("D_population_totals_reconcile").alias("check"), "n_checked", F.when(F.abs(F.col("w") - F.col("_s.w")) < 1.0, 0).otherwise(1).cast("long").alias("n_bad"))
    f = mine.select(F.lit("F_no_silent_zero_fill").alias("check"), "n_checked", F.abs(F.col("nulls") - F.col("_s.nulls")).alias("n_bad"))
    return rows.unionByName(d).unionByName(f).withColumn("passed", F.col("n_bad") == 0)


def freeze_decision(universe_pct: DataFrame, checks: DataFrame, n_cliffs: DataFrame, max_drift: float = 2.0) -> DataFrame:
    """One row: drift between universes, all checks passed, no cliffs, decision."""
    u = universe_pct.agg((F.max("pct") - F.min("pct")).alias("drift"))
    c = checks.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("ok"))
    k = n_cliffs.agg(F.count_if("is_cliff").alias("k"))
    r = u.withColumn("all_checks_pass", c.scalar()).withColumn("n_cliffs", k.scalar()).withColumn("is_quality_robust", F.col("drift") < max_drift)
    good = F.col("all_checks_pass") & F.col("is_quality_robust") & (F.col("n_cliffs") == 0)
    return r.withColumn("drift", F.round("drift", 2)).withColumn("decision", F.when(good, "VALIDATED_WITH_DOCUMENTED_LIMITATIONS").otherwise("REQUIRES_CORRECTION"))


def access_points(stops: DataFrame) -> DataFrame:
    """stop_id__mode keys with their system flags; the key is unique per (stop, mode)."""
    fixed = F.col("mode_name").isin("metro", "tram", "rail", "metrobus")
    p = stops.select(F.concat(F.col("stop_id").cast("string"), F.lit("__"), "mode_name").alias("access_point_id"), "mode_name", "district", fixed.alias("in_system_b")).dropDuplicates(["access_point_id"])
    return p.withColumn("in_system_a", F.lit(True))
