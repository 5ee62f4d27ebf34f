"""Multi-criteria scoring and sensitivity."""

from pyspark.sql import functions as F

from gridreach.functions import scalars as s
from gridreach.operators import scoring as so
from gridreach.operators import screening as sc
from gridreach.plans.q_c_joins import LONG_SCORES, VARIANTS
from gridreach.plans.q_f_aggregates import LONG_L
from gridreach.plans.registry import query

SPEC = {
    "demand": [("n_poi", "benefit"), ("n_trip", "benefit"), ("pop", "linear")],
    "transit": [("n_stop", "benefit"), ("noise", "cost")],
    "cycling": [("sum_size", "benefit"), ("noise", "linear")],
    "street": [("sum_size", "linear"), ("n_poi", "linear")],
    "terrain": [("terrain_raw", "raw")],
}
WEIGHTS = {"demand": 0.2, "transit": 0.2, "cycling": 0.2, "street": 0.2, "terrain": 0.2}


def dims(w):
    f = w.features.withColumn("terrain_raw", s.piecewise_cost(F.col("elev") / 10, 3.0, 14.0, 0.5))
    return so.dimension_scores(f, "grid_id", SPEC, ["district"])


R = "(select grid_id, district, percent_rank() over (order by n_poi) as p, percent_rank() over (order by n_trip) as t, percent_rank() over (order by pop) as o, percent_rank() over (order by n_stop) as s, percent_rank() over (order by noise) as n, percent_rank() over (order by sum_size) as z, case when elev/10<=3 then 1e0 when elev/10<=14 then 1-(elev/10-3)/11*0.5 when elev/10>14 then 0.5e0 end as e from features)"
DIMS = f"(select grid_id, district, (sqrt(p)+sqrt(t)+o)/3 as demand, (sqrt(s)+sqrt(1-n))/2 as transit, (sqrt(z)+n)/2 as cycling, (z+p)/2 as street, e as terrain from {R} r)"


@query("m1_dimension_scores", "features", f"select grid_id, district, round(demand,6) as demand, round(transit,6) as transit, round(cycling,6) as cycling, round(street,6) as street, round(terrain,6) as terrain from {DIMS} d")
def m1(w):
    return dims(w).select("grid_id", "district", *[F.round(c, 6).alias(c) for c in SPEC])


@query("m2_readiness", "features", f"select grid_id, round((transit+cycling+street+coalesce(terrain,0.5e0))/4,6) as readiness from {DIMS} d")
def m2(w):
    d = dims(w).na.fill(0.5, ["terrain"])
    return d.select("grid_id", F.round(so.readiness(WEIGHTS), 6).alias("readiness"))


@query("m3_opportunity", "features", f"select grid_id, round(sqrt(demand)*sqrt(1-cycling),6) as opportunity from {DIMS} d")
def m3(w):
    return dims(w).select("grid_id", F.round(so.opportunity(F.col("demand"), 1 - F.col("cycling"), WEIGHTS), 6).alias("opportunity"))


def _scn(col):
    parts = []
    for n, x in so.SCENARIOS.items():
        tot = x["urban_form"] + x["transit"] + x["cycling"] + x["terrain"]
        for v, tr in (("t1", "transit"), ("t2", "street")):
            a = x["demand"] / (x["demand"] + x["cycling"])
            parts.append(
                f"select grid_id, '{n}' as scenario, '{v}' as variant, round((street*{x['urban_form']}e0+{tr}*{x['transit']}e0+cycling*{x['cycling']}e0+terrain*{x['terrain']}e0)/{tot!r}e0,6) as readiness, round(pow(demand,{a!r}e0)*pow(1-cycling,1-{a!r}e0),6) as opportunity from d"
            )
    return " union all ".join(parts)


@query("m4_scenario_scores", "features", f"with d as (select grid_id, demand, transit, cycling, street, coalesce(terrain,0.5e0) as terrain from {DIMS} x) " + _scn(""))
def m4(w):
    d = dims(w).na.fill(0.5, ["terrain"]).withColumn("gap", 1 - F.col("cycling"))
    v = {"t1": {"urban_form": "street"}, "t2": {"urban_form": "street", "transit": "street"}}
    r = so.scenario_scores(d, "grid_id", so.SCENARIOS, v, "gap")
    return r.withColumn("readiness", F.round("readiness", 6)).withColumn("opportunity", F.round("opportunity", 6))


def variants(w):
    d = dims(w).na.fill(0.5, ["terrain"]).withColumn("gap", 1 - F.col("cycling")).withColumn("gap_alt", 1 - F.col("street"))
    no_street = {k: v for k, v in WEIGHTS.items() if k != "street"}
    vs = {
        "NO_STREET": (no_street, {}),
        "NO_GRADE": (WEIGHTS, {"terrain": "demand"}),
        "EXPANDED_TRANSIT": (WEIGHTS, {"transit": "street"}),
        "ALTERNATIVE_CYCLING": (WEIGHTS, {"cycling": "street", "gap": "gap_alt"}),
        "WEIGHT_PERTURBATION": (so.PERTURBED, {}),
    }
    return so.sensitivity_variants(d, "grid_id", WEIGHTS, vs, "gap")


V = f"""(select grid_id, (transit+cycling+street+terrain)/4 as r0, (transit+cycling+terrain)/3 as r1, (transit+cycling+street+demand)/4 as r2, (street+cycling+street+terrain)/4 as r3, (transit+street+street+terrain)/4 as r4, (transit*0.2e0+cycling*0.24e0+street*0.24e0+terrain*0.16e0)/0.84e0 as r5,
 sqrt(demand)*sqrt(1-cycling) as o0, sqrt(demand)*sqrt(1-street) as o4, pow(demand,0.4e0)*pow(1-cycling,0.6e0) as o5 from (select grid_id, demand, transit, cycling, street, coalesce(terrain,0.5e0) as terrain from {DIMS} x) d)"""
NAMES = ["BASELINE", "NO_STREET", "NO_GRADE", "EXPANDED_TRANSIT", "ALTERNATIVE_CYCLING", "WEIGHT_PERTURBATION"]


@query("m5_sensitivity_variants", "features", "select grid_id, " + ", ".join(f"round(r{i},6) as readiness__{n}, round({('o4' if i == 4 else 'o5' if i == 5 else 'o0')},6) as opportunity__{n}" for i, n in enumerate(NAMES)) + f" from {V} v")
def m5(w):
    v = variants(w)
    return v.select("grid_id", *[F.round(c, 6).alias(c) for c in v.columns[1:]])


def _pair_sql(table, cols, base_only=False):
    """Spearman, Jaccard, differences for pairs of columns of a SQL table."""
    long = "(" + " union all ".join(f"select grid_id, {i} as i, '{n}' as v, {c} as s from t" for i, (n, c) in enumerate(cols.items())) + ")"
    return f"""with t as (select * from {table} q), l as (select *, (rank() over (partition by v order by s)+(count(*) over (partition by v, s)-1)/2e0)/count(*) over (partition by v) as r from {long} z), th as (select v, quantile_cont(s,0.9) as q from l group by 1),
    f as (select l.*, s>=q as top from l join th using (v)), p as (select x.v as a, y.v as b, round(corr(x.r,y.r),4) as spearman, round(count(case when x.top and y.top then 1 end)*1e0/count(case when x.top or y.top then 1 end),4) as jaccard, round(avg(abs(x.s-y.s)),4) as mean_abs_diff, round(avg(abs(x.r-y.r)),4) as rank_displacement,
    count(case when y.top and not x.top then 1 end) as entries, count(case when x.top and not y.top then 1 end) as exits from f x join f y on x.grid_id=y.grid_id and x.i<y.i {'and x.i=0' if base_only else ''} group by 1,2) """


@query("m6_vs_baseline", "features", _pair_sql(f"(select grid_id, {', '.join(f'round(r{i},9) as r{i}' for i in range(6))} from {V} v)", {n: f"r{i}" for i, n in enumerate(NAMES)}, True) + " select b as variant, spearman, jaccard, mean_abs_diff from p")
def m6(w):
    v = variants(w)
    r = v.select("grid_id", *[F.round(f"readiness__{n}", 9).alias(n) for n in NAMES])
    return so.vs_baseline(r, "grid_id", "BASELINE", NAMES[1:])


PAIRS_SQL = _pair_sql("cell_scores", {v: v for v in VARIANTS})
_DIFF = "concat_ws(',', case when split_part(a,'__',1)<>split_part(b,'__',1) then 'area' end, case when split_part(a,'__',3)<>split_part(b,'__',3) then 'form' end, case when split_part(a,'__',2)<>split_part(b,'__',2) then 'shape' end)"
FACTORS = ["area", "shape", "form"]


def pairs(w):
    return so.with_differing_factors(so.pair_metrics(w.cell_scores, "grid_id", VARIANTS), FACTORS)


@query("m7_pairwise_comparison", "cell_scores", PAIRS_SQL + f" select *, {_DIFF} as differing_factors, cast(len(string_split({_DIFF},',')) as integer) as n_differing from p")
def m7(w):
    return pairs(w)


@query("m8_isolated_factor_effect", "cell_scores", PAIRS_SQL + f" select {_DIFF} as factor, count(*) as n_pairs, round(avg(spearman)+1e-12,4) as mean_spearman, round(avg(jaccard)+1e-12,4) as mean_jaccard, round(avg(mean_abs_diff)+1e-12,4) as mean_mean_abs_diff, round(avg(rank_displacement)+1e-12,4) as mean_rank_displacement from p where position(',' in {_DIFF})=0 group by 1")
def m8(w):
    return so.isolated_factor_effect(pairs(w))


STAB = f"""(select grid_id, avg(s) as mean_score, median(s) as median_score, min(s) as min_score, max(s) as max_score, stddev_pop(s) as std_score, max(s)-min(s) as range_score, avg(r) as mean_rank, stddev_pop(r) as std_rank, count(case when top then 1 end) as n_top, count(case when top then 1 end)*25e0 as pct_top from (
 select l.*, s>=q as top from (select *, (rank() over (partition by v order by s)+(count(*) over (partition by v, s)-1)/2e0)/count(*) over (partition by v) as r from {LONG_SCORES} z) l join (select v, quantile_cont(s,0.9) as q from {LONG_SCORES} z group by 1) th using (v)) f group by 1)"""
SD = {"mean_score": 6, "median_score": 6, "min_score": 6, "max_score": 6, "std_score": 5, "range_score": 6, "mean_rank": 10, "std_rank": 5}


@query("m9_cell_stability", "cell_scores", "select grid_id, " + ", ".join(f"round({c}+1e-12,{d}) as {c}" for c, d in SD.items()) + f", n_top, pct_top from {STAB} t")
def m9(w):
    st = so.cell_stability(w.cell_scores, "grid_id", VARIANTS)
    return st.select("grid_id", *[F.round(F.col(c) + 1e-12, d).alias(c) for c, d in SD.items()], "n_top", "pct_top")


_CC = "case when pct_top>=100 then 'ROBUST_HIGH' when pct_top>=75 then 'FREQUENT_HIGH' when pct_top>=25 then 'CONDITIONAL_HIGH' when pct_top>0 then 'RARE_HIGH' else 'NEVER_HIGH' end"


@query("m10_consensus_class", "cell_scores", f"select {_CC} as consensus, count(*) as n from {STAB} t group by 1")
def m10(w):
    st = so.cell_stability(w.cell_scores, "grid_id", VARIANTS)
    return st.groupBy(s.consensus_class(F.col("pct_top")).alias("consensus")).agg(F.count("*").alias("n"))


@query("m11_joint_class", "cell_scores", f"select concat(case when c in ('ROBUST_HIGH','FREQUENT_HIGH') then 'HIGH' when c='CONDITIONAL_HIGH' then 'MODERATE_SENSITIVE' else 'LOW' end, '_readiness__', case when r>=0.9 then 'HIGH' when r>=0.3 then 'MODERATE_SENSITIVE' else 'LOW' end, '_opportunity') as joint, count(*) as n from (select {_CC} as c, round(mean_score,9) as r from {STAB} t) u group by 1")
def m11(w):
    st = so.cell_stability(w.cell_scores, "grid_id", VARIANTS)
    m = F.round("mean_score", 9)
    other = F.when(m >= 0.9, "ROBUST_HIGH").when(m >= 0.3, "CONDITIONAL_HIGH").otherwise("NEVER_HIGH")
    return st.groupBy(so.joint_class(s.consensus_class(F.col("pct_top")), other).alias("joint")).agg(F.count("*").alias("n"))


META = {v: dict(zip(FACTORS, v.split("__"))) for v in VARIANTS}


@query(
    "m12_dominant_driver", "cell_scores",
    """with c as (select grid_id, t1__lin__uf0 as a, t1__sqrt__uf0 as b, t2__lin__uf0 as c, t2__sqrt__uf0 as d from cell_scores), g as (select *, (a+b+c+d)/4 as g from c), e as (select grid_id, greatest(a,b,c,d)-least(a,b,c,d) as rng, (a-g)**2+(b-g)**2+(c-g)**2+(d-g)**2 as t, 2*((a+b)/2-g)**2+2*((c+d)/2-g)**2 as s1, 2*((a+c)/2-g)**2+2*((b+d)/2-g)**2 as s2 from g),
    h as (select grid_id, rng, case when t>1e-12 then s1/t else 0 end as eta_area, case when t>1e-12 then s2/t else 0 end as eta_shape from e) select grid_id, round(eta_area,6) as eta_area, round(eta_shape,6) as eta_shape, case when rng<1e-6 then 'NO_DISAGREEMENT' when round(eta_area,9)>=round(eta_shape,9) then 'area' else 'shape' end as driver from h""",
)
def m12(w):
    d = so.dominant_driver(w.cell_scores, "grid_id", META, ["area", "shape"])
    return d.select("grid_id", F.round("eta_area", 6).alias("eta_area"), F.round("eta_shape", 6).alias("eta_shape"), "driver")


@query("m13_monte_carlo", "features")
def m13(w):
    return so.monte_carlo(dims(w).na.fill(0.5, ["terrain"]), "grid_id", list(SPEC), draws=1000)


@query("m14_latent_opportunity", "features", f"select grid_id, round((demand+transit+street)/3-cycling,6) as latent from {DIMS} d")
def m14(w):
    return dims(w).select("grid_id", F.round(so.latent_opportunity(["demand", "transit", "street"], "cycling"), 6).alias("latent"))


@query(
    "m15_pathological_cases", "access15",
    """select "case", count(*) as n_cells, round(avg(score),4) as mean_score, round(max(score),4) as max_score from (select 'zero_poi' as "case", score from access15 where n_poi=0 union all select 'zero_pop_zero_trip', score from access15 where pop<100 and n_trip<5 union all select 'unreachable', score from access15 where walk_food is null) u group by 1""",
)
def m15(w):
    cases = {"zero_poi": F.col("n_poi") == 0, "zero_pop_zero_trip": (F.col("pop") < 100) & (F.col("n_trip") < 5), "unreachable": F.col("walk_food").isNull()}
    return so.pathological_cases(w.access15, cases, ["score"])


@query("m15b_critical_check", "access15", "with q as (select quantile_cont(score,0.9) as d, quantile_cont(score,0.75) as q from access15), a as (select count(*) as n, round(count(case when score>=d then 1 end)*100e0/count(*),4) as pct_top_decile, round(count(case when score>=q then 1 end)*100e0/count(*),4) as pct_top_quartile from access15, q where n_poi=0) select *, pct_top_decile=0 and pct_top_quartile<25 as is_ok from a")
def m15b(w):
    return so.critical_check(w.access15, F.col("n_poi") == 0, "score")


@query(
    "m16_compare_versions", "cell_scores",
    """with r as (select grid_id, t1__lin__uf0 as a, t2__lin__uf0 as b, (rank() over (order by t1__lin__uf0)+(count(*) over (partition by t1__lin__uf0)-1)/2e0)/count(*) over () as ra, (rank() over (order by t2__lin__uf0)+(count(*) over (partition by t2__lin__uf0)-1)/2e0)/count(*) over () as rb from cell_scores)
    select grid_id, a as old_score, b as new_score, round(b-a,6) as change, round(ra,8) as rank_old, round(rb,8) as rank_new from r order by abs(round(b-a,12)) desc, grid_id limit 500""",
)
def m16(w):
    d = w.cell_scores.select("grid_id", F.col("t1__lin__uf0").alias("old_score"), F.col("t2__lin__uf0").alias("new_score"))
    c = so.compare_versions(d, "grid_id", "old_score", "new_score")
    return c.withColumn("change", F.round("change", 6)).withColumn("rank_old", F.round("rank_old", 8)).withColumn("rank_new", F.round("rank_new", 8))


@query("m17_group_profile", "cell_labels", f"""with g as (select 'changed' as "group", grid_id from cell_labels where la<>lb union all select 'dense', grid_id from cell_labels where n_poi>=3), l as (select grid_id, 'n_poi' as feature, n_poi as value from cell_labels union all select grid_id, 'n_trip', n_trip from cell_labels union all select grid_id, 'noise', noise from cell_labels),
    q as (select "group", feature, quantile_cont(value,0.25) as q1, median(value) as median, quantile_cont(value,0.75) as q3 from g join l using (grid_id) group by 1,2) select "group", feature, q1, median, q3, round((select (count(case when l.value<q.median then 1 end)+count(case when l.value<=q.median then 1 end))*50e0/count(*) from l where l.feature=q.feature),4) as percentile from q""")
def m17(w):
    p = so.group_profile(w.cell_labels, {"changed": F.col("la") != F.col("lb"), "dense": F.col("n_poi") >= 3}, ["n_poi", "n_trip", "noise"])
    return p.withColumn("percentile", F.round("percentile", 4))


@query("m18_criteria_audit", "cell_labels", f"select la, feature, round(median(value),6) as median from {LONG_L} l where feature in ('n_poi','n_trip','sum_size') group by 1,2")
def m18(w):
    return so.criteria_audit(w.cell_labels, ["n_poi", "n_trip", "sum_size"], "la").withColumn("median", F.round("median", 6))


@query("m18b_criteria_redundancy", "cell_labels", "select 'n_poi' as a, 'sum_size' as b, round(corr(x,y),6) as rho from (select rank() over (order by n_poi)+(count(*) over (partition by n_poi)-1)/2e0 as x, rank() over (order by sum_size)+(count(*) over (partition by sum_size)-1)/2e0 as y from cell_labels) t")
def m18b(w):
    m = sc.spearman_matrix(w.cell_labels, "grid_id", ["n_poi", "n_trip", "sum_size"])
    return sc.redundant_pairs(m, 0.8).select("a", "b", F.round("rho", 6).alias("rho"))
