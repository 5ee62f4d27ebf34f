"""Feature screening, scaling, clustering diagnostics."""

from pyspark.sql import functions as F

from gridreach.operators import clustering as cl
from gridreach.operators import ordered as o
from gridreach.operators import screening as sc
from gridreach.operators import summary as sm
from gridreach.plans.q_f_aggregates import FEATS, LONG_F, LONG_L, SKEW
from gridreach.plans.registry import query

CORR = ["n_poi", "sum_size", "n_trip", "trip_value", "n_stop", "pop", "elev"]


def _rk(c, cond):
    return f"(rank() over (order by {c})+(count(*) over (partition by {c})-1)/2e0)"


def _spearman_sql(cols, table="features"):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            parts.append(f"select '{a}' as a, '{b}' as b, count(*) as n, corr(x,y) as rho from (select {_rk(a, '')} as x, {_rk(b, '')} as y from {table} where {a} is not null and {b} is not null) t")
    return "(" + " union all ".join(parts) + ")"


@query("k1_spearman_matrix", "features", f"select a, b, n, round(rho,6) as rho, abs(round(rho,6))>=0.9 as is_redundant from {_spearman_sql(CORR)} s")
def k1(w):
    m = sc.spearman_matrix(w.features, "grid_id", CORR).withColumn("rho", F.round("rho", 6))
    return m.withColumn("is_redundant", F.abs("rho") >= 0.9)


GROUPS_SQL = f"""with recursive p as (select a, b from {_spearman_sql(CORR)} s where abs(rho)>=0.6 and a<>'pop' and b<>'pop'), e as (select a, b from p union select b, a from p), r as (select a as x, a as y from e union select r.x, e.b from r join e on r.y=e.a),
 c as (select x, min(y) as comp from r group by 1), k as (select *, row_number() over (partition by comp order by case x when 'trip_value' then 0 else 1 end, case when x like '%density%' or x like '%ratio%' or x like '%calibrated%' then 0 else 1 end, length(x), x) as rn from c)"""


@query("k2_redundancy_groups", "features", GROUPS_SQL + " select string_agg(x, ',' order by x) as members, cast(count(*) as integer) as n_members, max(case when rn=1 then x end) as representative, string_agg(case when rn>1 then x end, ',' order by x) as to_drop from k group by comp")
def k2(w):
    return groups(w)


def groups(w):
    pairs = sc.redundant_pairs(sc.spearman_matrix(w.features, "grid_id", CORR), 0.6)
    return sc.redundancy_groups(pairs, ["pop"], ["trip_value"])


_ORD = ", ".join(f"('{c}', {i})" for i, c in enumerate(CORR))


@query(
    "k3_screen_pairs", "features",
    f"""with s as (select * from {_spearman_sql(CORR)} t where abs(rho)>0.6), o(f, i) as (values {_ORD}), pref as (select 'n_trip' as dropped, 'trip_value' as kept where exists (select 1 from s where (a='n_trip' and b='trip_value') or (a='trip_value' and b='n_trip'))),
    sweep as (select s.b as dropped, arg_min(s.a, o.i) as kept from s join o on o.f=s.a where s.a not in (select dropped from pref) and s.b not in (select dropped from pref) group by 1) select * from pref union all select * from sweep""",
)
def k3(w):
    d = sc.screen_pairs(sc.spearman_matrix(w.features, "grid_id", CORR), CORR, [("trip_value", "n_trip")], 0.6)
    return w.spark.createDataFrame(sorted(d.items()), "dropped string, kept string")


@query("k4_log1p_if_improves", "features", f"select grid_id, round(case when abs(l)<abs(r) then ln(1+sum_size) else sum_size end,6) as v from features, (select (select {SKEW} from (select sum_size as value, avg(sum_size) over () as m from features) a) as r, (select {SKEW} from (select ln(1+sum_size) as value, avg(ln(1+sum_size)) over () as m from features) b) as l) t")
def k4(w):
    return sc.log1p_if_improves(w.features.select("grid_id", "sum_size"), "sum_size", "v").select("grid_id", F.round("v", 6).alias("v"))


@query("k4b_log1p_table", "features", f"select feature, round(r,5) as skew_raw, round(l,5) as skew_log1p, case when abs(l)<abs(r) then 'log1p' else 'keep_raw' end as recommendation from (select feature, min(value) as mn, avg((value-m)**3)/sqrt(avg((value-m)**2))**3 as r, avg((ln(1+greatest(value,0))-lm)**3)/sqrt(avg((ln(1+greatest(value,0))-lm)**2))**3 as l from (select *, avg(value) over (partition by feature) as m, avg(ln(1+greatest(value,0))) over (partition by feature) as lm from {LONG_F} f where value is not null and feature<>'n_stop') g group by 1) h where mn>=0 and r>0.3")
def k4b(w):
    # a 0/1 column has the same skewness before and after the log up to rounding, so it is left out
    t = sc.log1p_table(w.features, [c for c in FEATS if c != "n_stop"], 0.3)
    return t.withColumn("skew_raw", F.round("skew_raw", 5)).withColumn("skew_log1p", F.round("skew_log1p", 5))


def _rs(c):
    return f"({c}-(select median({c}) from features))/(select case when quantile_cont({c},0.75)=quantile_cont({c},0.25) then 1e0 else quantile_cont({c},0.75)-quantile_cont({c},0.25) end from features)"


@query("k5_robust_scale", "features", "select grid_id, " + ", ".join(f"round({_rs(c)},6) as {c}" for c in ("n_poi", "sum_size", "n_stop", "pop", "noise")) + " from features")
def k5(w):
    cols = ["n_poi", "sum_size", "n_stop", "pop", "noise"]
    return sc.robust_scale(w.features.select("grid_id", *cols), cols).select("grid_id", *[F.round(c, 6).alias(c) for c in cols])


@query("k6_winsorize", "features", "select grid_id, round(least(sum_size,(select quantile_cont(sum_size,0.99) from features)),6) as v from features")
def k6(w):
    return sc.winsorize(w.features.select("grid_id", "sum_size"), "sum_size", "v").select("grid_id", F.round("v", 6).alias("v"))


@query("k7_quantile_uniform", "features", "select grid_id, round(case when lo=0 then 0 when hi=n-1 then 1 else (lo+hi)/2e0/(n-1) end,8) as u from (select grid_id, rank() over (order by pop)-1 as lo, rank() over (order by pop)+count(*) over (partition by pop)-2 as hi, count(*) over () as n from features) t")
def k7(w):
    return sc.quantile_uniform(w.features.select("grid_id", "pop"), "pop", "u").select("grid_id", F.round("u", 8).alias("u"))


def _two(cond, col):
    """Median, IQR (0 read as 1) and smallest scaled value of the log among the active rows."""
    v = f"ln(1+{col})"
    return f"""q0 as (select median({v}) as m, quantile_cont({v},0.75)-quantile_cont({v},0.25) as d, min({v}) as mn from features where {cond}), q as (select m, case when d=0 then 1e0 else d end as iqr, (mn-m)/case when d=0 then 1e0 else d end as low from q0)"""


@query("k8_two_part", "features", f"with {_two('sum_size>0', 'sum_size')} select grid_id, case when sum_size>0 then 1e0 else 0e0 end as has_sum_size, round(case when sum_size>0 then (ln(1+sum_size)-m)/iqr else low-1 end,6) as sum_size_intensity from features, q")
def k8(w):
    return sc.two_part(w.features.select("grid_id", "sum_size"), "sum_size").select("grid_id", "has_sum_size", F.round("sum_size_intensity", 6).alias("sum_size_intensity"))


@query("k9_three_state", "features", f"with {_two('n_trip>3 and sum_size>0', 'sum_size')} select grid_id, round(case when n_trip>3 and sum_size>0 then (ln(1+sum_size)-m)/iqr when n_trip>3 then low-1 else low-2 end,6) as sum_size_state3 from features, q")
def k9(w):
    return sc.three_state(w.features.select("grid_id", "sum_size", "n_trip"), "sum_size", F.col("n_trip") > 3).select("grid_id", F.round("sum_size_state3", 6).alias("sum_size_state3"))


@query("k10_mask_undefined", "features", "select grid_id, case when n_poi<>0 then sum_size end as sum_size, case when n_trip<>0 then trip_value end as trip_value from features")
def k10(w):
    return sc.mask_undefined(w.features, {"sum_size": "n_poi", "trip_value": "n_trip"}).select("grid_id", "sum_size", "trip_value")


@query(
    "k11_scaling_risk", "features",
    f"""with a as (select feature, count(*) as n, round(count(case when value=0 then 1 end)*100e0/count(*),2) as pct_zero, median(value) as median, quantile_cont(value,0.75)-quantile_cont(value,0.25) as iqr, quantile_cont(case when value<>0 then value end,0.75)-quantile_cont(case when value<>0 then value end,0.25) as nonzero_iqr,
    greatest(max(value)-median(value),median(value)-min(value)) as far, {SKEW} as skew from (select *, avg(value) over (partition by feature) as m from {LONG_F} f where value is not null) g group by 1)
    select feature, n, pct_zero, round(median,6) as median, round(iqr,6) as iqr, round(nonzero_iqr,6) as nonzero_iqr, round(case when iqr>0 then far/iqr end,6) as max_abs_scaled, round(skew,5) as skew,
    coalesce(nullif(concat_ws('+', case when pct_zero>=40 then 'LARGE_ZERO_MASS' end, case when nonzero_iqr>0 and iqr>0 and nonzero_iqr/nullif(iqr,0)<0.05 then 'TINY_NONZERO_IQR' end, case when iqr=0 then 'ZERO_IQR' end, case when iqr>0 and far/iqr>20 then 'EXTREME_MAGNITUDE' end, case when abs(skew)>3 then 'HIGH_SKEW' end),''),'NONE') as risk_flags from a""",
)
def k11(w):
    r = sc.scaling_risk(w.features, FEATS)
    d = {"median": 6, "iqr": 6, "nonzero_iqr": 6, "max_abs_scaled": 6, "skew": 5}
    return r.select(*[F.round(c, d[c]).alias(c) if c in d else c for c in r.columns])


@query(
    "k12_reduced_set", "features",
    GROUPS_SQL + f""", d as (select feature, abs(avg(value))>1e-9 and stddev_samp(value)/abs(avg(value))<0.05 and count(case when value=0 then 1 end)*100e0/count(value)<50 as flat from {LONG_F} f group by 1),
    z as (select feature, case when feature='pop' then case when flat then 'NEAR_CONSTANT' end when feature in (select x from k where rn>1) then 'REDUNDANT' when feature='noise' then 'NOT_A_FEATURE' when flat then 'NEAR_CONSTANT' end as exclusion_reason from d) select feature, exclusion_reason is null as included, exclusion_reason from z""",
)
def k12(w):
    return sc.reduced_set(sm.describe_audit(w.features, FEATS), groups(w), ["pop"], {"noise": "NOT_A_FEATURE"})


@query("k13_pca_summary", "features")
def k13(w):
    return sc.pca_summary(w.features, ["n_poi", "sum_size", "n_trip", "trip_value", "n_stop", "pop", "noise"])


MCOLS = ["n_poi", "sum_size", "n_trip", "n_stop", "pop"]


def scaled(w):
    return sc.robust_scale(w.features.select("grid_id", *MCOLS), MCOLS)


@query("l1_kmeans_sweep", "features")
def l1(w):
    return cl.kmeans_sweep(cl.matrix(scaled(w), "grid_id", MCOLS), "grid_id", range(3, 11), [42, 1, 7, 123, 2024], n_init=10)


LLOYD_STEPS, LLOYD_COLS = 6, ("n_poi", "pop", "n_trip")


def _lloyd_sql():
    """Lloyd steps written out: three centres that begin at given cells, then as many means of the nearest rows."""
    pick = "c0 as (select cast(row_number() over (order by grid_id)-1 as integer) as c, " + ", ".join(f"{x} as m_{x}" for x in LLOYD_COLS) + " from features where grid_id in (45, 333, 777))"
    far = "+".join(f"(f.{x}-c.m_{x})*(f.{x}-c.m_{x})" for x in LLOYD_COLS)
    near = lambda i: f"select grid_id, arg_min(c, (round({far},9), c)) as c, min({far}) as d from features f, c{i} c group by 1"
    steps = [f"c{i + 1} as (select n.c, {', '.join(f'avg({x}) as m_{x}' for x in LLOYD_COLS)} from ({near(i)}) n join features using (grid_id) group by 1)" for i in range(LLOYD_STEPS)]
    return f"with {pick}, {', '.join(steps)}, e as ({near(LLOYD_STEPS)}) select e.c as label, count(*) as n, round(sum(d),4) as cost, {', '.join(f'round(any_value(m_{x}),6) as {x}' for x in LLOYD_COLS)} from e join c{LLOYD_STEPS} c using (c) group by 1"


@query("l1b_lloyd_steps", "features", _lloyd_sql())
def l1b(w):
    cols = list(LLOYD_COLS)
    m = cl.matrix(w.features.select("grid_id", *cols), "grid_id", cols)
    first = w.features.where(F.col("grid_id").isin(45, 333, 777)).orderBy("grid_id").select(*cols).collect()
    fit = cl.lloyd.CentreSet(3, 0, 0, cl.np.array([tuple(r) for r in first], float))
    cl.lloyd.fit(m, "grid_id", [fit], LLOYD_STEPS, 0.0)
    centres = w.spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(fit.centres)], "label int, " + ", ".join(f"m_{c} double" for c in cols))
    rows = cl.lloyd.labels(m, "grid_id", fit).join(w.features.select("grid_id", *cols), "grid_id").join(F.broadcast(centres), "label")  # one row a centre
    cost = sum((F.col(c) - F.col(f"m_{c}")) ** 2 for c in cols)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(cost), 4).alias("cost"), *[F.round(F.first(f"m_{c}"), 6).alias(c) for c in cols])


@query("l2_gaussian_mixture", "features")
def l2(w):
    labels, bic = cl.gmm_fit(cl.matrix(scaled(w), "grid_id", MCOLS), "grid_id", 3, 42, len(MCOLS))
    return labels.groupBy("label").agg(F.count("*").alias("n")).withColumn("bic", F.lit(bic))


@query("l3_bisecting", "features")
def l3(w):
    return cl.bisecting_labels(cl.matrix(scaled(w), "grid_id", MCOLS), "grid_id", 4)


EMB = "(select vec_id, label, cast(embedding as double[]) as v from embeddings)"


@query(
    "l4_silhouette", "",
    f"""with d as (select a.vec_id, a.label as la, b.label as lb, sum(greatest(list_sum(list_transform(list_zip(a.v,b.v), lambda z: (z[1]-z[2])*(z[1]-z[2]))),0)) as t, count(*) as n from {EMB} a, {EMB} b group by 1,2,3),
    s as (select vec_id, max(case when la=lb then t/(n-1) end) as a, min(case when la<>lb then t/n end) as b from d group by 1) select count(*) as n, round(avg((b-a)/greatest(a,b)),6) as silhouette from s""",
)
def l4(w):
    e = w.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    return cl.silhouette(e, "vec", "label").withColumn("silhouette", F.round("silhouette", 6))


@query(
    "l5_ch_db", "",
    f"""with l as (select vec_id, label, unnest(v) as x, generate_subscripts(v,1) as i from {EMB} e), c as (select label, i, avg(x) as m, count(*) as n from l group by 1,2), g as (select i, avg(x) as gm from l group by 1),
    w as (select l.vec_id, l.label, sum((x-m)**2) as d2 from l join c using (label, i) group by 1,2), s as (select label, sum(d2) as ss, avg(sqrt(d2)) as sp, count(*) as n from w group by 1), b as (select sum(n*(m-gm)**2) as bss from c join g using (i)),
    p as (select a.label as x, e.label as y, sqrt(sum((a.m-e.m)**2)) as dd from c a join c e on a.i=e.i and a.label<>e.label group by 1,2), r as (select x, max((s1.sp+s2.sp)/dd) as r from p join s s1 on s1.label=x join s s2 on s2.label=y group by 1)
    select cast((select count(*) from s) as integer) as k, cast((select sum(n) from s) as bigint) as n, round(((select bss from b)/((select count(*) from s)-1))/((select sum(ss) from s)/((select sum(n) from s)-(select count(*) from s))),5) as calinski_harabasz, round((select avg(r) from r),6) as davies_bouldin""",
)
def l5(w):
    e = w.embeddings.select(F.col("embedding").cast("array<double>").alias("vec"), "label")
    return cl.ch_db(e, "vec", "label").withColumn("calinski_harabasz", F.round("calinski_harabasz", 5)).withColumn("davies_bouldin", F.round("davies_bouldin", 6))


@query("l6_size_balance", "cell_labels", "select count(*) as k, round(min(n)*100e0/sum(n),2) as min_pct, round(max(n)*100e0/sum(n),2) as max_pct, round(max(n)*1e0/min(n),2) as size_ratio from (select lb, count(*) as n from cell_labels group by 1) t")
def l6(w):
    return cl.size_balance(w.cell_labels, "lb")


@query(
    "l7_ari_nmi", "cell_labels",
    """with t as (select la, lb, count(*)*1e0 as n from cell_labels group by 1,2), a as (select sum(n) as n from t group by la), b as (select sum(n) as n from t group by lb), s as (select (select sum(n*(n-1)/2) from t) as i, (select sum(n*(n-1)/2) from a) as pa, (select sum(n*(n-1)/2) from b) as pb, (select sum(n) from t) as n,
    (select sum(n*ln(n)) from t) as lt, (select sum(n*ln(n)) from a) as l1, (select sum(n*ln(n)) from b) as l2)
    select round((i-pa*pb/(n*(n-1)/2))/((pa+pb)/2-pa*pb/(n*(n-1)/2)),8) as ari, round(2*(ln(n)+(lt-l1-l2)/n)/(2*ln(n)-(l1+l2)/n),8) as nmi from s""",
)
def l7(w):
    return cl.ari_nmi(w.cell_labels, "la", "lb").select(F.round("ari", 8).alias("ari"), F.round("nmi", 8).alias("nmi"))


@query(
    "l8_best_match", "cell_labels",
    """with t as (select la, lb, count(*) as n from cell_labels group by 1,2), r as (select a.lb as b0, a.la as x0, b.la as x1, c.la as x2, d.la as x3, a.n+b.n+c.n+d.n as tot from t a, t b, t c, t d where a.lb=0 and b.lb=1 and c.lb=2 and d.lb=3 and a.la not in (b.la,c.la,d.la) and b.la not in (c.la,d.la) and c.la<>d.la order by tot desc limit 1),
    p as (select unnest([0,1,2,3]) as lb, unnest([x0,x1,x2,x3]) as la from r) select cast(lb as bigint) as lb, la, n as overlap, round(100e0*sum(n) over ()/(select count(*) from cell_labels),2) as pct_retained from p join t using (la, lb)""",
)
def l8(w):
    return cl.best_match(w.cell_labels, "la", "lb")


@query(
    "l9_split_transitions", "cell_labels",
    """with t as (select la, lb, count(*) as n, row_number() over (partition by la order by count(*) desc, lb) as rn, sum(count(*)) over (partition by la) as size from cell_labels group by 1,2), g as (select la, cast(any_value(size) as bigint) as size, max(case when rn=1 then lb end) as first_child, max(case when rn=1 then n end)*1e0/any_value(size) as s1, max(case when rn=2 then lb end) as second_child, coalesce(max(case when rn=2 then n end)*1e0/any_value(size),0) as s2 from t group by 1)
    select la, size, first_child, round(s1,4) as first_share, second_child, round(s2,4) as second_share, case when s1>=0.9 then 'COHERENT_CARRYOVER' when s1+s2>=0.9 and s2>=0.15 then 'CLEAN_SPLIT' else 'DISPERSED' end as kind, size*1e0/(select count(*) from cell_labels)<0.03 as is_tiny from g""",
)
def l9(w):
    return cl.split_transitions(w.cell_labels, "la", "lb")


LFEATS = ["n_poi", "n_trip", "sum_size", "noise"]


@query(
    "l10_percentile_gap", "cell_labels",
    f"""with q as (select la, feature, median(value) as med from {LONG_L} l where la in (0,1,2) group by 1,2), p as (select la, feature, round((select (count(case when l.value<q.med then 1 end)+count(case when l.value<=q.med then 1 end))*50e0/count(*) from {LONG_L} l where l.feature=q.feature),1) as pct from q)
    select feature, round(max(pct)-min(pct),1) as percentile_gap, round(max(pct)-min(pct),1)>=15 as is_meaningful from p group by 1""",
)
def l10(w):
    return cl.percentile_gap(w.cell_labels, LFEATS, "la", [0, 1, 2])


@query("l11_ablation", "features")
def l11(w):
    return cl.ablation(scaled(w), "grid_id", MCOLS, {"no_demand": ["n_trip"], "no_places": ["n_poi", "sum_size"]}, 3, n_init=10)


DIAG = "(select 'raw' as representation, 'kmeans' as algorithm, la+2 as k, round(0.9e0-la*0.05,4) as silhouette, 100e0+la*37+count(*)%50 as calinski_harabasz, round(0.95e0-la*0.2,4) as largest_share from cell_labels group by la union all select 'pca', 'mixture', la+2, round(0.8e0-la*0.02,4), 90e0+la*11, round(0.5e0,4) from cell_labels group by la)"


@query("l12_select_best", "cell_labels", f"with v as (select * from {DIAG} d), t as (select * from v order by silhouette desc, representation, algorithm, k limit 1), s as (select v.* from v, t where t.largest_share>0.8 and v.k>=3 and v.silhouette>=t.silhouette-0.15 order by v.calinski_harabasz desc, v.representation, v.algorithm, v.k limit 1) select *, 'secondary_calinski_harabasz' as chosen_via from s")
def l12(w):
    g = w.cell_labels.groupBy("la").agg(F.count("*").alias("n"))
    a = g.select(F.lit("raw").alias("representation"), F.lit("kmeans").alias("algorithm"), (F.col("la") + 2).alias("k"), F.round(0.9 - F.col("la") * 0.05, 4).alias("silhouette"), (100.0 + F.col("la") * 37 + F.col("n") % 50).alias("calinski_harabasz"), F.round(0.95 - F.col("la") * 0.2, 4).alias("largest_share"))
    b = g.select(F.lit("pca").alias("representation"), F.lit("mixture").alias("algorithm"), (F.col("la") + 2).alias("k"), F.round(0.8 - F.col("la") * 0.02, 4).alias("silhouette"), (90.0 + F.col("la") * 11).alias("calinski_harabasz"), F.lit(0.5).alias("largest_share"))
    return cl.select_best(a.unionByName(b))


@query("l13_label_change", "cell_labels", "select district, count(*) as n_cells, count(case when la<>lb then 1 end) as n_changed, round(count(case when la<>lb then 1 end)*100e0/count(*),2) as pct_changed from cell_labels group by 1")
def l13(w):
    return cl.label_change(w.cell_labels, "la", "lb", "district")


@query(
    "l13b_change_by_context", "cell_labels",
    """with d as (select *, sqrt((ix-(select avg(ix) from cell_labels))**2+(iy-(select avg(iy) from cell_labels))**2) as dd from cell_labels), q as (select quantile_cont(dd,1/3e0) as a, quantile_cont(dd,2/3e0) as b from d)
    select case when dd<=a then 'core' when dd<=b then 'intermediate' else 'peripheral' end as context, count(*) as n_cells, count(case when la<>lb then 1 end) as n_changed, round(count(case when la<>lb then 1 end)*100e0/count(*),2) as pct_changed from d, q group by 1""",
)
def l13b(w):
    return cl.change_by_context(w.cell_labels, "la", "lb")


@query("l13c_top_transitions", "cell_labels", "select la, lb, count(*) as n_cells from cell_labels group by 1,2 order by n_cells desc, la, lb limit 20")
def l13c(w):
    return cl.top_transitions(w.cell_labels, "la", "lb")


@query(
    "l13d_changed_vs_stable", "cell_labels",
    """with l as (select la, la<>lb as ch, 'n_poi' as feature, n_poi as v from cell_labels union all select la, la<>lb, 'n_trip', n_trip from cell_labels union all select la, la<>lb, 'noise', noise from cell_labels)
    select la, feature, median(case when ch then v end) as median_changed, median(case when not ch then v end) as median_stable, count(case when ch then 1 end) as n_changed, count(case when not ch then 1 end) as n_stable from l group by 1,2 having count(case when ch then 1 end)>=20 and count(case when not ch then 1 end)>=20""",
)
def l13d(w):
    return cl.changed_vs_stable(w.cell_labels, "la", "lb", ["n_poi", "n_trip", "noise"])
