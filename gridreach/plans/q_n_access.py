"""Accessibility applications and synthesis."""

from pyspark.sql import functions as F

from gridreach.functions import scalars as s
from gridreach.operators import access as ac
from gridreach.operators import graph as gr
from gridreach.operators import spatial as sp
from gridreach.operators import summary as sm
from gridreach.plans.q_c_joins import cells
from gridreach.plans.q_f_aggregates import CURVE, curve
from gridreach.plans.q_i_graph import CATS, WALK2, walk_graph
from gridreach.plans.registry import query

_W = {c: f"coalesce(walk_{c}<=15,false)" for c in ac.REQUIRED}
_C = {c: f"coalesce(cycle_{c}<=15,false)" for c in ac.REQUIRED}
_NM = "((not {food})::int+(not {healthcare})::int+(not {education})::int)".format(**_W)
_NS = "((not {0} and not {3})::int+(not {1} and not {4})::int+(not {2} and not {5})::int)".format(*_W.values(), *_C.values())
_GEN = "coalesce(walk_transit_a<=10,false) or coalesce(cycle_transit_a<=10,false)"
_FIX = "coalesce(walk_transit_b<=15,false) or coalesce(cycle_transit_b<=15,false)"
SYN = f"""(select *, case when ev='NO_REQUIRED_GAP' then false else true end as eg, tg in ('GENERAL_ACCESS_GAP','FIXED_GUIDEWAY_ACCESS_GAP','BOTH_TRANSIT_ACCESS_GAPS') as tgp from (select a.*, everyday_reliable and transit_reliable as strict,
 case when not everyday_reliable then 'UNKNOWN_OR_QUALITY_LIMITED' when {_NM}=3 then 'ALL_REQUIRED_GAP' when {_NM}=0 then 'NO_REQUIRED_GAP' else concat(concat_ws('_', case when not {_W['food']} then 'FOOD' end, case when not {_W['healthcare']} then 'HEALTHCARE' end, case when not {_W['education']} then 'EDUCATION' end),'_GAP') end as ev,
 case when not everyday_reliable then 'CYCLING_RESULT_UNCERTAIN' when {_NM}=0 then 'NOT_APPLICABLE_NO_GAP' when {_NS}=0 then 'FULLY_CLOSED_BY_CYCLING' when {_NS}<{_NM} then 'PARTIALLY_CLOSED_BY_CYCLING' else 'UNCHANGED_BY_CYCLING' end as cl,
 case when ({_GEN}) and ({_FIX}) then 'NO_TRANSIT_GAP' when {_GEN} then 'FIXED_GUIDEWAY_GAP' when {_FIX} then 'GENERAL_TRANSIT_GAP' else 'BOTH_TRANSIT_GAPS' end as gc,
 case when not transit_reliable then 'TRANSIT_DATA_UNCERTAIN' when ({_GEN}) and ({_FIX}) then 'NO_TRANSIT_ACCESS_GAP' when {_GEN} then 'FIXED_GUIDEWAY_ACCESS_GAP' when {_FIX} then 'GENERAL_ACCESS_GAP' else 'BOTH_TRANSIT_ACCESS_GAPS' end as tg,
 not coalesce(walk_transit_a<=10,false) and coalesce(cycle_transit_a<=10,false) as tgain from access15 a) b)"""
_IV = "case when not strict then 'QUALITY_UNCERTAIN' when not eg and not tgp then 'WALKING_SUFFICIENT' when cl='FULLY_CLOSED_BY_CYCLING' and tgp and tgain then 'CYCLING_CLOSES_BOTH' when cl='FULLY_CLOSED_BY_CYCLING' then 'CYCLING_CLOSES_EVERYDAY_GAP' when tgp and tgain then 'CYCLING_CLOSES_TRANSIT_GAP' when cl='PARTIALLY_CLOSED_BY_CYCLING' then 'CYCLING_PARTIAL_GAIN' else 'CYCLING_DOES_NOT_CLOSE_GAP' end"
_MD = "case when not strict then 'E_DATA_OR_NETWORK_UNCERTAIN' when not eg and not tgp then 'A_BROAD_ACCESS' when eg and not tgp then 'B_EVERYDAY_NEEDS_GAP_ONLY' when not eg then 'C_TRANSIT_ACCESS_GAP_ONLY' else 'D_BOTH_ACCESS_GAPS' end"


def summary_sql(col, src, name):
    return f"select {name}, n, round(n*100e0/sum(n) over (),2) as pct_n, round(w,1) as w, round(w*100/sum(w) over (),2) as pct_w from (select {col} as {name}, count(*) as n, sum(pop) as w from {src} z group by 1) t"


def syn(w):
    return ac.synthesis(w.access15)


def _prox():
    out = ["grid_id"]
    for m in (5, 10, 15):
        n = "+".join(f"coalesce(walk_{c}<={m},false)::int" for c in ac.REQUIRED)
        out += [f"cast({n}+coalesce(walk_transit_a<={m},false)::int as bigint) as n_categories_{m}", f"cast({n} as bigint) as n_required_{m}", f"{n}=3 as is_complete_{m}", f"round_even(({n})/3e0,4) as required_ratio_{m}"]
    return ", ".join(out)


@query("n1_proximity_summary", "access15", f"select {_prox()} from access15")
def n1(w):
    return ac.proximity_summary(w.access15, [*ac.REQUIRED, "transit_a"], ac.REQUIRED, [5, 10, 15])


@query("n2_deficit_class", "access15", f"select grid_id, case when {_NM}=0 then 'NONE_COMPLETE_ACCESS' when {_NM}>=2 then 'MULTI_SERVICE_DEFICIT' when not {_W['food']} then 'FOOD_DEFICIT' when not {_W['healthcare']} then 'HEALTHCARE_DEFICIT' else 'EDUCATION_DEFICIT' end as deficit from access15")
def n2(w):
    return w.access15.select("grid_id", ac.deficit_class(ac.missing()).alias("deficit"))


@query("n3_population_by_access", "access15", "select category, minutes, count(case when t<=minutes then 1 end) as n_cells, round(sum(case when t<=minutes then pop else 0 end),1) as population, round(count(case when t<=minutes then 1 end)*100e0/count(*),2) as pct_cells, round(sum(case when t<=minutes then pop else 0 end)*100/sum(pop),2) as pct_population from (select 'food' as category, walk_food as t, pop from access15 union all select 'healthcare', walk_healthcare, pop from access15 union all select 'education', walk_education, pop from access15 union all select 'transit_a', walk_transit_a, pop from access15 union all select 'transit_b', walk_transit_b, pop from access15) a, (select unnest([5,10,15]) as minutes) m group by 1,2")
def n3(w):
    return ac.population_by_access(w.access15, {c: f"walk_{c}" for c in ("food", "healthcare", "education", "transit_a", "transit_b")}, [5, 10, 15], "pop")


@query(
    "n4_extend_threshold", "edge origin dest features",
    f"""with recursive w2 as (select * from {WALK2} w), reach as (select node_id as source, node_id as node, 0e0 as m from origin union select r.source, e.dst, r.m+e.length_m from reach r join w2 e on r.node=e.src where r.m+e.length_m<=1666.67), best as (select source, node, min(m) as m from reach group by 1,2),
    t as (select o.grid_id, min(case when d.cat=0 then b.m end) as food, min(case when d.cat=1 then b.m end) as health, min(case when d.cat=2 then b.m end) as edu from origin o left join best b on b.source=o.node_id left join (select node_id, cat from dest where snap_status<>'QUESTIONABLE') d on d.node_id=b.node group by 1),
    l as (select grid_id, unnest(['food','health','edu']) as category, unnest([food,health,edu]) as m from t)
    select category, minutes, count(case when m<=minutes*60*5/3.6e0+1e-6 then 1 end) as n_cells, sum(case when m<=minutes*60*5/3.6e0+1e-6 then pop else 0 end) as population, round(sum(case when m<=minutes*60*5/3.6e0+1e-6 then pop else 0 end)*100/sum(pop),2) as pct_population from l join features using (grid_id), (select unnest([10,15,20]) as minutes) u group by 1,2""",
)
def n4(w):
    times = gr.reach(walk_graph(w), w.origin.select("node_id"), 20 * 60.0, ends=gr.category_ends(w.dest))
    required = ("food", "health", "edu")
    a = gr.category_summary(times, w.origin, {k: CATS[k] for k in required}, [10, 15, 20]).join(w.features.select("grid_id", "pop"), "grid_id")
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(m).alias("minutes"), F.col(f"{c}_access_{m}").alias("ok")) for c in required for m in (10, 15, 20)])
    people = F.sum(F.when(F.col("ok"), F.col("pop")).otherwise(0.0))
    return a.select("pop", F.inline(rows)).groupBy("category", "minutes").agg(F.count_if("ok").alias("n_cells"), people.alias("population"), F.round(people * 100 / F.sum("pop"), 2).alias("pct_population"))


_WA, _CA = " and ".join(_W.values()), " and ".join(_C.values())
_AC = f"case when {_WA} and {_CA} then 'WALK_AND_CYCLE_ACCESS' when {_WA} then 'WALK_ONLY_ACCESS' when {_CA} then 'CYCLE_ONLY_GAIN' else 'NEITHER_ACCESS' end"


def both_access():
    return [F.lit(True) & ac.within(f"{m}_food", 15) & ac.within(f"{m}_healthcare", 15) & ac.within(f"{m}_education", 15) for m in ("walk", "cycle")]


@query("n5_access_class", "access15", summary_sql(_AC, "access15", "access_class"))
def n5(w):
    return sm.weighted_class_summary(w.access15.withColumn("access_class", ac.access_class(*both_access())), ["access_class"], "pop")


@query(
    "n6_category_gain", "access15",
    "select category, count(case when wt is null and ct is not null then 1 end) as n_newly_reached, round(sum(case when wt is null and ct is not null then pop else 0 end),1) as pop_newly_reached, count(case when wt-ct>0 then 1 end) as n_faster, round(sum(case when (wt is null and ct is not null) or wt-ct>0 then pop else 0 end),1) as pop_helped, round(median(case when wt-ct>0 then round(wt-ct,9) end),2) as median_reduction from (select 'food' as category, walk_food as wt, cycle_food as ct, pop from access15 union all select 'healthcare', walk_healthcare, cycle_healthcare, pop from access15 union all select 'education', walk_education, cycle_education, pop from access15) a group by 1",
)
def n6(w):
    return ac.category_gain(w.access15, ac.REQUIRED, "pop")


@query("n7_deficit_closure", "access15", f"select grid_id, cl as closure_status, case when not everyday_reliable then 'UNCERTAIN' else coalesce(nullif(concat_ws('+', case when not {_W['food']} and {_C['food']} then 'FOOD' end, case when not {_W['healthcare']} and {_C['healthcare']} then 'HEALTHCARE' end, case when not {_W['education']} and {_C['education']} then 'EDUCATION' end),''),'NONE') end as closed_categories from {SYN} s")
def n7(w):
    return syn(w).select("grid_id", "closure_status", "closed_categories")


@query("n8_high_value_gain", "access15", f"select grid_id, cast(greatest({'+'.join(f'{c}::int' for c in _C.values())}-({'+'.join(f'{c}::int' for c in _W.values())}),0) as bigint) as categories_gained, pop>=m as meaningful_population, pop>=m and {'+'.join(f'{c}::int' for c in _C.values())}-({'+'.join(f'{c}::int' for c in _W.values())})>=1 as is_high_value from access15, (select median(pop) as m from access15 where pop>0) q")
def n8(w):
    return ac.high_value_gain(w.access15, "pop")


@query("n9_time_savings", "access15", "select system, count(saved) as n_both, round(count(saved)*100e0/count(*),2) as pct_both, round(count(case when saved<0 then 1 end)*100e0/count(saved),2) as pct_slower, round(quantile_cont(saved,0.25),2) as p25, round(median(saved),2) as median, round(quantile_cont(saved,0.75),2) as p75, round(quantile_cont(saved,0.9),2) as p90 from (select 'general' as system, round(walk_transit_a-cycle_transit_a,9) as saved from access15 union all select 'fixed', round(walk_transit_b-cycle_transit_b,9) from access15) s group by 1")
def n9(w):
    a = w.access15.select(*[F.round(f"{m}_transit_{k}", 9).alias(f"{m}_{k}") for m in ("walk", "cycle") for k in "ab"])
    return ac.time_savings(a, {"general": ("walk_a", "cycle_a"), "fixed": ("walk_b", "cycle_b")})


@query("n10_transit_gap", "access15", f"select gc as gap_class, tg as transit_gap, count(*) as n from {SYN} s group by 1,2")
def n10(w):
    return syn(w).groupBy("gap_class", "transit_gap").agg(F.count("*").alias("n"))


def _ps(name, cond):
    cols = ", ".join(f"round(sum(case when walk_transit_a<={m} then pop else 0 end),1) as pop_{m}, round(sum(case when walk_transit_a<={m} then pop else 0 end)*100/sum(pop),2) as pct_{m}" for m in (5, 10, 15))
    return f"select '{name}' as universe, {cols}, round(sum(case when walk_transit_a is null then pop else 0 end)*100/sum(pop),2) as pct_unreachable, round(sum(pop),1) as denominator from access15 where {cond}"


@query("n11_population_summary", "access15", _ps("RAW", "true") + " union all " + _ps("RELIABLE_ONLY", "transit_reliable"))
def n11(w):
    return ac.population_summary(w.access15, "walk_transit_a", "pop", F.col("transit_reliable"))


@query("n12_everyday_gap", "access15", summary_sql("ev", SYN, "everyday_gap"))
def n12(w):
    return sm.weighted_class_summary(syn(w), ["everyday_gap"], "pop")


@query("n13_multi_domain", "access15", summary_sql(_MD, SYN, "multi_domain"))
def n13(w):
    return sm.weighted_class_summary(syn(w), ["multi_domain"], "pop")


@query("n13b_intervention", "access15", summary_sql(_IV, SYN, "intervention"))
def n13b(w):
    return sm.weighted_class_summary(syn(w), ["intervention"], "pop")


@query("n14_high_population_gaps", "access15", f"with g as (select grid_id, pop from {SYN} s where (eg or tgp) and pop>0), q as (select quantile_cont(pop,0.25) as a, median(pop) as b, quantile_cont(pop,0.75) as c from g) select grid_id, case when pop<=a then 'Q1_LOWEST_POPULATION' when pop<=b then 'Q2' when pop<=c then 'Q3' else 'Q4_HIGHEST_POPULATION' end as band from g, q")
def n14(w):
    return ac.high_population_gaps(syn(w), "pop").select("grid_id", "band")


@query("n15_reliability_universes", "access15", "select universe, count(*) as n, round(count(*)*100e0/(select count(*) from access15),2) as pct_n, round(sum(pop),1) as pop, round(sum(pop)*100/(select sum(pop) from access15),2) as pct_pop from (select 'RAW' as universe, pop from access15 union all select 'EVERYDAY', pop from access15 where everyday_reliable union all select 'TRANSIT', pop from access15 where transit_reliable union all select 'STRICT', pop from access15 where everyday_reliable and transit_reliable) u group by 1")
def n15(w):
    e, t = F.col("everyday_reliable"), F.col("transit_reliable")
    u = sm.by_universe(w.access15, {"RAW": F.lit(True), "EVERYDAY": e, "TRANSIT": t, "STRICT": e & t}, [F.count("*").alias("n"), F.sum("pop").alias("p")])
    tot = w.access15.agg(F.count("*").alias("n"), F.sum("pop").alias("p"))
    u = u.withColumn("_t", tot.select(F.struct("*")).scalar())
    return u.select("universe", "n", F.round(F.col("n") / F.col("_t.n") * 100, 2).alias("pct_n"), F.round("p", 1).alias("pop"), F.round(F.col("p") / F.col("_t.p") * 100, 2).alias("pct_pop"))


_GAIN = f"greatest({'+'.join(f'{c}::int' for c in _C.values())}-({'+'.join(f'{c}::int' for c in _W.values())}),0)"


@query("n16_score_overlap", "access15", f"select count(case when g then 1 end) as n_group, count(case when g and score>=q then 1 end) as n_group_top, round(count(case when g and score>=q then 1 end)*100e0/count(case when g then 1 end),2) as pct_group_top, round(count(case when score>=q then 1 end)*100e0/count(*),2) as pct_all_top, round(corr(score,gain),4) as correlation from (select score, {_AC}='CYCLE_ONLY_GAIN' as g, {_GAIN} as gain, (select quantile_cont(score,0.75) from access15) as q from access15) t")
def n16(w):
    nc = s.count_true([ac.within(f"cycle_{c}", 15) for c in ac.REQUIRED]) - s.count_true([ac.within(f"walk_{c}", 15) for c in ac.REQUIRED])
    return ac.score_overlap(w.access15, ac.access_class(*both_access()) == "CYCLE_ONLY_GAIN", "score", F.greatest(nc, F.lit(0)))


@query("n17_gain_overlap", "access15", summary_sql(f"case when {_AC}='CYCLE_ONLY_GAIN' and gc<>'NO_TRANSIT_GAP' and tgain then 'BOTH_GAINS' when {_AC}='CYCLE_ONLY_GAIN' then 'EVERYDAY_NEEDS_GAIN_ONLY' when gc<>'NO_TRANSIT_GAP' and tgain then 'TRANSIT_GAIN_ONLY' else 'NO_CYCLING_GAIN' end", SYN, "overlap_group"))
def n17(w):
    a = syn(w)
    t = (F.col("gap_class") != "NO_TRANSIT_GAP") & F.col("transit_gain")
    return sm.weighted_class_summary(a.withColumn("overlap_group", ac.gain_overlap(ac.access_class(*both_access()) == "CYCLE_ONLY_GAIN", t)), ["overlap_group"], "pop")


_RC = "case when score>=0.9 then 'ROBUST_HIGH' when score>=0.7 then 'FREQUENT_HIGH' else 'RARE_HIGH' end"
_FQ = "case when district%25=3 then 'SUSPECT_FEED_COVERAGE' when district%25=7 then 'USABLE_WITH_LIMITATION' else 'GOOD_COVERAGE' end"
_QF = "case when district%25=9 then 'KNOWN_NETWORK_LIMITATION' when everyday_reliable then 'RELIABLE' else 'SMALL_COMPONENT_CAUTION' end"


def flags():
    ready = F.when(F.col("score") >= 0.9, "ROBUST_HIGH").when(F.col("score") >= 0.7, "FREQUENT_HIGH").otherwise("RARE_HIGH")
    d = F.col("district") % 25
    feed = F.when(d == 3, "SUSPECT_FEED_COVERAGE").when(d == 7, "USABLE_WITH_LIMITATION").otherwise("GOOD_COVERAGE")
    net = F.when(d == 9, "KNOWN_NETWORK_LIMITATION").when(F.col("everyday_reliable"), "RELIABLE").otherwise("SMALL_COMPONENT_CAUTION")
    return ready, feed, net


@query("n18_convergence_confidence", "access15", f"select case when g and r then 'BOTH_SIGNALS' when g then 'ACCESSIBILITY_GAIN_ONLY' when r then 'HIGH_EBIKE_READINESS_ONLY' else 'NEITHER' end as convergence, case when qf='KNOWN_NETWORK_LIMITATION' then 'KNOWN_SPECIAL_CASE' when qf<>'RELIABLE' and fq<>'GOOD_COVERAGE' then 'MULTIPLE_LIMITATIONS' when qf<>'RELIABLE' then 'NETWORK_LIMITATION' when fq<>'GOOD_COVERAGE' then 'TRANSIT_DATA_LIMITATION' else 'RELIABLE' end as confidence, count(*) as n from (select {_IV} in ('CYCLING_CLOSES_EVERYDAY_GAP','CYCLING_CLOSES_TRANSIT_GAP','CYCLING_CLOSES_BOTH') as g, {_RC} in ('ROBUST_HIGH','FREQUENT_HIGH') as r, {_QF} as qf, {_FQ} as fq from {SYN} s) t group by 1,2")
def n18(w):
    ready, feed, net = flags()
    return syn(w).groupBy(ac.convergence(F.col("intervention"), ready).alias("convergence"), ac.confidence(net, net, feed).alias("confidence")).agg(F.count("*").alias("n"))


DASH = {"population": "pop", "food_walk_min": "walk_food", "healthcare_walk_min": "walk_healthcare", "education_walk_min": "walk_education", "food_cycle_min": "cycle_food", "general_transit_walk_min": "walk_transit_a", "fixed_transit_walk_min": "walk_transit_b", "ebike_readiness": "score"}


@query("n19_dashboard_grid", "access15", "select grid_id, district, " + ", ".join(f"{c} as {n}" for n, c in DASH.items()) + f", round(pop/0.25,1) as population_density_per_km2, ev as everyday_gap_type, cl as cycling_gap_closure, tg as transit_gap_type, {_MD} as multi_domain_pattern, {_IV} as active_mobility_intervention, strict as synthesis_reliable from {SYN} s")
def n19(w):
    names = {"everyday_gap": "everyday_gap_type", "closure_status": "cycling_gap_closure", "transit_gap": "transit_gap_type", "multi_domain": "multi_domain_pattern", "intervention": "active_mobility_intervention", "strict_reliable": "synthesis_reliable"}
    return syn(w).select("grid_id", "district", *[F.col(c).alias(n) for n, c in DASH.items()], F.round(F.col("pop") / 0.25, 1).alias("population_density_per_km2"), *[F.col(c).alias(n) for c, n in names.items()])


@query("n19b_district_summary", "access15 cell_labels", "select a.district, count(*) as n_cells, round(sum(a.pop),1) as pop, " + ", ".join(f"count(case when l.lb={i} then 1 end) as cluster_{i}" for i in range(5)) + " from access15 a join cell_labels l using (grid_id) group by 1")
def n19b(w):
    j = w.access15.select("grid_id", "district", "pop").join(w.cell_labels.select("grid_id", "lb"), "grid_id")
    return j.groupBy("district").agg(F.count("*").alias("n_cells"), F.round(F.sum("pop"), 1).alias("pop"), *[F.count_if(F.col("lb") == i).alias(f"cluster_{i}") for i in range(5)])


def case_preds():
    return {"fully_closed": F.col("closure_status") == "FULLY_CLOSED_BY_CYCLING", "partly_closed": F.col("closure_status") == "PARTIALLY_CLOSED_BY_CYCLING", "unchanged": F.col("closure_status") == "UNCHANGED_BY_CYCLING", "sufficient": F.col("intervention") == "WALKING_SUFFICIENT", "uncertain": F.col("transit_gap") == "TRANSIT_DATA_UNCERTAIN"}


_CASES = f"""(select 'fully_closed' as "case", grid_id, pop from {SYN} a where cl='FULLY_CLOSED_BY_CYCLING' union all select 'partly_closed', grid_id, pop from {SYN} a where cl='PARTIALLY_CLOSED_BY_CYCLING' union all select 'unchanged', grid_id, pop from {SYN} a where cl='UNCHANGED_BY_CYCLING'
 union all select 'sufficient', grid_id, pop from {SYN} a where {_IV}='WALKING_SUFFICIENT' union all select 'uncertain', grid_id, pop from {SYN} a where tg='TRANSIT_DATA_UNCERTAIN')"""


@query("n20_case_studies", "access15", f"""select "case", grid_id, pop from (select *, row_number() over (partition by "case" order by pop, grid_id)-1 as i, count(*) over (partition by "case") as n from {_CASES} c where pop>0) t where i=n//2""")
def n20(w):
    return sm.median_member(syn(w), case_preds(), "pop", "grid_id")


@query("n21_sanity_cases", "access15", f"""select "case", grid_id, pop from (select *, row_number() over (partition by "case" order by pop desc, grid_id) as rn from {_CASES} c) t where rn=1""")
def n21(w):
    return ac.sanity_cases(syn(w), case_preds(), "pop", "grid_id")


@query("n22_reconcile_kpis", "access15", "select 'n_cells' as kpi, count(*)*1e0 as stored, count(*)*1e0 as live, true as matches from access15 union all select 'total_pop', round(sum(pop),1), round(sum(pop),1), true from access15 union all select 'n_food', count(case when walk_food<=10 then 1 end)*1e0, count(case when walk_food<=15 then 1 end)*1e0, count(case when walk_food<=10 then 1 end)=count(case when walk_food<=15 then 1 end) from access15")
def n22(w):
    def kpis(limit):
        a = w.access15.agg(F.count("*").cast("double").alias("n"), F.round(F.sum("pop"), 1).alias("p"), F.count_if(F.col("walk_food") <= limit).cast("double").alias("f"))
        return a.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(c).alias("value")) for k, c in (("n_cells", "n"), ("total_pop", "p"), ("n_food", "f"))])))

    return ac.reconcile_kpis(kpis(10), kpis(15))


@query(
    "n23_consistency_suite", "access15",
    """select * from (select 'A_no_gap_matches_complete_access' as "check", count(case when everyday_reliable then 1 end) as n_checked from access15 union all select 'B_fully_closed_is_cycle_gain', (select count(*) from """ + SYN + """ s where cl='FULLY_CLOSED_BY_CYCLING') union all select 'C_transit_gap_reproduced', count(case when transit_reliable then 1 end) from access15
    union all select 'D_population_totals_reconcile', count(*) from access15 union all select 'E_no_uncertain_counted', count(case when not transit_reliable then 1 end) from access15 union all select 'F_no_silent_zero_fill', count(*) from access15 union all select 'G_limited_cells_not_strict', count(case when not everyday_reliable then 1 end) from access15) t, (select cast(0 as bigint) as n_bad, true as passed) k""",
)
def n23(w):
    return ac.consistency_suite(syn(w), w.access15, "pop")


def broken(w):
    """The synthesis with faults: each kind in the cells of one remainder of grid_id."""
    k = F.col("grid_id") % 101
    b = syn(w)
    faults = {
        "everyday_gap": (k == 1, F.lit("NO_REQUIRED_GAP")), "closure_status": (k == 2, F.lit("FULLY_CLOSED_BY_CYCLING")),
        "walk_food": ((k == 4) & F.col("walk_food").isNull(), F.lit(0.0)), "pop": (k == 5, F.col("pop") + 7.0),
        "strict_reliable": ((k == 6) & ~F.col("everyday_reliable"), F.lit(True)),
    }
    b = b.withColumns({c: F.when(on, v).otherwise(F.col(c)) for c, (on, v) in faults.items()})
    gap = F.when((k == 3) & ~F.col("transit_reliable"), F.lit("NO_TRANSIT_ACCESS_GAP")).when((k == 7) & F.col("transit_reliable"), F.lit("BOTH_TRANSIT_ACCESS_GAPS"))
    return b.withColumn("transit_gap", F.coalesce(gap, F.col("transit_gap")))


N23B = f"""(select *, n_bad=0 as passed from (select 'A_no_gap_matches_complete_access' as "check", count(case when everyday_reliable then 1 end) as n_checked, count(case when everyday_reliable and grid_id%101=1 and {_NM}>0 then 1 end) as n_bad from access15
    union all select 'B_fully_closed_is_cycle_gain', count(case when cl='FULLY_CLOSED_BY_CYCLING' or grid_id%101=2 then 1 end), count(case when grid_id%101=2 and ({_NM}=0 or {_NS}>0) then 1 end) from {SYN} s
    union all select 'C_transit_gap_reproduced', count(case when transit_reliable then 1 end), count(case when transit_reliable and grid_id%101=7 and tg<>'BOTH_TRANSIT_ACCESS_GAPS' then 1 end) from {SYN} s
    union all select 'D_population_totals_reconcile', count(*), cast(case when count(case when grid_id%101=5 then 1 end)>0 then 1 else 0 end as bigint) from access15
    union all select 'E_no_uncertain_counted', count(case when not transit_reliable then 1 end), count(case when not transit_reliable and grid_id%101=3 then 1 end) from access15
    union all select 'F_no_silent_zero_fill', count(*), count(case when grid_id%101=4 and walk_food is null then 1 end) from access15
    union all select 'G_limited_cells_not_strict', count(case when not everyday_reliable then 1 end), count(case when not everyday_reliable and grid_id%101=6 then 1 end) from access15) t)"""


@query("n23b_consistency_faults", "access15", f"select * from {N23B} b")
def n23b(w):
    return ac.consistency_suite(broken(w), w.access15, "pop")


def universe_pct(w):
    ok = ac.within("walk_food", 15) & ac.within("walk_healthcare", 15) & ac.within("walk_education", 15)
    pct = F.sum(F.when(ok, F.col("pop")).otherwise(0.0)) / F.sum("pop") * 100
    e, t = F.col("everyday_reliable"), F.col("transit_reliable")
    return sm.by_universe(w.access15, {"all": F.col("pop") > 0, "reliable": e, "strict": e & t}, [pct.alias("pct")])


@query(
    "n24_freeze_decision", "access15",
    f"""with u as (select sum(case when {_WA} then pop else 0 end)*100/sum(pop) as pct from access15 where pop>0 union all select sum(case when {_WA} then pop else 0 end)*100/sum(pop) from access15 where everyday_reliable union all select sum(case when {_WA} then pop else 0 end)*100/sum(pop) from access15 where everyday_reliable and transit_reliable),
    k as (select count(case when j2>j1*1.5 and j2>5 then 1 end) as n_cliffs from (select category, round(max(case when "limit"=10 then pct_w end)-max(case when "limit"=5 then pct_w end),2) as j1, round(max(case when "limit"=15 then pct_w end)-max(case when "limit"=10 then pct_w end),2) as j2 from {CURVE} c group by 1) d)
    select round(drift,2) as drift, true as all_checks_pass, n_cliffs, drift<2 as is_quality_robust, case when drift<2 and n_cliffs=0 then 'VALIDATED_WITH_DOCUMENTED_LIMITATIONS' else 'REQUIRES_CORRECTION' end as decision from (select max(pct)-min(pct) as drift from u) x, k""",
)
def n24(w):
    return ac.freeze_decision(universe_pct(w), ac.consistency_suite(syn(w), w.access15, "pop"), sm.cliff_flags(curve(w), (5, 10, 15)))


@query(
    "n24b_freeze_refused", "access15",
    f"""with u as (select sum(case when {_WA} then pop else 0 end)*100/sum(pop) as pct from access15 where pop>0 union all select sum(case when {_WA} then pop else 0 end)*100/sum(pop) from access15 where everyday_reliable union all select sum(case when {_WA} then pop else 0 end)*100/sum(pop) from access15 where everyday_reliable and transit_reliable),
    k as (select count(case when j2>j1*1.5 and j2>5 then 1 end) as n_cliffs from (select category, round(max(case when "limit"=10 then pct_w end)-max(case when "limit"=5 then pct_w end),2) as j1, round(max(case when "limit"=15 then pct_w end)-max(case when "limit"=10 then pct_w end),2) as j2 from {CURVE} c group by 1) d), ok as (select bool_and(passed) as ok from {N23B} b)
    select round(drift,2) as drift, ok as all_checks_pass, n_cliffs, drift<2 as is_quality_robust, case when ok and drift<2 and n_cliffs=0 then 'VALIDATED_WITH_DOCUMENTED_LIMITATIONS' else 'REQUIRES_CORRECTION' end as decision from (select max(pct)-min(pct) as drift from u) x, k, ok""",
)
def n24b(w):
    return ac.freeze_decision(universe_pct(w), ac.consistency_suite(broken(w), w.access15, "pop"), sm.cliff_flags(curve(w), (5, 10, 15)))


@query("n25_access_points", "stop grid", "select mode_name, count(*) as n_access_points, cast(count(distinct district) as bigint) as n_districts, bool_and(mode_name in ('metro','tram','rail','metrobus')) as in_system_b from (select distinct s.stop_id, s.mode_name, g.district from stop s join grid g on s.x>=g.x0 and s.x<g.x0+500 and s.y>=g.y0 and s.y<g.y0+500) t group by 1")
def n25(w):
    p = ac.access_points(sp.join_cells(w.stop.select("stop_id", "mode_name", "x", "y"), cells(w, "district"), 500.0))
    d = p.groupBy("mode_name", "district").agg(F.count("*").alias("c"), F.bool_and("in_system_b").alias("b"))
    return d.groupBy("mode_name").agg(F.sum("c").alias("n_access_points"), F.count("*").alias("n_districts"), F.bool_and("b").alias("in_system_b"))
