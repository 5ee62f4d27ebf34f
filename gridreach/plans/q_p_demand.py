"""Demand models and the streaming count."""

from pyspark.sql import functions as F

from gridreach.operators import demand as dm
from gridreach.plans.registry import query
from gridreach.session import scratch
from gridreach.streaming import trips as st

XS = ["n_poi", "sum_size", "pop", "noise"]
#: Size of the reference's boosted trees, and what its search draws from.
TREES = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3}
SEARCH = {"maxDepth": range(4, 10), "stepSize": [0.001, 0.01], "maxIter": range(100, 500, 100)}


@query("p1_linear_single", "features", " union all ".join(f"select '{x}' as feature, round(regr_slope(n_trip,{x}),7) as slope, round(regr_intercept(n_trip,{x}),6) as intercept, round(regr_r2(n_trip,{x}),7) as r2 from features" for x in XS))
def p1(w):
    f = dm.simple_fits(w.features, XS, "n_trip")
    return f.select("feature", F.round("slope", 7).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 7).alias("r2"))


def _normal_sql(xs, y):
    """Least squares by elimination on the covariances, one step a feature; then the intercept and R2."""
    k = range(len(xs))
    first = ", ".join([f"covar_pop({a},{b}) as a{i}_{j}" for i, a in enumerate(xs) for j, b in enumerate(xs)] + [f"covar_pop({a},{y}) as b{i}" for i, a in enumerate(xs)])
    steps = [f"s0 as (select {first} from features)"]
    for p in k:
        cells = [f"a{i}_{j}-a{i}_{p}*a{p}_{j}/a{p}_{p} as a{i}_{j}" if i != p else f"a{i}_{j}" for i in k for j in k]
        rights = [f"b{i}-a{i}_{p}*b{p}/a{p}_{p} as b{i}" if i != p else f"b{i}" for i in k]
        steps.append(f"s{p + 1} as (select {', '.join(cells + rights)} from s{p})")
    coef = ", ".join(f"b{i}/a{i}_{i} as c{i}" for i in k)
    fit = ", ".join(steps) + f", c as (select {coef} from s{len(xs)}), m as (select avg({y}) as ym, var_pop({y}) as yv, {', '.join(f'avg({x}) as m{i}, covar_pop({x},{y}) as v{i}' for i, x in enumerate(xs))} from features)"
    rows = [f"select '{x}' as term, round(c{i},6) as value from c" for i, x in enumerate(xs)]
    rows += ["select 'intercept', round(ym-" + "-".join(f"c{i}*m{i}" for i in k) + ",6) from c, m", "select 'r2', round((" + "+".join(f"c{i}*v{i}" for i in k) + ")/yv,6) from c, m"]
    return f"with {fit} " + " union all ".join(rows)


@query("p1b_linear_multi", "features", _normal_sql(XS, "n_trip"))
def p1b(w):
    return dm.linear_table(w.features, XS, "n_trip").withColumn("value", F.round("value", 6))


def parted(w):
    return dm.split(w.features, (F.col("grid_id") * 7919) % 1000 / 1000, {"train": 0.6, "val": 0.2, "test": 0.2})


@query("p2_gradient_boosting", "features")
def p2(w):
    d = parted(w)
    m = dm.gbt_fit(d.where(F.col("part") == "train"), XS, "n_trip", **TREES)
    return m.transform(dm.assembled_with(d, XS, "n_trip", "grid_id")).select("grid_id", "label", "prediction")


@query("p3_split", "features", "select grid_id, case when (grid_id*7919)%1000/1000<0.6 then 'train' when (grid_id*7919)%1000/1000<0.8 then 'val' else 'test' end as part from features")
def p3(w):
    return parted(w).select("grid_id", "part")


@query("p4_random_search", "features")
def p4(w):
    return dm.random_search(w.features, XS, "n_trip", SEARCH, n=5, folds=3)


@query("p5_r2_table", "features")
def p5(w):
    d = dm.cut(parted(w).select("part", "n_trip", *XS))
    train = d.where(F.col("part") == "train")
    return dm.r2_table({"linear": dm.linear_fit(train, XS, "n_trip"), "boosted": dm.gbt_fit(train, XS, "n_trip", **TREES)}, d, XS, "n_trip")


@query(
    "p6_neighbour_features", "features",
    """with c as (select grid_id, ix*500+250 as x, iy*500+250 as y, ix, iy, n_poi, pop from features), n as (select a.grid_id, b.n_poi, b.pop, row_number() over (partition by a.grid_id order by sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), b.grid_id) as rn from c a join c b on abs(a.ix-b.ix)<=3 and abs(a.iy-b.iy)<=3 and a.grid_id<>b.grid_id)
    select grid_id, round(avg(n_poi),6) as n_poi_nb, round(avg(pop),6) as pop_nb from n where rn<=5 group by 1""",
)
def p6(w):
    f = w.features.select("grid_id", (F.col("ix") * 500.0 + 250).alias("x"), (F.col("iy") * 500.0 + 250).alias("y"), "n_poi", "pop")
    n = dm.neighbour_features(f, "grid_id", 5, ["n_poi", "pop"], start=1000.0)
    return n.select("grid_id", F.round("n_poi_nb", 6).alias("n_poi_nb"), F.round("pop_nb", 6).alias("pop_nb"))


@query("x1_stream_hourly_counts", "trip", "select cast(floor(x/1000) as bigint) as ix, cast(floor(y/1000) as bigint) as iy, event_type, date_trunc('hour', start_time) as hour, count(*) as n from trip group by 1,2,3,4")
def x1(w):
    # many files, each with events of the whole span, taken two at a time: several micro-batches with rows out of order
    files = scratch(w.spark, "events")
    w.events.repartition(12, "event_id").write.parquet(files)
    s = w.spark.readStream.schema(st.EVENT_SCHEMA).option("maxFilesPerTrigger", 2).parquet(files)
    e, u = F.col("event_id"), F.col("user_id")
    t = s.select(
        "event_type", F.col("ts").cast("timestamp").alias("start_time"),
        ((u * 7919 + e * 37) % 20000 + 0.5).alias("x"), ((u * 104729 + e * 53) % 20000 + 0.5 + 20000.0 * F.floor(e / 10000)).alias("y"),
    )
    return st.run_to_table(w.spark, st.stream_counts(t, 1000.0, "30 days"), ["ix", "iy", "event_type", "hour"])
