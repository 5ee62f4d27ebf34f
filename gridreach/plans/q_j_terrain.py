"""Raster operators."""

from pyspark.sql import functions as F

from gridreach.operators import terrain as tr
from gridreach.plans.q_f_aggregates import pixel_cells
from gridreach.plans.registry import query


def px(w):
    return w.pixel.select("r", "c", F.col("elev").alias("value"))


@query("j1_mosaic", "pixel", "select r, c, cast(case when c<70 and elev is not null then 0 else 1 end as integer) as tile, case when c<70 and elev is not null then elev else elev+1 end as value from pixel where c between 5 and 110 and elev is not null and (c<70 or c>=50)")
def j1(w):
    p = px(w)
    a, b = p.where(F.col("c") < 70), p.where(F.col("c") >= 50).withColumn("value", F.col("value") + 1)
    top = p.agg(F.max("r")).first()[0]
    return tr.mosaic([a, b], (0, top, 5, 110))


_BIL = """(select t.*, least(greatest({y}/160-0.5,0),(select max(r) from pixel)) as fr, least(greatest({x}/160-0.5,0),119) as fc from {src} t)"""


def _bilinear(src, x, y, keys):
    base = _BIL.format(src=src, x=x, y=y)
    w = "case when p.r=floor(fr) then 1-(fr-floor(fr)) else fr-floor(fr) end * case when p.c=floor(fc) then 1-(fc-floor(fc)) else fc-floor(fc) end"
    return f"""(select {keys}, case when count(*)=any_value(need) and count(p.elev)=count(*) then sum({w}*p.elev) end as value from (select *, (case when fr>floor(fr) then 2 else 1 end)*(case when fc>floor(fc) then 2 else 1 end) as need from {base} b) q
    join pixel p on (p.r=floor(fr) or (p.r=floor(fr)+1 and fr>floor(fr))) and (p.c=floor(fc) or (p.c=floor(fc)+1 and fc>floor(fc))) group by {keys})"""


@query("j2_resample_bilinear", "pixel", f"select r, c, round(value,5) as value from (select tr as r, tc as c, value from {_bilinear('(select r as tr, c as tc, c*160e0+120 as tx, r*160e0+100 as ty from pixel)', 'tx', 'ty', 'tr, tc')} z) y where value is not null")
def j2(w):
    t = w.pixel.select("r", "c", (F.col("c") * 160.0 + 120).alias("x"), (F.col("r") * 160.0 + 100).alias("y"))
    return tr.resample_bilinear(px(w), t, 160.0).where(F.col("value").isNotNull()).withColumn("value", F.round("value", 5))


@query(
    "j3_horn_slope", "pixel",
    """with b as (select min(r) as r0, max(r) as r1, min(c) as c0, max(c) as c1 from pixel), n as (select p.r, p.c, di, dj, least(greatest(p.r+di,r0),r1) as nr, least(greatest(p.c+dj,c0),c1) as nc from pixel p, b, (select unnest([-1,0,1]) as di) i, (select unnest([-1,0,1]) as dj) j),
    s as (select n.r, n.c, count(p.elev) as k, sum(dj*case when di=0 then 2 else 1 end*p.elev)/(8*160) as gx, sum(di*case when dj=0 then 2 else 1 end*p.elev)/(8*160) as gy from n left join pixel p on p.r=n.nr and p.c=n.nc group by 1,2)
    select r, c, case when k=9 then round(degrees(atan(sqrt(gx*gx+gy*gy))),6) end as slope from s""",
)
def j3(w):
    return tr.horn_slope(px(w), 160.0).withColumn("slope", F.round("slope", 6))


@query("j4_pixels_to_cells", "pixel", "select r, c, cast(floor((y0+80)/500)*40+floor((x0+80)/500) as bigint) as grid_id from pixel")
def j4(w):
    return pixel_cells(w).select("r", "c", "grid_id")


@query("j5_sample_bilinear", "stop pixel", f"select stop_id, round(value,5) as value from {_bilinear('stop', 'x', 'y', 'stop_id')} z")
def j5(w):
    return tr.sample_bilinear(px(w), w.stop, ["stop_id"], 160.0).withColumn("value", F.round("value", 5))


@query(
    "j6_segment_grade", "cycleway pixel",
    f"""with c as (select *, sqrt((x2-x1)**2+(y2-y1)**2) as len from cycleway where sqrt((x2-x1)**2+(y2-y1)**2)>=30), e as (select distinct x1 as px, y1 as py from c union select distinct x2, y2 from c), z as (select * from {_bilinear('e', 'px', 'py', 'px, py')} q)
    select line_id, round(len,4) as len, round(abs(b.value-a.value)/len*100,5) as grade_pct, abs(b.value-a.value)/len*100>30 as is_suspicious from c join z a on a.px=x1 and a.py=y1 join z b on b.px=x2 and b.py=y2 where a.value is not null and b.value is not null""",
)
def j6(w):
    s = tr.segment_grade(w.cycleway, px(w), ["line_id"], 160.0)
    return s.withColumn("len", F.round("len", 4)).withColumn("grade_pct", F.round("grade_pct", 5))
