"""Threshold-curve queries."""

from pyspark.sql import functions as F

from cellgrid.operators import curves as cv, spots as sp
from cellgrid.plans.catalog import query
from cellgrid.plans.sqlkit import hash32

K = ["gene", "z"]

DERIV = """ci as (select *, row_number() over (partition by gene, z order by thr)-1 as i, count(*) over (partition by gene, z) as cnt from curve),
gr as (select *, case when i=0 then lead(n) over w - n when i=cnt-1 then n - lag(n) over w else (lead(n) over w - lag(n) over w)/2.0 end as g
  from ci window w as (partition by gene, z order by thr)),
deriv as (select a.gene, a.z, a.i, a.thr, abs(avg(b.g)) as deriv from gr a cross join range(-2,3) o join gr b on a.gene=b.gene and a.z=b.z
  and b.i = case when a.i+o.range<0 then -(a.i+o.range)-1 when a.i+o.range>=a.cnt then 2*a.cnt-(a.i+o.range)-1 else a.i+o.range end group by all)"""
FANO = DERIV + """, fano as (select a.gene, a.z, a.i, a.thr, s.win, case when avg(b.deriv)=0 then 0 else var_pop(b.deriv)/avg(b.deriv) end as fano
  from deriv a cross join (select range as win from range(3,22,2)) s join deriv b on a.gene=b.gene and a.z=b.z and abs(b.i-a.i)<=s.win//2
  group by all having count(*)=s.win)"""
MAD = FANO + """, md as (select gene, z, win, median(fano) m from fano group by all),
mm as (select gene, z, win, m, median(abs(fano-m)) d from fano join md using (gene, z, win) group by all),
madsugg as (select gene, z, win, (coalesce(min(thr) filter (where round(fano,9)<=round(m-d,9)),min(thr)) + coalesce(min(thr) filter (where round(fano,9)<=round(m+d,9)),min(thr)))/2 as mad_sugg
  from fano join mm using (gene, z, win) group by all)"""


def two_piece(src: str, out: str, keys: str, x: str, y: str) -> str:
    """CTEs ``out``(keys, knot, slope, icept, sse, cross)."""
    sums = {"n": "1.0::double", "sx": "x", "sy": "y", "sxx": "x*x", "sxy": "x*y", "syy": "y*y"}
    return f"""{out}_b as (select {keys}, {x}::double as x, {y}::double as y from {src}),
{out}_l as (select *, {', '.join(f'sum({e}) over w as l{k}, sum({e}) over v as t{k}' for k, e in sums.items())} from {out}_b
  window w as (partition by {keys} order by x rows unbounded preceding), v as (partition by {keys})),
{out}_r as (select *, {', '.join(f't{k}-l{k} as r{k}' for k in sums)} from {out}_l),
{out}_h as (select *, rsx-x*rn as h, rsxx-2*x*rsx+x*x*rn as hh, rsxx-x*rsx as hx, rsxy-x*rsy as hy from {out}_r where ln>=2 and rn>=2),
{out}_v as (select *, tsxx-tsx*tsx/tn as vxx, tsxy-tsx*tsy/tn as vxy, tsyy-tsy*tsy/tn as vyy, hh-h*h/tn as vhh, hx-tsx*h/tn as vxh, hy-tsy*h/tn as vyh from {out}_h),
{out}_c as (select *, (vxy*vhh-vyh*vxh)/(vxx*vhh-vxh*vxh) as b1, (vyh*vxx-vxy*vxh)/(vxx*vhh-vxh*vxh) as b2 from {out}_v),
{out}_k as (select {keys}, x as knot, b1+b2 as slope, (tsy-b1*tsx-b2*h)/tn-b2*x as icept, round(vyy-b1*vxy-b2*vyh, 6) as sse from {out}_c),
{out}_m as (select * from {out}_k qualify row_number() over (partition by {keys} order by sse, knot)=1),
{out}_s as (select b.*, knot, slope, icept, sse, sign(round(y-(slope*x+icept),6)) as sg from {out}_b b join {out}_m using ({keys})),
{out}_t as (select *, lead(sg) over (partition by {keys} order by x) <> sg as turn from {out}_s),
{out} as (select {keys}, knot, slope, icept, sse, greatest(knot, coalesce(min(x) filter (where turn), knot)) as crossing from {out}_t
  group by {keys}, knot, slope, icept, sse)"""


@query("curve_derivative", f"with {DERIV} select * from deriv", d="thr deriv", i="i z")
def _(t):
    return cv.curve_derivative(t.curve, K)


@query("curve_fano", f"with {FANO} select * from fano", d="thr fano", i="i z win")
def _(t):
    return cv.curve_fano(cv.curve_derivative(t.curve, K), K)


@query("curve_mad_suggestion", f"with {MAD} select * from madsugg", d="mad_sugg", i="z win")
def _(t):
    return cv.curve_mad_suggestion(cv.curve_fano(cv.curve_derivative(t.curve, K), K), [*K, "win"])


@query("curve_two_piece_fit", f"""with {two_piece('curve', 'tp', 'gene, z', 'thr', 'n')} select * from tp""",
       d="knot slope icept sse crossing", i="z", digits=4)
def _(t):
    return cv.curve_two_piece_fit(t.curve, K, "thr", "n")


@query("suggest_threshold", f"""with {MAD}, {two_piece('fano', 'tp', 'gene, z, win', 'thr', 'fano')}
    select gene, z, avg((mad_sugg+knot+crossing)/3.0) as suggestion, round_even(round(avg((mad_sugg+knot+crossing)/3.0),6),0) as thr
    from madsugg join tp using (gene, z, win) group by all""", d="suggestion thr", i="z")
def _(t):
    return cv.suggest_threshold(t.curve, K)


@query("threshold_search_range", """with a as (select gene, z, max(thr) x0 from curve group by all),
    h as (select gene, z, x0, max(thr) filter (where thr<x0 and (x0-thr)%30=0 and thr>=greatest(1,x0-200) and n>=80) hit
      from curve join a using (gene, z) group by all),
    m as (select gene, z, coalesce(hit, case when x0-30*(floor((x0-greatest(1,x0-200))/30)+1)<1 then 1 else x0-200 end) as min_thr from h)
    select gene, z, min_thr, range as k, min_thr+400*range/99.0::double as thr from m, range(100)""", d="min_thr thr", i="z k")
def _(t):
    return cv.threshold_search_range(t.curve, K, max_spots=80, step=30.0, size=400.0)


def line_sql(src: str, out: str, keys: str, seed: int, trials: int = 32) -> str:
    """CTEs ``out``(keys, slope, icept, inliers) from ``src``(keys, x, y)."""
    h = hash32("(x::int)::varchar", "trial::varchar", f"'{seed}'")
    return f"""{out}_m as (select {keys}, median(y) med from {src} group by {keys}),
{out}_d as (select {keys}, median(abs(y-med)) lim from {src} join {out}_m using ({keys}) group by {keys}),
{out}_p as (select *, row_number() over (partition by {keys}, trial order by {h}, x) <= ceil(count(*) over (partition by {keys}, trial)/2.0) as pick
  from (select *, range as trial from {src}, range({trials})) join {out}_d using ({keys})),
{out}_f as (select {keys}, trial, regr_slope(y,x) s, regr_intercept(y,x) c from {out}_p where pick group by {keys}, trial),
{out}_i as (select {keys}, trial, x, y, round(abs(y-(s*x+c)),9) r, round(abs(y-(s*x+c)),9) <= round(lim,9) as inl from {out}_p join {out}_f using ({keys}, trial)),
{out}_s as (select {keys}, trial, count(*) filter (where inl) as inliers, round(sum(r*r) filter (where inl),9) sse, regr_slope(y,x) filter (where inl) slope,
  regr_intercept(y,x) filter (where inl) icept from {out}_i group by {keys}, trial),
{out} as (select {keys}, slope, icept, inliers from {out}_s qualify row_number() over (partition by {keys} order by inliers desc, sse, trial)=1)"""


LOGMED = """lm as (select section, channel, z as x, case when median(v)=0 then 0 else ln(median(v)) end as y from dense group by section, channel, z)"""


@query("robust_line", f"with {LOGMED}, {line_sql('lm', 'rl', 'section, channel', 42)} select * from rl", d="slope icept", i="inliers section")
def _(t):
    p = t.dense.groupBy("section", "channel", "z").agg(F.median("v").alias("_m"))
    p = p.withColumn("y", F.when(F.col("_m") == 0, 0.0).otherwise(F.ln("_m")))
    return cv.robust_line(p, ["section", "channel"], seed=42)


@query("depth_attenuation_unscaled", f"""with {LOGMED}, {line_sql('lm', 'rl', 'section, channel', 42)}
    select section, channel, z, y, count(*) as n, sum(round_even(round(v*exp(-slope*z),9),0)) as s from dense join rl using (section, channel) group by all""",
       d="s", i="z y n section")
def _(t):
    out = cv.depth_attenuation(t.dense, None, 42)
    return out.groupBy("section", "channel", "z", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))


@query("poly_fit_purge", None, d="fit y", i="z")
def _(t):
    p = t.events.groupBy(F.col("event_type").alias("gene"), (F.dayofyear("ts") % 32).alias("z")).agg(F.avg("value").alias("y"))
    return cv.poly_fit_purge(p, ["gene"])


DECAY_RATES = (0.001, 0.04, 0.5, 3.0)


@query("exp_decay_fit", f"""with recursive rate as (select range as z, ([{', '.join(f'{r}::double' for r in DECAY_RATES)}])[range+1] as b0 from range(4)),
    pts as (select gene, z, b0, thr/60/b0 as x, 3000*exp(-thr/60)+4000+(n%7)*0.02::double as y from curve join rate using (z)),
    it as (select distinct gene, z, ln(b0/4) as lo, ln(b0*4) as hi, 0 as step from pts
      union all
      select gene, z, case when g>0 then lo else (lo+hi)/2 end, case when g>0 then (lo+hi)/2 else hi end, step+1
      from (select gene, z, lo, hi, step, covar_pop(x*e,y)-covar_pop(y,e)/var_pop(e)*covar_pop(x*e,e) as g
            from (select p.*, lo, hi, step, exp(-exp((lo+hi)/2)*x) as e from it join pts p using (gene, z) where step<60) group by all)),
    found as (select gene, z, exp((lo+hi)/2) as b from it where step=60)
    select gene, z, regr_slope(y,exp(-b*x)) as a, b, regr_intercept(y,exp(-b*x)) as c from pts join found using (gene, z) group by all""",
       d="a b c", i="z", digits=4)
def _(t):
    """Decays of rates from 0.001 to 3 with a little of the curves on top; the SQL halves on the sign of the slope in b."""
    rate = F.element_at(F.array(*[F.lit(r) for r in DECAY_RATES]), F.col("z") + 1)
    p = t.curve.withColumn("x", F.col("thr") / 60 / rate)
    p = p.withColumn("y", 3000 * F.exp(-F.col("thr") / 60) + 4000 + (F.col("n") % 7) * 0.02)
    return cv.exp_decay_fit(p, K, "x", "y").drop("sse")


@query("smooth_thresholds", """select gene, z, thr, avg(thr) over (partition by gene order by z rows between 1 preceding and 1 following) as smooth
    from (select gene, z, avg(n) as thr from curve group by all)""", d="thr smooth", i="z")
def _(t):
    return cv.smooth_thresholds(t.curve.groupBy("gene", "z").agg(F.avg("n").alias("thr")), ["gene"])


@query("curve_knee", """with r as (select gene, z, min(thr) x0, max(thr) x1, min(n) y0, max(n) y1 from curve group by all),
    d as (select gene, z, thr, round((thr-x0)/(x1-x0)::double + (n-y0)/(y1-y0)::double - 1, 9) d from curve join r using (gene, z))
    select gene, z, thr as knee, d as height from d qualify row_number() over (partition by gene, z order by d desc, thr)=1""",
       d="knee height", i="z")
def _(t):
    return cv.curve_knee(t.curve, K)


#: least squares rising sequence as the largest least mean, then cubic fits of 35 points by polynomials orthogonal on the window
CURVATURE = """ci as (select *, row_number() over w - 1 as i, count(*) over (partition by gene, z) as cnt from curve window w as (partition by gene, z order by thr)),
gr as (select *, case when i=0 then lead(n) over w - n when i=cnt-1 then n - lag(n) over w else (lead(n) over w - lag(n) over w)/2.0 end::double as g
  from ci window w as (partition by gene, z order by thr)),
su as (select *, sum(g) over (partition by gene, z order by thr rows unbounded preceding) as s from gr),
ab as (select a.gene, a.z, a.i as a, b.i as i, (b.s-a.s+a.g)/(b.i-a.i+1) as m from su a join su b on a.gene=b.gene and a.z=b.z and b.i>=a.i),
lm as (select *, min(m) over (partition by gene, z, a order by i desc rows unbounded preceding) as least_mean from ab),
up as (select gene, z, i, max(least_mean) as v from lm group by all),
ed as (select *, greatest(0, least(i-17, cnt-35)) as lo, least(cnt, greatest(0, least(i-17, cnt-35))+35) - greatest(0, least(i-17, cnt-35)) as m from ci),
wi as (select e.gene, e.z, e.i, e.thr, e.n, e.cnt, m::double as m, u.v, u.i-lo-(m-1)/2.0::double as c, e.i-lo-(m-1)/2.0::double as c0
  from ed e join up u on e.gene=u.gene and e.z=u.z and u.i>=lo and u.i<lo+m),
po as (select *, c*c-(m*m-1)/12 as q, c0*c0-(m*m-1)/12 as q0, c*c*c-c*(3*m*m-7)/20 as k, c0*c0*c0-c0*(3*m*m-7)/20 as k0 from wi),
sl as (select gene, z, i, po.thr::double as thr, n, cnt, case when max(cnt)<5 then 0 else
  avg(v) + sum(v*c)*max(c0)/sum(c*c) + sum(v*q)*max(q0)/sum(q*q) + sum(v*k)*max(k0)/sum(k*k) end as slope from po group by gene, z, i, po.thr, n, cnt),
st as (select *, thr-lag(thr) over w as hs, lead(thr) over w-thr as hd, lag(slope) over w as f0, lead(slope) over w as f2 from sl window w as (partition by gene, z order by i)),
be as (select *, case when hs is null then (f2-slope)/hd when hd is null then (slope-f0)/hs else (hs*hs*f2+(hd*hd-hs*hs)*slope-hd*hd*f0)/(hs*hd*(hs+hd)) end as bend from st)"""


@query("curve_curvature", f"""with {CURVATURE} select gene, z, thr, n, slope, case when cnt<5 then 0 else abs(bend)/pow(1+slope*slope, 1.5) end as kappa from be""",
       d="thr n slope kappa", i="z")
def _(t):
    return cv.curve_curvature(t.curve, K)


@query("winscore_shifted", f"""with {DERIV}, s as (select a.gene, a.z, a.i, a.thr, w.win, coalesce(var_samp(b.deriv),0)/nullif(avg(b.deriv),0) sc
    from deriv a cross join (select range as win from range(3,22,3)) w join deriv b on a.gene=b.gene and a.z=b.z and b.i between a.i and a.i+w.win-1 group by all)
    select d.gene, d.z, d.i, d.thr, w.win, s.sc as score from deriv d cross join (select range as win from range(3,22,3)) w
    left join s on s.gene=d.gene and s.z=d.z and s.win=w.win and s.i = d.i - floor(w.win*0.5+0.5)::int""", d="thr score", i="i z win")
def _(t):
    return cv.winscore_shifted(cv.curve_derivative(t.curve, K), K)


SCAN = """ci as (select *, row_number() over (partition by gene, z order by thr)-1 as i, count(*) over (partition by gene, z) as cnt from curve),
m1 as (select gene, z, median(n) med from curve group by all),
m2 as (select gene, z, med, median(abs(n-med)) mad from curve join m1 using (gene, z) group by all),
pk as (select gene, z, i as peak from ci qualify row_number() over (partition by gene, z order by n desc, i)=1),
tl as (select ci.*, peak, least(i-peak, cnt-1-i, 2) as reach from ci join pk using (gene, z) where i>=peak and cnt-(peak+1)>=5),
sm as (select a.gene, a.z, a.i, a.thr, round(avg(b.n),9) as s from tl a join tl b on a.gene=b.gene and a.z=b.z and abs(a.i-b.i)<=a.reach group by all),
fs as (select gene, z, f, min(thr) filter (where s<=round(med+mad*f,9)) as sugg, max(thr) mt from sm join m2 using (gene, z), (select range*0.25::double-1 as f from range(9)) group by all)"""


@query("curve_scan_test", f"""with {SCAN} select gene, z, avg(sugg) as th_avg, coalesce(stddev_samp(sugg),0) as th_std, count(sugg) as hits,
    greatest(round(round(avg(sugg)-2*coalesce(stddev_samp(sugg),0),6)),1) as th_min,
    least(round(round(avg(sugg)+2*coalesce(stddev_samp(sugg),0),6)), max(mt)) as th_max from fs group by all having count(sugg)>0""",
       d="th_avg th_std th_min th_max", i="hits z")
def _(t):
    return cv.curve_scan_test(t.curve, K)


SUGG_SQL = """sg as (select gene, z, case win%3 when 0 then 'med' when 1 then 'fit' else 'cross' end as pool, mad_sugg as value from madsugg)"""


def suggestions(t):
    s = cv.curve_mad_suggestion(cv.curve_fano(cv.curve_derivative(t.curve, K), K), [*K, "win"])
    return s.select(*K, F.element_at(F.array(F.lit("med"), F.lit("fit"), F.lit("cross")), (F.col("win") % 3 + 1).cast("int")).alias("pool"),
                    F.col("mad_sugg").alias("value"))


@query("pool_suggestions", f"""with {MAD}, {SUGG_SQL},
    p as (select gene, z, pool, avg(value) + coalesce(stddev_samp(value),0)*0.5::double as lv from sg group by all),
    a as (select gene, z, coalesce(stddev_samp(value),0) std_all, avg(value) mean_all from sg group by all),
    l as (select gene, z, round(round(sum(lv*case pool when 'med' then 0.25::double when 'fit' then 0.5 else 0.25 end),6)) thr from p group by all),
    j as (select *, thr-std_all dmin, thr+std_all dmax from l join a using (gene, z)),
    o as (select *, greatest(dmin,20) omin, least(dmax,60) omax from j)
    select gene, z, mean_all, std_all, round(round(case when omin>omax then case when 20>=dmax then (20+dmax)/2 else (60+dmin)/2 end else (omin+omax)/2 end,6)) as thr
    from o""", d="thr mean_all std_all", i="z")
def _(t):
    return cv.pool_suggestions(suggestions(t), K, {"med": 1.0, "fit": 2.0, "cross": 1.0}, 0.5, (20.0, 60.0))


@query("score_suggestions", f"""with {MAD}, {SUGG_SQL},
    st as (select gene, z, avg(value) mu, stddev_samp(value) sd, median(value) med from sg group by all),
    dv as (select gene, z, mu, sd, med, median(abs(value-med)) mad from sg join st using (gene, z) group by all),
    th as (select gene, z, thr, mu, sd, med, mad, coalesce(lead(thr) over (partition by gene, z order by thr), thr+1) nx from (select gene, z, thr from curve) join dv using (gene, z)),
    bd as (select *, (select count(*) from range(1,33) k where round(abs(thr-med),9) <= round(k.range*0.25::double*mad,9)) b from th),
    hb as (select bd.gene, bd.z, bd.thr, count(value) hits from bd left join sg on sg.gene=bd.gene and sg.z=bd.z and value>=thr
       and value < case when nx=thr+1 then 1e18 else nx end group by all)
    select gene, z, thr, hits, 0.5*exp(-0.5*((thr-mu)/sd)*((thr-mu)/sd))/(sd*sqrt(2*pi())) + 0.5*b/nullif(sum(b) over (partition by gene, z),0)::double as score
    from bd join hb using (gene, z, thr)""", d="thr score", i="hits z")
def _(t):
    return cv.score_suggestions(t.curve.select(*K, "thr"), suggestions(t), K)


@query("low_noise_check", """with c as (select section, channel, count(*) n from dense where v>1+45 group by all)
    select section, channel, log10(7*32*32)-log10(n) >= log10(7*32*32)*0.45::double as low_noise from c""", i="section")
def _(t):
    k = ["section", "channel"]
    shifted = t.dense.withColumn("v", F.col("v") - 45)
    return cv.low_noise_check(sp.spot_count_curve(shifted, 1.0, 5.0, 10, k), t.volumes, k)


@query("peak_5pct_range", """with r as (select gene, z, max(n) mx, min(n) mn from curve group by all),
    p as (select gene, z, mx, mn, min(thr) px from curve join r using (gene, z) where n=mx group by all)
    select gene, z, px as peak_x, coalesce(max(thr) filter (where n<=mx-(mx-mn)*0.05::double and thr<=px), px) as min_x,
    coalesce(min(thr) filter (where n<=mx-(mx-mn)*0.05::double and thr>=px), px) as max_x from curve join p using (gene, z) group by gene, z, px""",
       d="peak_x min_x max_x", i="z")
def _(t):
    return cv.peak_5pct_range(t.curve, K)


