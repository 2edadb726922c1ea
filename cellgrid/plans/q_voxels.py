"""Voxel, region and spot queries."""

import numpy as np
from pyspark.sql import functions as F

from cellgrid.functions.exprs import gaussian_weights, psf_sigma
from cellgrid.functions.lines import by_merge
from cellgrid.operators import curves, regions as rg, spots as sp, voxels as vx
from cellgrid.plans.bindings import GENES, NX, NY, NZ, SHIFTS, UNMIX
from cellgrid.plans.catalog import query
from cellgrid.plans.q_curves import LOGMED, line_sql, two_piece
from cellgrid.plans.sqlkit import line_sums, nearest, reflect, weighted

CH = ["A", "N", "R"]


def lsum(df):
    return df.groupBy("section", "channel", "z", "y").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * (F.col("x") + 1)).alias("sx"))


L = dict(d="s sx", i="z y n section")


@query("fix_saturated", line_sums("select * replace (case when v>80 then 0 else v end as v) from dense"), **L)
def _(t):
    return lsum(vx.fix_saturated(t.dense, 80))


@query("nan_to_zero", "select section, channel, z, y, x, case when v>60 then 0 else v end as v from voxels", d="v")
def _(t):
    broken = t.voxels.withColumn("v", F.when(F.col("v") > 60, float("nan")).otherwise(F.col("v")))
    return vx.nan_to_zero(broken, ["v"])


@query("flip_z", f"select section, channel, {NZ}-1-z as z, y, x, v from voxels", d="v", i="z")
def _(t):
    return vx.flip_z(t.voxels, t.volumes).select("section", "channel", "z", "y", "x", "v")


@query("select_channel", "select * from voxels where channel='N'", d="v")
def _(t):
    return vx.select_channel(t.voxels, "N")


@query("split_channels", "select channel, count(*) as n, sum(v) as s from voxels group by 1", d="s", i="n")
def _(t):
    from cellgrid.sources.sinks import scratch_path
    path = scratch_path(t.spark, "channels")
    vx.split_channels(t.voxels, path)
    return t.spark.read.parquet(path).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))


@query("merge_channels", """select ascii(channel)-65 as channel, section, z, y, x, v from voxels""", d="v", i="channel")
def _(t):
    named = t.voxels.withColumn("path", F.concat(F.lit("out/channel_"), F.ascii("channel") - 65, F.lit(".tif")))
    return vx.merge_channels(named.drop("channel")).select("channel", "section", "z", "y", "x", "v")


@query("crop_roi", "select * from voxels where y>=8 and y<24 and x>=4 and x<30 and z=3", d="v")
def _(t):
    return vx.crop_roi(t.voxels, (8, 24), (4, 30), vx.middle_plane(NZ))


def _quick(p):
    pos = f"least(greatest(n*{p!r}::double-1,0),n-1)"
    return (f"max(v) filter (where rn-1=floor({pos})) + max({pos}-floor({pos})) * "
            f"(max(v) filter (where rn-1=ceil({pos})) - max(v) filter (where rn-1=floor({pos})))")


QUICK = "select *, row_number() over (partition by section, channel order by v) as rn, count(*) over (partition by section, channel) as n from dense"


@query("scale_contrast", line_sums(f"""with lim as (select section, channel, {_quick(.001)} as lo, {_quick(.99995)} as hi0
    from ({QUICK}) group by all), l2 as (select *, case when hi0<=lo then lo+1 else hi0 end as hi from lim)
    select d.* replace (greatest(0,least(1,(v-lo)/(hi-lo))) as v) from dense d join l2 using (section, channel)"""), **L)
def _(t):
    return lsum(vx.scale_contrast(t.dense))


@query("quick_percentile", f"""select section, channel, {_quick(.25)} as p25, {_quick(.9)} as p90 from ({QUICK}) group by all""",
       d="p25 p90")
def _(t):
    return vx.quick_percentile(t.dense, ["section", "channel"], "v", {"p25": 0.25, "p90": 0.9})


@query("minmax_normalise_pair", """with lim as (select section, min(v) lo, max(v) hi from dense where channel in ('A','N') group by 1)
    select section, channel, z, y, sum((v-lo)/(hi-lo)) as s from dense join lim using (section) where channel in ('A','N')
    group by all""", d="s")
def _(t):
    a, b = (t.dense.where(F.col("channel") == c) for c in "AN")
    return vx.minmax_normalise_pair(a, b).groupBy("section", "channel", "z", "y").agg(F.sum("v").alias("s"))


@query("drop_empty_planes", """with p as (select section, z, count(*) c from voxels where v<>0 group by all),
    s as (select section, sum(n_y*n_x) sz from volumes group by 1),
    k as (select section, z, row_number() over (partition by section order by z)-1 as nz from p join s using (section)
          where (sz-c)/sz::double <= 0.894)
    select section, channel, nz as z, y, x, v from voxels join k using (section, z)""", d="v", i="z")
def _(t):
    return vx.drop_empty_planes(t.voxels, t.volumes, 0.894).select("section", "channel", "z", "y", "x", "v")


@query("shift_channels", f"""select section, channel, z, y+dy as y, x+dx as x, v from voxels join
    (values {','.join(map(str, SHIFTS))}) s(channel,dx,dy) using (channel)
    where y+dy between 0 and {NY - 1} and x+dx between 0 and {NX - 1}""", d="v", i="y x")
def _(t):
    shifts = t.rows(SHIFTS, "channel string, dx int, dy int")
    return vx.shift_channels(t.voxels, shifts, t.volumes)


@query("unmix", """with w as (select section,z,y,x, coalesce(max(v) filter (where channel='A'),0) a,
    coalesce(max(v) filter (where channel='N'),0) n, coalesce(max(v) filter (where channel='R'),0) r from voxels group by all),
    w1 as (select *, greatest(0, n-greatest(0,(a-5)*0.3::double)) n1 from w),
    w2 as (select *, greatest(0, r-greatest(0,n1*0.2::double)) r1 from w1)
    select * from (select section,z,y,x,unnest(['A','N','R']) as channel, unnest([a,n1,r1]) as v from w2) where v<>0""", d="v")
def _(t):
    return vx.unmix(t.voxels, UNMIX, CH)


BOX = 8


def spline_inverse(n):
    """Rows (i, j, weight) of the inverse of the spline's (1, 4, 1) / 6 on n mirrored samples."""
    m = np.diag([4.0] * n) + np.diag([1.0] * (n - 1), 1) + np.diag([1.0] * (n - 1), -1)
    m[0, 0] = m[-1, -1] = 5.0
    return ",".join(f"({i},{j},{float(w)!r}::double)" for (i, j), w in np.ndenumerate(np.linalg.inv(m / 6.0)))


def spline_tap(a, n):
    """Cubic weight and mirrored box number of one of four taps around f<a>."""
    d = f"abs(f{a}-(floor(f{a})+t{a}.range))"
    j = f"(floor(f{a})+t{a}.range)::int"
    return (f"case when {d}<1 then (4-6*{d}*{d}+3*{d}*{d}*{d})/6.0::double else power(2-{d},3)/6.0::double end as w{a}, "
            f"case when {j}<0 then -({j})-1 when {j}>={n} then 2*{n}-({j})-1 else {j} end as j{a}")


SPLINE_INVERSE = spline_inverse(NY // BOX)
BG_SQL = f"""
b0 as (select section, channel, z, y//{BOX} as "by", x//{BOX} as bx, v from dense),
{''.join(f'''m{k} as (select section, channel, z, "by", bx, median(v) m, stddev_pop(v) s from b{k} group by all),
b{k + 1} as (select b{k}.* from b{k} join m{k} using (section, channel, z, "by", bx) where abs(v-m) <= 3.0*s + 1e-12),
''' for k in range(5))}
bx0 as (select section, channel, z, "by", bx, median(v) m from b5 group by all),
bxs as (select a.section, a.channel, a.z, a."by", a.bx, median(b.m) m from bx0 a join bx0 b on a.section=b.section
  and a.channel=b.channel and a.z=b.z and abs(a."by"-b."by")<=1 and abs(a.bx-b.bx)<=1 group by all),
inv(i,j,w) as (values {SPLINE_INVERSE}),
cf as (select section, channel, z, p.i as "by", q.i as bx, sum(p.w*q.w*m) as c from bxs join inv p on p.j="by" join inv q on q.j=bx group by all),
rng as (select section, channel, z, min(m) lo, max(m) hi from bxs group by all),
pos as (select *, (y+0.5::double)/{BOX}-0.5 fy, (x+0.5::double)/{BOX}-0.5 fx from dense),
tap as (select section, channel, z, y, x, {spline_tap('y', NY // BOX)}, {spline_tap('x', NX // BOX)} from pos, range(-1,3) ty, range(-1,3) tx),
bgs as (select t.section, t.channel, t.z, t.y, t.x, sum(wy*wx*c) as s from tap t join cf on cf.section=t.section and cf.channel=t.channel and cf.z=t.z
  and cf."by"=jy and cf.bx=jx group by all),
bgv as (select d.*, least(greatest(s, lo), hi) as bg from dense d join bgs using (section, channel, z, y, x) join rng using (section, channel, z))"""


@query("estimate_background", f"""with {BG_SQL} select section, channel, z, y, count(*) as n, sum(bg) as s, sum(bg*(x+1)) as sx
    from bgv group by all""", **L)
def _(t):
    return lsum(vx.estimate_background(t.dense, BOX).withColumn("v", F.col("bg")))


@query("remove_lipofuscin", f"""with {BG_SQL}, w as (select section,z,y,x,
    {','.join(f"max(v) filter (where channel='{c}') v{c}, max(bg) filter (where channel='{c}') b{c}" for c in CH)} from bgv group by all),
    r as (select *, coalesce(greatest(0,least((vA-bA)/bA,(vN-bN)/bN)),0) rel from w)
    select section, z, y, sum(greatest(0,vR-rel*bR*0.8::double)) as sr, sum(greatest(0,vN-rel*bN*0.5::double)) as sn
    from r group by all""", d="sr sn")
def _(t):
    out = vx.remove_lipofuscin(vx.estimate_background(t.dense, BOX), ["A", "N"], {"R": 0.8, "N": 0.5})
    return out.groupBy("section", "z", "y").agg(*[
        F.sum(F.when(F.col("channel") == c, F.col("v"))).alias(n) for c, n in (("R", "sr"), ("N", "sn"))])


@query("delta_f_over_f", f"""with {BG_SQL} select section, mask_id, channel, greatest(0,avg(v-bg))/avg(bg) as dff
    from bgv join masks using (section,z,y,x) group by all""", d="dff")
def _(t):
    return vx.delta_f_over_f(vx.estimate_background(t.dense, BOX), t.masks)


def lc_sql(src, out, rx, ry, factor, mode):
    ones = lambda r: [1.0] * (2 * r + 1)
    n = (2 * rx + 1) * (2 * ry + 1)
    expr = {"center": "v - m + av", "both": f"(v-(m-{factor}*sd))/nullif(2*{factor}*sd,0)*(mx-mn)+mn",
            "stretch": f"(v-m)/nullif(2*{factor}*sd,0)*(mx-mn)+m"}[mode]
    ns = {"x": NX, "y": NY}
    return f"""{out}_i as (select *, v::double as p, v*v as q from {src}),
{out}_x as ({weighted(f'{out}_i', 'x', ones(rx), {'p': 'p', 'q': 'q'}, reflect, str(ns['x']))}),
{out}_y as ({weighted(f'{out}_x', 'y', ones(ry), {'p': 'p', 'q': 'q'}, reflect, str(ns['y']))}),
{out}_g as (select section, channel, min(v) mn, max(v) mx, avg(v) av from {src} group by all),
{out}_s as (select section, channel, z, y, x, s.v, p/{n} as m, sqrt(greatest(0, q/{n} - (p/{n})*(p/{n}))) as sd, mn, mx, av
  from {out}_y join {src} s using (section, channel, z, y, x) join {out}_g using (section, channel)),
{out} as (select section, channel, z, y, x, {expr} as v from {out}_s)"""


for name, mode, flags in (("local_contrast", "both", (True, True)), ("local_contrast_center", "center", (True, False)),
                          ("local_contrast_stretch", "stretch", (False, True))):
    def _(t, flags=flags):
        return lsum(vx.local_contrast(t.dense, 3, 2, 3.0, *flags))
    query(name, f"with {lc_sql('dense', 'lc', 3, 2, '3.0::double', mode)} {line_sums('select * from lc')}", **L)(_)


def ball_sql(src, out, radius, s):
    ny, nx = NY // s, NX // s
    half = {dy: int((radius * radius - dy * dy) ** .5 + 1e-9) for dy in range(-radius, radius + 1)}
    offs = ",".join(f"({dy},{w})" for dy, w in half.items() if abs(dy) < ny)
    base = lambda c, n: f"least(greatest(floor(({c}-{s // 2})/{s}.0),0),{n - 2})"
    pos = lambda c: f"(({c}+0.5::double)/{s}-0.5)"
    return f"""{out}_sm as (select section, channel, z, y//{s} as y, x//{s} as x, min(v) as v from {src} group by all),
{out}_dk as (select a.section, a.channel, a.z, a.y, a.x, min(b.v) as v from {out}_sm a, (values {offs}) o(dy,w), {out}_sm b
  where a.section=b.section and a.channel=b.channel and a.z=b.z and b.y=a.y+o.dy and b.x between a.x-o.w and a.x+o.w group by all),
{out}_p as (select section, channel, z, y, x, v, {base('y', ny)} as y0, {base('x', nx)} as x0, {pos('y')} py, {pos('x')} px from {src}),
{out} as (select p.section, p.channel, p.z, p.y, p.x, p.v - sum(
   (case when d.y=y0 then 1-(py-y0) else py-y0 end)*(case when d.x=x0 then 1-(px-x0) else px-x0 end)*d.v) as v
  from {out}_p p join {out}_dk d on p.section=d.section and p.channel=d.channel and p.z=d.z and d.y between y0 and y0+1
  and d.x between x0 and x0+1 group by p.section, p.channel, p.z, p.y, p.x, p.v)"""


@query("rolling_ball_subtract", f"with {ball_sql('dense', 'rb', 12, 2)} {line_sums('select * from rb')}", **L)
def _(t):
    return lsum(vx.rolling_ball_subtract(t.dense, 12))


@query("preprocess_registration", f"""with {lc_sql('dense', 'l1', 6, 6, '3.0::double', 'center')},
    {ball_sql('l1', 'l2', 12, 2)}, {lc_sql('l2', 'l3', 4, 4, '3.0::double', 'stretch')}
    {line_sums('select * replace (coalesce(v,0) as v) from l3')}""", d="s sx", i="z y n section", digits=4)
def _(t):
    return lsum(vx.preprocess_registration(t.dense, 6, 12, 4))


GW = gaussian_weights(0.8)


@query("gaussian_smooth", f"""with gx as ({weighted('dense', 'x', GW, {'v': 'v'})}),
    gy as ({weighted('gx', 'y', GW, {'v': 'v'}, n=str(NY))}) {line_sums('select * from gy')}""", **L)
def _(t):
    return lsum(vx.gaussian_smooth(t.dense, 0.8))


SIG = psf_sigma("Alexa Fluor 647")
G0, G2 = vx.log_kernels(SIG)
LOG_SQL = f"""g_x as ({weighted('dense', 'x', G0, {'v': 'v'}, reflect)}), g2_x as ({weighted('dense', 'x', G2, {'v': 'v'}, reflect)}),
a_ as ({weighted('g2_x', 'y', G0, {'v': 'v'}, reflect, str(NY))}), b_ as ({weighted('g_x', 'y', G2, {'v': 'v'}, reflect, str(NY))}),
lg as (select section, channel, z, y, x, greatest(0, -(a_.v+b_.v)) as v from a_ join b_ using (section, channel, z, y, x))"""


@query("log_filter", f"with {LOG_SQL} {line_sums('select * from lg')}", **L)
def _(t):
    return lsum(vx.log_filter(t.dense, SIG))


LM_SQL = """select section, channel, z, y, x, v from (select *, max(mx) over (partition by section, channel, z, x order by y
    rows between 1 preceding and 1 following) as m from (select *, max(v) over (partition by section, channel, z, y order by x
    rows between 1 preceding and 1 following) as mx from dense)) where v=m"""


@query("local_maxima", LM_SQL, d="v")
def _(t):
    return vx.local_maxima(t.dense, 1).select("section", "channel", "z", "y", "x", "v")


@query("spots_threshold", f"""select m.* from ({LM_SQL}) m join (values ('A',60),('N',70),('R',65)) h(channel,thr) using (channel)
    where v > thr""", d="v")
def _(t):
    thr = t.rows([("A", 60.0), ("N", 70.0), ("R", 65.0)], "channel string, thr double")
    return sp.spots_threshold(vx.local_maxima(t.dense, 1), thr, ["channel"]).select("section", "channel", "z", "y", "x", "v")


@query("spot_count_curve", """select gene, z, range*3.0::double as thr, count(*) filter (where v > range*3.0) as n
    from (select channel as gene, z, v from dense), range(100) group by all""", d="thr", i="n z")
def _(t):
    return sp.spot_count_curve(t.dense.withColumnRenamed("channel", "gene"), 0.0, 3.0, 100)


@query("threshold_range", """with p as (select section, channel, z, quantile_cont(v,0.95) a, quantile_cont(v,0.999999) b from dense group by all),
    e as (select section, channel, median(a) lo, median(b) hi from p group by all)
    select section, channel, range as k, lo+(hi-lo)*range/99.0::double as thr from e, range(100)""", d="thr", i="k")
def _(t):
    return vx.threshold_range(t.dense, 100)


@query("dense_spot_split", i="section z spot", d="cy cx total")
def _(t):
    return sp.dense_spot_split(t.voxels.where("v > 20"))


SPC = """with pp as (select m.* from masks m join good_cells c on m.section=c.section and m.mask_id=c.mask_id
    and m.z = c.z_plane + c.principal_plane - 2),
    h as (select section, mask_id, gene, count(*) c from (select distinct section, gene, z, y, x from spots) s
          join pp using (section, z, y, x) group by all)"""


SPC_SQL = f"""{SPC} select g.section, g.mask_id, {','.join(f"coalesce(max(c) filter (where gene='{c}'),0) as {c}" for c in CH)}
    from good_cells g left join h using (section, mask_id) group by all"""


@query("spots_per_cell", SPC_SQL, i="section mask_id A N R")
def _(t):
    pp = rg.principal_plane_masks(t.masks, t.good_cells)
    return sp.spots_per_cell(t.spots, pp, t.good_cells, CH)


@query("principal_plane_masks", "select section, mask_id, z, y, x from masks join good_cells using (section, mask_id) where z=z_plane+principal_plane-2",
       i="mask_id z y x section")
def _(t):
    return rg.principal_plane_masks(t.masks, t.good_cells).select("section", "mask_id", "z", "y", "x")


@query("spot_density", """select section, mask_id, z, count(distinct case when s.x is not null then m.y*1000+m.x end) as n,
    count(distinct m.y*1000+m.x) as area, n/area as density from masks m left join spots s using (section, z, y, x) group by all""",
       d="density", i="n area mask_id z section")
def _(t):
    return sp.spot_density(t.spots, t.masks)


@query("filter_spots_in_mask", "select s.* from spots s where exists (select 1 from masks m where m.section=s.section and m.z=s.z and m.y=s.y and m.x=s.x)", d="v")
def _(t):
    return sp.filter_spots_in_mask(t.spots, t.masks).select("section", "gene", "z", "y", "x", "v")


@query("spots_per_plane", """select c.section, g.range as z, count(s.x) as n from sections c cross join range(7) g
    left join spots s on s.section=c.section and s.z=g.range group by all""", i="section z n")
def _(t):
    return sp.spots_per_plane(t.spots, t.sections)


@query("plane_thresholds", f"""with lm as ({LM_SQL}), p as (select section, channel, z, quantile_cont(v,0.95) a, quantile_cont(v,0.999999) b from dense group by all),
    e as (select section, channel, median(a) lo, median(b) hi from p group by all),
    pc as (select section, channel, z, lo+(hi-lo)*k.range/99.0::double as thr, count(*) filter (where round((v-lo)/((hi-lo)/99),9) > k.range) as n
      from lm join e using (section, channel), range(100) k group by all), {two_piece('pc', 'tp', 'section, channel, z', 'thr', 'n')}
    select section, channel, z, knot as thr, avg(knot) over (partition by section, channel order by z rows between 1 preceding and 1 following) as smooth from tp""",
       d="thr smooth", i="z section")
def _(t):
    return curves.plane_thresholds(vx.local_maxima(t.dense, 1), t.dense, 100)


@query("region_props", """select section, mask_id, channel, count(*) as volume, avg(z) as cz, avg(y) as cy, avg(x) as cx,
    min(v) as min_v, avg(v) as mean_v from masks join dense using (section,z,y,x) group by all""",
       d="cz cy cx min_v mean_v", i="volume mask_id section")
def _(t):
    return rg.region_props(t.dense, t.masks)


@query("keep_nonzero_cells", """select section, mask_id from (select section, mask_id, channel, min(v) mv from masks join
    (select * replace (v-30 as v) from dense) using (section,z,y,x) group by all) group by all having bool_and(mv>0)""", i="section mask_id")
def _(t):
    return rg.keep_nonzero_cells(rg.region_props(t.dense.withColumn("v", F.col("v") - 30), t.masks))


@query("crop_bounds", f"""select section, greatest(min(y)-2,0) as y_start, least(max(y)+3,{NY}) as y_stop,
    greatest(min(x)-2,0) as x_start, least(max(x)+3,{NX}) as x_stop from masks group by 1""", i="section y_start y_stop x_start x_stop")
def _(t):
    return rg.crop_bounds(t.masks, t.sections, 2)


@query("depth_attenuation", f"""with {LOGMED}, {line_sql('lm', 'rl', 'section, channel', 42)}
    select section, channel, z, y, count(*) as n, sum(w) as s, sum(w*(x+1)) as sx from
    (select *, round_even(round(v*exp(-slope*z),9),0) as w from dense join rl using (section, channel)) group by all""", **L)
def _(t):
    return lsum(curves.depth_attenuation(t.dense, sigma=SIG, seed=42))


@query("label_overlap_filter", """with lab as (select section, channel as label, z, y, x from voxels where v > 10),
    sz as (select section, mask_id, count(*) n from masks group by all),
    h as (select section, mask_id, label, count(*) h from masks join lab using (section,z,y,x) group by all),
    ok as (select distinct section, mask_id from h join sz using (section, mask_id) where h/n::double >= 0.14)
    select m.* from masks m join ok using (section, mask_id)""", i="section mask_id z y x")
def _(t):
    labels = t.voxels.where("v > 10").select("section", F.col("channel").alias("label"), "z", "y", "x")
    return rg.label_overlap_filter(t.masks, labels, 0.14).select("section", "mask_id", "z", "y", "x")


REGION = "select parcellation_index as parc_id from parc_terms where division in ('ASIA','EUROPE')"


def region_ids(t):
    return t.parc_terms.where(F.col("division").isin("ASIA", "EUROPE")).select(F.col("parcellation_index").alias("parc_id"))


@query("masks_in_region", f"""with c as (select section, mask_id, round(avg(z)) z, round(avg(y)) y, round(avg(x)) x from masks group by all),
    ok as (select c.section, c.mask_id from c join annotation a on a.section=c.section and a.z=c.z and a.y=c.y and a.x=c.x where parc_id in ({REGION}))
    select m.* from masks m join ok using (section, mask_id)""", i="section mask_id z y x")
def _(t):
    return rg.masks_in_region(t.masks, t.annotation, region_ids(t)).select("section", "mask_id", "z", "y", "x")


@query("clip_masks_to_region", f"select m.* from masks m join annotation a using (section,z,y,x) where parc_id in ({REGION})",
       i="section mask_id z y x")
def _(t):
    return rg.clip_masks_to_region(t.masks, t.annotation, region_ids(t)).select("section", "mask_id", "z", "y", "x")


@query("relabel_dense", f"""with m as (select m.* from masks m join annotation a using (section,z,y,x) where parc_id in ({REGION}))
    select section, mask_id, z, y, x, dense_rank() over (partition by section order by mask_id)-1 as new_id from m""",
       i="section mask_id z y x new_id")
def _(t):
    return rg.relabel_dense(rg.clip_masks_to_region(t.masks, t.annotation, region_ids(t))).select(
        "section", "mask_id", "z", "y", "x", "new_id")


@query("annotation_boundaries", """with e as (select distinct a.section, a.z, a.y, a.x from annotation a
    cross join (values (0,1),(0,-1),(1,0),(-1,0)) o(dy,dx)
    join annotation b on a.section=b.section and a.z=b.z and b.y=a.y+dy and b.x=a.x+dx where a.parc_id<>b.parc_id)
    select distinct a.section, a.z, a.y, a.x from e cross join range(-2,3) p(dy) cross join range(-2,3) q(dx)
    join annotation a on a.section=e.section and a.z=e.z and a.y=e.y+dy and a.x=e.x+dx where abs(dy)+abs(dx)<=2""",
       i="section z y x")
def _(t):
    return rg.annotation_boundaries(t.annotation, 2)


@query("region_perimeter", f"""with i as (select section,z,y,x from annotation where parc_id in ({REGION})),
    n as (select a.section,a.z,a.y,a.x,count(b.x) c from i a cross join (values (0,1),(0,-1),(1,0),(-1,0)) o(dy,dx)
    left join i b on a.section=b.section and a.z=b.z and b.y=a.y+dy and b.x=a.x+dx group by all)
    select section,z,y,x from n where c<4""", i="section z y x")
def _(t):
    return rg.region_perimeter(t.annotation, region_ids(t))


@query("majority_filter", f"""select section, z, yy as y, xx as x from (select section, z, y+a as yy, x+b as xx
      from (select distinct section,z,y,x from voxels) v, (values (-1),(0),(1)) p(a), (values (-1),(0),(1)) q(b))
    where yy between 0 and {NY - 1} and xx between 0 and {NX - 1} group by section, z, yy, xx having count(*)>=5""",
       i="section z y x")
def _(t):
    return rg.majority(t.voxels.select("section", "z", "y", "x").distinct(), t.sections)


@query("color_by_gene", """with p as (select section, mask_id, count(*) as value from masks join spots using (section,z,y,x) where gene='A' group by all)
    select m.*, p.value from masks m join p using (section, mask_id)""", i="section mask_id z y x value")
def _(t):
    expr = by_merge(t.masks).join(t.spots, ["section", "z", "y", "x"]).groupBy("section", "mask_id", "gene").agg(
        F.count(F.lit(1)).alias("value"))
    return rg.color_by_gene(t.masks, expr, "A").select("section", "mask_id", "z", "y", "x", "value")


@query("color_by_type", """select section, mask_id, m.z, m.y, m.x, round_even((mask_id%4)*10*0.01::double*255,0) as r,
    round_even(0.5::double*255,0) as g, round_even((mask_id%4)*25*0.01::double*255,0) as b, 255 as a
    from masks m join good_cells using (section, mask_id)""", i="section mask_id z y x r g b a")
def _(t):
    types = t.good_cells.select("section", "mask_id", (F.col("mask_id") % 4).alias("subclass"))
    colours = types.select("subclass").distinct().select(
        "subclass", (F.col("subclass") * 10 * F.lit(0.01)).alias("r"), F.lit(0.5).alias("g"),
        (F.col("subclass") * 25 * F.lit(0.01)).alias("b"))
    return rg.color_by_type(t.masks, types, colours).select("section", "mask_id", "z", "y", "x", "r", "g", "b", "a")


@query("roi_mean", "select section, channel, z, avg(v) as mean_v from dense where y>=4 and y<20 and x>=6 and x<31 group by all", d="mean_v")
def _(t):
    return vx.roi_mean(t.dense, (4, 20), (6, 31))


@query("roi_median", "select section, channel, z, median(v) as median_v from dense where y>=4 and y<20 and x>=6 and x<31 group by all", d="median_v")
def _(t):
    return vx.roi_median(t.dense, (4, 20), (6, 31))


@query("pixel_lookup", "select section, channel, z, v from dense where y=7 and x=9", d="v")
def _(t):
    return vx.pixel_lookup(t.dense, 7, 9).select("section", "channel", "z", "v")


@query("histogram_match", f"""with c as (select section, channel, z, v, count(*) n from dense group by all),
    f as (select section, channel, z, v, sum(n) over (partition by section, channel, z order by v)::double/(sum(n) over (partition by section, channel, z)) q from c),
    r as (select section, channel, v rv, q rq from f where z=0),
    lo as (select f.*, r.rv as v0, r.rq as q0 from f asof left join r on f.section=r.section and f.channel=r.channel and f.q>=r.rq),
    hi as (select lo.*, r.rv as v1, r.rq as q1 from lo asof left join r on lo.section=r.section and lo.channel=r.channel and lo.q<=r.rq),
    m as (select section, channel, z, v, case when v0 is null then v1 when v1 is null then v0 when q1=q0 then v0
      else v0+(q-q0)/(q1-q0)*(v1-v0) end as nv from hi)
    {line_sums('select d.section, d.channel, d.z, d.y, d.x, m.nv as v from dense d join m using (section, channel, z, v)')}""", **L)
def _(t):
    return lsum(vx.histogram_match(t.dense))


def _foc(src, axis, w, n):
    return weighted(src, axis, w, {"v": "v"}, reflect, n)


@query("focus_metrics", f"""with dx as ({_foc('dense', 'x', [-.5, 0., .5], str(NX))}), sx as ({_foc('dense', 'x', [.25, .5, .25], str(NX))}),
    gx as ({_foc('dx', 'y', [.25, .5, .25], str(NY))}), gy as ({_foc('sx', 'y', [-.5, 0., .5], str(NY))}),
    lx as ({_foc('dense', 'x', [1., -2., 1.], str(NX))}), ly as ({_foc('dense', 'y', [1., -2., 1.], str(NY))})
    select section, channel, z, avg((gx.v*gx.v+gy.v*gy.v)/2)/avg(d.v) as tenengrad, var_pop(lx.v+ly.v) as laplace_var
    from gx join gy using (section,channel,z,y,x) join lx using (section,channel,z,y,x) join ly using (section,channel,z,y,x)
    join dense d using (section,channel,z,y,x) group by all""", d="tenengrad laplace_var", digits=5)
def _(t):
    return vx.focus_metrics(t.dense)


@query("plane_correlation", """with r as (select section, channel, y, x, v as ref from dense where z=3)
    select section, channel, z, corr(v, ref) as r from dense join r using (section, channel, y, x) group by all""", d="r")
def _(t):
    ref = t.dense.where("z = 3").select("section", "channel", "y", "x", F.col("v").alias("ref"))
    return vx.plane_correlation(t.dense, ref)


def _resize(size, method):
    nz, ny, nx = size
    coord = lambda a, n, m: f"((g{a}.range+1.0::double)*{n}/{m}-1.0)"
    pts = f"""pts as (select section, channel, gz.range as z, gy.range as y, gx.range as x, {coord('z', NZ, nz)} sz, {coord('y', NY, ny)} sy,
      {coord('x', NX, nx)} sx from volumes, range({nz}) gz, range({ny}) gy, range({nx}) gx)"""
    if method == "nearest":
        near = lambda a, n: f"{nearest(f'floor(s{a}+0.5)', n)}"
        return f"""with {pts} select p.section, p.channel, p.z, p.y, p.x, d.v from pts p join dense d on d.section=p.section and d.channel=p.channel
          and d.z={near('z', NZ)} and d.y={near('y', NY)} and d.x={near('x', NX)}"""
    tap = lambda a, n: f"{nearest(f'(floor(s{a})+o{a}.range)', n)}::int as j{a}"
    w = lambda a: f"(case when o{a}.range=1 then s{a}-floor(s{a}) else 1-(s{a}-floor(s{a})) end)"
    return f"""with {pts}, tp as (select section, channel, z, y, x, {tap('z', NZ)}, {tap('y', NY)}, {tap('x', NX)}, {w('z')}*{w('y')}*{w('x')} as w
      from pts, range(2) oz, range(2) oy, range(2) ox)
      select p.section, p.channel, p.z, p.y, p.x, sum(w*d.v) as v from tp p join dense d on d.section=p.section and d.channel=p.channel and d.z=jz
      and d.y=jy and d.x=jx group by p.section, p.channel, p.z, p.y, p.x"""


@query("resize_volume", line_sums(_resize((4, 20, 24), "linear")), **L)
def _(t):
    return lsum(vx.resize_volume(t.dense, t.volumes, (4, 20, 24), "linear"))


@query("resize_volume_nearest", line_sums(_resize((10, 20, 40), "nearest")), **L)
def _(t):
    return lsum(vx.resize_volume(t.dense, t.volumes, (10, 20, 40), "nearest"))


@query("qc_pass_by_zspan", """select z_span, count(*) as n, avg((result='good')::int) as pass_rate from mask_qc group by 1""",
       d="pass_rate", i="n z_span")
def _(t):
    return rg.qc_pass_by_zspan(t.mask_qc)
