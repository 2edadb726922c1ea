"""Similarity and deformation queries (channel A against channel N of each section)."""

from pyspark.sql import functions as F

from cellgrid.functions.exprs import gaussian_weights
from cellgrid.functions.lines import by_merge
from cellgrid.operators import similarity as sm, voxels as vx
from cellgrid.plans.bindings import NX, NY, NZ
from cellgrid.plans.catalog import query
from cellgrid.plans.sqlkit import line_sums, nearest

PAIR = """pr as (select a.section, a.z, a.y, a.x, a.v, b.v as u from (select * from dense where channel='A') a
 join (select * from dense where channel='N') b on a.section=b.section and a.z=b.z and a.y=b.y and a.x=b.x)"""
T = dict(d="t", i="section")


def pair(t):
    return tuple(t.dense.where(F.col("channel") == c).drop("channel") for c in "AN")


@query("sim_d", f"with {PAIR} select section, avg(v-u) as t from pr group by 1", **T)
def _(t):
    return sm.sim_d(*pair(t))


@query("sim_sd", f"with {PAIR} select section, avg((v-u)*(v-u)) as t from pr group by 1", **T)
def _(t):
    return sm.sim_sd(*pair(t))


@query("sim_ld", f"with {PAIR} select section, avg(ln(abs(v-u)+1)) as t from pr group by 1", **T)
def _(t):
    return sm.sim_ld(*pair(t))


@query("sim_sd_masked", f"with {PAIR} select section, avg((v-u)*(v-u)) as t from pr join masks using (section,z,y,x) group by 1", **T)
def _(t):
    return sm.sim_sd(*pair(t), t.masks.withColumn("weight", F.lit(1.0)))


@query("sim_cc", f"with {PAIR} select section, 1-corr(v,u) as t from pr group by 1", **T)
def _(t):
    return sm.sim_cc(*pair(t))


def sobel_sql(src, out, col, ndim):
    k3 = lambda d, s1, s2: f"(case when abs({s1})+abs({s2})=2 then 1 when abs({s1})+abs({s2})=1 then 3 else 6 end)*({d})"
    if ndim == 2:
        sel = f"sum({'b.' + col}*dx*(2-abs(dy))) as gx, sum({'b.' + col}*dy*(2-abs(dx))) as gy"
        offs = "range(-1,2) p(dy), range(-1,2) q(dx), (values (0)) r(dz)"
    else:
        sel = (f"sum(b.{col}*{k3('dx', 'dy', 'dz')}) as gx, sum(b.{col}*{k3('dy', 'dx', 'dz')}) as gy, sum(b.{col}*{k3('dz', 'dy', 'dx')}) as gz")
        offs = "range(-1,2) p(dy), range(-1,2) q(dx), range(-1,2) r(dz)"
    return f"""{out}_t as materialized (select section, z, y, x, dz, dy, dx, z+dz as jz, y+dy as jy, x+dx as jx from {src}, {offs}),
{out} as (select a.section, a.z, a.y, a.x, {sel} from {out}_t a join {src} b on b.section=a.section and b.z=jz
  and b.y=jy and b.x=jx group by a.section, a.z, a.y, a.x)"""


EPS = "2.220446049250313e-16::double"


def gd_sql(ndim):
    g = ["gx", "gy"] + (["gz"] if ndim == 3 else [])
    scope = "section" if ndim == 3 else "section, z"
    return f"""with {PAIR}, rt as (select section, avg(v)/avg(u) a from pr group by 1),
    dd as (select section, z, y, x, v-a*u as d from pr join rt using (section)), {sobel_sql('dd', 'sb', 'd', ndim)},
    vr as (select {scope}, {', '.join(f'var_samp({c}) v{c}' for c in g)} from sb group by {scope})
    select section, 2-avg({'+'.join(f'v{c}/(v{c}+{c}*{c}+{EPS})' for c in g)}) as t from sb join vr using ({scope}) group by 1"""


def gc_sql(ndim):
    g = ["gx", "gy"] + (["gz"] if ndim == 3 else [])
    scope = "section" if ndim == 3 else "section, z"
    return f"""with {PAIR}, {sobel_sql('pr', 'sv', 'v', ndim)}, {sobel_sql('pr', 'su', 'u', ndim)},
    r as (select {scope}, ({'+'.join(f'corr(sv.{c},su.{c})' for c in g)})/{len(g)} as r from sv join su using (section,z,y,x) group by {scope})
    select section, 1-avg(r) as t from r group by 1"""


for name, fn, sql in (("sim_gd", sm.sim_gd, gd_sql), ("sim_gc", sm.sim_gc, gc_sql)):
    for ndim, suffix in ((3, ""), (2, "_2d")):
        def _(t, fn=fn, ndim=ndim):
            return fn(*pair(t), ndim=ndim)
        query(name + suffix, sql(ndim), **T)(_)


@query("sim_pi", f"""with {PAIR}, m as (select section, avg(v) mv, avg(u) mu, count(*) n from pr group by 1),
    d as (select section, z, y, x, n, v/(mv+1e-5::double)-u/(mu+1e-5::double) as d from pr join m using (section)),
    t as materialized (select *, y+dy as jy, x+dx as jx from d, range(-3,4) p(dy), range(-3,4) q(dx) where dy*dy+dx*dx<=9
      and y between 3 and {NY - 4} and x between 3 and {NX - 4}),
    s as (select a.section, a.n, a.z, a.y, a.x, avg(0.09::double/(0.09::double+(a.d-b.d)*(a.d-b.d))) s from t a join d b
      on a.section=b.section and a.z=b.z and b.y=a.jy and b.x=a.jx group by all)
    select section, 1-sum(s)/max(n) as t from s group by 1""", **T)
def _(t):
    return sm.sim_pi(*pair(t), radius=3)


UNIT = PAIR + """, mm as (select section, least(min(v),min(u)) lo, greatest(max(v),max(u)) hi from pr group by 1),
un as (select section, z, y, x, (v-lo)/(hi-lo) as v, (u-lo)/(hi-lo) as u from pr join mm using (section))"""


def hist_sql(src, out, bins, keys):
    return f"""{out}_s as (select {keys}, v*{bins}.0::double as pi, u*{bins}.0::double as pj from {src}),
{out}_e as (select {keys}, least(greatest(floor(pi)+a.range,0),{bins - 1})::int as i, least(greatest(floor(pj)+b.range,0),{bins - 1})::int as j,
  (case a.range when 1 then pi-floor(pi) else 1-(pi-floor(pi)) end)*(case b.range when 1 then pj-floor(pj) else 1-(pj-floor(pj)) end) as p
  from {out}_s, range(2) a, range(2) b),
{out} as (select {keys}, i, j, sum(p)/sum(sum(p)) over (partition by {keys}) as p from {out}_e group by {keys}, i, j)"""


def mi_sql(src, out, bins, keys):
    vals = ",".join(f"({k - 3},{w!r}::double)" for k, w in enumerate(gaussian_weights(1.0)))
    cols = lambda p: ", ".join(f"{p}.{k}" for k in keys.split(", "))
    same = " and ".join(f"b.{k}=a.{k}" for k in keys.split(", "))
    c = lambda e: nearest(e, str(bins))
    return f"""{hist_sql(src, out + '_h', bins, keys)},
{out}_g as (select k.*, gi.range as i, gj.range as j, coalesce(p,0) as p from (select distinct {keys} from {out}_h) k cross join range({bins}) gi cross join range({bins}) gj
  left join {out}_h h on {' and '.join(f'h.{k}=k.{k}' for k in keys.split(', '))} and h.i=gi.range and h.j=gj.range),
{out}_k as materialized (select a.*, w.w, {c('(a.i+w.o)')} as ji, {c('(a.j+w.o)')} as jj from {out}_g a, (values {vals}) w(o,w)),
{out}_x as (select {cols('a')}, a.i, a.j, sum(a.w*b.p) p from {out}_k a join {out}_g b on {same} and b.j=a.j and b.i=a.ji group by all),
{out}_y as (select {cols('a')}, a.i, a.j, sum(a.w*b.p) p from {out}_k a join {out}_x b on {same} and b.i=a.i and b.j=a.jj group by all),
{out}_1 as (select {keys}, i, sum(p) p from {out}_g group by {keys}, i), {out}_2 as (select {keys}, j as i, sum(p) p from {out}_g group by {keys}, j),
{out}_1s as (select {cols('a')}, a.i, sum(w.w*b.p) p from {out}_1 a, (values {vals}) w(o,w), {out}_1 b where {same} and b.i={c('(a.i+w.o)')} group by all),
{out}_2s as (select {cols('a')}, a.i, sum(w.w*b.p) p from {out}_2 a, (values {vals}) w(o,w), {out}_2 b where {same} and b.i={c('(a.i+w.o)')} group by all),
{out} as (select {keys}, -(ha+hb)/hab as t from (select {keys}, -sum(p*ln(p+{EPS})) ha from {out}_1s group by {keys})
  join (select {keys}, -sum(p*ln(p+{EPS})) hb from {out}_2s group by {keys}) using ({keys})
  join (select {keys}, -sum(p*ln(p+{EPS})) hab from {out}_y group by {keys}) using ({keys}))"""


@query("joint_histogram", f"with {UNIT}, {hist_sql('un', 'jh', 128, 'section')} select * from jh where p > 1e-12", d="p", i="i j section", digits=9)
def _(t):
    return sm.joint_histogram(sm._unit_pairs(*pair(t), None), 128).where("p > 1e-12")


@query("sim_mi", f"with {UNIT}, {mi_sql('un', 'mi', 128, 'section')} select * from mi", **T)
def _(t):
    return sm.sim_mi(*pair(t))


def _edge(n, r):
    return lambda k: f"(round(1+({n}-1)*({k})/{r}.0::double)-1)"


def smoothing_rows(bins):
    """Rows (i, s, weight) of the Gaussian with its ends held: what bin s gives to bin i."""
    w = gaussian_weights(1.0)
    rows = {}
    for i in range(bins):
        for k, x in enumerate(w):
            at = (i, min(max(i + k - len(w) // 2, 0), bins - 1))
            rows[at] = rows.get(at, 0.0) + x
    return ",".join(f"({i},{s},{x!r}::double)" for (i, s), x in rows.items())


def sparse_mi_sql(src, out, bins, keys):
    """The measure over filled bins only: empty ones add nothing, and many blocks times all bins would be too many rows."""
    smooth = lambda a, col, rest: f"select {keys}, k.i as {col}{rest}, sum(k.w*p) as p from {a} join {out}_k k on k.s={a}.{col} group by all"
    part = lambda a: f"(select {keys}, -sum(p*ln(p+{EPS})) as h from {a} group by {keys})"
    return f"""{hist_sql(src, out + '_h', bins, keys)}, {out}_k(i,s,w) as (values {smoothing_rows(bins)}),
{out}_x as ({smooth(out + '_h', 'i', ', j')}), {out}_y as ({smooth(out + '_x', 'j', f', {out}_x.i as i')}),
{out}_1 as (select {keys}, i, sum(p) as p from {out}_h group by {keys}, i), {out}_2 as (select {keys}, j, sum(p) as p from {out}_h group by {keys}, j),
{out}_1s as ({smooth(out + '_1', 'i', '')}), {out}_2s as ({smooth(out + '_2', 'j', '')}),
{out} as (select {keys}, -(a.h+b.h)/ab.h as t from {part(out + '_1s')} a join {part(out + '_2s')} b using ({keys}) join {part(out + '_y')} ab using ({keys}))"""


@query("sim_mip", f"""with {UNIT}, bl as (select section, v, u, rz.range bz, ry.range as "by", rx.range bx from un, range(8) rz, range(8) ry, range(8) rx
    where z between {_edge(NZ, 8)('rz.range')} and {_edge(NZ, 8)('rz.range+1')} and y between {_edge(NY, 8)('ry.range')} and {_edge(NY, 8)('ry.range+1')}
    and x between {_edge(NX, 8)('rx.range')} and {_edge(NX, 8)('rx.range+1')}), b2 as (select section, bz*64+"by"*8+bx as blk, v, u from bl),
    {sparse_mi_sql('b2', 'mi', 128, 'section, blk')} select section, sum(t)/512 as t from mi group by 1""", **T)
def _(t):
    return sm.sim_mip(*pair(t))


@query("modality_check", f"""with {UNIT}, b as (select section, least(floor(v*60),59) b, 1 m, 0 s from un union all select section, least(floor(u*60),59), 0, 1 from un),
    h as (select section, b, sum(m)::double m, sum(s)::double s from b group by all), n as (select section, sum(m) nm, sum(s) ns from h group by 1),
    l as (select section, sum(abs(m/nm-s/ns)) as l1 from h join n using (section) group by 1)
    select section, l1, case when l1>0.25 then 'mi' else 'sd' end as measure from l""", d="l1", i="section")
def _(t):
    return sm.modality_check(*pair(t))


FIELD = """fld as (select section, z, y, x, n_y, n_x, ((x*3+y+section)%5-2)*0.4::double as tx, ((x+y*2+z)%7-3)*0.3::double as ty, ((x+z)%3-1)*0.2::double as tz from grid3)"""


def field(t):
    return vx.grid(t.sections).select(
        "section", "z", "y", "x", "n_z", "n_y", "n_x", (((F.col("x") * 3 + F.col("y") + F.col("section")) % 5 - 2) * 0.4).alias("tx"),
        (((F.col("x") + F.col("y") * 2 + F.col("z")) % 7 - 3) * 0.3).alias("ty"), (((F.col("x") + F.col("z")) % 3 - 1) * 0.2).alias("tz"))


def _slope(c, a):
    w = f"(partition by section, {', '.join(o for o in 'zyx' if o != a)} order by {a})"
    return (f"case when lag({c}) over {w} is null then lead({c}) over {w}-{c} when lead({c}) over {w} is null then {c}-lag({c}) over {w} "
            f"else (lead({c}) over {w}-lag({c}) over {w})/2 end")


def strain_sql(axes):
    g = ", ".join(f"{1 if a == b else 0} - ({_slope('t' + a, b)}) as g{a}{b}" for a in axes for b in axes)
    e = [(a, c) for i, a in enumerate(axes) for c in axes[i:]]
    out = ", ".join(f"0.5::double*({1 if a == c else 0} - ({'+'.join(f'g{a}{b}*g{c}{b}' for b in axes)})) as e_{a}{c}" for a, c in e)
    s = ", ".join(f"sum(e_{a}{c}) as e_{a}{c}, sum(e_{a}{c}*(x+1)) as m_{a}{c}" for a, c in e)
    return f"with {FIELD}, g as (select section, z, y, x, {g} from fld), s as (select section, z, y, x, {out} from g) select section, z, y, {s} from s group by all"


for axes, name in ((("x", "y"), "strain_tensor"), (("x", "y", "z"), "strain_tensor_3d")):
    def _(t, axes=axes):
        s = sm.strain_tensor(field(t), axes)
        es = [c for c in s.columns if c.startswith("e_")]
        return s.groupBy("section", "z", "y").agg(*[F.sum(c).alias(c) for c in es],
                                                  *[F.sum(F.col(c) * (F.col("x") + 1)).alias("m" + c[1:]) for c in es])
    pairs = [a + c for i, a in enumerate(axes) for c in axes[i:]]
    query(name, strain_sql(axes), d=" ".join(f"e_{p} m_{p}" for p in pairs), i="section z y")(_)


@query("forward_field", f"""with {FIELD}, sp as (select section, z, floor(y+ty)+b.range as y, floor(x+tx)+a.range as x, tx, ty,
      (case a.range when 1 then (x+tx)-floor(x+tx) else 1-((x+tx)-floor(x+tx)) end)*(case b.range when 1 then (y+ty)-floor(y+ty) else 1-((y+ty)-floor(y+ty)) end) as w
      from fld, range(2) a, range(2) b),
    gg as (select section, z, y, x, sum(-tx*w) sx, sum(-ty*w) sy, sum(w) sw from sp group by all),
    kk as (select range as o, exp(-range*range/(2*(5/6.0::double)*(5/6.0::double))) k from range(-3,4)),
    cv as (select section, z, y+p.o as y, x+q.o as x, sum(sx*p.k*q.k) fx, sum(sy*p.k*q.k) fy, sum(sw*p.k*q.k) fw from gg, kk p, kk q
      where y+p.o between 0 and {NY - 1} and x+q.o between 0 and {NX - 1} group by all)
    select section, z, y, sum(fx/fw) as sfx, sum(fy/fw) as sfy, sum(fx/fw*(x+1)) as mfx from cv group by all""", d="sfx sfy mfx", i="section z y")
def _(t):
    f = sm.forward_field(field(t))
    return f.groupBy("section", "z", "y").agg(F.sum("fx").alias("sfx"), F.sum("fy").alias("sfy"),
                                              F.sum(F.col("fx") * (F.col("x") + 1)).alias("mfx"))


CUBIC = ["(-0.5*t*t*t+t*t-0.5*t)", "(1.5*t*t*t-2.5*t*t+1)", "(-1.5*t*t*t+2*t*t+0.5*t)", "(0.5*t*t*t-0.5*t*t)"]


def resample_sql(pts, src, method, boundary):
    """Oracle text: pts(section, channel, z, y, x, sy, sx) sampled from src per plane."""
    if method == "linear":
        taps, w = [0, 1], lambda k, t: f"(case {k} when 0 then 1-{t} else {t} end)"
    elif method == "cubic":
        taps, w = [-1, 0, 1, 2], None
    else:
        taps, w = [0], lambda k, t: "1"
    fl = (lambda s: f"floor({s}+0.5)") if method == "nearest" else (lambda s: f"floor({s})")

    def wt(k, s):
        t = f"({s}-floor({s}))"
        if method == "cubic":
            return "(case " + k + " " + " ".join(f"when {i - 1} then {c.replace('t', t)}" for i, c in enumerate(CUBIC)) + " end)"
        return w(k, t)

    tv = ",".join(f"({k})" for k in taps)
    idx = (lambda e, n: nearest(e, str(n))) if boundary == "replicate" else (lambda e, n: e)
    return f"""rs_t as (select p.section, p.channel, p.z, p.y, p.x, {idx(f"({fl('sy')}+ky.k)", NY)}::int as jy, {idx(f"({fl('sx')}+kx.k)", NX)}::int as jx,
  {wt('ky.k', 'sy')}*{wt('kx.k', 'sx')} as w from {pts} p, (values {tv}) ky(k), (values {tv}) kx(k)),
rs as (select t.section, t.channel, t.z, t.y, t.x, sum(w*coalesce(d.v,0)) as v from rs_t t left join {src} d on d.section=t.section and d.channel=t.channel
  and d.z=t.z and d.y=jy and d.x=jx group by t.section, t.channel, t.z, t.y, t.x)"""


for method, boundary in (("linear", "replicate"), ("cubic", "zero")):
    def _(t, method=method, boundary=boundary):
        chans = vx.by_section(t.volumes.select("section", "channel"), ["section"])
        f = by_merge(field(t)).join(chans, "section").select("section", "channel", "z", "y", "x", "tx", "ty")
        out = vx.warp_by_field(f, t.dense, method, boundary)
        return out.groupBy("section", "channel", "z", "y").agg(
            F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * (F.col("x") + 1)).alias("sx"))
    query("warp_by_field" + ("" if method == "linear" else "_cubic"), f"""with {FIELD}, pt as (select f.section, v.channel, z, y, x, y+ty as sy, x+tx as sx
        from fld f join volumes v using (section)), {resample_sql('pt', 'dense', method, boundary)} {line_sums('select * from rs')}""",
          d="s sx", i="z y n section")(_)
