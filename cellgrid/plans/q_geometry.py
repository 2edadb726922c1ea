"""Geometry queries."""

import math

from pyspark.sql import functions as F

from cellgrid.operators import geometry as g, voxels as vx
from cellgrid.plans.bindings import NX, NY, NZ
from cellgrid.plans.catalog import query
from cellgrid.plans.q_similarity import resample_sql
from cellgrid.plans.sqlkit import line_sums

AX = "xyz"
COEF = " ".join(f"{o}{i}" for o in AX for i in AX + "t")


def det3(m):
    return (f"({m['x', 'x']}*({m['y', 'y']}*{m['z', 'z']}-{m['y', 'z']}*{m['z', 'y']})-{m['x', 'y']}*({m['y', 'x']}*{m['z', 'z']}-{m['y', 'z']}*{m['z', 'x']})"
            f"+{m['x', 'z']}*({m['y', 'x']}*{m['z', 'y']}-{m['y', 'y']}*{m['z', 'x']}))")


def cramer(m, rhs, col):
    return det3({(r, c): (rhs[r] if c == col else m[r, c]) for r in AX for c in AX})


CM = {(a, b): f"c{min(a, b)}{max(a, b)}" for a in AX for b in AX}
FIT = f"""mo as (select section, count(*) n, {', '.join(f'avg(m{a}) am{a}, avg(f{a}) af{a}' for a in AX)},
  {', '.join(f'covar_pop(m{a},m{b}) c{a}{b}' for a in AX for b in AX if a <= b)}, {', '.join(f'covar_pop(m{a},f{b}) k{a}{b}' for a in AX for b in AX)}
  from fiducials group by 1 having count(*)>=3),
so as (select *, {', '.join(f"{cramer(CM, {r: f'k{r}{o}' for r in AX}, i)}/(case when {det3(CM)} > 1e-9*cxx*cyy*czz then {det3(CM)} end) as {o}{i}" for o in AX for i in AX)} from mo),
aff as (select section, {', '.join(f'{o}{i}' for o in AX for i in AX)}, {', '.join(f"af{o}-({'+'.join(f'{o}{i}*am{i}' for i in AX)}) as {o}t" for o in AX)} from so)"""


@query("affine_fit", f"with {FIT} select * from aff", d=COEF, i="section")
def _(t):
    return g.affine_fit(t.fiducials)


def moved(t):
    return t.fiducials.select("section", "pt_id", F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z"))


@query("affine_apply", f"""with {FIT} select f.section, pt_id, {', '.join(f"{o}t+{'+'.join(f'{o}{i}*m{i}' for i in AX)} as q{o}" for o in AX)}
    from fiducials f join aff using (section)""", d="qx qy qz", i="section pt_id", digits=5)
def _(t):
    return g.affine_apply(moved(t), g.affine_fit(t.fiducials)).select("section", "pt_id", "qx", "qy", "qz")


@query("affine_round_trip", f"""with {FIT} select f.section, count(*) as n, 0.0 as err from fiducials f join aff using (section)
    where xx is not null group by 1""", d="err", i="section n", digits=5)
def _(t):
    fit = g.affine_fit(t.fiducials).where("xx is not null")
    there = g.affine_apply(moved(t), fit).select("section", "pt_id", *[F.col(a).alias(f"o{a}") for a in AX], *[F.col(f"q{a}").alias(a) for a in AX])
    back = g.affine_apply(there, fit, inverse=True)
    err = sum([F.abs(F.col(f"q{a}") - F.col(f"o{a}")) for a in AX], F.lit(0.0))
    return back.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.max(err).alias("err"))


AFF2 = "select distinct section, 1.05::double as xx, 0.1::double as xy, 1.5137::double+section*0.01::double as xt, -0.08::double as yx, 0.95::double as yy, -0.7391::double as yt from sections"


def affine2(t):
    return t.sections.select("section", F.lit(1.05).alias("xx"), F.lit(0.1).alias("xy"), (1.5137 + F.col("section") * F.lit(0.01)).alias("xt"),
                             F.lit(-0.08).alias("yx"), F.lit(0.95).alias("yy"), F.lit(-0.7391).alias("yt"))


def lsum(df):
    return df.groupBy("section", "channel", "z", "y").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * (F.col("x") + 1)).alias("sx"))


for mode, (method, edge) in g.WARP_MODES.items():
    def _(t, mode=mode):
        return lsum(g.affine_warp_voxels(t.dense, affine2(t), mode))
    query("affine_warp_voxels" + ("" if mode == 0 else f"_mode{mode}"), f"""with a2 as ({AFF2}),
      pt as (select d.section, channel, z, y, x, {NX}/2.0::double + xx*(x-{NX}/2.0::double) + xy*(y-{NY}/2.0::double) + xt as sx,
        {NY}/2.0::double + yx*(x-{NX}/2.0::double) + yy*(y-{NY}/2.0::double) + yt as sy from dense d join a2 using (section)),
      {resample_sql('pt', 'dense', method, edge)} {line_sums('select * from rs')}""", d="s sx", i="z y n section")(_)


def _csize(t):
    return t.fiducials.select("section").distinct().select("section", F.lit(100).alias("n_x"), F.lit(90).alias("n_y"), F.lit(8).alias("n_z"))


@query("affine_point_error", f"""with {FIT} select f.section, sum((power({'50+xx*(mx-50)+xy*(my-45)+xz*(mz-4)+xt'}-fx,2) +
    power(45+yx*(mx-50)+yy*(my-45)+yz*(mz-4)+yt-fy,2) + power(4+zx*(mx-50)+zy*(my-45)+zz*(mz-4)+zt-fz,2))/(10000+8100+64)*(1+pt_id%3)) as err
    from fiducials f join aff using (section) group by 1""", d="err", i="section")
def _(t):
    f = t.fiducials.withColumn("strength", 1 + F.col("pt_id") % 3)
    return g.affine_point_error(f, g.affine_fit(t.fiducials), _csize(t))


@query("field_point_error", f"""with f as (select c_nationkey%(select count(*) from sections) as section, (c_custkey%40)::double mx, (c_custkey%37)::double my, (c_custkey%7)::double mz,
    c_acctbal/1000 as fx, c_acctbal/900 as fy from customer),
    g as (select section, z, y, x, (x%3-1)*0.5::double tx, (y%4-1)*0.25::double ty from grid3)
    select section, sum((power(x+tx-fx,2)+power(y+ty-fy,2))/({NX * NX}+{NY * NY})*2.0) as err from f join g using (section) where x=mx and y=my and z=mz group by 1""",
       d="err", i="section")
def _(t):
    n = t.sections.agg(F.count(F.lit(1))).scalar()
    k = F.col("c_custkey")
    f = t.customer.select(
        (F.col("c_nationkey") % n).cast("int").alias("section"), (k % 40).cast("double").alias("mx"),
        (k % 37).cast("double").alias("my"), (k % 7).cast("double").alias("mz"), (F.col("c_acctbal") / 1000).alias("fx"),
        (F.col("c_acctbal") / 900).alias("fy"), F.lit(2.0).alias("strength"))
    field = vx.grid(t.sections).select("section", "z", "y", "x", ((F.col("x") % 3 - 1) * 0.5).alias("tx"), ((F.col("y") % 4 - 1) * 0.25).alias("ty"))
    return g.field_point_error(f, field, t.sections, axes=("x", "y"))


# ---- B-spline: grid spacing 8 over the 32 x 32 planes --------------------------------------------
S = 8
GN = int((NX + 3 * S) // S) + 1
SP = {"x": float(S), "y": float(S)}
INIT = f"gr as (select section, gx.range as gx, gy.range as gy, (gx.range-1)*{S}.0::double as ox, (gy.range-1)*{S}.0::double as oy from sections, range({GN}) gx, range({GN}) gy)"


def grid0(t):
    return g.bspline_init_grid(t.sections.drop("n_z"), SP)


@query("bspline_init_grid", f"with {INIT} select * from gr", d="ox oy", i="section gx gy")
def _(t):
    return grid0(t)


@query("bspline_init_grid_affine", f"""with {INIT}, a2 as ({AFF2}) select section, gx, gy, {NX}/2.0::double+xx*(ox-{NX}/2)+xy*(oy-{NY}/2)+xt as ox,
    {NY}/2.0::double+yx*(ox-{NX}/2)+yy*(oy-{NY}/2)+yt as oy from gr join a2 using (section)""", d="ox oy", i="section gx gy")
def _(t):
    return g.bspline_init_grid(t.sections.drop("n_z"), SP, affine2(t))


PTS = f"""pts as (select (l_suppkey//4)::int as section, l_orderkey as pt_id, l_linenumber as ln, l_partkey as pk, (l_partkey%{NX})::double as px, (l_orderkey%{NY})::double as py,
  (l_linenumber-4)*0.25::double as dx, (l_quantity-25)/50 as dy from lineitem)"""


def points(t):
    return t.lineitem.select(
        F.floor(F.col("l_suppkey") / 4).cast("int").alias("section"), F.col("l_orderkey").alias("pt_id"), F.col("l_linenumber").alias("ln"),
        F.col("l_partkey").alias("pk"), (F.col("l_partkey") % NX).cast("double").alias("px"), (F.col("l_orderkey") % NY).cast("double").alias("py"),
        ((F.col("l_linenumber") - 4) * 0.25).alias("dx"), ((F.col("l_quantity") - 25) / 50).alias("dy"))


def basis(k, a, slope=False):
    v = [f"power(1-{a},3)/6", f"(3*power({a},3)-6*power({a},2)+4)/6", f"(-3*power({a},3)+3*power({a},2)+3*{a}+1)/6", f"power({a},3)/6"]
    if slope:
        v = [f"(-power({a}-1,2)/2)", f"(1.5*power({a},2)-2*{a})", f"(-1.5*power({a},2)+{a}+0.5)", f"power({a},2)/2"]
        v = [f"({e})/{S}" for e in v]
    return "(case " + k + "".join(f" when {i} then {e}" for i, e in enumerate(v)) + " end)"


FITG = f"""{PTS}, pw as (select *, floor(px/{S})::int ix, floor(py/{S})::int iy, px/{S}-floor(px/{S}) ax, py/{S}-floor(py/{S}) ay from pts),
pk as (select section, ix+k.range as gx, iy+m.range as gy, dx, dy, {basis('k.range', 'ax')}*{basis('m.range', 'ay')} as w,
  (select sum(power({basis('r', 'ax')},2)) from (select range r from range(4)))*(select sum(power({basis('r', 'ay')},2)) from (select range r from range(4))) as s
  from pw, range(4) k, range(4) m),
up as (select section, least(greatest(gx,0),{GN - 1}) gx, least(greatest(gy,0),{GN - 1}) gy, sum(w*w*w*dx/s)/(sum(w*w)+2.220446049250313e-16::double) ux,
  sum(w*w*w*dy/s)/(sum(w*w)+2.220446049250313e-16::double) uy from pk group by all),
fg as (select section, gx, gy, ox+coalesce(ux,0) as ox, oy+coalesce(uy,0) as oy from gr left join up using (section, gx, gy))"""


def fitted(t):
    return g.bspline_grid_fit(grid0(t), points(t), SP, t.sections.drop("n_z"))


@query("bspline_grid_fit", f"with {INIT}, {FITG} select * from fg", d="ox oy", i="section gx gy")
def _(t):
    return fitted(t)


def eval_sql(pts, keep, out):
    return f"""{out}_w as (select *, floor(px/{S})::int ix, floor(py/{S})::int iy, px/{S}-floor(px/{S}) ax, py/{S}-floor(py/{S}) ay from {pts}),
{out}_k as materialized (select *, ix+k.range as jx, iy+m.range as jy, {basis('k.range', 'ax')}*{basis('m.range', 'ay')} as w,
  {basis('k.range', 'ax', True)}*{basis('m.range', 'ay')} as wx, {basis('k.range', 'ax')}*{basis('m.range', 'ay', True)} as wy from {out}_w, range(4) k, range(4) m),
{out} as (select {keep}, sum(w*f.ox) as "Tx", sum(w*f.oy) as "Ty", sum(wx*f.ox) dxx, sum(wy*f.ox) dxy, sum(wx*f.oy) dyx, sum(wy*f.oy) dyy
  from {out}_k k join fg f on f.section=k.section and f.gx=k.jx and f.gy=k.jy group by all)"""


@query("bspline_eval_points", f"with {INIT}, {FITG}, {eval_sql('pts', 'k.section, pt_id, ln, pk, k.px, k.py, dy', 'ev')} select section, pt_id, ln, pk, dy, \"Tx\", \"Ty\" from ev",
       d="Tx Ty dy", i="section pt_id ln pk")
def _(t):
    pts = points(t).groupBy("section", "pt_id", "ln", "pk", "px", "py", "dy").agg(F.count(F.lit(1)).alias("_c"))
    return g.bspline_eval_points(fitted(t), pts, SP).select("section", "pt_id", "ln", "pk", "dy", "Tx", "Ty")


def refine_sql(src, axis, other, out):
    return f"""{out}_l as (select *, lead(ox) over w x1, lead(ox,2) over w x2, lead(oy) over w y1, lead(oy,2) over w y2 from {src} window w as (partition by section, {other} order by {axis})),
{out} as (select section, {other}, {axis}*2+k.range as {axis}, case k.range when 0 then (ox+x1)/2 else (ox+6*x1+x2)/8 end as ox,
  case k.range when 0 then (oy+y1)/2 else (oy+6*y1+y2)/8 end as oy from {out}_l, range(2) k where (k.range=0 and x1 is not null) or (k.range=1 and x2 is not null))"""


G2 = int((NX + 1.5 * S) // (S / 2)) + 1


@query("bspline_refine_grid", f"""with {INIT}, {FITG}, {refine_sql('fg', 'gx', 'gy', 'r1')}, {refine_sql('r1', 'gy', 'gx', 'r2')}
    select section, gx, gy, ox, oy from r2 where gx<{G2} and gy<{G2}""", d="ox oy", i="section gx gy")
def _(t):
    return g.bspline_refine_grid(fitted(t), SP, t.sections.drop("n_z"))


@query("point_registration", None, d="mean_distance", i="section level")
def _(t):
    f = t.fiducials.select("section", *[(F.col(c) + 8).alias(c) for c in ("mx", "my", "fx", "fy")])  # all landmarks lie in the grid
    return g.point_registration(f, {"x": 128, "y": 128})[3]


@query("bspline_invert", None, d="mean_distance", i="section level")
def _(t):
    return g.bspline_invert(fitted(t), SP, {"x": NX, "y": NY}, 3)[3]


@query("bspline_warp_voxels", f"""with {INIT}, {FITG}, vp as (select section, z, y, x, x::double as px, y::double as py from grid3), {eval_sql('vp', 'k.section, k.z, k.y, k.x', 'ev')},
    pt as (select section, channel, z, y, x, "Tx" as sx, "Ty" as sy from ev join volumes using (section)), {resample_sql('pt', 'dense', 'linear', 'replicate')}
    {line_sums('select * from rs')}""", d="s sx", i="z y n section")
def _(t):
    return lsum(g.bspline_warp_voxels(t.dense, fitted(t), SP, 0))


JAC = f"""{INIT}, {FITG}, vp as (select section, gy.range as y, gx.range as x, gx.range::double as px, gy.range::double as py from sections, range({NX}) gx, range({NY}) gy),
    {eval_sql('vp', 'k.section, k.y, k.x', 'ev')}"""


@query("jacobian_det", f"with {JAC} select section, y, x, dxx*dyy-dxy*dyx as det from ev", d="det", i="section y x")
def _(t):
    return g.jacobian_det(fitted(t), t.sections.drop("n_z"), SP)


@query("folding_error", f"with {JAC} select section, avg(abs(ln(greatest(dxx*dyy-dxy*dyx,2.2e-16))/greatest(dxx*dyy-dxy*dyx,2.2e-16))) as folding from ev group by 1",
       d="folding", i="section")
def _(t):
    return g.folding_error(g.jacobian_det(fitted(t), t.sections.drop("n_z"), SP))


@query("bending_energy", f"""with {INIT}, {FITG}, s as (select section, gx, gy, ox/sqrt({NX * NX + NY * NY}) ox, oy/sqrt({NX * NX + NY * NY}) oy from fg),
    d as (select s.*, lead(ox) over wx-2*ox+lag(ox) over wx xxx, lead(oy) over wx-2*oy+lag(oy) over wx yxx, lead(ox) over wy-2*ox+lag(ox) over wy xyy, lead(oy) over wy-2*oy+lag(oy) over wy yyy,
      lead(ox) over wx-ox ex, lead(oy) over wx-oy ey from s window wx as (partition by section, gy order by gx), wy as (partition by section, gx order by gy)),
    e as (select *, lead(ex) over wy-ex xxy, lead(ey) over wy-ey yxy from d window wy as (partition by section, gx order by gy))
    select section, (sum(xxx*xxx)+sum(yxx*yxx)+sum(xyy*xyy)+sum(yyy*yyy)+2*(sum(xxy*xxy)+sum(yxy*yxy)))*count(*)*2/100 as energy from e group by 1""",
       d="energy", i="section")
def _(t):
    return g.bending_energy(fitted(t), t.sections.drop("n_z"))


def _rot(axis, deg, p):
    c, s = (f"({f(math.radians(deg))!r}::double)" for f in (math.cos, math.sin))
    if axis == "x":
        return {"x": p["x"], "y": f"({c}*{p['y']}-{s}*{p['z']})", "z": f"({s}*{p['y']}+{c}*{p['z']})"}
    if axis == "y":
        return {"x": f"({c}*{p['x']}+{s}*{p['z']})", "y": p["y"], "z": f"(-({s})*{p['x']}+{c}*{p['z']})"}
    return {"x": f"({c}*{p['x']}-{s}*{p['y']})", "y": f"({s}*{p['x']}+{c}*{p['y']})", "z": p["z"]}


def back_sql():
    m = {(o, i): f"{o}{i}" for o in AX for i in AX}
    rhs = {o: f"(m{o}-{o}t)" for o in AX}
    q = ", ".join(f"{cramer(m, rhs, i)}/{det3(m)} as q{i}" for i in AX)
    p = {"x": "(qx+10)", "y": "(qy+20)", "z": "(qz+3)"}
    for axis, deg in (("x", 5.0), ("y", -3.0), ("y", -90.0), ("z", -90.0)):
        p = _rot(axis, deg, p)
    return f"with {FIT}, b as (select f.section, pt_id, {q} from fiducials f join aff using (section)) select section, pt_id, {', '.join(f'{p[a]} as a{a}' for a in AX)} from b"


@query("atlas_back_transform", back_sql(), d="ax ay az", i="section pt_id", digits=4)
def _(t):
    return g.atlas_back_transform(moved(t), g.affine_fit(t.fiducials), (10.0, 20.0, 3.0), 5.0, -3.0).select("section", "pt_id", "ax", "ay", "az")


@query("tax_to_parc", "select distinct parcellation_index as parc_id from parc_terms where division in ('ASIA','AFRICA')", i="parc_id")
def _(t):
    return g.tax_to_parc(t.parc_terms, ["ASIA", "AFRICA"], "division")


@query("locate_points", f"""with p as (select (l_suppkey//4)::int as section, l_orderkey, l_linenumber, l_partkey, l_quantity, l_quantity/1.2::double as x, l_extendedprice/3000 as y, (l_linenumber-1)::double as z from lineitem)
    select p.section, l_orderkey, l_linenumber, l_partkey, l_quantity, coalesce(n_name,'outer space') as place from p
    left join annotation a on a.section=p.section and a.z=round(p.z) and a.y=round(p.y) and a.x=round(p.x) left join nation on n_nationkey=parc_id and n_nationkey<>3""",
       i="section l_orderkey l_linenumber l_partkey")
def _(t):
    p = t.lineitem.select(F.floor(F.col("l_suppkey") / 4).cast("int").alias("section"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                          (F.col("l_quantity") / 1.2).alias("x"), (F.col("l_extendedprice") / 3000).alias("y"), (F.col("l_linenumber") - 1).cast("double").alias("z"))
    terms = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    ont = terms.unionByName(terms.where("id = 3"))  # an id listed twice is not exactly one match
    return g.locate_points(p, t.annotation, ont).drop("x", "y", "z")


@query("contour_unroll", """with p as (select c_custkey//64 as contour, c_custkey as pt_id, (c_custkey*37%97)::double as x, (c_custkey*53%89)::double as y from customer)
    select contour, pt_id, sum(s) over (partition by contour order by pt_id) as fx, 7.0 as fy from (select *, coalesce(sqrt(power(x-lag(x) over w,2)+power(y-lag(y) over w,2)),0) s
    from p window w as (partition by contour order by pt_id))""", d="fx fy", i="contour pt_id")
def _(t):
    k = F.col("c_custkey")
    p = t.customer.select(F.floor(k / 64).alias("contour"), k.alias("pt_id"), (k * 37 % 97).cast("double").alias("x"), (k * 53 % 89).cast("double").alias("y"))
    return g.contour_unroll(p, ["contour"], "pt_id", 7.0).drop("x", "y")


@query("sigmoid_edge", """with p as (select *, row_number() over (partition by section, channel, z, y order by x) i, count(*) over (partition by section, channel, z, y) n from dense),
    m as (select section, channel, z, y, avg(v) filter (where i<=ceil(n/5.0)) a, avg(v) filter (where i>n-ceil(n/5.0)) b from p group by all)
    select section, channel, z, y, abs(b-a) as amp, case when a>b then max(i) filter (where v>round((a+b)/2,9)) else min(i) filter (where v>round((a+b)/2,9)) end as mid
    from p join m using (section, channel, z, y) group by section, channel, z, y, a, b""", d="amp", i="mid z y")
def _(t):
    return g.sigmoid_edge(t.dense, ["section", "channel", "z", "y"])


@query("points_near_plane", f"""select p.section, l_orderkey, l_linenumber, l_partkey, l_quantity, f.range as frame from (select *, (l_suppkey//4)::int as section, l_quantity/4 as z from lineitem) p, range({NZ}) f
    where abs(p.z-f.range) < 5.51::double""", i="section l_orderkey l_linenumber l_partkey frame")
def _(t):
    p = t.lineitem.select(F.floor(F.col("l_suppkey") / 4).cast("int").alias("section"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                          (F.col("l_quantity") / 4).alias("z"))
    return g.points_near_plane(p, t.sections).drop("z")


@query("delete_points", "select section, pt_id from fiducials where pt_id not in (select o_custkey from orders where o_totalprice > 300000)", i="section pt_id")
def _(t):
    sel = t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("pt_id"))
    return g.delete_points(t.fiducials, sel, ["pt_id"]).select("section", "pt_id")


@query("fiducial_check", """with s as (select section, pt_id, fx, mx, my, mz, fy, fz, 100+section%3 as lim from fiducials),
    ok as (select section from s group by 1 having count(*)>=3 and not bool_or(mx>lim or my>92 or mz>9 or fx>lim or fy>92 or fz>9))
    select section, pt_id from s where section in (select section from ok)""", i="section pt_id")
def _(t):
    sizes = t.fiducials.select("section").distinct().select("section", (100 + F.col("section") % 3).alias("n_x"), F.lit(92).alias("n_y"), F.lit(9).alias("n_z"))
    return g.fiducial_check(t.fiducials, sizes).select("section", "pt_id")
