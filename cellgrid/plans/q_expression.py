"""Expression-matrix queries."""

from pyspark.sql import functions as F

from cellgrid.operators import expression as ex, sparse
from cellgrid.plans.catalog import query
from cellgrid.plans.sqlkit import hash32

PANEL = [f"g{k:02d}" for k in range(64)]
LIST8 = ",".join(f"'{g}'" for g in PANEL)
WIDE = "wide as (select cell_id, " + ", ".join(f"max(value) filter (where gene='{g}') as {g}" for g in PANEL) + \
       ", 50 + cell_id%37 as area from expr group by cell_id)"


def wide(t):
    w = t.expr.where(F.col("gene").isin(PANEL)).groupBy("cell_id").pivot("gene", PANEL).agg(F.first("value"))
    return w.withColumn("area", 50 + F.col("cell_id") % 37)


@query("norm_by_area", f"with {WIDE} select cell_id, {', '.join(f'{g}/(area*(0.325::double*0.325::double)) as {g}' for g in PANEL)} from wide", d=" ".join(PANEL))
def _(t):
    return ex.norm_by_area(wide(t), PANEL)


NORM = """tt as (select cell_id, sum(value) s from expr group by 1), nm as (select e.cell_id, gene,
  round_even(round(value*(select median(s) from tt)/s,9),0) as value from expr e join tt using (cell_id))"""


@query("norm_to_median_total", f"with {NORM} select * from nm", d="value")
def _(t):
    return ex.norm_to_median_total(t.expr)


@query("log1p", "select cell_id, gene, ln(1+value) as value from expr", d="value")
def _(t):
    return ex.log1p(t.expr)


@query("zscore_genes", """with s as (select gene, avg(ln(1+value)) m, stddev_pop(ln(1+value)) sd from expr group by 1)
    select cell_id, gene, (ln(1+value)-m)/case when sd=0 then 1 else sd end as value from expr join s using (gene)""", d="value")
def _(t):
    return ex.zscore_genes(ex.log1p(t.expr))


@query("normalise_chain", f"""with {NORM}, l as (select cell_id, gene, ln(1+value) v from nm), s as (select gene, avg(v) m, stddev_pop(v) sd from l group by 1)
    select cluster, gene, avg((v-m)/case when sd=0 then 1 else sd end) as mean_z from l join s using (gene) join meta using (cell_id) group by all""", d="mean_z")
def _(t):
    z = ex.zscore_genes(ex.log1p(ex.norm_to_median_total(t.expr)))
    return z.join(t.meta.select("cell_id", "cluster"), "cell_id").groupBy("cluster", "gene").agg(F.avg("value").alias("mean_z"))


def vectors(t):
    return ex.cell_vectors(ex.zscore_genes(ex.log1p(t.expr))).withColumn("split", F.lit(0))


@query("pca_project", None, d="variance", i="comp")
def _(t):
    train, _ = ex.pca_project(vectors(t), vectors(t), 10)
    return train.select(F.posexplode("vec").alias("comp", "score")).groupBy("comp").agg(F.var_pop("score").alias("variance"))


@query("pca_total_variance", "select sum(v) as total, 63 as comps from (select gene, var_pop(ln(1+value)) v from expr group by 1)", d="total", i="comps", digits=3)
def _(t):
    v = ex.cell_vectors(ex.log1p(t.expr)).withColumn("split", F.lit(0))
    m = ex.pca_fit(v, 64)
    lost = ex.pca_fit(v, 63).agg(F.count(F.lit(1)).alias("comps"))
    total = v.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v")).agg(F.sum("v").alias("t"))
    return m.agg(F.sum("variance").alias("s")).select(
        F.when(F.col("s") <= total.scalar() + 1e-6, total.scalar()).alias("total"), lost.scalar().alias("comps"))


@query("pc_clip_scale", """with l as (select gene, quantile_cont(value,0.1) lo, quantile_cont(value,0.9) hi from expr group by 1)
    select cell_id, gene, case when hi=lo then 0 else (least(greatest(value,lo),hi)-lo)/(hi-lo) end as value from expr join l using (gene)""", d="value")
def _(t):
    return ex.pc_clip_scale(t.expr, comp="gene", score="value")


@query("corr_matrix", "select a.gene as gene_a, b.gene as gene_b, corr(a.value,b.value) as r from expr a join expr b using (cell_id) group by all", d="r")
def _(t):
    return ex.corr_matrix(t.expr)


NZ = "nz as (select cell_id, gene, ln(1+value) as v from expr where value<>0)"


def logged_csr(t):
    return t.csr_rows.withColumn("data", F.transform("data", lambda x: F.log1p(x)))


@query("zscore_genes_sparse", f"""with {NZ}, s as (select gene, avg(ln(1+value)) m, stddev_pop(ln(1+value)) sd from expr group by 1)
    select cell_id, substr(gene,2)::int as gene_index, (v-m)/sd as value from nz join s using (gene)""", d="value", i="gene_index")
def _(t):
    from cellgrid.sources.scans import scan_csr_matrix
    nz = ex.log1p(scan_csr_matrix(t.csr_rows))
    stats = ex.gene_stats(nz, ["gene_index"], cells=t.embeddings.agg(F.count(F.lit(1))).scalar())
    return ex.zscore_genes(nz, stats, ["gene_index"])


@query("corr_matrix_sparse", "select substr(a.gene,2)::int as i, substr(b.gene,2)::int as j, corr(ln(1+a.value),ln(1+b.value)) as r from expr a join expr b using (cell_id) group by all",
       d="r", i="i j")
def _(t):
    return sparse.correlations(logged_csr(t), 64)


# a 65th gene, the sum of two others, leaves a component without variance: the 64 kept ones hold everything
WIDER = f"""{NZ}, w as (select cell_id, substr(gene,2)::int as i, ln(1+value) as v from expr
    union all select cell_id, 64, sum(ln(1+value)) from expr where gene in ('g03', 'g11') group by 1)"""


def wider_csr(t):
    at = lambda k: F.coalesce(F.get(F.map_values(F.map_filter(F.map_from_arrays("indices", "data"), lambda i, _: i == k)), F.lit(0)), F.lit(0.0))
    rows = logged_csr(t).withColumn("sum", at(3) + at(11))
    return rows.select("cell_id", F.lit(0).alias("split"), F.concat("indices", F.array(F.lit(64))).alias("indices"),
                       F.concat("data", F.array("sum")).alias("data"))


@query("pca_sparse", f"""with {WIDER} select a.i, b.i as j, covar_pop(a.v, b.v) as cov from w a join w b using (cell_id) where a.i <= b.i group by all""",
       d="cov", i="i j")
def _(t):
    """The covariance of all genes, rebuilt from the components' variances and loadings."""
    model = ex.pca_fit(wider_csr(t), 65)
    load = model.select("comp", "variance", F.posexplode("loading").alias("i", "a"))
    other = load.select("comp", F.col("i").alias("j"), F.col("a").alias("b"))
    return load.join(other, "comp").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("variance") * F.col("a") * F.col("b")).alias("cov"))


@query("pca_orthonormal", "select a.range as a, b.range as b, (a.range = b.range)::int::double as dot from range(64) a, range(64) b where a.range <= b.range",
       d="dot", i="a b")
def _(t):
    """Products of the loadings of all pairs of components."""
    load = ex.pca_fit(wider_csr(t), 65).select(F.col("comp").alias("a"), F.posexplode("loading").alias("i", "x"))
    return load.join(load.select(F.col("a").alias("b"), "i", F.col("x").alias("y")), "i").where("a <= b").groupBy("a", "b").agg(
        F.sum(F.col("x") * F.col("y")).alias("dot"))


@query("pca_scores", f"""with {WIDER}, m as (select i, avg(v) mu from w group by 1)
    select cell_id, sum((v-mu)*(v-mu)) as length from w join m using (i) group by 1""", d="length", i="cell_id")
def _(t):
    """Squared length of each cell's scores over all components, that of the centred cell itself."""
    rows = wider_csr(t)
    scores = ex.pca_apply(rows, ex.pca_fit(rows, 65))
    return scores.select("cell_id", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x).alias("length"))


#: the inverse by sweeping one gene after the other: after all of them the matrix is minus the inverse
SWEEP = f"""with recursive e as (select cell_id, gene, value, dense_rank() over (order by gene) as g from expr where gene in ({','.join(f"'{g}'" for g in PANEL)})),
    co as (select a.g as i, b.g as j, corr(a.value, b.value) as v from e a join e b using (cell_id) group by 1, 2),
    sw as (select 0::bigint as step, i, j, v from co union all
      select step+1, i, j, case when i=k and j=k then -1/p when i=k or j=k then v/p else v-vik*vkj/p end from (
        select x.step, x.i, x.j, x.v, x.step+1 as k, r.v as vik, c.v as vkj, d.v as p from sw x
        join sw r on r.i=x.i and r.j=x.step+1 join sw c on c.j=x.j and c.i=x.step+1 join sw d on d.i=x.step+1 and d.j=x.step+1) t),
    la as (select i, j, v from sw where step=(select max(g) from e)), na as (select distinct gene, g from e)"""


@query("partial_corr_matrix", f"""{SWEEP} select a.gene as gene_a, b.gene as gene_b, case when la.i=la.j then 1.0 else la.v/sqrt(p.v*q.v) end as r
    from la join la p on p.i=la.i and p.j=la.i join la q on q.i=la.j and q.j=la.j join na a on a.g=la.i join na b on b.g=la.j""", d="r")
def _(t):
    return ex.partial_corr_matrix(t.expr.where(F.col("gene").isin(PANEL)))


BC = """bc as (select vec_id, {b}, {c} from embeddings)""".format(
    b=", ".join(f"(embedding[{k + 1}]>0)::int as b{k}_b" for k in range(3)), c=", ".join(f"embedding[{k + 9}]::double as c{k}" for k in range(4)))


def bin_cont(t):
    e = lambda k: F.col("embedding")[k].cast("double")
    return t.embeddings.select("vec_id", *[(e(k) > 0).cast("int").alias(f"b{k}_b") for k in range(3)], *[e(k + 8).alias(f"c{k}") for k in range(4)])


def pb_sql():
    """Residualise through centred normal equations of the three other columns (Cramer)."""
    from cellgrid.plans.q_geometry import det3
    out = []
    for c in range(4):
        o = dict(zip("xyz", [k for k in range(4) if k != c]))
        m = {(p, q): f"v{min(o[p], o[q])}{max(o[p], o[q])}" for p in "xyz" for q in "xyz"}
        rhs = {p: f"v{min(o[p], c)}{max(o[p], c)}" for p in "xyz"}
        beta = {p: f"({det3({(r, q): (rhs[r] if q == p else m[r, q]) for r in 'xyz' for q in 'xyz'})}/{det3(m)})" for p in "xyz"}
        res = f"c{c}" + "".join(f"-{beta[p]}*c{o[p]}" for p in "xyz")
        for b in range(3):
            out.append(f"select 'b{b}_b' as binary_var, 'c{c}' as continuous_var, count(*) as n, corr(b{b}_b, {res}) as r from bc, mv")
    cov = ", ".join(f"covar_samp(c{a},c{b}) v{a}{b}" for a in range(4) for b in range(a, 4))
    return f"""with {BC}, mv as (select {cov} from bc), u as ({' union all '.join(out)})
      select *, tanh(atanh(r)-1.959963984540054::double/sqrt(n-3)) as ci_lo, tanh(atanh(r)+1.959963984540054::double/sqrt(n-3)) as ci_hi from u"""


@query("partial_pointbiserial", pb_sql(), d="r ci_lo ci_hi", i="n")
def _(t):
    return ex.partial_pointbiserial(bin_cont(t), [f"b{k}_b" for k in range(3)], [f"c{k}" for k in range(4)]).drop("p_val")


@query("merge_corr_blocks", f"""with c as (select a.gene as gene_a, b.gene as gene_b, corr(a.value,b.value) as r from expr a join expr b using (cell_id)
      where a.gene in ({LIST8}) and b.gene in ({LIST8}) group by all)
    select gene_a, gene_b, case when (gene_a in ('g00','g01') and gene_b not in ('g00','g01')) or (gene_b in ('g00','g01') and gene_a not in ('g00','g01'))
      then 0.25 else r end as r from c""", d="r")
def _(t):
    r = ex.corr_matrix(t.expr.where(F.col("gene").isin(PANEL)))
    block = r.where("gene_a in ('g00','g01') and gene_b not in ('g00','g01')").select(
        F.col("gene_a").alias("binary_var"), F.col("gene_b").alias("continuous_var"), F.lit(0.25).alias("r"))
    return ex.merge_corr_blocks(r, block)


#: nearest cells of each distinct value: pairs within 20 ranks, counts taken nearest first, then the factor's three sums
FACTOR = """c as (select gene, value, count(*) c from expr group by 1, 2),
    r as (select *, row_number() over (partition by gene order by value) r, least(20, sum(c) over (partition by gene)-1) k from c),
    p as (select a.gene, a.r, a.k, b.r s, b.value v, abs(b.value-a.value) dist, b.c-(a.r=b.r)::int mult from r a join r b on a.gene=b.gene and b.r between a.r-20 and a.r+20),
    t as (select *, greatest(0, least(mult, k-coalesce(sum(mult) over (partition by gene, r order by dist, v rows between unbounded preceding and 1 preceding), 0))) n from p),
    f as (select gene, r, max(dist) filter (where n>0) far from t group by 1, 2),
    d as (select t.gene, t.r, 1/(coalesce(sum(n*greatest(f.far, dist))/nullif(max(k),0),0)+1e-10::double) dens from t join f on t.gene=f.gene and t.s=f.r and n>0 group by 1, 2),
    o as (select t.gene, t.r, sum(n*b.dens)/max(k)/max(a.dens)>2 outlier from t join d b on t.gene=b.gene and t.s=b.r join d a on t.gene=a.gene and t.r=a.r where n>0 group by 1, 2),
    j as (select gene, value, coalesce(outlier, false) outlier from r left join o using (gene, r)),
    l as (select gene, min(value) filter (where not outlier) lo, max(value) filter (where not outlier) hi from j group by 1)"""


def middle(k: str) -> str:
    return f"round_even(round((case when {k}=0 then lo-(hi-lo)*0.001::double else lo+{k}*((hi-lo)/10) end + lo+({k}+1)*((hi-lo)/10))/2,9),0)"


CODE = "coalesce(greatest(ceil(round((value-lo)/nullif((hi-lo)/10,0),9))-1,0),0)"


@query("bin_gene", f"""with {FACTOR},
    m as (select gene, value, outlier, case when not outlier then {middle(CODE)} else
        (select min({{'d': abs({middle('x.k')}-value), 'k': x.k, 'm': {middle('x.k')}}}).m from (select unnest(range(10)) k) x) end as binned from j join l using (gene))
    select cell_id, gene, value, outlier, binned from expr join m using (gene, value)""", d="value binned")
def _(t):
    return ex.bin_gene(t.expr)


@query("bin_gene_equal_width", f"""with l as (select gene, min(value) lo, max(value) hi from expr group by 1)
    select cell_id, gene, value, {middle(CODE)} as binned from expr join l using (gene)""", d="value binned")
def _(t):
    return ex.bin_gene(t.expr, thresh=None).drop("outlier")


@query("robust_dynamic_range", f"""with b as (select *, {hash32('cell_id', "'7'")}%10 as boot from expr),
    s as (select boot, gene, avg(value) m, stddev_pop(value) s, max(value) mx, min(value) mn from b group by all)
    select gene, ln(1+avg(case when mx>=m+3*s then m+3*s else mx end - case when mn<=m-3*s then m-3*s else mn end)) as rdr from s group by 1""", d="rdr")
def _(t):
    from cellgrid.functions.exprs import hash32 as h
    return ex.robust_dynamic_range(t.expr.withColumn("boot", F.pmod(h(F.col("cell_id"), F.lit(7)), F.lit(10))))


@query("var_explained", """with p as (select gene, cluster as type, avg(value) m, var_pop(value) v from expr join meta using (cell_id) group by all)
    select gene, coalesce(var_pop(m)/nullif(var_pop(m)+sum(v*p)/sum(p),0),0) as var_explained from p join freqs using (type) group by 1""", d="var_explained")
def _(t):
    return ex.var_explained(t.expr, t.meta, t.freqs)


@query("var_explained_sparse", """with p as (select gene, cluster as type, avg(ln(1+value)) m, var_pop(ln(1+value)) v from expr join meta using (cell_id) group by all)
    select gene, coalesce(var_pop(m)/nullif(var_pop(m)+sum(v*p)/sum(p),0),0) as var_explained from p join freqs using (type) group by 1""", d="var_explained")
def _(t):
    return ex.var_explained(ex.log1p(t.expr.where("value <> 0")), t.meta, t.freqs, nonzeros=True)


@query("robust_dynamic_range_sparse", f"""with b as (select *, {hash32('cell_id', "'7'")}%10 as boot from expr),
    s as (select boot, gene, avg(value) m, stddev_pop(value) s, max(value) mx, min(value) mn from b group by all)
    select gene, ln(1+avg(least(mx, m+3*s) - greatest(mn, m-3*s))) as rdr from s group by 1""", d="rdr")
def _(t):
    from cellgrid.functions.exprs import hash32 as h
    boot = F.pmod(h(F.col("cell_id"), F.lit(7)), F.lit(10)).alias("boot")
    cells = t.meta.select("cell_id", boot)
    return ex.robust_dynamic_range(t.expr.where("value <> 0").join(cells, "cell_id"), cells.groupBy("boot").agg(F.count(F.lit(1)).alias("n")))


@query("gini", """with r as (select gene, value - least(min(value) over (partition by gene),0) + 1e-7::double as x,
    row_number() over (partition by gene order by value) i, count(*) over (partition by gene) n from expr)
    select gene, sum((2*i-n-1)*x)/(max(n)*sum(x)) as gini from r group by 1""", d="gini")
def _(t):
    return ex.gini(t.expr, ["gene"], "value")


@query("expr_histogram", """with b as (select e.*, feature_matrix_label as batch from expr e join meta using (cell_id)),
    l as (select batch, gene, min(value) lo, max(value) hi from b group by all)
    select batch, gene, least(floor(round((value-lo)*20/(hi-lo),9)),19) as bin, count(*) as n from b join l using (batch, gene) group by all""", i="bin n")
def _(t):
    return ex.expr_histogram(t.expr.join(t.meta.select("cell_id", F.col("feature_matrix_label").alias("batch")), "cell_id"), "batch")


@query("gene_by_type_dist", """select subclass as type, count(*) as n, avg(value) as mean, quantile_cont(value,0.05) as p05, quantile_cont(value,0.25) as p25,
    quantile_cont(value,0.5) as p50, quantile_cont(value,0.75) as p75, quantile_cont(value,0.95) as p95 from expr join meta using (cell_id) where gene='g03' group by 1""",
       d="mean p05 p25 p50 p75 p95", i="n")
def _(t):
    return ex.gene_by_type_dist(t.expr, t.meta, "g03", "subclass")
