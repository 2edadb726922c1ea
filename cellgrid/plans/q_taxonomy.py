"""Taxonomy and frequency queries."""

from pyspark.sql import functions as F

from cellgrid.operators import taxonomy as tx
from cellgrid.plans.catalog import query


@query("extract_meta", "select cell_id, division from meta where division in ('div1','div3')")
def _(t):
    return tx.extract_meta(t.meta, ["div1", "div3"], "restrict", "anatomy", "division").select("cell_id", "division")


@query("extract_meta_remove", "select cell_id, subclass from meta where subclass not in ('s0','s4')")
def _(t):
    return tx.extract_meta(t.meta, ["s0", "s4"], "remove", "taxonomy", "subclass").select("cell_id", "subclass")


@query("nt_group", """with w as (select section, mask_id, max(positive::int) filter (where gene='slc5a7') a, max(positive::int) filter (where gene='slc32a1') b,
    max(positive::int) filter (where gene='slc17a6') c from bin_calls group by all)
    select section, mask_id, case when a=1 then 'cht' when b=1 then 'vgat' when c=1 then 'vglut' end as nt_group from w""", i="section mask_id")
def _(t):
    genes = ["slc5a7", "slc32a1", "slc17a6"]
    w = t.bin_calls.groupBy("section", "mask_id").pivot("gene", genes).agg(F.max(F.col("positive").cast("int")))
    return tx.nt_group(w).select("section", "mask_id", "nt_group")


@query("type_fractions", "select subclass as type, count(*) as n, count(*)/(select count(*) from meta)::double as p from meta group by 1", d="p", i="n")
def _(t):
    return tx.type_fractions(t.meta, "subclass")


@query("rollup_freqs", """with j as (select * from freqs join taxonomy on type=cluster)
    select 'cluster' as level, cluster as type, sum(p) as p from j group by all union all select 'supertype', supertype, sum(p) from j group by all
    union all select 'subclass', subclass, sum(p) from j group by all union all select 'class', class, sum(p) from j group by all""", d="p")
def _(t):
    return tx.rollup_freqs(t.freqs, t.taxonomy)


@query("freqs_for_groups", """with g as (select subclass, string_agg(cluster, ', ' order by cluster) as name from taxonomy group by 1)
    select name, sum(p) as p from g join taxonomy using (subclass) join freqs on type=cluster group by 1""", d="p")
def _(t):
    g = t.taxonomy.groupBy("subclass").agg(F.array_join(F.array_sort(F.collect_set("cluster")), ", ").alias("name")).select("name")
    return tx.freqs_for_groups(t.freqs, g)


@query("renormalise_freqs", "with f as (select * from freqs where p>0.05) select type, p/(select sum(p) from f) as p from f", d="p")
def _(t):
    return tx.renormalise_freqs(t.freqs.where("p > 0.05"))


@query("cluster_parents", "select cell_id, cluster, supertype, subclass, class from meta")
def _(t):
    return tx.cluster_parents(t.meta, t.taxonomy)


@query("identify_level", """with n as (select distinct cluster as label, 'cluster' as level from taxonomy union select distinct supertype,'supertype' from taxonomy
    union select distinct subclass,'subclass' from taxonomy union select distinct class,'class' from taxonomy),
    l as (select distinct substr('cstkx', (vec_id%5+1)::int, 1)||label as label from embeddings)
    select l.label, coalesce(level,'not in taxonomy') as level from l left join n using (label)""")
def _(t):
    l = t.embeddings.select(F.concat(F.substring(F.lit("cstkx"), (F.col("vec_id") % 5 + 1).cast("int"), F.lit(1)), F.col("label")).alias("label")).distinct()
    return tx.identify_level(l, t.taxonomy)


@query("find_clusters", "select distinct cluster from taxonomy where subclass='s2'")
def _(t):
    return tx.find_clusters(t.taxonomy, "s2", "subclass")


@query("compare_proportions", """with o as (select cluster as type, count(*)/(select count(*) from meta where cluster<>'c3')::double as p
      from meta where cluster<>'c3' group by 1)
    select f.type, f.p*100 as reference_pct, coalesce(o.p,0)*100 as observed_pct from freqs f left join o using (type)""", d="reference_pct observed_pct")
def _(t):
    return tx.compare_proportions(t.freqs, tx.type_fractions(t.meta.where("cluster <> 'c3'")))


@query("in_out_counts", "select count(*) filter (where subclass in ('s0','s3')) as n_in, count(*) filter (where subclass not in ('s0','s3')) as n_out from meta", i="n_in n_out")
def _(t):
    region = t.taxonomy.where("subclass in ('s0','s3')").select(F.col("subclass").alias("type"))
    return tx.in_out_counts(t.meta.select(F.col("subclass").alias("type")), region)


@query("area_stats", """with a as (select section, mask_id, count(*) as area from masks group by all)
    select result, avg(area) as mean_area, stddev_pop(area) as sd_area, count(*) as n from a join mask_qc using (section, mask_id) group by 1""", d="mean_area sd_area", i="n")
def _(t):
    a = t.masks.groupBy("section", "mask_id").agg(F.count(F.lit(1)).alias("area"))
    return tx.area_stats(a.join(t.mask_qc, ["section", "mask_id"]), "result")


@query("sorted_shares", "select type, p, (p*10)::double as r from freqs order by type", d="p r")
def _(t):
    return tx.sorted_shares(t.freqs, t.freqs.select("type", (F.col("p") * 10).alias("r")))


@query("entropy_bits", "select log2(s) - e/s as bits from (select sum(p) s, sum(p*log2(p)) e from freqs)", d="bits")
def _(t):
    return tx.entropy_bits(t.freqs)
