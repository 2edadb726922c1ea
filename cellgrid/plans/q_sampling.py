"""Sampling and split queries."""

from pyspark.sql import functions as F

from cellgrid.operators import sampling as sa
from cellgrid.plans.catalog import query
from cellgrid.plans.sqlkit import hash32

RANK = lambda part: f"row_number() over (partition by {part} order by {hash32('cell_id', chr(39) + '42' + chr(39))}, cell_id)"
FOLDS = f"folds as (select cell_id, cluster, ({RANK('cluster')}-1)%5 as fold from meta)"
PARTS = f"{FOLDS}, prt as (select cell_id, cluster, range as split, case when fold=range then 'test' else 'train' end as part from folds, range(5))"


def folds(t):
    return sa.kfold_stratified(t.meta.select("cell_id", "cluster"), 5, "cluster", 42)


@query("bootstrap_by_freq", f"""with s as (select cluster, count(*) sz from meta group by 1), n as (select cell_id, cluster, {RANK('cluster')} rn from meta),
    d as (select cluster, j.range as draw, {hash32('cluster', 'j.range::varchar', "'42'")}%sz+1 as rn from s join freqs on type=cluster, range(1,1001) j where j.range<=round_even(round(p*1000,9),0))
    select cluster, draw, cell_id from d join n using (cluster, rn)""", i="draw")
def _(t):
    return sa.bootstrap_by_freq(t.meta.select("cell_id", "cluster"), t.freqs, 1000, 42)


@query("bootstrap_splits", f"""with {PARTS}, f0 as (select * from freqs where p >= 5/200.0), f1 as (select type, p/(select sum(p) from f0) p from f0),
    s as (select split, part, cluster, count(*) sz from prt group by all), n as (select split, part, cell_id, cluster, {RANK('split, part, cluster')} rn from prt),
    d as (select split, part, cluster, j.range as draw, {hash32('split::varchar', 'part', 'cluster', 'j.range::varchar', "'42'")}%sz+1 as rn from s join f1 on type=cluster, range(1,201) j
      where j.range<=round_even(round(p*case part when 'train' then 160 else 40 end,9),0))
    select split, part, cluster, draw, cell_id from d join n using (split, part, cluster, rn)""", i="draw split")
def _(t):
    return sa.bootstrap_splits(sa.split_parts(folds(t), 5), t.freqs, 200, 5, 42)


@query("supercells", f"""with s as (select cluster, count(*) sz from meta group by 1), n as (select cell_id, cluster, {RANK('cluster')} rn from meta),
    d as (select cluster, u.range as super, j.range as draw, {hash32('cluster', 'u.range::varchar', 'j.range::varchar', "'42'")}%sz+1 as rn
      from s, (select unnest(range(1, 2*(select max(sz) from s)+2)) as range) u, range(1,6) j where u.range<=greatest(1,round_even(sz*2.0::double,0))),
    m as (select cluster, super, draw, cell_id from d join n using (cluster, rn))
    select m.cluster, super, gene, sum(value) as value, max(m.cell_id) filter (where draw=1) as first_cell from m join expr using (cell_id) group by all""",
       d="value", i="super first_cell")
def _(t):
    return sa.supercells(t.expr, t.meta.select("cell_id", "cluster"), 5, 2.0, 42)


@query("supercells_splits", f"""with {PARTS}, s as (select split, part, cluster, count(*) sz from prt group by all),
    n as (select split, part, cell_id, cluster, {RANK('split, part, cluster')} rn from prt),
    u as (select unnest(range(1, (select max(sz) from s)+2)) as super),
    d as (select split, part, cluster, super, j.range as draw, {hash32('split::varchar', 'part', 'cluster', 'super::varchar', 'j.range::varchar', "'42'")}%sz+1 as rn
      from s, u, range(1,4) j where super<=greatest(1,round_even(sz*0.5::double,0))),
    m as (select split, part, cluster, super, draw, cell_id from d join n using (split, part, cluster, rn))
    select split, part, cluster, super, gene, sum(value) as value, max(m.cell_id) filter (where draw=1) as first_cell from m join expr using (cell_id) group by all""",
       d="value", i="super first_cell split")
def _(t):
    return sa.supercells_splits(t.expr, folds(t), 5, 3, 0.5, 42)


@query("kfold_stratified", f"with {FOLDS} select cell_id, cluster, fold from folds", i="fold")
def _(t):
    return folds(t)


@query("filter_min_cells", "select cell_id, cluster from meta where cluster in (select cluster from meta group by 1 having count(*)>=50)")
def _(t):
    return sa.filter_min_cells(t.meta, 50).select("cell_id", "cluster")


@query("fetch_expression", f"""with m as (select *, class<>'k2' as neuron from meta where cluster<>'c9'),
    r as (select *, {RANK('feature_matrix_label, neuron')} rn, count(*) over (partition by feature_matrix_label, neuron) n from m)
    select cell_id, feature_matrix_label, neuron, gene, value from r join expr using (cell_id) where rn<=round_even(n*case when neuron then 0.8::double else 0.5 end,0)""", d="value")
def _(t):
    return sa.fetch_expression(t.meta, t.expr, [f"c{k}" for k in range(9)], 0.8, 0.5, 42, ["k2"]).select(
        "cell_id", "feature_matrix_label", "neuron", "gene", "value")


@query("fetch_spatial", """with m as (select cell_id%3 as priority, cell_id, gene, value from expr union all select cell_id%2+1, cell_id, gene, value+1000 from expr)
    select distinct m.* from m where priority = (select min(priority) from m m2 where m2.cell_id=m.cell_id)""", d="value", i="priority")
def _(t):
    a = t.expr.withColumn("priority", F.col("cell_id") % 3)
    b = t.expr.withColumn("priority", F.col("cell_id") % 2 + 1).withColumn("value", F.col("value") + 1000)
    return sa.fetch_spatial(t.meta, a.unionByName(b)).select("priority", "cell_id", "gene", "value")
