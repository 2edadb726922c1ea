"""Classification, recombination and graph queries."""

from pyspark.sql import functions as F

from cellgrid.operators import classify as cl, neighbours as nb
from cellgrid.plans.catalog import query
from cellgrid.plans.q_sampling import FOLDS, folds

VEC = "vc as (select vec_id as cell_id, 'c'||label as label, list_transform(embedding, lambda e: e::double) as vec from embeddings)"
PRED = f"""{FOLDS}, {VEC}, nn as (select q.cell_id, r.cell_id as ref, r.label, round({{dist}},6) as d from vc q join folds fq on fq.cell_id=q.cell_id, vc r join folds fr on fr.cell_id=r.cell_id
  where fq.fold=0 and fr.fold<>0 qualify row_number() over (partition by q.cell_id order by round({{dist}},6), r.cell_id)<=5),
vt as (select cell_id, label, count(*) n from nn group by all),
pd as (select cell_id, label as pred from vt qualify row_number() over (partition by cell_id order by n desc, label)=1),
pr as (select p.cell_id, v.label, p.pred from pd p join vc v using (cell_id))"""
EUC, COS = "list_distance(q.vec, r.vec)", "1-list_cosine_similarity(q.vec, r.vec)"


def vectors(t):
    v = F.transform("embedding", lambda e: e.cast("double"))
    return t.embeddings.select(F.col("vec_id").alias("cell_id"), F.concat(F.lit("c"), F.col("label")).alias("label"), v.alias("vec"))


def halves(t):
    v = vectors(t).join(folds(t).select("cell_id", "fold"), "cell_id")
    return v.where("fold = 0").drop("fold"), v.where("fold <> 0").drop("fold")


def predicted(t, metric="euclidean", **how):
    test, train = halves(t)
    return test.select("cell_id", "label").join(nb.knn_classify(test, train, 5, metric, **how), "cell_id")


@query("knn_classify", f"with {PRED.format(dist=COS)} select cell_id, label, pred from pr")
def _(t):
    return predicted(t, "cosine")


@query("knn_classify_euclidean", f"with {PRED.format(dist=EUC)} select cell_id, label, pred from pr")
def _(t):
    return predicted(t)


@query("knn_classify_partitioned", f"with {PRED.format(dist=EUC)} select cell_id, label, pred from pr")
def _(t):
    return predicted(t, ship_rows=0, pivots=16, block=64)


@query("accuracy", f"with {PRED.format(dist=EUC)} select avg((label=pred)::int) as accuracy from pr", d="accuracy")
def _(t):
    return cl.accuracy(predicted(t))


CM = f"""{PRED.format(dist=EUC)}, lb as (select label from pr union select pred from pr),
cm as (select a.label as "true", b.label as pred, count(p.cell_id) as n from lb a cross join lb b left join pr p on p.label=a.label and p.pred=b.label group by all)"""


@query("confusion_matrix", f"with {CM} select * from cm", i="n")
def _(t):
    return cl.confusion_matrix(predicted(t))


@query("weighted_sparsity", f"""with {CM}, r as (select "true", n+1e-7::double x, row_number() over (partition by "true" order by n) i, count(*) over (partition by "true") k from cm),
    g as (select "true", sum((2*i-k-1)*x)/(max(k)*sum(x)) gini from r group by 1)
    select sum(gini*p)/sum(p) as sparsity from g join freqs on type="true" """, d="sparsity")
def _(t):
    return cl.weighted_sparsity(cl.confusion_matrix(predicted(t)), t.freqs)


def fold_data(t):
    return cl.fold_table(t.expr, t.meta, folds(t), 5)


PREPROCESSED = f"""with {FOLDS}, m as (select cluster, string_agg(cluster, ', ') over (partition by subclass order by cluster rows between unbounded preceding and unbounded following) as name from taxonomy),
    b as (select f.cell_id, range as split, case when fold=range then 'test' else 'train' end as part, name as label, gene, ln(1+value) v from folds f join m using (cluster) join expr using (cell_id), range(5)),
    s as (select split, gene, avg(v) mu, stddev_pop(v) sd from b where part='train' group by all)
    select split, part, gene, label, sum((v-mu)/case when sd=0 then 1 else sd end) as value, count(*) as n from b join s using (split, gene) group by all"""


def merged_names(t):
    return t.taxonomy.groupBy("subclass").agg(F.array_sort(F.collect_set("cluster")).alias("c")).select(
        F.explode("c").alias("label"), F.array_join("c", ", ").alias("name"))


def by_label(p):
    return p.groupBy("split", "part", "gene", "label").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))


@query("preprocess_splits", PREPROCESSED, d="value", i="split n")
def _(t):
    return by_label(cl.preprocess_splits(fold_data(t), merged_names(t)))


@query("preprocess_splits_sparse", PREPROCESSED, d="value", i="split n")
def _(t):
    data = fold_data(t)
    cells = data.select("split", "part", "cell_id", "label").distinct()
    return by_label(cl.preprocess_splits(data.where("value <> 0"), merged_names(t), cells=cells))


@query("cross_validate", None, d="accuracy", i="split")
def _(t):
    return cl.accuracy(cl.cross_validate(t.expr, t.meta, folds(t)), ["split"])


@query("cross_validate_single_gene", f"""with {FOLDS}, b as (select f.cell_id, range as split, fold=range as test, cluster as label, ln(1+value) v from folds f join expr e on e.cell_id=f.cell_id and gene='g05', range(5)),
    s as (select split, avg(v) mu, stddev_pop(v) sd from b where not test group by 1), z as (select b.*, (v-mu)/sd z from b join s using (split)),
    nn as (select q.split, q.cell_id, q.label as own, r.label from z q join z r on q.split=r.split and q.test and not r.test
      qualify row_number() over (partition by q.split, q.cell_id order by round(abs(q.z-r.z),6), r.cell_id)<=5),
    vt as (select split, cell_id, own, label, count(*) n from nn group by all)
    select split, avg((own=label)::int) as accuracy from (select * from vt qualify row_number() over (partition by split, cell_id order by n desc, label)=1) group by 1""",
       d="accuracy", i="split")
def _(t):
    return cl.accuracy(cl.cross_validate(t.expr, t.meta, folds(t), genes=["g05"]), ["split"])


@query("bootstrap_test", None, d="accuracy sparsity", i="splits")
def _(t):
    return cl.bootstrap_test(t.expr, t.meta, folds(t), t.freqs, 5, 5000, 42)


SHARES = f"""{CM}, sh as (select "true", pred, coalesce(n/nullif(sum(n) over (partition by "true"),0)::double,0) as share from cm)"""


def shares(t):
    return cl.confusion_rows_pct(cl.confusion_matrix(predicted(t)))


@query("confusion_rows_pct", f"with {SHARES} select * from sh", d="share")
def _(t):
    return shares(t)


DIST = f"""{SHARES}, dm as (select x."true" as a, x.pred as b, case when x."true"=x.pred then 0 else 1-(x.share+y.share)/2 end as d from sh x join sh y on y."true"=x.pred and y.pred=x."true")"""


@query("confusion_to_distance", f"with {DIST} select * from dm", d="d")
def _(t):
    return cl.confusion_to_distance(shares(t))


@query("merge_closest_first_round", f"""with {DIST}, ct as (select 0.001::double*(floor(round(min(d)/0.001::double,6))+1) cut from dm where a<>b),
    ne as (select a, b, d from dm where a<>b qualify row_number() over (partition by a order by round(d,9), least(a,b), greatest(a,b))=1)
    select x.a, x.b, x.d from ne x join ne y on x.a=y.b and x.b=y.a, ct where x.a<x.b and round(x.d,9)<round(cut,9)""", d="d")
def _(t):
    dm = cl.confusion_to_distance(shares(t)).where("a <> b")
    cut = cl.merge_cut(dm).scalar()
    return cl.mutual_nearest(dm).join(dm, ["a", "b"]).where(F.round("d", 9) < F.round(cut, 9))


@query("merge_closest", None)
def _(t):
    return cl.merge_closest(cl.confusion_to_distance(shares(t)))


@query("manual_merge", """select distinct 'c'||label as label, case when label in (1,2) then 'early' when label in (5,6,7) then 'late' else 'c'||label end as "group" from embeddings""")
def _(t):
    lab = t.meta.select(F.col("cluster").alias("label")).distinct()
    targets = t.rows([("c1", "early"), ("c2", "early"), ("c5", "late"), ("c6", "late"), ("c7", "late")], "label string, group string")
    return cl.manual_merge(lab, targets)


@query("label_mapping", """with g as (select subclass as label, class as grp from taxonomy group by all), b as (select class as grp, string_agg(subclass, ', ' order by subclass) as name from (select distinct subclass, class from taxonomy) group by 1)
    select label, name from g join b using (grp)""")
def _(t):
    return cl.label_mapping(t.taxonomy.select(F.col("subclass").alias("label"), F.col("class").alias("group")).distinct())


@query("iterative_recombination", None, d="accuracy bits", i="round n_labels")
def _(t):
    return cl.iterative_recombination(fold_data(t), t.freqs, 0.99, n_comps=20)[0]


@query("assign_cell_types", None)
def _(t):
    cells = t.meta.select("cell_id", F.concat(F.lit("nt"), F.col("cell_id") % 2).alias("nt_group"))
    groups = t.taxonomy.select("subclass").distinct().withColumn("nt_group", F.concat(F.lit("nt"), F.ascii(F.substring("subclass", 2, 1)) % 2))
    atlas = t.meta.withColumn("cell_id", F.concat(F.lit("a"), F.col("cell_id")))
    atlas_expr = t.expr.withColumn("cell_id", F.concat(F.lit("a"), F.col("cell_id")))
    return cl.assign_cell_types(t.expr, cells, atlas_expr, atlas, t.freqs, groups, seed=42)


@query("batch_centre", """with p as (select e.cell_id, feature_matrix_label as batch, gene as comp, value as score from expr e join meta using (cell_id))
    select cell_id, batch, comp, score - avg(score) over (partition by batch, comp) as score from p""", d="score")
def _(t):
    p = t.expr.join(t.meta.select("cell_id", F.col("feature_matrix_label").alias("batch")), "cell_id").select(
        "cell_id", "batch", F.col("gene").alias("comp"), F.col("value").alias("score"))
    return cl.batch_centre(p)


GRAPH = f"""{VEC}, ed as (select distinct least(a,b) as a, greatest(a,b) as b from (select q.cell_id as a, r.cell_id as b from vc q, vc r where q.cell_id<>r.cell_id
  qualify row_number() over (partition by q.cell_id order by round({EUC},6), r.cell_id)<=10))"""


def graph(t):
    return nb.knn_graph(vectors(t).drop("label"), 10)


@query("knn_graph", f"with {GRAPH} select a, b from ed", i="a b")
def _(t):
    return graph(t)


def rounds_sql(n):
    text = f"{GRAPH}, e2 as (select a, b from ed union select b, a from ed), l0 as (select distinct a as node, a as c from e2)"
    for r in range(n):
        text += f""", v{r} as (select e2.a as node, c, count(*) n from e2 join l{r} on l{r}.node=e2.b group by all),
l{r + 1} as materialized (select node, c from v{r} qualify row_number() over (partition by node order by n desc, c)=1)"""
    # settled, or in a cycle of two: then the smaller of both labels
    return f"with {text} select x.node, least(x.c, y.c) as community from l{n} x join l{n - 1} y using (node)"


@query("graph_communities", rounds_sql(24), i="node community")
def _(t):
    return cl.graph_communities(graph(t))


