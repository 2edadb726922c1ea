"""Classifier metrics, cluster recombination, and the composed typing workflows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrid.operators import expression as ex, sampling as sa, sparse, taxonomy as tx
from cellgrid.operators.neighbours import knn_classify, knn_join
from cellgrid.session import cut_lineage


# ---- metrics: pred(cell_id, label, pred [, keys]) -------------------------------------------------

def accuracy(pred: DataFrame, keys=()) -> DataFrame:
    return pred.groupBy(*keys).agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))


def confusion_matrix(pred: DataFrame, labels: DataFrame | None = None, keys=()) -> DataFrame:
    """Counts over all label pairs, zeros kept. Pairs are generated from the label list (label-count sized)."""
    keys = list(keys)
    found = pred.groupBy(*keys, F.col("label").alias("true"), "pred").agg(F.count(F.lit(1)).alias("n"))
    names = labels if labels is not None else pred.select(*keys, F.explode(F.array("label", "pred")).alias("label")).distinct()
    lists = names.groupBy(*keys).agg(F.sort_array(F.collect_set("label")).alias("_all"))
    grid = lists.select(*keys, F.explode("_all").alias("true"), "_all").select(*keys, "true", F.explode("_all").alias("pred"))
    return grid.join(found, [*keys, "true", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def weighted_sparsity(cm: DataFrame, freqs: DataFrame, keys=()) -> DataFrame:
    """Mean Gini of the confusion rows, weighted by frequency."""
    g = ex.gini(cm, [*keys, "true"], "n").join(freqs.select(F.col("type").alias("true"), "p"), "true")
    return g.groupBy(*keys).agg((F.sum(F.col("gini") * F.col("p")) / F.sum("p")).alias("sparsity"))


def confusion_rows_pct(cms: DataFrame) -> DataFrame:
    """Folds summed, rows divided by their total; empty rows become 0."""
    total = cms.groupBy("true", "pred").agg(F.sum("n").alias("n"))
    row = F.sum("n").over(Window.partitionBy("true"))
    return total.select("true", "pred", F.coalesce(F.try_divide(F.col("n").cast("double"), row), F.lit(0.0)).alias("share"))


def confusion_to_distance(cm: DataFrame) -> DataFrame:
    """d(a,b) = 1 - (cm_ab + cm_ba)/2, diagonal 0."""
    flip = cm.select(F.col("pred").alias("true"), F.col("true").alias("pred"), F.col("share").alias("_t"))
    d = 1 - (F.col("share") + F.col("_t")) / 2
    return cm.join(flip, ["true", "pred"]).select(
        F.col("true").alias("a"), F.col("pred").alias("b"), F.when(F.col("true") == F.col("pred"), 0.0).otherwise(d).alias("d"))


# ---- recombination (label-count sized tables) --------------------------------------------------------

def merge_cut(dm: DataFrame, step: float = 0.001) -> DataFrame:
    """First multiple of ``step`` above the smallest distance: the cut at which something merges."""
    least = dm.where("a <> b").agg(F.min("d").alias("_d"))
    return least.select((F.lit(step) * (F.floor(F.round(F.col("_d") / step, 6)) + 1)).alias("cut"))


def mutual_nearest(gd: DataFrame) -> DataFrame:
    """Pairs (a < b) that are each other's closest group."""
    order = F.struct(F.round("d", 9), F.least("a", "b"), F.greatest("a", "b"))
    near = gd.groupBy("a").agg(F.min_by("b", order).alias("b"))
    back = near.select(F.col("a").alias("b"), F.col("b").alias("a"))
    return near.join(back, ["a", "b"]).where("a < b")


def merge_closest(dm: DataFrame, step: float = 0.001) -> DataFrame:
    """Average linkage under the first cut that merges anything: (label, group), group = least member.

    Mutually nearest groups merge first; the average linkage never undoes such a merge, so
    rounds of them give the same tree. Distances between groups are means of label pairs.
    """
    dm = cut_lineage(dm)
    cut = merge_cut(dm, step).first()["cut"]
    groups = cut_lineage(dm.select(F.col("a").alias("label")).distinct().withColumn("group", F.col("label")))
    if cut is None:
        return groups
    while True:
        ga = groups.select(F.col("label").alias("a"), F.col("group").alias("_ga"))
        gb = groups.select(F.col("label").alias("b"), F.col("group").alias("_gb"))
        gd = (dm.join(ga, "a").join(gb, "b").where("_ga <> _gb").groupBy(F.col("_ga").alias("a"), F.col("_gb").alias("b"))
              .agg(F.avg("d").alias("d")))
        close = gd.where(F.round("d", 9) < F.round(F.lit(cut), 9))
        pairs = mutual_nearest(gd).join(close.select("a", "b"), ["a", "b"], "left_semi")
        moves = pairs.select(F.col("b").alias("group"), F.col("a").alias("_to"))
        nxt = cut_lineage(groups.join(moves, "group", "left").select(
            "label", F.coalesce("_to", "group").alias("group"), F.col("_to").isNotNull().alias("moved")))
        if nxt.where("moved").isEmpty():
            return nxt.drop("moved")
        groups = nxt.drop("moved")


def manual_merge(labels: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(label, group): user lists of labels to merge; all other labels stay alone."""
    return labels.join(targets, "label", "left").withColumn("group", F.coalesce("group", "label"))


def label_mapping(groups: DataFrame) -> DataFrame:
    """(label, group) -> (label, name): name lists the members as 'a, b'."""
    named = groups.groupBy("group").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("name"))
    return groups.join(named, "group").select("label", "name").distinct()


def compose_mapping(mapping: DataFrame, groups: DataFrame) -> DataFrame:
    """Base labels through ``mapping`` (label, name), then through groups of those names: (label, name) by base members.

    Members travel as rows, so a comma inside a label does no harm.
    """
    moved = mapping.join(groups.withColumnRenamed("label", "name"), "name").select("label", "group")
    return label_mapping(moved)


# ---- splits, cross-validation ---------------------------------------------------------------------

def preprocess_splits(boots: DataFrame, mapping: DataFrame | None = None, keys=("split",), cells: DataFrame | None = None) -> DataFrame:
    """boots(keys, part, cell_id, label, gene, value): log1p, standardise by train statistics, remap labels.

    ``cells`` (keys, part, cell_id, label) lists all cells where ``boots`` holds non-zeros only. Train statistics then
    count the zeros, and every cell gets a value for each gene of its split.
    """
    keys = list(keys)
    logged = ex.log1p(boots)
    if cells is None:
        stats = ex.gene_stats(logged.where("part = 'train'"), [*keys, "gene"])
        out = ex.zscore_genes(logged, stats, [*keys, "gene"])
    else:
        out = _standardised(logged, cells, keys)
    if mapping is not None:
        out = out.join(mapping, "label", "left").withColumn("label", F.coalesce("name", "label")).drop("name")
    return out


def _standardised(logged: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """All genes of every cell: listed values and zeros, by the statistics of the split's train cells."""
    train = cells.where("part = 'train'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    genes = logged.select("gene").distinct()
    stats = sparse.grouped_moments(logged.where("part = 'train'"), keys, train, genes)
    sd = F.when(F.col("var") > 0, F.sqrt("var")).otherwise(1.0)
    panel = stats.groupBy(*keys).agg(F.collect_list(F.struct("gene", "mean", sd.alias("sd"))).alias("_panel"))  # as wide as the panel
    own = [*keys, "part", "cell_id", "label"]
    listed = logged.groupBy(*keys, "part", "cell_id").agg(F.map_from_entries(F.collect_list(F.struct("gene", "value"))).alias("_x"))
    rows = cells.select(*own).join(listed, [*keys, "part", "cell_id"], "left").join(panel, keys)
    value = lambda s: (F.coalesce(F.col("_x")[s["gene"]], F.lit(0.0)) - s["mean"]) / s["sd"]
    return rows.select(*own, F.explode(F.transform("_panel", lambda s: F.struct(s["gene"].alias("gene"), value(s).alias("value")))).alias("_e")).select(*own, "_e.*")


def split_neighbours(data: DataFrame, keys=("split",), n_comps: int | None = 50, k: int = 5, metric: str = "cosine") -> DataFrame:
    """All splits in one job (split is a key): vectors -> components (train fit) -> k neighbours.

    Returns (keys, cell_id, label, ref_label), k rows per test cell. Labels play no part in
    the search, so merged labels can be voted on again without a new search.
    """
    keys = list(keys)
    vec = ex.cell_vectors(data, [*keys, "part", "cell_id", "label"])
    if n_comps:
        vec = cut_lineage(vec)
        model = ex.pca_fit(vec.where("part = 'train'"), n_comps, keys)
        vec = ex.pca_apply(vec, model, keys)
    train, test = vec.where("part = 'train'"), vec.where("part = 'test'")
    found = knn_join(test.select(*keys, F.col("cell_id").alias("query_id"), "vec"),
                     train.select(*keys, F.col("cell_id").alias("ref_id"), "label", "vec"), k, metric, keys)
    near = found.select(*keys, F.col("query_id").alias("cell_id"), F.col("label").alias("ref_label"))
    return test.select(*keys, "cell_id", "label").join(near, [*keys, "cell_id"])


def vote(near: DataFrame, mapping: DataFrame | None = None, keys=("split",)) -> DataFrame:
    """Majority of the neighbours' labels (after the mapping), ties to the smallest: (keys, cell_id, label, pred)."""
    keys = list(keys)
    if mapping is not None:
        for c in ("label", "ref_label"):
            m = mapping.select(F.col("label").alias(c), F.col("name").alias("_name"))
            near = near.join(m, c, "left").withColumn(c, F.coalesce("_name", c)).drop("_name")
    n = near.groupBy(*keys, "cell_id", "label", "ref_label").agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys, "cell_id", "label").agg(
        F.min_by("ref_label", F.struct(-F.col("_n"), F.col("ref_label"))).alias("pred"))


def classify_splits(data: DataFrame, keys=("split",), n_comps: int | None = 50, k: int = 5, metric: str = "cosine") -> DataFrame:
    return vote(split_neighbours(data, keys, n_comps, k, metric), None, keys)


def fold_table(expr: DataFrame, meta: DataFrame, folds: DataFrame, n_splits: int, level: str = "cluster") -> DataFrame:
    cells = sa.split_parts(folds.select("cell_id", "fold"), n_splits).join(
        meta.select("cell_id", F.col(level).alias("label")), "cell_id")
    return cells.select("split", "part", "cell_id", "label").join(expr, "cell_id")


def cross_validate(expr: DataFrame, meta: DataFrame, folds: DataFrame, n_splits: int = 5, genes: list[str] | None = None,
                   n_comps: int | None = 50, metric: str = "cosine", mapping: DataFrame | None = None) -> DataFrame:
    """Gene subset -> components -> kNN per fold. One gene uses the value itself and Euclidean distance."""
    if genes:
        expr = ex.align_genes(expr, genes)
    single = bool(genes) and len(genes) == 1
    data = preprocess_splits(fold_table(expr, meta, folds, n_splits), mapping)
    return classify_splits(data, n_comps=None if single else n_comps, metric="euclidean" if single else metric)


def bootstrap_table(expr: DataFrame, meta: DataFrame, folds: DataFrame, freqs: DataFrame, n_splits: int, n: int, seed: int) -> DataFrame:
    """Train/test bootstraps of every split: (split, part, cell_id = cluster|draw, label, gene, value)."""
    cells = sa.split_parts(folds.select("cell_id", "fold"), n_splits).join(meta.select("cell_id", "cluster"), "cell_id")
    draws = sa.bootstrap_splits(cells, freqs, n, n_splits, seed)
    named = draws.select("split", "part", F.concat_ws("|", "cluster", "draw").alias("draw_id"), F.col("cluster").alias("label"), "cell_id")
    return named.join(expr, "cell_id").select("split", "part", F.col("draw_id").alias("cell_id"), "label", "gene", "value")


def bootstrap_test(expr: DataFrame, meta: DataFrame, folds: DataFrame, freqs: DataFrame, n_splits: int = 5, n: int = 5000,
                   seed: int = 0, mapping: DataFrame | None = None) -> DataFrame:
    """Mean accuracy and sparsity over bootstrapped folds (n splits into 4:1 train:test for five folds)."""
    boots = bootstrap_table(expr, meta, folds, freqs, n_splits, n, seed)
    pred = cut_lineage(classify_splits(preprocess_splits(boots, mapping), n_comps=None))
    named = tx.freqs_for_groups(freqs, mapping.select("name").distinct()).withColumnRenamed("name", "type") if mapping is not None else freqs
    cm = confusion_matrix(pred, keys=["split"])
    per = accuracy(pred, ["split"]).join(weighted_sparsity(cm, named, ["split"]), "split")
    return per.agg(F.avg("accuracy").alias("accuracy"), F.avg("sparsity").alias("sparsity"), F.count(F.lit(1)).alias("splits"))


def iterative_recombination(boots: DataFrame, freqs: DataFrame, acc_thresh: float = 0.99,
                            n_comps: int | None = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cross-validate, merge the most confused labels, repeat until accurate enough or one label is left.

    Returns (history, final label mapping, final confusion shares). The neighbour search does
    not depend on labels, so it runs once; a round only maps labels, votes and merges
    label-sized tables. The driver keeps four numbers a round. Each round merges at least two
    labels; one that does not is an error, not an end.
    """
    spark = boots.sparkSession
    near = cut_lineage(split_neighbours(preprocess_splits(boots), n_comps=n_comps))
    mapping, history, rnd = None, [], 0
    while True:
        rnd += 1
        pred = cut_lineage(vote(near, mapping))
        acc = accuracy(pred, ["split"]).agg(F.avg("accuracy").alias("a")).first()["a"]
        names = pred.select("label").distinct()
        n_labels = names.count()
        named = freqs if mapping is None else tx.freqs_for_groups(freqs, mapping.select("name").distinct())
        bits = tx.entropy_bits(named).first()["bits"]
        if history and n_labels >= history[-1][2]:
            raise RuntimeError(f"round {rnd} merged no labels: {n_labels} are left at accuracy {acc}")
        history.append((rnd, float(acc), int(n_labels), float(bits)))
        shares = cut_lineage(confusion_rows_pct(confusion_matrix(pred)))
        if acc >= acc_thresh or n_labels <= 1:
            break
        groups = merge_closest(confusion_to_distance(shares))
        base = names.select("label", F.col("label").alias("name")) if mapping is None else mapping
        mapping = cut_lineage(compose_mapping(base, groups))
    hist = spark.createDataFrame(history, "round int, accuracy double, n_labels int, bits double")
    if mapping is None:
        mapping = names.withColumn("name", F.col("label"))
    return hist, mapping, shares


# ---- cell typing ---------------------------------------------------------------------------------------

def batch_centre(pcs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """pcs(cell_id, batch, comp, score): subtract each batch's mean per component."""
    group = ["batch", *extra, "comp"]
    mean = pcs.groupBy(*group).agg(F.avg("score").alias("_m"))
    return pcs.join(mean, group).withColumn("score", F.col("score") - F.col("_m")).drop("_m")


def assign_cell_types(expr: DataFrame, cells: DataFrame, atlas_expr: DataFrame, atlas_meta: DataFrame, freqs: DataFrame,
                      groups: DataFrame, level: str = "subclass", k: int = 5, n_comps: int = 16, seed: int = 0) -> DataFrame:
    """Label every cell from the atlas types allowed for its transmitter group.

    cells(cell_id, nt_group); groups(nt_group, subclass). All groups run in one job with
    ``nt_group`` as key: restrict atlas, renormalise frequencies, supercells, bootstrap as
    many atlas cells as there are cells, joint components, batch centring, kNN.
    """
    key = ["nt_group"]
    allowed = atlas_meta.join(groups, "subclass").select("nt_group", "cell_id", "cluster", F.col(level).alias("label"))
    parents = allowed.select("nt_group", "cluster").distinct()
    f = parents.join(freqs, F.col("cluster") == F.col("type"))
    w = Window.partitionBy("nt_group")  # label-count sized
    f = f.withColumn("p", F.col("p") / F.sum("p").over(w)).select("nt_group", "cluster", "p")
    # k = 1 supercells are plain resamples, so the atlas cells themselves are drawn
    n_real = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    sizes = allowed.groupBy("nt_group", "cluster").agg(F.count(F.lit(1)).alias("_size")).join(f, ["nt_group", "cluster"]).join(n_real, key)
    draws = sizes.withColumn("_k", F.rint(F.round(F.col("p") * F.col("_n"), 9)).cast("int")).where("_k > 0").withColumn(
        "draw", F.explode(F.sequence(F.lit(1), F.col("_k"))))
    draws = draws.withColumn("rn", sa.draw_index(F.col("_size"), F.col("nt_group"), F.col("cluster"), F.col("draw"), F.lit(seed)))
    pool = sa.numbered(allowed, ["nt_group", "cluster"], seed)
    picked = draws.join(pool, ["nt_group", "cluster", "rn"]).select(
        "nt_group", F.concat_ws("|", "cluster", "draw").alias("unit"), "label", "cell_id")
    genes = expr.select("gene").distinct()
    ref = picked.join(atlas_expr.join(genes, "gene", "left_semi"), "cell_id").select(
        "nt_group", F.lit("atlas").alias("batch"), F.col("unit").alias("cell_id"), "label", "gene", "value")
    own = cells.join(expr, "cell_id").select("nt_group", F.lit("cells").alias("batch"), F.col("cell_id").cast("string").alias("cell_id"),
                                             F.lit(None).cast("string").alias("label"), "gene", "value")
    both = ex.log1p(own.unionByName(ref))
    both = ex.zscore_genes(both, ex.gene_stats(both, ["nt_group", "gene"]), ["nt_group", "gene"])
    vec = cut_lineage(ex.cell_vectors(both, ["nt_group", "batch", "cell_id", "label"]))
    vec = ex.pca_apply(vec, ex.pca_fit(vec, n_comps, key), key)
    long = vec.select("nt_group", "batch", "cell_id", "label", F.posexplode("vec").alias("comp", "score"))
    centred = batch_centre(long, ("nt_group",)).withColumnRenamed("comp", "gene").withColumnRenamed("score", "value")
    ready = ex.cell_vectors(centred, ["nt_group", "batch", "cell_id", "label"])
    pred = knn_classify(ready.where("batch = 'cells'"), ready.where("batch = 'atlas'"), k, "euclidean", key)
    return pred.select("nt_group", "cell_id", F.col("pred").alias(level))


def graph_communities(edges: DataFrame) -> DataFrame:
    """Label propagation on an undirected graph until labels settle: (node, community).

    Votes are pre-aggregated per (node, label), so a hub with very many edges is one row per
    distinct label. Ties go to the smallest label. All nodes change at once, so labels may
    come round in a cycle instead of settling; then each node takes its smallest label of
    the cycle.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    states, marks = [], []
    while True:
        votes = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), "community")
                 .agg(F.count(F.lit(1)).alias("_n")))
        labels = cut_lineage(votes.groupBy("node").agg(F.min_by("community", F.struct(-F.col("_n"), F.col("community"))).alias("community")))
        mark = labels.agg(F.sum(F.xxhash64("node", "community").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("community", "node"))).first()
        if mark in marks:
            cycle = states[marks.index(mark):]
            return reduce(DataFrame.unionByName, cycle).groupBy("node").agg(F.min("community").alias("community"))
        states.append(labels)
        marks.append(mark)
