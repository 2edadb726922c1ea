"""Seeded sampling and splits: every choice is an md5 rank, so results repeat on any cluster.

Numbering inside a cluster uses hash buckets (``hash_row_number``); a cluster holding a
third of all cells is numbered by thousands of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.exprs import hash32
from cellgrid.functions.ranking import hash_row_number


def numbered(cells: DataFrame, keys: list[str], seed: int, unit: str = "cell_id") -> DataFrame:
    """Adds rn (1-based, hash order) within keys."""
    return hash_row_number(cells, keys, hash32(F.col(unit), F.lit(seed)), [F.col(unit)], "rn")


def draw_index(size: Column, *parts: Column) -> Column:
    return F.pmod(hash32(*parts), size) + 1


def bootstrap_by_freq(cells: DataFrame, freqs: DataFrame, n, seed: int, keys: list[str] | None = None,
                      unit: str = "cell_id") -> DataFrame:
    """round(p*n) draws with replacement from each cluster; clusters without cells are skipped.

    ``freqs``: type, p. ``n`` is a number, or a column of ``cells``' key table for keyed draws.
    Returns (keys, cluster, draw, unit).
    """
    keys = keys or []
    group = [*keys, "cluster"]
    sizes = cells.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    want = sizes.join(freqs.select(F.col("type").alias("cluster"), "p"), "cluster")
    count = F.rint(F.round(F.col("p") * (n if isinstance(n, Column) else F.lit(n)), 9)).cast("int")
    draws = want.withColumn("_k", count).where("_k > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_k"))))
    parts = [*[F.col(k) for k in keys], F.col("cluster"), F.col("draw"), F.lit(seed)]
    draws = draws.withColumn("rn", draw_index(F.col("_size"), *parts))
    return draws.join(numbered(cells, group, seed, unit).select(*group, "rn", unit), [*group, "rn"]).select(*group, "draw", unit)


def split_freqs(freqs: DataFrame, n_splits: int, n: int) -> DataFrame:
    """Drop types rarer than splits/n and renormalise."""
    kept = freqs.where(F.col("p") >= n_splits / n)
    total = kept.agg(F.sum("p")).scalar()
    return kept.withColumn("p", F.col("p") / total)


def bootstrap_splits(units: DataFrame, freqs: DataFrame, n: int, n_splits: int, seed: int, unit: str = "cell_id") -> DataFrame:
    """The same per (split, part): n(k-1)/k train and n/k test draws."""
    size = F.when(F.col("part") == "train", round((n_splits - 1) / n_splits * n)).otherwise(round(n / n_splits))
    return bootstrap_by_freq(units, split_freqs(freqs, n_splits, n), size, seed, ["split", "part"], unit)


def supercell_members(cells: DataFrame, k: int, factor: float, seed: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, cluster, super, draw, cell_id): max(1, round(factor*size)) supercells of k draws per cluster."""
    group = [*(keys or []), "cluster"]
    sizes = cells.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    n_super = F.greatest(F.lit(1), F.rint(F.col("_size") * F.lit(float(factor))).cast("int"))
    draws = sizes.withColumn("super", F.explode(F.sequence(F.lit(1), n_super))).withColumn(
        "draw", F.explode(F.sequence(F.lit(1), F.lit(k))))
    parts = [*[F.col(c) for c in group], F.col("super"), F.col("draw"), F.lit(seed)]
    draws = draws.withColumn("rn", draw_index(F.col("_size"), *parts))
    return draws.join(numbered(cells, group, seed).select(*group, "rn", "cell_id"), [*group, "rn"]).select(
        *group, "super", "draw", "cell_id")


def supercells(expr: DataFrame, cells: DataFrame, k: int, factor: float, seed: int, keys: list[str] | None = None) -> DataFrame:
    """Summed expression per supercell; its metadata cell is the first draw."""
    group = [*(keys or []), "cluster", "super"]
    members = supercell_members(cells, k, factor, seed, keys)
    first = members.where("draw = 1").select(*group, F.col("cell_id").alias("first_cell"))
    total = members.join(expr, "cell_id").groupBy(*group, "gene").agg(F.sum("value").alias("value"))
    return total.join(first, group)


def split_parts(cells: DataFrame, n_splits: int) -> DataFrame:
    """cells(fold) -> one row per split with part train/test."""
    return cells.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))).withColumn(
        "part", F.when(F.col("fold") == F.col("split"), "test").otherwise("train"))


def supercells_splits(expr: DataFrame, folds: DataFrame, n_splits: int, k: int, factor: float, seed: int) -> DataFrame:
    return supercells(expr, split_parts(folds, n_splits), k, factor, seed, ["split", "part"])


def kfold_stratified(meta: DataFrame, k: int, level: str, seed: int) -> DataFrame:
    return numbered(meta, [level], seed).withColumn("fold", F.pmod(F.col("rn") - 1, F.lit(k)).cast("int")).drop("rn")


def filter_min_cells(meta: DataFrame, k: int, level: str = "cluster") -> DataFrame:
    big = meta.groupBy(level).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select(level)
    return meta.join(big, level, "left_semi")


#: fixed values: atlas classes that are not neurons
NON_NEURONAL = ["30 Astro-Epen", "31 OPC-Oligo", "32 OEC", "33 Vascular", "34 Immune"]


def fetch_expression(meta: DataFrame, expr: DataFrame, clusters: list[str], neur_frac: float, nn_frac: float, seed: int,
                     non_neuronal: list[str] = NON_NEURONAL) -> DataFrame:
    """Cells of the clusters, a fixed share of neurons and non-neurons per matrix file, with expression."""
    m = meta.where(F.col("cluster").isin(clusters)).withColumn("neuron", ~F.col("class").isin(non_neuronal))
    group = ["feature_matrix_label", "neuron"]
    share = F.when(F.col("neuron"), neur_frac).otherwise(nn_frac)
    sizes = m.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_keep", F.rint(F.col("_n") * share)).drop("_n")
    kept = numbered(m, group, seed).join(sizes, group).where("rn <= _keep").drop("rn", "_keep")
    return kept.join(expr, "cell_id")


def fetch_spatial(meta: DataFrame, matrices: DataFrame) -> DataFrame:
    """matrices(priority, cell_id, gene, value): each wanted cell from the first dataset that has it."""
    wanted = matrices.join(meta.select("cell_id").distinct(), "cell_id", "left_semi")
    first = wanted.groupBy("cell_id").agg(F.min("priority").alias("priority"))
    return wanted.join(first, ["cell_id", "priority"])
