"""Expression-matrix operators on the long table expr(cell_id, gene, value)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrid.functions.exprs import PIXEL_UM
from cellgrid.functions.ranking import exact_percentiles, overlapping_blocks
from cellgrid.operators import sparse
from cellgrid.schema import SchemaMismatch
from cellgrid.session import cut_lineage


def norm_by_area(cells: DataFrame, genes: list[str], area: str = "area") -> DataFrame:
    """Value per square micron (pixel area is 0.325^2), always by the original area."""
    scale = F.col(area) * (PIXEL_UM * PIXEL_UM)
    return cells.withColumns({g: F.try_divide(F.col(g), scale) for g in genes}).drop(area)


def norm_to_median_total(expr: DataFrame) -> DataFrame:
    """Scale every cell to the median total; half-even rounding; 16-bit range."""
    totals = expr.groupBy("cell_id").agg(F.sum("value").alias("_total"))
    target = exact_percentiles(totals, [], F.col("_total"), {"_m": 0.5}).scalar()
    scaled = F.rint(F.round(F.coalesce(F.try_divide(F.col("value") * F.col("_target"), F.col("_total")), F.lit(0.0)), 9))
    return (expr.join(totals.withColumn("_target", target), "cell_id")
            .withColumn("value", F.least(scaled, F.lit(65535.0))).drop("_total", "_target"))


def log1p(expr: DataFrame) -> DataFrame:
    return expr.withColumn("value", F.log1p("value"))


def gene_stats(expr: DataFrame, keys=("gene",), sample: bool = False, cells: Column | None = None) -> DataFrame:
    """Mean and deviation per gene. ``cells`` is the number of cells where ``expr`` lists non-zeros only:
    entries that are not there then count as zeros."""
    if cells is None:
        sd = F.stddev_samp("value") if sample else F.stddev_pop("value")
        return expr.groupBy(*keys).agg(F.avg("value").alias("mean"), sd.alias("sd"))
    sums = expr.groupBy(*keys).agg(F.sum("value").alias("_s"), F.count("value").alias("_c"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("_v"))
    mean, within = F.col("_s") / cells, F.col("_s") / F.col("_c")
    # squares about the non-zeros' own mean, moved to the mean over all cells
    squares = F.col("_c") * F.col("_v") + F.col("_c") * (within - mean) * (within - mean) + (cells - F.col("_c")) * mean * mean
    return sums.select(*keys, mean.alias("mean"), F.sqrt(squares / ((cells - 1) if sample else cells)).alias("sd"))


def zscore_genes(expr: DataFrame, stats: DataFrame | None = None, keys=("gene",)) -> DataFrame:
    """Standardise by the given (train) statistics; a zero deviation counts as 1."""
    stats = gene_stats(expr, keys) if stats is None else stats
    sd = F.when(F.coalesce("sd", F.lit(0.0)) == 0, 1.0).otherwise(F.col("sd"))
    return expr.join(stats, list(keys)).withColumn("value", (F.col("value") - F.col("mean")) / sd).drop("mean", "sd")


def cell_vectors(expr: DataFrame, keys=("cell_id",)) -> DataFrame:
    """One row per cell with its values in gene order (a cell has one value per panel gene)."""
    return expr.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("gene", "value"))),
                                               lambda s: s["value"]).alias("vec"))


def gene_order(expr: DataFrame) -> DataFrame:
    """gene -> 0-based position in gene order (panel sized)."""
    return expr.select("gene").distinct().select("gene", (F.row_number().over(Window.orderBy("gene")) - 1).alias("i"))


def corr_matrix(expr: DataFrame) -> DataFrame:
    """Gene x gene Pearson r over all cells of ``expr``; values that are not listed are zeros."""
    names = cut_lineage(gene_order(expr))
    r = sparse.correlations(cut_lineage(sparse.csr(expr, names)), names.count())
    return (r.join(names.select(F.col("gene").alias("gene_a"), "i"), "i")
            .join(names.select(F.col("gene").alias("gene_b"), F.col("i").alias("j")), "j")
            .select("gene_a", "gene_b", "r"))


def partial_corr_matrix(expr: DataFrame) -> DataFrame:
    """Each pair given all other genes: -P_ij / sqrt(P_ii P_jj) with P the inverse correlation matrix.

    The inverse works on the panel-sized matrix only; Spark has already reduced the cells.
    """
    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["gene_a"].unique())
        m = pdf.pivot(index="gene_a", columns="gene_b", values="r").loc[names, names].to_numpy()
        p = np.linalg.pinv(m)
        d = np.sqrt(np.diag(p))
        out = -p / np.outer(d, d)
        np.fill_diagonal(out, 1.0)
        a, b = np.meshgrid(names, names, indexing="ij")
        return pd.DataFrame({"gene_a": a.ravel(), "gene_b": b.ravel(), "r": out.ravel()})

    return corr_matrix(expr).groupBy(F.lit(0).alias("panel")).applyInPandas(invert, "gene_a string, gene_b string, r double")


def _beta_tail(t: float, dof: float) -> float:
    """Two-sided tail of Student's t by the continued fraction of the incomplete beta function."""
    x, a, b = dof / (dof + t * t), dof / 2.0, 0.5
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        x, a, b = 1 - x, b, a
    if x <= 0:
        return 1.0 if swap else 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for e in (even, odd):
            d, c = 1.0 / (1.0 + e * d), 1.0 + e / c
            f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * f if swap else front * f


def partial_pointbiserial(cells: DataFrame, binary: list[str], continuous: list[str]) -> DataFrame:
    """r of each binary with each continuous column residualised on the other continuous ones.

    One pass of covariances over the cells gives everything: regression coefficients, the
    residual variance and its covariance with the binary column. Returns n, r, 95 % CI, p.
    """
    cols = binary + continuous
    moments = cells.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols],
        *[F.min(F.col(b).cast("double")).alias(f"lo_{b}") for b in binary], *[F.max(F.col(b).cast("double")).alias(f"hi_{b}") for b in binary],
        *[F.count_if(~F.col(b).cast("double").isin(0.0, 1.0)).alias(f"mid_{b}") for b in binary],
        *[F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c_{a}__{b}")
          for i, a in enumerate(cols) for b in cols[i:]])
    def solve(batches):
        for pdf in batches:
            for rec in pdf.to_dict("records"):
                if any(rec[f"null_{c}"] for c in cols):
                    raise ValueError("NULL or NaN values: drop or impute first")
                for b in binary:
                    if rec[f"mid_{b}"] or rec[f"lo_{b}"] == rec[f"hi_{b}"]:
                        raise ValueError(f"{b} must have exactly two values")
                cov = lambda a, b: rec.get(f"c_{a}__{b}", rec.get(f"c_{b}__{a}"))
                n, rows = rec["n"], []
                for c in continuous:
                    others = [o for o in continuous if o != c]
                    beta = (np.linalg.lstsq(np.array([[cov(p, q) for q in others] for p in others]),
                                            np.array([cov(p, c) for p in others]), rcond=None)[0] if others else np.array([]))
                    var_e = cov(c, c) - sum(w * cov(p, c) for w, p in zip(beta, others))
                    for b in binary:
                        r = (cov(b, c) - sum(w * cov(b, p) for w, p in zip(beta, others))) / math.sqrt(cov(b, b) * var_e)
                        r = max(-1.0, min(1.0, r))
                        z, half = math.atanh(max(-1 + 1e-15, min(1 - 1e-15, r))), 1.959963984540054 / math.sqrt(n - 3) if n > 3 else math.inf
                        p = _beta_tail(r * math.sqrt((n - 2) / max(1e-300, 1 - r * r)), n - 2)
                        rows.append((b, c, n, r, math.tanh(z - half), math.tanh(z + half), p))
                yield pd.DataFrame(rows, columns=["binary_var", "continuous_var", "n", "r", "ci_lo", "ci_hi", "p_val"])

    return moments.mapInPandas(solve, "binary_var string, continuous_var string, n bigint, r double, ci_lo double, ci_hi double, p_val double")


def merge_corr_blocks(r_all: DataFrame, r_block: DataFrame) -> DataFrame:
    """Overwrite the binary x continuous cells of the full matrix in both triangles."""
    b = r_block.select(F.col("binary_var").alias("gene_a"), F.col("continuous_var").alias("gene_b"), F.col("r").alias("_r"))
    both = b.unionByName(b.select(F.col("gene_b").alias("gene_a"), F.col("gene_a").alias("gene_b"), "_r"))
    return r_all.join(both, ["gene_a", "gene_b"], "left").withColumn("r", F.coalesce("_r", "r")).drop("_r")


def pc_clip_scale(pcs: DataFrame, lo: float = 10, hi: float = 90, comp: str = "comp", score: str = "score") -> DataFrame:
    """Clip each component to its p10..p90, then min-max to 0..1."""
    lim = exact_percentiles(pcs, [comp], F.col(score), {"_lo": lo / 100, "_hi": hi / 100})
    c = F.least(F.greatest(F.col(score), F.col("_lo")), F.col("_hi"))
    return pcs.join(lim, comp).withColumn(score, F.coalesce(
        F.try_divide(c - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))).drop("_lo", "_hi")


# ---- binning and gene scores ----------------------------------------------------------------------

def outlier_factors(counts: DataFrame, k: int = 20, block: int = 4096) -> DataFrame:
    """counts(gene, value, c) plus ``factor``, the local outlier factor of the gene's cells with that value.

    A cell's k nearest others lie within k distinct values on either side, with their
    counts; of equally near values the lower comes first. Distances to the k-th, densities
    and factors are three windows over overlapping blocks of ranked values, so a gene may
    have any number of values. A gene of one cell has the factor 1.
    """
    totals = counts.groupBy("gene").agg(F.least(F.sum("c") - 1, F.lit(k)).alias("_k"))
    rows = overlapping_blocks(counts.select("gene", "value", "c").join(totals, "gene"), ["gene"], [F.col("value")], 3 * k, block)
    around = Window.partitionBy("gene", "_block").orderBy("value").rowsBetween(-k, k)

    def over_nearest(start: Column, step: Callable[[Column, Column, Column], Column], *more: str) -> Column:
        """Folds ``step(sum, neighbour, taken)`` over the neighbours, nearest first, while cells are wanted."""
        near = F.transform(F.collect_list(F.struct("value", "c", *more)).over(around), lambda x: F.struct(
            F.abs(x["value"] - F.col("value")).alias("dist"), x["value"].alias("value"),
            (x["c"] - (x["value"] == F.col("value")).cast("long")).alias("mult"), *[x[m].alias(m) for m in more]))

        def add(a: Column, x: Column) -> Column:
            taken = F.greatest(F.lit(0), F.least(x["mult"], F.col("_k") - a["seen"]))
            return F.struct((a["seen"] + taken).alias("seen"), F.when(taken > 0, step(a["sum"], x, taken)).otherwise(a["sum"]).alias("sum"))

        return F.aggregate(F.array_sort(near), F.struct(F.lit(0).cast("long").alias("seen"), start.alias("sum")), add)["sum"]

    far = rows.withColumn("_far", over_nearest(F.lit(0.0), lambda s, x, taken: x["dist"]))
    reach = over_nearest(F.lit(0.0), lambda s, x, taken: s + taken * F.greatest(x["_far"], x["dist"]), "_far")
    dense = far.withColumn("_density", 1.0 / (F.coalesce(F.try_divide(reach, F.col("_k")), F.lit(0.0)) + 1e-10))
    beside = over_nearest(F.lit(0.0), lambda s, x, taken: s + taken * x["_density"], "_density")
    judged = dense.withColumn("factor", F.coalesce(F.try_divide(beside, F.col("_k")) / F.col("_density"), F.lit(1.0)))
    return judged.where("_core").select("gene", "value", "c", "factor")


def bin_gene(expr: DataFrame, bins: int = 10, thresh: float | None = 2.0) -> DataFrame:
    """Replace values by rounded midpoints of equal-width bins over the non-outliers.

    Outlier factors are computed on each gene's distinct values with their counts, never on
    the cells. ``thresh=None`` keeps every value.
    """
    counts = expr.groupBy("gene", "value").agg(F.count(F.lit(1)).alias("c"))
    if thresh is None:
        judged = counts.withColumn("outlier", F.lit(False))
    else:
        judged = cut_lineage(outlier_factors(counts).withColumn("outlier", F.col("factor") > thresh).drop("factor"))
    keep = F.when(~F.col("outlier"), F.col("value"))
    j = judged.join(judged.groupBy("gene").agg(F.min(keep).alias("_lo"), F.max(keep).alias("_hi")), "gene")
    step = (F.col("_hi") - F.col("_lo")) / float(bins)

    def middle(k: Column) -> Column:
        left = F.when(k == 0, F.col("_lo") - (F.col("_hi") - F.col("_lo")) * 0.001).otherwise(F.col("_lo") + k * step)
        return F.rint(F.round((left + F.col("_lo") + (k + 1) * step) / 2, 9))

    code = F.coalesce(F.greatest(F.ceil(F.round(F.try_divide(F.col("value") - F.col("_lo"), step), 9)) - 1, F.lit(0)), F.lit(0))
    nearest = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.struct(
        F.abs(middle(k) - F.col("value")).alias("d"), k.alias("k"), middle(k).alias("m"))))["m"]
    mapped = j.select("gene", "value", "outlier", F.when(F.col("outlier"), nearest).otherwise(middle(code)).alias("binned"))
    return expr.join(mapped, ["gene", "value"])


def robust_dynamic_range(boots: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """boots(boot, gene, value) -> log1p of the mean 3-sd-capped range.

    ``cells`` (boot, n) says how many cells each draw has where ``boots`` lists non-zeros only: the others are zeros,
    and a gene without a value in a draw has the range 0 there.
    """
    if cells is None:
        s = boots.groupBy("boot", "gene").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"),
                                              F.max("value").alias("high"), F.min("value").alias("low"))
    else:
        s = sparse.grouped_moments(boots, ["boot"], cells)
    top, low = F.col("mean") + 3 * F.sqrt("var"), F.col("mean") - 3 * F.sqrt("var")
    capped = F.least(F.col("high"), top) - F.greatest(F.col("low"), low)
    ranges = s.groupBy("gene").agg(F.sum(capped).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    draws = F.col("_n") if cells is None else cells.agg(F.count(F.lit(1))).scalar()
    return ranges.select("gene", F.log1p(F.col("_sum") / draws).alias("rdr"))


def var_explained(expr: DataFrame, meta: DataFrame, freqs: DataFrame, level: str = "cluster", nonzeros: bool = False) -> DataFrame:
    """Between-type variance over between + frequency-weighted within; weights joined by key.

    With ``nonzeros`` the cells of ``meta`` count in full and values that ``expr`` does not list are zeros.
    """
    types = meta.select("cell_id", F.col(level).alias("type"))
    typed = expr.join(types, "cell_id")
    if nonzeros:
        sizes = types.join(freqs.select("type"), "type", "left_semi").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
        per = sparse.grouped_moments(typed, ["type"], sizes, expr.select("gene")).select("gene", "type", F.col("mean").alias("m"), F.col("var").alias("v"))
    else:
        per = typed.groupBy("gene", "type").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    g = per.join(freqs, "type").groupBy("gene").agg(
        F.var_pop("m").alias("b"), (F.sum(F.col("v") * F.col("p")) / F.sum("p")).alias("w"))
    return g.select("gene", F.coalesce(F.try_divide(F.col("b"), F.col("b") + F.col("w")), F.lit(0.0)).alias("var_explained"))


def gini(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Gini per group. Equal values are counted first, so ranks run over distinct values."""
    counts = df.groupBy(*keys, F.col(col).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    c = counts.withColumn("_lo", F.min("_x").over(w)).withColumn("_n", F.sum("_c").over(w))
    c = c.withColumn("_r", F.coalesce(F.sum("_c").over(w.orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = F.col("_x") - F.least(F.col("_lo"), F.lit(0.0)) + 1e-7
    return c.groupBy(*keys, "_n").agg((F.sum(F.col("_c") * (2 * F.col("_r") + F.col("_c") - F.col("_n")) * x)
                                       / (F.col("_n") * F.sum(F.col("_c") * x))).alias("gini")).drop("_n")


def expr_histogram(expr: DataFrame, batch: str, bins: int = 20) -> DataFrame:
    """Counts in equal-width bins of each gene and batch."""
    lim = expr.groupBy(batch, "gene").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    pos = F.coalesce(F.try_divide((F.col("value") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")), F.lit(0.0))
    b = F.least(F.floor(F.round(pos, 9)), F.lit(bins - 1)).cast("int")
    return expr.join(lim, [batch, "gene"]).groupBy(batch, "gene", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: fixed values: quartiles and whiskers of a violin
VIOLIN = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def gene_by_type_dist(expr: DataFrame, meta: DataFrame, gene: str, level: str = "cluster") -> DataFrame:
    one = expr.where(F.col("gene") == gene).join(meta.select("cell_id", F.col(level).alias("type")), "cell_id")
    n = one.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return n.join(exact_percentiles(one, ["type"], F.col("value"), VIOLIN), "type")


# ---- principal components ----------------------------------------------------------------------------

pca_fit, pca_apply = sparse.fit_components, sparse.apply_components


def pca_project(train: DataFrame, test: DataFrame, k: int = 50, keys=("split",)) -> tuple[DataFrame, DataFrame]:
    """Fit on train vectors, apply to both."""
    train = cut_lineage(train)  # read by every pass
    model = pca_fit(train, k, keys)
    return pca_apply(train, model, keys), pca_apply(test, model, keys)


def align_genes(expr: DataFrame, genes: list[str]) -> DataFrame:
    """Restrict to a gene list; all of it must be present."""
    found = expr.where(F.col("gene").isin(genes)).select("gene").distinct().count()
    if found != len(set(genes)):
        raise SchemaMismatch(f"{len(set(genes)) - found} of the requested genes are missing")
    return expr.where(F.col("gene").isin(genes))
