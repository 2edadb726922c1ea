"""Cell-table projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.ranking import bucketed_row_number

#: fixed values: columns of a cell table that are not genes
NON_GENES = ["section", "mask_id", "cell_id", "area", "volume", "z_plane", "z_span", "principal_plane", "assessed", "result"]


def filt_cells_keyword(cells: DataFrame, kw: str, col: str = "cell_id") -> DataFrame:
    return cells.where(F.contains(F.col(col).cast("string"), F.lit(kw)))


def filt_features(cells: DataFrame, remove: list[str] | None = None, keep: list[str] | None = None, genes: bool = False) -> DataFrame:
    """Drop non-gene columns, then the remove list, then all but the keep list."""
    cols = cells.columns
    if genes:
        cols = [c for c in cols if c not in NON_GENES or c == "cell_id"]
    if remove:
        cols = [c for c in cols if c not in remove]
    if keep:
        cols = [c for c in cols if c in keep or c == "cell_id"]
    return cells.select(*cols)


def build_cell_df(mask_qc: DataFrame, bin_calls: DataFrame, genes: list[str], remove_unassessed: bool = True,
                  remove_bad: bool = True, keys=("section", "mask_id")) -> DataFrame:
    """Mask QC joined by key with one <gene>_b boolean per gene."""
    keep = mask_qc
    if remove_unassessed:
        keep = keep.where("assessed = 1")
    if remove_bad:
        keep = keep.where("result = 'good'")
    wide = bin_calls.groupBy(*keys).agg(*[F.bool_or(F.when(F.col("gene") == g, F.col("positive"))).alias(f"{g}_b") for g in genes])
    return keep.join(wide, list(keys), "left").drop("assessed", "result")


def assign_cell_id(cells: DataFrame, exp: str, uid_col: str = "section") -> DataFrame:
    """<exp>_<uid>_<n>, n = 1-based position by mask id within the section."""
    n = bucketed_row_number(cells, [uid_col], ["mask_id"], F.floor(F.col("mask_id") / 4096), "_n")
    return n.withColumn("cell_id", F.concat_ws("_", F.lit(exp), uid_col, "_n")).drop("_n")
