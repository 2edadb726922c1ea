"""Every query against its SQL oracle at sf0.001; CELLGRID_QUICK=1 runs a cross-section."""

import os

import pytest

from cellgrid.plans import load_all
from harness import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_all()
QUICK = ["spots_per_cell", "unmix", "flip_z", "region_props", "spot_count_curve", "annotation_boundaries", "sim_cc", "affine_fit",
         "bspline_grid_fit", "curve_fano", "norm_to_median_total", "corr_matrix", "gini", "bootstrap_by_freq", "kfold_stratified",
         "rollup_freqs", "knn_classify", "knn_classify_partitioned", "confusion_to_distance", "parse_filename", "classify_files",
         "build_cell_df", "assign_cell_id", "pending_work", "incremental_cells", "sink_split_by_size",
         "find_file_by_uid", "curve_two_piece_fit", "zscore_genes_sparse", "corr_matrix_sparse", "pca_sparse", "field_point_error"]
NAMES = QUICK if os.environ.get("CELLGRID_QUICK") else sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert got.startswith(("ok", "rows-only")), got
