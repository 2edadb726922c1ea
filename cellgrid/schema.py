"""Table contracts. Coordinates are 0-based (z, y, x)."""

from pyspark.sql import types as T

VOXEL_KEYS = ("section", "channel")

MASK_QC = T.StructType([
    T.StructField("mask_id", T.IntegerType()),
    T.StructField("z_plane", T.IntegerType()),
    T.StructField("z_span", T.IntegerType()),
    T.StructField("principal_plane", T.IntegerType()),
    T.StructField("assessed", T.IntegerType()),
    T.StructField("result", T.StringType()),
])

#: fixed values: header names of the two QC files, mapped to our column names
MASK_QC_HEADER = {
    "Mask ID": "mask_id", "Z-plane": "z_plane", "Z-span": "z_span",
    "Principal Plane": "principal_plane", "Assessed": "assessed", "Result": "result",
}

RUN_PARAMS = T.StructType([
    T.StructField("affine", T.StringType()),
    T.StructField("iterations", T.LongType()),
    T.StructField("fix_channel", T.LongType()),
    T.StructField("mov_channel", T.LongType()),
])

ATLAS_META = T.StructType([T.StructField(n, T.StringType()) for n in (
    "cell_label", "cluster", "supertype", "subclass", "class", "feature_matrix_label",
    "parcellation_organ", "parcellation_category", "parcellation_division",
    "parcellation_structure", "parcellation_substructure")])


class SchemaMismatch(ValueError):
    """Raised when tables that must agree on their columns do not."""
