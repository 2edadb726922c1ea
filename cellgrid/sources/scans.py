"""Readers and file-name parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cellgrid.functions.lines import by_merge
from cellgrid.schema import ATLAS_META, MASK_QC, MASK_QC_HEADER, RUN_PARAMS, SchemaMismatch

#: fixed values: token sets that classify files of a section, first match wins (case-insensitive)
FILE_TOKENS = {
    ("registration", None): ["nt", "neur", "snap25"],
    ("binary", None): ["bin"],
    ("mask", True): ["final_qc_masks"],
    ("mask", False): ["uncurated_masks"],
    ("mask_image", True): ["masks_qc_final"],
    ("mask_image", False): ["cp_masks"],
    ("data", None): [".tif"],
}
#: fixed values: tracer channels that are not genes
LABEL_CHANNELS = ["dtom", "egfp", "wga", "ctb"]


def _as_doubles(df: DataFrame, keep: set[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") if c in keep else F.col(f"`{c}`").cast("double").alias(c) for c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema])


def scan_cells_csv(spark: SparkSession, path: str, columns: list[str] | None = None, key: str = "Cell ID") -> DataFrame:
    """Cell table; every column but the key becomes double, NaN becomes NULL. Columns are pruned in the scan."""
    raw = spark.read.option("header", True).csv(path)  # header only, all strings: no inference pass
    if columns:
        missing = [c for c in columns if c not in raw.columns]
        if missing:
            raise SchemaMismatch(f"columns not in {path}: {missing}")
        raw = raw.select(*dict.fromkeys([key, *columns]))
    return nan_to_null(_as_doubles(raw, {key})).withColumnRenamed(key, "cell_id")


def scan_experiment(spark: SparkSession, exp_dir: str, columns: list[str] | None = None, key: str = "Cell ID") -> DataFrame:
    """All <exp>/post/core_output/<uid>/<exp>_<uid>.csv in one scan, tagged with exp and uid."""
    raw = spark.read.option("header", True).csv(f"{exp_dir}/post/core_output/*/*.csv")
    tagged = raw.withColumn("_f", F.col("_metadata.file_path"))
    if columns:
        tagged = tagged.select(*dict.fromkeys([key, *columns]), "_f")
    parts = r"([^/]+)/post/core_output/([^/]+)/([^/]+)\.csv$"
    exp, uid, stem = (F.regexp_extract("_f", parts, k) for k in (1, 2, 3))
    tagged = tagged.withColumn("exp", exp).withColumn("uid", uid).where(stem == F.concat_ws("_", exp, uid)).drop("_f")
    return nan_to_null(_as_doubles(tagged, {key, "exp", "uid"})).withColumnRenamed(key, "cell_id")


def union_checked(*dfs: DataFrame) -> DataFrame:
    """Union of tables whose columns match in order; anything else is an error."""
    first = dfs[0]
    for d in dfs[1:]:
        if d.columns != first.columns:
            raise SchemaMismatch(f"columns differ: {first.columns} vs {d.columns}")
        first = first.unionByName(d)
    return first


def scan_mask_qc(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    kinds = {f.name: f.dataType for f in MASK_QC}
    extra = [c for c in raw.columns if c not in MASK_QC_HEADER]
    return raw.select(*[F.col(f"`{h}`").cast(kinds[n]).alias(n) for h, n in MASK_QC_HEADER.items()], *[F.col(f"`{c}`") for c in extra])


def scan_bin_calls(spark: SparkSession, path: str, row_key: str = "Row") -> DataFrame:
    """Wide 0/1 gene table to long (mask_id, gene, positive)."""
    raw = spark.read.option("header", True).csv(path)
    genes = [c for c in raw.columns if c not in (row_key, "section")]
    ids = [c for c in raw.columns if c not in genes]
    return (raw.unpivot([f"`{c}`" for c in ids], [f"`{g}`" for g in genes], "gene", "_v")
            .withColumn("positive", F.col("_v").cast("double") != 0).drop("_v").withColumnRenamed(row_key, "mask_id"))


def scan_atlas_meta(spark: SparkSession, path: str, extra: T.StructType | None = None) -> DataFrame:
    """Atlas metadata by name from the header; string columns of the fixed contract."""
    raw = spark.read.option("header", True).csv(path)
    want = [f.name for f in (extra or ATLAS_META)]
    missing = [c for c in want if c not in raw.columns]
    if missing:
        raise SchemaMismatch(f"atlas metadata lacks {missing}")
    return raw.select(*want)


def scan_csr_matrix(csr_rows: DataFrame, key: str = "cell_id") -> DataFrame:
    """Rows (key, indices, data) to long non-zeros (key, gene_index, value)."""
    return csr_rows.select(key, F.explode(F.arrays_zip("indices", "data")).alias("e")).select(
        key, F.col("e.indices").cast("int").alias("gene_index"), F.col("e.data").cast("double").alias("value"))


def scan_mapping_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("comment", "#").csv(path)


def matrix_genes_by_rows(wide: DataFrame, symbols: DataFrame, gene_col: str = "gene_id") -> DataFrame:
    """Genes as rows, cells as columns -> long (cell_id, gene, value) with gene symbols joined."""
    cells = [c for c in wide.columns if c != gene_col]
    long = wide.unpivot([gene_col], cells, "cell_id", "value")
    return long.join(symbols, gene_col).select("cell_id", F.col("symbol").alias("gene"), "value")


def matrix_cells_by_rows(wide: DataFrame, id_col: str = "cell_id") -> DataFrame:
    return wide.unpivot([id_col], [c for c in wide.columns if c != id_col], "gene", "value")


def gene_index(genes: DataFrame, order: str = "pos") -> DataFrame:
    """Distinct symbols in first-seen file order with a dense 0-based index (gene-count sized)."""
    first = genes.groupBy("gene").agg(F.min(order).alias("_first"))
    return first.select("gene", (F.row_number().over(Window.orderBy("_first", "gene")) - 1).alias("gene_index"))


def scan_ontology(lines: DataFrame, col: str = "value") -> DataFrame:
    """``id,name`` text lines; quotes stripped; only the first comma separates."""
    parts = F.split(F.regexp_replace(col, '"', ""), ",", 2)
    return lines.select(F.expr(f"try_cast(split(regexp_replace({col}, '\"', ''), ',', 2)[0] as bigint)").alias("id"),
                        parts[1].alias("name")).where("id is not null")


def scan_run_params(json_rows: DataFrame, schema: T.StructType = RUN_PARAMS) -> DataFrame:
    """JSON parameter text; the affine string becomes numbers and tells 2-D (6) from 3-D (12)."""
    p = json_rows.withColumn("p", F.from_json("json", schema)).select(*[c for c in json_rows.columns if c != "json"], "p.*")
    nums = F.transform(F.filter(F.split(F.trim("affine"), r"[\s,]+"), lambda s: s != ""), lambda s: s.cast("double"))
    return p.withColumn("affine", nums).withColumn("ndim", F.when(F.size("affine") == 6, 2).when(F.size("affine") == 12, 3))


# ---- paths ------------------------------------------------------------------------------------------

def file_name(path: str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parse_filename(files: DataFrame) -> DataFrame:
    """One row per channel of DATE_EXP/DATE_r#_HCR/UID__gene488_gene594__INFO.ext."""
    stem = F.regexp_replace(file_name(), r"\.[^.]*$", "")
    parts = F.split(stem, "__")
    top, rnd = F.element_at(F.split("path", "/"), -3), F.element_at(F.split("path", "/"), -2)
    j = files.select("path", F.substring(top, 12, 1000).alias("exp"), F.to_date(F.substring(top, 1, 10)).alias("exp_date"),
                     F.regexp_extract(rnd, r"_r(\d+)_", 1).cast("int").alias("round"), parts[0].alias("uniq_id"),
                     F.get(parts, F.lit(2)).alias("info"), F.posexplode(F.split(parts[1], "_")).alias("channel_pos", "_c"))
    return j.withColumn("gene", F.expr("substring(_c, 1, length(_c) - 3)")).withColumn("wavelength", F.substring("_c", -3, 3).cast("int")).drop("_c")


def derive_params(dirs: DataFrame, col: str = "data_dir") -> DataFrame:
    """<date_exp>/post/<stage>/<uid> -> uid, post dir, experiment (folder name minus 11 characters)."""
    p = F.split(F.regexp_replace(col, "/$", ""), "/")
    return dirs.select(col, F.element_at(p, -1).alias("uid"), F.element_at(p, -3).alias("post_dir"),
                       F.substring(F.element_at(p, -4), 12, 1000).alias("experiment"))


def parse_image_description(images: DataFrame, col: str = "description", chans: int = 1, planes: int = 1) -> DataFrame:
    """channels= and slices= (else frames=) from free text, with found flags and defaults."""
    num = lambda pat: F.try_element_at(F.regexp_extract_all(col, F.lit(pat), 1), F.lit(1)).cast("int")
    c, z = num(r"channels=(\d+)"), F.coalesce(num(r"slices=(\d+)"), num(r"frames=(\d+)"))
    return images.select("path", F.coalesce(c, F.lit(chans)).alias("channels"), F.coalesce(z, F.lit(planes)).alias("planes"),
                         c.isNotNull().alias("channels_found"), z.isNotNull().alias("planes_found"))


def find_file_by_uid(files: DataFrame, uids: DataFrame) -> DataFrame:
    """The one file whose name holds the uid; uids with none or several matches give no row.

    A uid may stand anywhere in the name. Every name offers its pieces of the lengths that
    uids have, so this stays an equi-join.
    """
    lengths = uids.agg(F.collect_set(F.length("uid"))).scalar()
    sized = files.withColumn("_name", file_name()).withColumn("_n", F.explode(lengths)).where("_n > 0 and _n <= length(_name)")
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_name") - F.col("_n") + 1),
                                          lambda i: F.substring(F.col("_name"), i, F.col("_n"))))
    tagged = sized.select("path", F.explode(pieces).alias("uid"))
    hit = by_merge(tagged).join(uids.select("uid").distinct(), "uid").groupBy("uid").agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("path"))
    return hit.where("_n = 1").drop("_n")


def classify_files(files: DataFrame) -> DataFrame:
    """kind by ordered token sets ('other' if none is in the name), and for masks whether they are the curated ones."""
    name = F.lower(file_name())
    kind, curated = F.lit("other"), F.lit(None).cast("boolean")
    for (label, flag), tokens in reversed(FILE_TOKENS.items()):
        hit = F.exists(F.array(*[F.lit(x) for x in tokens]), lambda x: F.contains(name, x))
        kind, curated = F.when(hit, label).otherwise(kind), F.when(hit, F.lit(flag).cast("boolean")).otherwise(curated)
    return files.select("path", kind.alias("kind"), curated.alias("curated"))


def remove_label_channels(channels: DataFrame, col: str = "gene") -> DataFrame:
    return channels.where(~F.lower(col).rlike("|".join(LABEL_CHANNELS)))


def strings_filter_keywords(df: DataFrame, col: str, kws: list[str], mode: str = "keep") -> DataFrame:
    hit = F.exists(F.array(*[F.lit(k.lower()) for k in kws]), lambda k: F.contains(F.lower(col), k))
    return df.where(hit if mode == "keep" else ~hit)
