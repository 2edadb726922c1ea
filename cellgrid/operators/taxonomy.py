"""Cell-type taxonomy and frequency operators (taxonomies are small dimension tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.schema import SchemaMismatch

#: fixed values: taxonomy levels, fine to coarse, and anatomy levels, coarse to fine
LEVELS = ["cluster", "supertype", "subclass", "class"]
ANATOMY = ["organ", "category", "division", "structure", "substructure"]


def extract_meta(meta: DataFrame, selection: list[str], kind: str = "restrict", category: str = "anatomy",
                 level: str = "organ") -> DataFrame:
    """Keep or drop the cells whose level value is in the selection."""
    allowed = ANATOMY if category == "anatomy" else LEVELS
    if level not in allowed or kind not in ("restrict", "remove"):
        raise SchemaMismatch(f"unknown {category} level {level!r} or kind {kind!r}")
    hit = F.col(level).isin(selection)
    return meta.where(hit if kind == "restrict" else ~F.coalesce(hit, F.lit(False)))


def nt_group(cells: DataFrame) -> DataFrame:
    """Transmitter group by priority of the three marker genes."""
    g = F.when(F.col("slc5a7") == 1, "cht").when(F.col("slc32a1") == 1, "vgat").when(F.col("slc17a6") == 1, "vglut")
    return cells.withColumn("nt_group", g)


def type_fractions(meta: DataFrame, level: str = "cluster") -> DataFrame:
    total = meta.agg(F.count(F.lit(1))).scalar()
    return meta.groupBy(F.col(level).alias("type")).agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / total)


def rollup_freqs(freqs: DataFrame, taxonomy: DataFrame, level: str | None = None) -> DataFrame:
    """Cluster frequencies summed at one level, or at every level when none is given."""
    j = freqs.join(taxonomy, F.col("type") == F.col("cluster"))
    levels = [level] if level else LEVELS
    rows = F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), F.col(lv).alias("name")) for lv in levels])).alias("l")
    return j.select(rows, "p").groupBy("l.level", F.col("l.name").alias("type")).agg(F.sum("p").alias("p"))


def freqs_for_groups(freqs: DataFrame, groups: DataFrame) -> DataFrame:
    """groups(name 'a, b') -> summed frequency of the parts."""
    parts = groups.select("name", F.explode(F.split("name", ", ")).alias("type"))
    return parts.join(freqs, "type").groupBy("name").agg(F.sum("p").alias("p"))


def renormalise_freqs(freqs: DataFrame) -> DataFrame:
    total = freqs.agg(F.sum("p")).scalar()
    return freqs.withColumn("p", F.col("p") / total)


def cluster_parents(meta: DataFrame, taxonomy: DataFrame) -> DataFrame:
    return meta.select("cell_id", "cluster").join(taxonomy, "cluster", "left")


def level_names(taxonomy: DataFrame) -> DataFrame:
    """(label, level) of every taxonomy name."""
    return taxonomy.select(F.explode(F.array(*[
        F.struct(F.col(lv).alias("label"), F.lit(lv).alias("level")) for lv in LEVELS])).alias("l")).select("l.*").distinct()


def identify_level(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    return labels.join(level_names(taxonomy), "label", "left").withColumn("level", F.coalesce("level", F.lit("not in taxonomy")))


def find_clusters(taxonomy: DataFrame, name: str, level: str) -> DataFrame:
    return taxonomy.where(F.col(level) == name).select("cluster").distinct()


def compare_proportions(reference: DataFrame, observed: DataFrame) -> DataFrame:
    """Percent per type in the reference and in the observation; absent counts as 0."""
    o = observed.select("type", F.col("p").alias("_o"))
    return reference.join(o, "type", "left").select("type", (F.col("p") * 100).alias("reference_pct"),
                                                    (F.coalesce("_o", F.lit(0.0)) * 100).alias("observed_pct"))


def in_out_counts(labels: DataFrame, region_types: DataFrame) -> DataFrame:
    flagged = labels.join(region_types.select("type").distinct().withColumn("_in", F.lit(1)), "type", "left")
    return flagged.agg(F.count("_in").alias("n_in"), (F.count(F.lit(1)) - F.count("_in")).alias("n_out"))


def area_stats(cells: DataFrame, by: str) -> DataFrame:
    return cells.groupBy(by).agg(F.avg("area").alias("mean_area"), F.stddev_pop("area").alias("sd_area"), F.count(F.lit(1)).alias("n"))


def sorted_shares(freqs: DataFrame, colours: DataFrame) -> DataFrame:
    return freqs.join(colours, "type", "left").orderBy("type")


def entropy_bits(freqs: DataFrame) -> DataFrame:
    """Base-2 entropy of the normalised frequencies, as log2(S) - sum(p log2 p)/S."""
    s = F.sum("p")
    plogp = F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0))
    return freqs.agg((F.log2(s) - plogp / s).alias("bits"))
