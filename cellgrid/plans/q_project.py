"""Projection and filter queries on cell tables."""

from pyspark.sql import functions as F

from cellgrid.operators import project as pj
from cellgrid.plans.bindings import GENES
from cellgrid.plans.catalog import query
from cellgrid.sources import scans as sc


def cells(t):
    return pj.build_cell_df(t.mask_qc, t.bin_calls, GENES)


CELLS = "cl as (select section, mask_id, z_plane, z_span, principal_plane, " + ", ".join(
    f"(select bool_or(positive) from bin_calls b where b.section=g.section and b.mask_id=g.mask_id and gene='{g}') as {g}_b" for g in GENES) + " from good_cells g)"


@query("build_cell_df", f"with {CELLS} select * from cl", i="section mask_id z_plane z_span principal_plane")
def _(t):
    return cells(t)


@query("assign_cell_id", f"with {CELLS} select section, mask_id, 'EXP1_'||section||'_'||row_number() over (partition by section order by mask_id) as cell_id from cl", i="section mask_id")
def _(t):
    return pj.assign_cell_id(cells(t), "EXP1").select("section", "mask_id", "cell_id")


@query("filt_cells_keyword", f"with {CELLS}, i as (select section, mask_id, 'EXP1_'||section||'_'||row_number() over (partition by section order by mask_id) as cell_id from cl) select * from i where contains(cell_id, '_1_')",
       i="section mask_id")
def _(t):
    return pj.filt_cells_keyword(pj.assign_cell_id(cells(t), "EXP1").select("section", "mask_id", "cell_id"), "_1_")


@query("filt_features", f"with {CELLS}, i as (select *, 'EXP1_'||section||'_'||row_number() over (partition by section order by mask_id) as cell_id from cl) select cell_id, slc5a7_b, slc17a6_b from i")
def _(t):
    return pj.filt_features(pj.assign_cell_id(cells(t), "EXP1"), ["slc32a1_b"], ["slc5a7_b", "slc17a6_b", "slc32a1_b"], True).select("cell_id", "slc5a7_b", "slc17a6_b")


@query("strings_filter_keywords", "select p_partkey, p_name from part where not (contains(lower(p_name),'red') or contains(lower(p_name),'wid'))")
def _(t):
    return sc.strings_filter_keywords(t.part.select("p_partkey", "p_name"), "p_name", ["RED", "Wid"], "remove")


@query("remove_label_channels", "select p_partkey, gene from (select p_partkey, (['eGFP','dTom','phox2b','WGA','ctb'])[p_partkey%5+1]||p_size as gene from part) where not regexp_matches(lower(gene),'dtom|egfp|wga|ctb')")
def _(t):
    names = F.array(*[F.lit(x) for x in ("eGFP", "dTom", "phox2b", "WGA", "ctb")])
    g = t.part.select("p_partkey", F.concat(F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")), F.col("p_size")).alias("gene"))
    return sc.remove_label_channels(g)
