"""Masks, annotations and the joins between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrid.functions.lines import by_merge
from cellgrid.functions.ranking import bucketed_row_number
from cellgrid.operators.voxels import ZYX

MASK = ["section", "mask_id"]


def region_props(voxels: DataFrame, masks: DataFrame, channel: str = "channel") -> DataFrame:
    """Per mask and channel: size, centroid, min and mean intensity. Masks may be any size."""
    return by_merge(masks).join(voxels, ["section", *ZYX]).groupBy(*MASK, channel).agg(
        F.count(F.lit(1)).alias("volume"), F.avg("z").alias("cz"), F.avg("y").alias("cy"), F.avg("x").alias("cx"),
        F.min("v").alias("min_v"), F.avg("v").alias("mean_v"))


def mask_shape(masks: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return masks.groupBy(*MASK, *extra).agg(F.count(F.lit(1)).alias("volume"), F.avg("z").alias("cz"),
                                            F.avg("y").alias("cy"), F.avg("x").alias("cx"))


def keep_nonzero_cells(props: DataFrame) -> DataFrame:
    return (props.groupBy(*MASK).agg(F.bool_and(F.col("min_v") > 0).alias("_all")).where("_all").drop("_all"))


def principal_plane_masks(masks: DataFrame, cells: DataFrame) -> DataFrame:
    """Each listed cell's voxels at its principal plane (z_plane + principal_plane - 2, 0-based)."""
    plane = cells.select(*MASK, (F.col("z_plane") + F.col("principal_plane") - 2).alias("z"))
    return by_merge(masks).join(plane, [*MASK, "z"])


def crop_bounds(masks: DataFrame, sections: DataFrame, margin: int = 100) -> DataFrame:
    """Half-open box around all masks of a section, widened by ``margin`` and clipped."""
    box = masks.groupBy("section").agg(F.min("y").alias("y0"), F.max("y").alias("y1"),
                                       F.min("x").alias("x0"), F.max("x").alias("x1"))
    return box.join(sections, "section").select(
        "section", F.greatest(F.col("y0") - margin, F.lit(0)).alias("y_start"),
        F.least(F.col("y1") + 1 + margin, F.col("n_y")).alias("y_stop"),
        F.greatest(F.col("x0") - margin, F.lit(0)).alias("x_start"),
        F.least(F.col("x1") + 1 + margin, F.col("n_x")).alias("x_stop"))


def label_overlap_filter(masks: DataFrame, labels: DataFrame, thresh: float = 0.05) -> DataFrame:
    """Keep masks that any label image covers by at least ``thresh`` of their voxels."""
    size = masks.groupBy(*MASK).agg(F.count(F.lit(1)).alias("_n"))
    hits = by_merge(masks).join(labels, ["section", *ZYX]).groupBy(*MASK, "label").agg(F.count(F.lit(1)).alias("_h"))
    passed = (hits.join(size, MASK).groupBy(*MASK)
              .agg(F.bool_or(F.col("_h") / F.col("_n") >= thresh).alias("_p")).where("_p"))
    return by_merge(masks).join(passed.select(*MASK), MASK, "left_semi")


def masks_in_region(masks: DataFrame, annotation: DataFrame, parc_ids: DataFrame) -> DataFrame:
    """Masks whose centroid voxel (rounded half away from zero) lies in the given structures."""
    centre = mask_shape(masks).select(*MASK, *[F.round(f"c{a}").cast("int").alias(a) for a in ZYX])
    where = centre.join(by_merge(annotation), ["section", *ZYX]).join(parc_ids, "parc_id", "left_semi")
    return by_merge(masks).join(where.select(*MASK), MASK, "left_semi")


def clip_masks_to_region(masks: DataFrame, annotation: DataFrame, parc_ids: DataFrame) -> DataFrame:
    inside = annotation.join(parc_ids, "parc_id", "left_semi")
    return by_merge(masks).join(inside, ["section", *ZYX], "left_semi")


def relabel_dense(masks: DataFrame) -> DataFrame:
    """Mask ids of a section become 0..n-1 in order."""
    ids = masks.select(*MASK).distinct()
    ranked = bucketed_row_number(ids, ["section"], ["mask_id"], F.floor(F.col("mask_id") / 4096), "_r")
    return by_merge(masks).join(ranked.withColumn("new_id", F.col("_r") - 1).drop("_r"), MASK)


def annotation_boundaries(annotation: DataFrame, dilate: int = 1) -> DataFrame:
    """Voxels with a different 4-neighbour in the plane, grown by a diamond ``dilate`` times."""
    wx = Window.partitionBy("section", "z", "y").orderBy("x")
    wy = Window.partitionBy("section", "z", "x").orderBy("y")
    p = F.col("parc_id")
    rows = annotation.withColumn("_ex", F.coalesce(F.lag(p).over(wx) != p, F.lit(False))
                                 | F.coalesce(F.lead(p).over(wx) != p, F.lit(False)))
    edge = rows.withColumn("_ey", F.coalesce(F.lag(p).over(wy) != p, F.lit(False))
                           | F.coalesce(F.lead(p).over(wy) != p, F.lit(False))).where("_ex or _ey")
    offsets = [F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
               for dy in range(-dilate, dilate + 1) for dx in range(-dilate, dilate + 1) if abs(dy) + abs(dx) <= dilate]
    grown = edge.select("section", "z", "y", "x", F.explode(F.array(*offsets)).alias("o")).select(
        "section", "z", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
    return grown.join(by_merge(annotation.select("section", *ZYX)), ["section", *ZYX], "left_semi")


def region_perimeter(annotation: DataFrame, parc_ids: DataFrame) -> DataFrame:
    """Outline of the selected structures: a selected voxel with an unselected 4-neighbour."""
    tagged = annotation.join(parc_ids.withColumn("_in", F.lit(True)), "parc_id", "left")
    inside = F.coalesce(F.col("_in"), F.lit(False))
    wx = Window.partitionBy("section", "z", "y").orderBy("x")
    wy = Window.partitionBy("section", "z", "x").orderBy("y")
    t = tagged.withColumn("_in", inside)
    quiet = [F.coalesce(f("_in").over(w), F.lit(False)) for f in (F.lag, F.lead) for w in (wx, wy)]
    t = t.withColumn("_all", quiet[0] & quiet[1] & quiet[2] & quiet[3])
    return t.where("_in and not _all").select("section", *ZYX)


def majority(mask: DataFrame, sections: DataFrame) -> DataFrame:
    """Voxels with at least 5 set voxels in their 3x3 neighbourhood."""
    offs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    votes = mask.select("section", *ZYX, F.explode(offs).alias("o")).groupBy(
        "section", "z", (F.col("y") + F.col("o.a")).alias("y"), (F.col("x") + F.col("o.b")).alias("x")).count()
    return (votes.where("count >= 5").join(sections, "section")
            .where("y >= 0 and y < n_y and x >= 0 and x < n_x").select("section", *ZYX))


def color_by_gene(masks: DataFrame, expr: DataFrame, gene: str) -> DataFrame:
    """Mask voxels with the cell's expression of ``gene`` as value."""
    lut = expr.where(F.col("gene") == gene).select(*MASK, "value")
    return by_merge(masks).join(lut, MASK)


def color_by_type(masks: DataFrame, types: DataFrame, colours: DataFrame, level: str = "subclass") -> DataFrame:
    """Mask voxels as 8-bit RGBA by the cell's type; ``colours``: level, r, g, b in 0..1."""
    rgba = types.join(colours, level).select(*MASK, *[
        F.rint(F.col(c) * 255).cast("int").alias(c) for c in ("r", "g", "b")], F.lit(255).alias("a"))
    return by_merge(masks).join(rgba, MASK)


def qc_pass_by_zspan(mask_qc: DataFrame) -> DataFrame:
    return mask_qc.groupBy("z_span").agg(F.count(F.lit(1)).alias("n"),
                                         F.avg((F.col("result") == "good").cast("double")).alias("pass_rate"))
