"""Spot detection, counting and assignment to cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrid.functions.exprs import clip
from cellgrid.functions.lines import by_merge
from cellgrid.functions.ranking import exact_percentiles
from cellgrid.operators.voxels import KEYS, ZYX
from cellgrid.session import cut_lineage


def spots_threshold(maxima: DataFrame, thresholds: DataFrame, on: list[str]) -> DataFrame:
    """Local maxima strictly above their plane's or gene's threshold (column ``thr``)."""
    return maxima.join(thresholds, on).where("v > thr").drop("thr")


def spot_count_curve(maxima: DataFrame, start: float, step: float, n: int, keys=("gene", "z")) -> DataFrame:
    """Spots above each of n thresholds in one pass: bucket once, then a reverse running sum."""
    keys = list(keys)
    passed = clip(F.ceil(F.round((F.col("v") - start) / step, 9)), 0, n).cast("int")  # thresholds below v
    hist = maxima.groupBy(*keys, (passed - 1).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    filler = hist.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"), F.lit(0).cast("long").alias("c"))
    full = hist.where("k >= 0").unionByName(filler).groupBy(*keys, "k").agg(F.sum("c").alias("c"))
    above = Window.partitionBy(*keys).orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return full.select(*keys, (F.lit(start) + F.col("k") * F.lit(step)).alias("thr"), F.sum("c").over(above).alias("n"))


def spot_count_curve_at(maxima: DataFrame, thresholds: DataFrame, keys, n: int) -> DataFrame:
    """The same for thresholds given per group as (keys, k, thr), equally spaced."""
    keys = list(keys)
    ends = thresholds.groupBy(*keys).agg(F.min("thr").alias("_lo"), F.max("thr").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / (n - 1)
    passed = clip(F.ceil(F.round(F.coalesce(F.try_divide(F.col("v") - F.col("_lo"), step), F.lit(0.0)), 9)), 0, n).cast("int")
    plane = [*keys, "z"]
    hist = (maxima.join(ends, keys).groupBy(*plane, (passed - 1).alias("k")).agg(F.count(F.lit(1)).alias("c")))
    filler = (maxima.select(*plane).distinct().join(thresholds.select(*keys, "k"), keys)
              .withColumn("c", F.lit(0).cast("long")))
    full = hist.where("k >= 0").unionByName(filler).groupBy(*plane, "k").agg(F.sum("c").alias("c"))
    above = Window.partitionBy(*plane).orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    counted = full.select(*plane, "k", F.sum("c").over(above).alias("n"))
    return counted.join(thresholds, [*keys, "k"]).select(*plane, "thr", "n")


def spots_per_cell(spots: DataFrame, masks: DataFrame, cells: DataFrame, genes: list[str]) -> DataFrame:
    """Distinct spot pixels per cell, one column per gene; cells with none get 0.

    ``masks`` is the principal-plane mask table. Counting aggregates map-side, so a very
    large mask costs no more than its rows.
    """
    hits = (spots.select("section", "gene", *ZYX).distinct().join(by_merge(masks), ["section", *ZYX])
            .groupBy("section", "mask_id").pivot("gene", genes).agg(F.count(F.lit(1))))
    listed = cells.select("section", "mask_id")
    return listed.join(hits, ["section", "mask_id"], "left").select(
        "section", "mask_id", *[F.coalesce(F.col(f"`{g}`"), F.lit(0)).alias(g) for g in genes])


def filter_spots_in_mask(spots: DataFrame, masks: DataFrame) -> DataFrame:
    return spots.join(by_merge(masks), ["section", *ZYX], "left_semi")


def spots_per_plane(spots: DataFrame, sections: DataFrame) -> DataFrame:
    planes = sections.select("section", F.explode(F.sequence(F.lit(0), F.col("n_z") - 1)).alias("z"))
    n = spots.groupBy("section", "z").agg(F.count(F.lit(1)).alias("n"))
    return planes.join(n, ["section", "z"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def spot_density(spots: DataFrame, masks: DataFrame) -> DataFrame:
    """Spots per cell and per cell area, plane by plane."""
    area = masks.groupBy("section", "mask_id", "z").agg(F.count(F.lit(1)).alias("area"))
    n = (spots.select("section", *ZYX).distinct().join(by_merge(masks), ["section", *ZYX])
         .groupBy("section", "mask_id", "z").agg(F.count(F.lit(1)).alias("n")))
    out = area.join(n, ["section", "mask_id", "z"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("density", F.try_divide(F.col("n").cast("double"), F.col("area")))


#: side and depth of the boxes whose components one task finds at once
COMPONENT_EDGE, COMPONENT_PLANES = 256, 16


def _connected(z: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Position of the least (y, x) of each voxel's 8-connected component in its plane."""
    order = np.lexsort((x, y, z))
    z, y, x = (a[order].astype(np.int64) for a in (z, y, x))
    wide = int(x.max() - x.min()) + 3  # so that no line runs into the next one
    place = ((z - z.min()) * (int(y.max() - y.min()) + 3) + y - y.min() + 1) * wide + x - x.min() + 1
    spots, first, which = np.unique(place, return_index=True, return_inverse=True)
    pairs = []
    for step in (1, wide - 1, wide, wide + 1):
        at = np.minimum(np.searchsorted(spots, spots + step), len(spots) - 1)
        hit = np.flatnonzero(spots[at] == spots + step)
        pairs.append((hit, at[hit]))
    a, b = (np.concatenate(side) for side in zip(*pairs))
    root = np.arange(len(spots))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    out = np.empty(len(order), np.int64)
    out[order] = order[first[root[which]]]
    return out


def plane_components(bright: DataFrame, keys=KEYS) -> DataFrame:
    """8-connected components of a sparse voxel set in each plane; label = least (y, x) of the component.

    Each task finds those of bounded boxes of voxels. Only labels that touch across a border between boxes are joined
    further, least label first with a pointer jump per round, until nothing changes.
    """
    plane = [*keys, "z"]
    rows = bright.select(*plane, "y", "x", "v").dropna(subset=[*plane, "y", "x"])
    kinds = dict(rows.dtypes)
    box = {"_bz": F.floor(F.col("z") / COMPONENT_PLANES), "_by": F.floor(F.col("y") / COMPONENT_EDGE), "_bx": F.floor(F.col("x") / COMPONENT_EDGE)}

    def label(table: pa.Table) -> pa.Table:
        at = _connected(*(table[a].to_numpy() for a in ZYX))
        return table.select([*plane, "y", "x", "v"]).append_column("_y", table["y"].take(at)).append_column("_x", table["x"].take(at))

    shape = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*plane, "y", "x", "v")), f"_y {kinds['y']}", f"_x {kinds['x']}"])
    found = rows.withColumns(box).groupBy(*keys, *box).applyInArrow(label, shape)
    found = cut_lineage(found.select(*plane, "y", "x", "v", F.struct(F.col("_y").alias("y"), F.col("_x").alias("x")).alias("lab")))
    last = COMPONENT_EDGE - 1
    border = found.where(" or ".join(f"pmod({a}, {COMPONENT_EDGE}) in (0, {last})" for a in "yx")).select(*plane, "y", "x", "lab")
    offs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    beside = border.select(*plane, F.explode(offs).alias("o"), "y", "x", F.col("lab").alias("other")).select(
        *plane, (F.col("y") + F.col("o.a")).alias("y"), (F.col("x") + F.col("o.b")).alias("x"), "other")
    links = cut_lineage(by_merge(border).join(beside, [*plane, "y", "x"]).where("lab <> other").select(*plane, "lab", "other").distinct())
    if links.isEmpty():
        return found
    roots = cut_lineage(links.select(*plane, "lab").distinct().withColumn("root", F.col("lab")))
    while True:
        least = links.join(by_merge(roots.select(*plane, F.col("lab").alias("other"), F.col("root").alias("cand"))), [*plane, "other"]).groupBy(
            *plane, "lab").agg(F.min("cand").alias("cand"))
        jump = roots.select(*plane, F.col("lab").alias("cand"), F.col("root").alias("_far"))
        new = F.least("root", "cand", F.coalesce("_far", "cand"))
        step = roots.join(by_merge(least), [*plane, "lab"]).join(by_merge(jump), [*plane, "cand"], "left")
        nxt = cut_lineage(step.select(*plane, "lab", new.alias("root"), (new != F.col("root")).alias("moved")))
        roots = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return found.join(by_merge(roots), [*plane, "lab"], "left").select(*plane, "y", "x", "v", F.coalesce("root", "lab").alias("lab"))


def dense_spot_split(bright: DataFrame, keys=KEYS) -> DataFrame:
    """Replace each bright region by round(intensity / median region intensity) spots, at least one."""
    plane = [*keys, "z"]
    regions = plane_components(bright, keys).groupBy(*plane, "lab").agg(
        F.sum("v").alias("total"), F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    ref = exact_percentiles(regions, list(keys), F.col("total"), {"ref": 0.5})
    n = F.greatest(F.lit(1), F.rint(F.coalesce(F.try_divide(F.col("total"), F.col("ref")), F.lit(1.0))).cast("int"))
    return (regions.join(ref, list(keys)).withColumn("spot", F.explode(F.sequence(F.lit(1), n)))
            .select(*plane, "cy", "cx", "total", "spot"))


