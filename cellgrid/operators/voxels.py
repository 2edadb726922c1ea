"""Voxel-table operators: planes, channels, filters, resampling.

Sparse tables hold non-zero voxels; ``densify`` adds the zeros and carries the extents
(n_z, n_y, n_x) that the neighbourhood passes need. Work is keyed by section, channel
and image line, all bounded by image geometry.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrid.functions import lines
from cellgrid.functions.exprs import clip, cubic_bspline, finite_or_zero, gaussian_weights, non_negative
from cellgrid.functions.ranking import exact_percentiles
from cellgrid.operators import tiles
from cellgrid.session import cut_lineage

KEYS = ["section", "channel"]
ZYX = ["z", "y", "x"]
EXTENTS = ["n_z", "n_y", "n_x"]


def axis_range(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Few rows that each become very many, dealt to all tasks: Spark would join them into one part for their small size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by_section(rows: DataFrame, keys) -> DataFrame:
    """``rows`` dealt by the first of ``keys``, the section, as voxels are.

    Windows over lines, sums and tiles of images, and joins with another side that is dealt so, then find their rows in
    the task and exchange nothing: voxels are shuffled while they are sparse.
    """
    return dealt(rows, list(keys)[:1])


def grid(volumes: DataFrame) -> DataFrame:
    """Every coordinate of every volume (generated, no join), by sections."""
    keys = [c for c in volumes.columns if c not in EXTENTS]
    rows = by_section(volumes, keys)
    for a in ZYX:
        rows = rows.withColumn(a, axis_range(lines.EXTENT[a]))
    return rows


def densify(voxels: DataFrame, volumes: DataFrame, keys=KEYS) -> DataFrame:
    """Every voxel of every volume, ``v`` 0 where ``voxels`` has none.

    Only the sparse voxels are shuffled, by sections: each of them and one mark per image line, in the order of x, write
    themselves and the zeros up to the next one. A generated grid is never sorted or joined.
    """
    keys = list(keys)
    line = [*keys, *EXTENTS, "_copy", "z", "y"]
    sizes = by_section(volumes.groupBy(*keys, *EXTENTS).agg(F.count(F.lit(1)).alias("_copy")), keys).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_copy").cast("int"))))
    marks = sizes.withColumn("z", axis_range("n_z")).withColumn("y", axis_range("n_y"))
    found = by_section(voxels.select(*keys, *ZYX, "v"), keys).join(lines.by_merge(sizes), keys).where(" and ".join(
        f"{a} >= 0 and {a} < {n} and {a} % 1 = 0" for a, n in zip(ZYX, EXTENTS)))
    found = found.select(*line[:-2], *[F.col(a).cast("int").alias(a) for a in ZYX], "v")
    rows = found.unionByName(marks.withColumns({"x": F.lit(-1), "v": F.lit(None).cast(voxels.schema["v"].dataType)}))
    after = F.lead("x").over(Window.partitionBy(*line).orderBy("x"))
    rows = rows.withColumn("_end", F.coalesce(after, F.col("n_x").cast("int")) - 1)
    # a voxel that another one of the same place follows writes only itself, and a mark nothing at its own place
    span = F.when(F.col("_end") > F.col("x"), F.sequence("x", "_end")).otherwise(F.array("x"))
    full = rows.withColumn("_at", F.explode(span)).where("_at >= 0")
    v = F.coalesce(F.when(F.col("_at") == F.col("x"), F.col("v")), F.lit(0.0)).alias("v")
    return full.select(*keys, "z", "y", F.col("_at").alias("x"), *EXTENTS, v)


# ---- value and coordinate projections -------------------------------------------------

def fix_saturated(voxels: DataFrame, limit: float = 60000) -> DataFrame:
    return voxels.withColumn("v", F.when(F.col("v") > limit, 0.0).otherwise(F.col("v")))


def nan_to_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: finite_or_zero(F.col(c)) for c in cols})


def flip_z(voxels: DataFrame, volumes: DataFrame, keys=("section", "channel")) -> DataFrame:
    depth = volumes.select(*keys, F.col("n_z").alias("_n"))
    return voxels.join(depth, list(keys)).withColumn("z", F.col("_n") - 1 - F.col("z")).drop("_n")


def select_channel(voxels: DataFrame, channel: str) -> DataFrame:
    return voxels.where(F.col("channel") == channel)


def split_channels(voxels: DataFrame, path: str) -> None:
    """One folder per channel; later reads of a channel prune to it."""
    voxels.write.mode("overwrite").partitionBy("channel").parquet(path)


def merge_channels(parts: DataFrame) -> DataFrame:
    """Stack single-channel tables; the channel number comes from ``channel_<n>`` in ``path``."""
    n = F.regexp_extract("path", r"channel_(\d+)", 1)
    return parts.where(n != "").withColumn("channel", n.cast("int")).drop("path")


def crop_roi(voxels: DataFrame, rows=None, cols=None, plane: int | None = None,
             sagittal: int | None = None) -> DataFrame:
    """Half-open row/col box, one plane, or the slice at one x. Range filters prune files."""
    cond = F.lit(True)
    if rows:
        cond &= (F.col("y") >= rows[0]) & (F.col("y") < rows[1])
    if cols:
        cond &= (F.col("x") >= cols[0]) & (F.col("x") < cols[1])
    if plane is not None:
        cond &= F.col("z") == plane
    if sagittal is not None:
        cond &= F.col("x") == sagittal
    return voxels.where(cond)


def middle_plane(n_z: int) -> int:
    return math.ceil(n_z / 2) - 1


def scale_contrast(voxels: DataFrame, keys=KEYS, lo: float = 0.1, hi: float = 99.995) -> DataFrame:
    lim = exact_percentiles(voxels, list(keys), F.col("v"), {"_lo": lo / 100, "_hi": hi / 100}, rule="quick")
    lim = lim.withColumn("_hi", F.when(F.col("_hi") <= F.col("_lo"), F.col("_lo") + 1).otherwise(F.col("_hi")))
    scaled = (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return voxels.join(lim, list(keys)).withColumn("v", clip(scaled, 0.0, 1.0)).drop("_lo", "_hi")


def minmax_normalise_pair(a: DataFrame, b: DataFrame, key: str = "section") -> DataFrame:
    """Both images to 0..1 by their common range; keeps i_min, i_max for the inverse."""
    both = a.withColumn("image", F.lit("moving")).unionByName(b.withColumn("image", F.lit("static")))
    lim = both.groupBy(key).agg(F.min("v").alias("i_min"), F.max("v").alias("i_max"))
    return both.join(lim, key).withColumn(
        "v", F.coalesce(F.try_divide(F.col("v") - F.col("i_min"), F.col("i_max") - F.col("i_min")), F.lit(0.0)))


def minmax_restore(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.col("v") * (F.col("i_max") - F.col("i_min")) + F.col("i_min")).drop("i_min", "i_max")


# ---- planes and channels ----------------------------------------------------------------

def drop_empty_planes(voxels: DataFrame, volumes: DataFrame, max_zero: float = 0.5) -> DataFrame:
    size = volumes.groupBy("section").agg(F.sum(F.col("n_y") * F.col("n_x")).alias("_size"))
    filled = voxels.where("v != 0").groupBy("section", "z").agg(F.count(F.lit(1)).alias("_nz"))
    kept = filled.join(size, "section").where((F.col("_size") - F.col("_nz")) / F.col("_size") <= max_zero)
    order = Window.partitionBy("section").orderBy("z")
    new_z = kept.select("section", "z", (F.row_number().over(order) - 1).alias("_z"))
    return voxels.join(new_z, ["section", "z"]).withColumn("z", F.col("_z")).drop("_z")


def shift_channels(voxels: DataFrame, shifts: DataFrame, volumes: DataFrame) -> DataFrame:
    """Move each channel by (dx, dy); what leaves the image is dropped, what it leaves is 0."""
    moved = voxels.join(shifts, "channel", "left").select(
        "section", "channel", "z", (F.col("y") + F.coalesce("dy", F.lit(0))).alias("y"),
        (F.col("x") + F.coalesce("dx", F.lit(0))).alias("x"), "v")
    size = volumes.select("section", "channel", "n_y", "n_x")
    return (moved.join(size, KEYS).where("y >= 0 and y < n_y and x >= 0 and x < n_x").drop("n_y", "n_x"))


def channels_wide(voxels: DataFrame, channels: list[str], value: str = "v", prefix: str = "") -> DataFrame:
    return voxels.groupBy("section", *ZYX).agg(*[
        F.coalesce(F.max(F.when(F.col("channel") == c, F.col(value))), F.lit(0.0)).alias(prefix + c) for c in channels])


def unmix(voxels: DataFrame, steps: list[tuple], channels: list[str]) -> DataFrame:
    """Apply the enabled rows (src, dst, offset, scale, enabled) in order; zero voxels are omitted."""
    wide = channels_wide(voxels, channels)
    for src, dst, offset, scale, enabled in steps:
        if enabled:
            bleed = non_negative((F.col(src) - offset) * scale)
            wide = wide.withColumn(dst, non_negative(F.col(dst) - bleed))
    long = wide.unpivot(["section", *ZYX], channels, "channel", "v")
    return long.where("v != 0")


# ---- background -------------------------------------------------------------------------

def _mean(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, e: a + e) / F.size(arr)


def _middle(arr: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(arr)
    return (F.element_at(arr, F.floor((n + 1) / 2).cast("int")) + F.element_at(arr, F.floor(n / 2 + 1).cast("int"))) / 2.0


def _let(value: Column, body) -> Column:
    """body(value) with ``value`` evaluated once per row, not once per array element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _clip_round(a: Column, clip_sigma: float) -> Column:
    """Drop array values further than clip_sigma standard deviations from the median."""
    sd = _let(_mean(a), lambda mu: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, e: s + (e - mu) * (e - mu)) / F.size(a)))
    return _let(F.struct(_middle(a).alias("m"), sd.alias("sd")), lambda s: F.filter(
        a, lambda e: F.abs(e - s["m"]) <= clip_sigma * s["sd"] + 1e-12))


def background_boxes(dense: DataFrame, box: int = 50, clip_sigma: float = 3.0, rounds: int = 5, keys=KEYS) -> DataFrame:
    """Clipped box medians after a 3x3 median over neighbouring boxes."""
    cells = dense.groupBy(*keys, "z", F.floor(F.col("y") / box).cast("int").alias("by"),
                          F.floor(F.col("x") / box).cast("int").alias("bx"),
                          F.ceil(F.col("n_y") / box).cast("int").alias("nby"),
                          F.ceil(F.col("n_x") / box).cast("int").alias("nbx")).agg(
        F.sort_array(F.collect_list("v")).alias("a"))  # at most box*box values
    for _ in range(rounds):
        cells = cells.withColumn("a", _clip_round(F.col("a"), clip_sigma))
    boxes = cells.select(*keys, "z", "by", "bx", "nby", "nbx", _middle(F.col("a")).alias("m"))
    near = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    spread = (boxes.withColumn("o", F.explode(near)).withColumn("by", F.col("by") + F.col("o.dy"))
              .withColumn("bx", F.col("bx") + F.col("o.dx"))
              .where("by >= 0 and by < nby and bx >= 0 and bx < nbx"))
    return spread.groupBy(*keys, "z", "by", "bx", "nby", "nbx").agg(F.median("m").alias("m"))


#: pole of the cubic spline's inverse filter; its powers fall below double precision after ``SPLINE_REACH`` boxes
SPLINE_POLE, SPLINE_REACH = math.sqrt(3.0) - 2.0, 30


def spline_coefficients(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, z, by, bx, nby, nbx, m): cubic spline coefficients in place of the values of a grid, mirrored edges.

    The inverse of the spline's (1, 4, 1) / 6 is the pole's powers to both sides; what its forward and backward
    recursions add up is written out as one sum per axis, cut where the powers vanish, so that a grid may be tiled.
    """
    weights = [math.sqrt(3.0) * SPLINE_POLE ** abs(k) for k in range(-SPLINE_REACH, SPLINE_REACH + 1)]
    grid = boxes.select(*keys, "z", F.col("by").alias("y"), F.col("bx").alias("x"), F.col("m").alias("v"),
                        F.lit(1).alias("n_z"), F.col("nby").alias("n_y"), F.col("nbx").alias("n_x"))
    solved = tiles.filter_tiles(grid, keys, (SPLINE_REACH, SPLINE_REACH),
                                lambda stack: {"v": tiles.correlate(tiles.correlate(stack, weights, 2), weights, 1)}, ["v"])
    return solved.select(*keys, "z", F.col("y").alias("by"), F.col("x").alias("bx"), F.col("n_y").alias("nby"), F.col("n_x").alias("nbx"), F.col("v").alias("m"))


def _around(grid: DataFrame, keys: list[str]) -> DataFrame:
    """The 4 x 4 values c[j][i] around each box, one box before and two after on both axes, mirrored; boxes from -1 on."""
    for axis, extent, values in (("bx", "nbx", F.col("m")), ("by", "nby", F.col("c"))):
        w = Window.partitionBy(*keys, "by" if axis == "bx" else "bx").orderBy(axis)
        grid = lines.pad_reflect(grid, axis, 2, extent).withColumn("c", F.array(*[lines.shifted(w, values, -k) for k in (-1, 0, 1, 2)]))
        grid = grid.where((F.col(axis) >= -1) & (F.col(axis) < F.col(extent)))
    return grid


def estimate_background(dense: DataFrame, box: int = 50, clip_sigma: float = 3.0, keys=KEYS) -> DataFrame:
    """Adds column ``bg``: the box background enlarged to voxels by cubic splines, within the range of the plane's boxes.

    Box centres lie at (box - 1) / 2, and so on; beyond the outer centres the grid is mirrored.
    """
    boxes = cut_lineage(background_boxes(dense, box, clip_sigma, keys=keys))  # a box x box part of the voxels, read for its range and for its spline
    limits = by_section(boxes.groupBy(*keys, "z").agg(F.min("m").alias("_lo"), F.max("m").alias("_hi")), keys)
    splines = by_section(spline_coefficients(boxes, list(keys)), keys)
    patches = _around(splines, [*keys, "z"]).select(*keys, "z", "by", "bx", "c").join(lines.by_merge(limits), [*keys, "z"])
    at = {a: (F.col(a) + 0.5) / box - 0.5 for a in "yx"}
    placed = dense.withColumns({f"b{a}": F.floor(e).cast("int") for a, e in at.items()})
    joined = placed.join(lines.by_merge(patches), [*keys, "z", "by", "bx"])
    wy, wx = (cubic_bspline(at[a] - F.col(f"b{a}")) for a in "yx")
    rows = [sum([F.col("c")[j][i] * wx[i] for i in range(1, 4)], F.col("c")[j][0] * wx[0]) for j in range(4)]
    bg = sum([rows[j] * wy[j] for j in range(1, 4)], rows[0] * wy[0])
    return joined.withColumn("bg", clip(bg, F.col("_lo"), F.col("_hi"))).drop("by", "bx", "c", "_lo", "_hi")


def remove_lipofuscin(with_bg: DataFrame, model: list[str], scales: dict[str, float]) -> DataFrame:
    """Subtract the autofluorescence share common to the model channels from the target channels."""
    names = sorted(set(model) | set(scales))
    agg = [F.max(F.when(F.col("channel") == c, F.col(k))).alias(f"{k}_{c}") for c in names for k in ("v", "bg")]
    wide = with_bg.groupBy("section", *ZYX).agg(*agg)
    ratios = [F.try_divide(F.col(f"v_{c}") - F.col(f"bg_{c}"), F.col(f"bg_{c}")) for c in model]
    rel = F.least(*ratios) if len(ratios) > 1 else ratios[0]
    wide = wide.withColumn("rel", non_negative(finite_or_zero(rel)))
    cleaned = [F.struct(F.lit(c).alias("channel"), non_negative(
        F.col(f"v_{c}") - F.col("rel") * F.col(f"bg_{c}") * F.lit(s)).alias("v")) for c, s in scales.items()]
    return wide.select("section", *ZYX, F.explode(F.array(*cleaned)).alias("c")).select("section", *ZYX, "c.*")


def delta_f_over_f(with_bg: DataFrame, masks: DataFrame) -> DataFrame:
    cells = with_bg.join(lines.by_merge(masks), ["section", *ZYX]).groupBy("section", "mask_id", "channel").agg(
        F.avg(F.col("v") - F.col("bg")).alias("_d"), F.avg("bg").alias("_b"))
    return cells.select("section", "mask_id", "channel",
                        F.try_divide(non_negative(F.col("_d")), F.col("_b")).alias("dff"))


# ---- contrast, rolling ball, smoothing ----------------------------------------------------

def box_statistics(dense: DataFrame, rx: int, ry: int, keys=KEYS, carried=()) -> DataFrame:
    """Adds _mean and _sd of the (2 ry + 1) x (2 rx + 1) box around each voxel of a plane, mirror edge; ``carried`` has one value per image."""
    def moments(stack):
        mean, sd = tiles.box_moments(stack, ry, rx)
        return {"_mean": mean, "_sd": sd}

    return tiles.filter_tiles(dense, list(keys), (ry, rx), moments, ["_mean", "_sd"], carried=carried)


def with_range(dense: DataFrame, stats: DataFrame, keys) -> DataFrame:
    """``dense`` with the statistics of its image, joined where its voxels are."""
    return dense.join(lines.by_merge(stats), list(keys))


def local_contrast(dense: DataFrame, rx: int, ry: int, factor: float = 3.0, center: bool = True,
                   stretch: bool = True, keys=KEYS) -> DataFrame:
    """Box mean/std contrast normalisation per plane; division by a zero std gives NULL."""
    whole = dense.groupBy(*keys).agg(F.min("v").alias("_min"), F.max("v").alias("_max"), F.avg("v").alias("_avg"))
    boxes = box_statistics(with_range(dense, whole, keys), rx, ry, keys, ["_min", "_max", "_avg"])
    v, mean, ptp = F.col("v"), F.col("_mean"), F.col("_max") - F.col("_min")
    d = factor * F.col("_sd")
    if center and stretch:
        out = F.try_divide(v - (mean - d), 2 * d) * ptp + F.col("_min")
    elif center:
        out = v - mean + F.col("_avg")
    elif stretch:
        out = F.try_divide(v - mean, 2 * d) * ptp + mean
    else:
        out = v
    return boxes.withColumn("v", out).drop("_mean", "_sd", "_min", "_max", "_avg")


def shrink_factor(radius: int) -> int:
    """fixed values: 1 up to radius 10, 2 up to 30, 4 up to 100, else 8"""
    return 1 if radius <= 10 else 2 if radius <= 30 else 4 if radius <= 100 else 8


def disk_minimum(img: DataFrame, radius: int, keys=KEYS) -> DataFrame:
    """Minimum over a disk; voxels outside the image do not count."""
    return tiles.filter_tiles(img, list(keys), (radius, radius), lambda stack: {"v": tiles.disk_min(stack, radius)}, ["v"], mode="constant")


def rolling_ball_background(dense: DataFrame, radius: int, scale_radius: bool = False, keys=KEYS) -> DataFrame:
    """Adds ``ball``: block-minimum shrink, disk minimum, bilinear enlargement.

    The footprint keeps the unshrunk radius unless ``scale_radius``; at the borders the
    lower interpolation index is clamped to the first block.
    """
    s = shrink_factor(radius)
    r = max(1, radius // s) if scale_radius else radius
    if s == 1:
        ball = lambda stack: {"ball": tiles.disk_min(stack, r)}
        return tiles.filter_tiles(dense, list(keys), (r, r), ball, ["ball"], mode="constant")
    reach = s * (r + 2)  # the disk around the two blocks that a voxel is interpolated from
    return tiles.filter_tiles(dense, list(keys), (reach, reach), None, ["ball"], step=s,
                              whole=lambda *tile: {"ball": tiles.ball_background(*tile[:5], s, r)})


def rolling_ball_subtract(dense: DataFrame, radius: int, scale_radius: bool = False, keys=KEYS) -> DataFrame:
    return (rolling_ball_background(dense, radius, scale_radius, keys)
            .withColumn("v", F.col("v") - F.col("ball")).drop("ball"))


def preprocess_registration(dense: DataFrame, wide: int = 400, ball: int = 50, narrow: int = 50, factor: float = 3.0,
                            keys=KEYS) -> DataFrame:
    """Box means taken off, a rolling ball's background taken off, box contrast stretched to the range of the image.

    All steps run on one tile, whose halo is as wide as theirs together: nothing between them is shuffled or written.
    The range is wanted before the voxels, so the first two steps run twice.
    """
    # the constant that centring adds back leaves a rolling ball's difference unchanged, so no statistic is needed before it
    s = shrink_factor(ball)
    reach = ball if s == 1 else s * (ball + 2)

    def flat(margin: int):
        """The image without its means and ball on the tile's core and ``margin`` around it, with the core's place in it."""
        def made(stack, origin, core, stop, extent, hole):
            mean, _ = tiles.box_moments(np.pad(stack, ((0, 0), (wide, wide), (wide, wide)), mode="symmetric"), wide, wide)
            centred = stack - mean
            if hole is not None:
                centred[hole] = 0.0
            first = [max(0, c - margin) for c in core]
            last = [min(n, c + margin) for n, c in zip(extent, stop)]
            inner = tuple(slice(a - o, b - o) for a, b, o in zip(first, last, origin))
            if s == 1:
                low = tiles.disk_min(np.pad(centred, ((0, 0), (ball, ball), (ball, ball)), constant_values=np.inf), ball)[:, *inner]
            else:
                low = tiles.ball_background(centred, origin, first, last, extent, s, ball)
            out = centred[:, *inner] - low
            if hole is not None:
                out[hole[:, *inner]] = 0.0
            return out, tuple(slice(c - a, e - a) for c, e, a in zip(core, stop, first))
        return made

    def without(*tile):
        out, core = flat(0)(*tile)
        return {"v": out[:, *core]}

    def boxed(*tile):
        out, core = flat(narrow)(*tile)
        mean, sd = tiles.box_moments(np.pad(out, ((0, 0), (narrow, narrow), (narrow, narrow)), mode="symmetric"), narrow, narrow)
        return {"v": out[:, *core], "_mean": mean[:, *core], "_sd": sd[:, *core]}

    halo = lambda margin: 2 * (-(-(wide + reach + margin) // s) * s,)
    first = tiles.filter_tiles(dense, list(keys), halo(0), None, ["v"], whole=without, step=s)
    whole = by_section(first.groupBy(*keys).agg(F.min("v").alias("_min"), F.max("v").alias("_max")), keys)
    out = tiles.filter_tiles(with_range(dense, whole, keys), list(keys), halo(narrow), None, ["v", "_mean", "_sd"], whole=boxed, step=s, carried=["_min", "_max"])
    stretched = F.try_divide(F.col("v") - F.col("_mean"), 2 * factor * F.col("_sd")) * (F.col("_max") - F.col("_min")) + F.col("_mean")
    return nan_to_zero(out.withColumn("v", stretched).drop("_mean", "_sd", "_min", "_max"), ["v"])


def gaussian_smooth(dense: DataFrame, sigma: float, axes=("x", "y"), keys=KEYS) -> DataFrame:
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    if "z" in axes:
        dense = lines.weighted_pass(dense, keys, "z", weights, "v")
    reach = {a: r if a in axes else 0 for a in "yx"}

    def smooth(stack):
        for axis, a in ((1, "y"), (2, "x")):
            stack = tiles.correlate(stack, weights, axis) if reach[a] else stack
        return {"v": stack}

    return tiles.filter_tiles(dense, list(keys), (reach["y"], reach["x"]), smooth, ["v"], mode="edge")


def log_kernels(sigma: float) -> tuple[list[float], list[float]]:
    """Gaussian and its second derivative, truncated at 4 sigma."""
    r = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * k * k / sigma ** 2) for k in range(-r, r + 1)]
    g = [w / sum(raw) for w in raw]
    return g, [w * (k * k / sigma ** 4 - 1 / sigma ** 2) for k, w in zip(range(-r, r + 1), g)]


def log_filter(dense: DataFrame, sigma: float, keys=KEYS) -> DataFrame:
    """Negated Laplacian-of-Gaussian per plane, negatives to 0, mirror edge."""
    g, g2 = log_kernels(sigma)
    r = len(g) // 2

    def sharpen(stack):
        bends = tiles.correlate(tiles.correlate(stack, g2, 2), g, 1) + tiles.correlate(tiles.correlate(stack, g, 2), g2, 1)
        return {"v": np.maximum(-bends, 0.0)}

    return tiles.filter_tiles(dense, list(keys), (r, r), sharpen, ["v"])


def local_maxima(dense: DataFrame, dist: int = 1, keys=KEYS) -> DataFrame:
    """Voxels equal to the maximum of their (2*dist+1)^2 neighbourhood in the plane."""
    rows = dense.withColumn("_m", lines.running_extreme(lines.line_window(keys, "x"), "v", dist))
    cols = rows.withColumn("_m", lines.running_extreme(lines.line_window(keys, "y"), "_m", dist))
    return cols.where("v = _m").drop("_m")


# ---- plane statistics ---------------------------------------------------------------------

def threshold_range(dense: DataFrame, n: int = 100, keys=KEYS) -> DataFrame:
    """n equally spaced thresholds between the medians of the plane percentiles 95 and 99.9999."""
    planes = dense.groupBy(*keys, "z").agg(
        F.percentile("v", F.array(F.lit(0.95), F.lit(0.999999))).alias("p"))
    ends = planes.groupBy(*keys).agg(F.median(F.col("p")[0]).alias("lo"), F.median(F.col("p")[1]).alias("hi"))
    return ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        *keys, "k", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (n - 1.0)).alias("thr"))


def quick_percentile(df: DataFrame, keys: list[str], col: str, ps: dict[str, float]) -> DataFrame:
    return exact_percentiles(df, keys, F.col(col), ps, rule="quick")


def histogram_match(dense: DataFrame, ref_z: int = 0, keys=KEYS) -> DataFrame:
    """Map each plane's values so that its CDF follows the reference plane's CDF."""
    plane = Window.partitionBy(*keys, "z")
    counts = dense.groupBy(*keys, "z", "n_z", "v").agg(F.count(F.lit(1)).alias("c"))
    run = plane.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cdf = counts.select(*keys, "z", "n_z", "v", (F.sum("c").over(run) / F.sum("c").over(plane)).alias("q"))
    ref = cdf.where(F.col("z") == ref_z).withColumn("z", axis_range("n_z"))
    points = cdf.select(*keys, "z", "q", F.col("v").alias("src"), F.lit(None).cast("struct<q:double,v:double>").alias("r"))
    marks = ref.select(*keys, "z", "q", F.lit(None).cast("double").alias("src"),
                       F.struct("q", F.col("v").cast("double").alias("v")).alias("r"))
    both = points.unionByName(marks)
    up = plane.orderBy(F.col("q"), F.col("src").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    down = plane.orderBy(F.col("q").desc(), F.col("src").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    joined = both.select(*keys, "z", "q", "src", F.last("r", True).over(up).alias("a"),
                         F.last("r", True).over(down).alias("b")).where("src is not null")
    step = F.try_divide(F.col("q") - F.col("a.q"), F.col("b.q") - F.col("a.q"))
    mapped = joined.select(*keys, "z", F.col("src").alias("v"), F.when(F.col("a").isNull(), F.col("b.v")).when(
        F.col("b").isNull(), F.col("a.v")).otherwise(
        F.col("a.v") + F.coalesce(step, F.lit(0.0)) * (F.col("b.v") - F.col("a.v"))).alias("new_v"))
    return dense.join(mapped, [*keys, "z", "v"]).withColumn("v", F.col("new_v")).drop("new_v")


def focus_metrics(dense: DataFrame, keys=KEYS) -> DataFrame:
    """Per plane: mean squared Sobel magnitude over mean value, and Laplacian variance (mirror edge)."""
    p = lines.pad_reflect(dense, "x", 1)
    p = lines.weighted_pass(p, keys, "x", [-0.5, 0.0, 0.5], "v", "dx", "zero")
    p = lines.weighted_pass(p, keys, "x", [0.25, 0.5, 0.25], "v", "sx", "zero")
    p = lines.inside(lines.weighted_pass(p, keys, "x", [1.0, -2.0, 1.0], "v", "lx", "zero"), "x")
    p = lines.pad_reflect(p, "y", 1)
    p = lines.weighted_pass(p, keys, "y", [0.25, 0.5, 0.25], "dx", "gx", "zero")
    p = lines.weighted_pass(p, keys, "y", [-0.5, 0.0, 0.5], "sx", "gy", "zero")
    p = lines.inside(lines.weighted_pass(p, keys, "y", [1.0, -2.0, 1.0], "v", "ly", "zero"), "y")
    return p.groupBy(*keys, "z").agg(
        F.try_divide(F.avg((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) / 2), F.avg("v")).alias("tenengrad"),
        F.var_pop(F.col("lx") + F.col("ly")).alias("laplace_var"))


def plane_correlation(dense: DataFrame, image: DataFrame, keys=KEYS) -> DataFrame:
    """Pearson r of every plane with a 2-D reference image (y, x, ref)."""
    on = [k for k in keys if k in image.columns] + ["y", "x"]
    return dense.join(image, on).groupBy(*keys, "z").agg(F.corr("v", "ref").alias("r"))


def roi_mean(voxels: DataFrame, rows, cols) -> DataFrame:
    return crop_roi(voxels, rows, cols).groupBy(*KEYS, "z").agg(F.avg("v").alias("mean_v"))


def roi_median(voxels: DataFrame, rows, cols) -> DataFrame:
    return crop_roi(voxels, rows, cols).groupBy(*KEYS, "z").agg(F.median("v").alias("median_v"))


def pixel_lookup(voxels: DataFrame, y: int, x: int) -> DataFrame:
    return voxels.where((F.col("y") == y) & (F.col("x") == x))


# ---- resampling ---------------------------------------------------------------------------

def resize_volume(dense: DataFrame, volumes: DataFrame, size: tuple[int, int, int], method: str = "nearest",
                  keys=KEYS) -> DataFrame:
    """New extents ``size`` = (n_z, n_y, n_x); output i reads input (i+1)/scale - 1, edge replicated."""
    out = by_section(volumes.select(*keys, *EXTENTS), keys)
    for a, m in zip(ZYX, size):
        out = out.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    for a, m in zip(ZYX, size):
        out = out.withColumn(f"s{a}", (F.col(a) + 1.0) * F.col(lines.EXTENT[a]) / float(m) - 1.0)
    out = tiles.resample(out, dense, method, "replicate", ("z", "y", "x"), keys)
    return out.select(*keys, *ZYX, "v")


def warp_by_field(field: DataFrame, dense: DataFrame, method: str = "linear", boundary: str = "replicate",
                  axes=("y", "x"), keys=KEYS) -> DataFrame:
    """``field``: keys, z, y, x and displacements t<axis>; output v(p) = source(p + t(p))."""
    extents = dense.groupBy(*keys).agg(*[F.max(lines.EXTENT[a]).alias(lines.EXTENT[a]) for a in ZYX])  # one row per image
    coords = lines.by_merge(field).join(extents, [k for k in keys if k in field.columns])
    for a in ZYX:
        coords = lines.inside(coords, a)
    for a in axes:
        coords = coords.withColumn(f"s{a}", F.col(a) + F.col(f"t{a}"))
    return tiles.resample(coords, dense, method, boundary, axes, keys).select(*keys, *ZYX, "v")
