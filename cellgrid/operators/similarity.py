"""Image similarity and deformation measures: aggregates over two joined voxel tables.

Inputs ``a`` and ``b`` share (section, z, y, x, v, extents); results have one row per
section. Every final aggregate is partial-aggregated, so one huge section is no hot spot.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrid.functions import lines
from cellgrid.functions.exprs import EPS, clip, gaussian_weights
from cellgrid.operators import tiles
from cellgrid.operators import voxels as vx
from cellgrid.operators.voxels import EXTENTS, ZYX
from cellgrid.session import cut_lineage

KEY = ["section"]


def paired(a: DataFrame, b: DataFrame, mask: DataFrame | None = None, keys=KEY) -> DataFrame:
    """v from ``a``, u from ``b``, w = mask weight (1 without a mask)."""
    both = a.join(lines.by_merge(b.select(*keys, *ZYX, F.col("v").alias("u"))), [*keys, *ZYX])
    if mask is None:
        return both.withColumn("w", F.lit(1.0))
    return both.join(lines.by_merge(mask.select(*keys, *ZYX, F.col("weight").alias("w"))), [*keys, *ZYX], "left").withColumn(
        "w", F.coalesce("w", F.lit(0.0)))


def _mean_weighted(df: DataFrame, value: Column, keys=KEY, name: str = "t") -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(value * F.col("w")) / F.sum("w")).alias(name))


def sim_d(a, b, mask=None):
    return _mean_weighted(paired(a, b, mask), F.col("v") - F.col("u"))


def sim_sd(a, b, mask=None):
    d = F.col("v") - F.col("u")
    return _mean_weighted(paired(a, b, mask), d * d)


def sim_ld(a, b, mask=None):
    return _mean_weighted(paired(a, b, mask), F.ln(F.abs(F.col("v") - F.col("u")) + 1))


def _cross_correlations(df: DataFrame, pairs: list[tuple[str, str]], masked: bool, keys=KEY) -> DataFrame:
    """Column r: mean over the pairs of the (weighted) product sum over the whole-image norms."""
    keys = list(keys)
    if not masked:  # equals Pearson r, one pass
        rs = [F.coalesce(F.corr(v, u), F.lit(0.0)) for v, u in pairs]
        return df.groupBy(*keys).agg((sum(rs, F.lit(0.0)) / len(rs)).alias("r"))
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for p in pairs for c in p])
    rs = []
    for v, u in pairs:
        dv, du = F.col(v) - F.col(f"_m_{v}"), F.col(u) - F.col(f"_m_{u}")
        rs.append(F.sum(dv * du * F.col("w")) / (F.sqrt(F.sum(dv * dv)) * F.sqrt(F.sum(du * du)) + EPS))
    return df.join(means, keys).groupBy(*keys).agg((sum(rs, F.lit(0.0)) / len(rs)).alias("r"))


def sim_cc(a, b, mask=None):
    return _cross_correlations(paired(a, b, mask), [("v", "u")], mask is not None).select(*KEY, (1 - F.col("r")).alias("t"))


def sobel(df: DataFrame, cols: list[str], ndim: int, keys=KEY) -> tuple[DataFrame, list[list[str]]]:
    """Adds the Sobel responses of each column (zero outside the image).

    All responses of all columns share one window pass per axis. The 3-D kernel is the
    (1 3 1) x (1 3 1) product with centre 6 instead of 9, hence the -3 corrections.
    """
    diff, smooth = [-1.0, 0.0, 1.0], [1.0, 2.0, 1.0] if ndim == 2 else [1.0, 3.0, 1.0]

    def go(frame, axis, kernel, src, out):
        return lines.weighted_pass(frame, keys, axis, kernel, src, out, "zero")

    for c in cols:
        df = go(go(df, "x", diff, c, f"{c}_d"), "x", smooth, c, f"{c}_s")
    for c in cols:
        df = go(go(df, "y", smooth, f"{c}_d", f"{c}_gx"), "y", diff, f"{c}_s", f"{c}_gy")
        if ndim == 3:
            df = go(go(df, "y", smooth, f"{c}_s", f"{c}_gz"), "y", diff, c, f"{c}_e")
    if ndim == 3:
        for c in cols:
            df = go(go(df, "z", smooth, f"{c}_gx", f"{c}_gx"), "z", smooth, f"{c}_gy", f"{c}_gy")
            df = go(go(df, "z", diff, f"{c}_gz", f"{c}_gz"), "z", diff, c, f"{c}_f")
            df = df.withColumns({f"{c}_gx": F.col(f"{c}_gx") - 3 * F.col(f"{c}_d"),
                                 f"{c}_gy": F.col(f"{c}_gy") - 3 * F.col(f"{c}_e"),
                                 f"{c}_gz": F.col(f"{c}_gz") - 3 * F.col(f"{c}_f")})
    axes = "xy" if ndim == 2 else "xyz"
    return df, [[f"{c}_g{a}" for a in axes] for c in cols]


def sim_gd(a, b, mask=None, ndim: int = 3):
    """Gradient difference; the Sobel filter is linear, so it runs once on v - ratio*u."""
    both = paired(a, b, mask)
    ratio = both.groupBy(*KEY).agg((F.avg("v") / F.avg("u")).alias("_a"))
    d = both.join(ratio, KEY).withColumn("d", F.col("v") - F.col("_a") * F.col("u"))
    d, (names,) = sobel(d, ["d"], ndim)
    scope = KEY if ndim == 3 else [*KEY, "z"]
    var = d.groupBy(*scope).agg(*[F.var_samp(n).alias(f"_v_{n}") for n in names])
    score = sum([F.col(f"_v_{n}") / (F.col(f"_v_{n}") + F.col(n) * F.col(n) + EPS) for n in names], F.lit(0.0))
    return _mean_weighted(d.join(var, scope), score).withColumn("t", 2 - F.col("t"))


def sim_gc(a, b, mask=None, ndim: int = 3):
    """1 - mean gradient cross-correlation; every plane counts in the 2-D form."""
    both = paired(a, b, mask)
    both, (gv, gu) = sobel(both, ["v", "u"], ndim)
    scope = KEY if ndim == 3 else [*KEY, "z"]
    r = _cross_correlations(both, list(zip(gv, gu)), mask is not None, scope)
    return r.groupBy(*KEY).agg((1 - F.avg("r")).alias("t"))


def cube_arrays(df: DataFrame, col: str, r: int, axes, keys=KEY) -> DataFrame:
    """Column ``nb``: the (2r+1)^d neighbour values in row-major order of ``axes``."""
    df = df.withColumn("nb", F.array(F.col(col)))
    for axis in reversed(list(axes)):
        w = lines.line_window(keys, axis)
        df = df.withColumn("nb", F.concat(*[F.coalesce(lines.shifted(w, "nb", -k), F.col("nb")) for k in range(-r, r + 1)]))
    return df


def sim_pi(a, b, mask=None, radius: int = 5, sigma: float = 0.3, ndim: int = 2):
    """Pattern intensity over interior voxels (at least ``radius`` from every filtered edge)."""
    axes = ("y", "x") if ndim == 2 else ("z", "y", "x")
    both = paired(a, b, mask)
    means = both.groupBy(*KEY).agg(F.avg("v").alias("_mv"), F.avg("u").alias("_mu"), F.sum("w").alias("_n"))
    d = both.join(means, KEY).withColumn("d", F.col("v") / (F.col("_mv") + 1e-5) - F.col("u") / (F.col("_mu") + 1e-5))
    d = cube_arrays(d.select(*KEY, *ZYX, *EXTENTS, "w", "d", "_n"), "d", radius, axes)
    span = range(-radius, radius + 1)
    offsets = [(p, q) for p in span for q in span] if ndim == 2 else [(p, q, s) for p in span for q in span for s in span]
    member = [sum(k * k for k in o) <= radius * radius for o in offsets]
    inside = F.array(*[F.lit(m) for m in member])
    s2 = sigma * sigma
    score = F.aggregate(F.zip_with("nb", inside, lambda e, m: F.when(
        m, s2 / (s2 + (F.col("d") - e) * (F.col("d") - e))).otherwise(0.0)), F.lit(0.0), lambda p, q: p + q) / float(sum(member))
    cond = F.lit(True)
    for ax in axes:
        cond &= (F.col(ax) >= radius) & (F.col(ax) < F.col(lines.EXTENT[ax]) - radius)
    return (d.where(cond).withColumn("_s", score).groupBy(*KEY, "_n").agg(F.sum(F.col("_s") * F.col("w")).alias("_t"))
            .select(*KEY, (1 - F.col("_t") / F.col("_n")).alias("t")))


# ---- mutual information -----------------------------------------------------------------------

def joint_histogram(pairs: DataFrame, bins: int = 128, keys=KEY) -> DataFrame:
    """Joint histogram of v, u in 0..1; each sample is split linearly between adjacent bins; sums to 1."""
    def split(c: str) -> tuple[Column, Column, Column]:
        pos = F.col(c) * float(bins)
        low = F.floor(pos)
        return clip(low, 0, bins - 1).cast("int"), clip(low + 1, 0, bins - 1).cast("int"), pos - low

    i0, i1, fi = split("v")
    j0, j1, fj = split("u")
    cells = F.array(*[F.struct(i.alias("i"), j.alias("j"), (wi * wj).alias("p"))
                      for i, wi in ((i0, 1 - fi), (i1, fi)) for j, wj in ((j0, 1 - fj), (j1, fj))])
    raw = pairs.select(*keys, F.explode(cells).alias("c")).groupBy(*keys, F.col("c.i").alias("i"), F.col("c.j").alias("j")).agg(
        F.sum("c.p").alias("p"))
    total = F.sum("p").over(Window.partitionBy(*keys))  # at most bins^2 rows
    return raw.select(*keys, "i", "j", (F.col("p") / total).alias("p"))


def mutual_information(pairs: DataFrame, bins: int = 128, keys=KEY) -> DataFrame:
    """-(H(A)+H(B))/H(A,B) after Gaussian(1) smoothing of the histograms.

    A histogram is held from the first to the last filled bin and as far around as the smoothing reaches: bins beyond
    are zeros and add nothing.
    """
    keys = list(keys)
    w = gaussian_weights(1.0)
    half = len(w) // 2

    def entropy(p: np.ndarray) -> float:
        for axis in range(p.ndim):
            edges = [(half, half) if axis == a else (0, 0) for a in range(p.ndim)]
            p = tiles.correlate(np.pad(p, edges, mode="edge"), w, axis)
        return -float((p * np.log(p + EPS)).sum())

    def score(table: pa.Table) -> pa.Table:
        at = [table[c].to_numpy() for c in "ij"]
        low = [max(0, int(a.min()) - half) for a in at]
        p = np.zeros([min(bins, int(a.max()) + half + 1) - first for a, first in zip(at, low)])  # one histogram at a time
        p[at[0] - low[0], at[1] - low[1]] = table["p"].to_numpy()
        hab = entropy(p)
        t = -(entropy(p.sum(axis=1)) + entropy(p.sum(axis=0))) / (EPS if hab == 0 else hab)
        return pa.Table.from_arrays([*[table[k].slice(0, 1) for k in keys], pa.array([t])], [*keys, "t"])

    # groups without a key or a filled bin have no score
    hist = joint_histogram(pairs, bins, keys).dropna(subset=[*keys, "i", "j", "p"])
    return hist.groupBy(*keys).applyInArrow(score, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in hist.schema if f.name in keys), "t double"]))


def _unit_pairs(a, b, mask):
    """Paired values scaled to 0..1 by the common range of both images, where the mask has weight."""
    def limits(image, low, high):
        return image.groupBy(*KEY).agg(F.min("v").alias(low), F.max("v").alias(high))

    lim = limits(a, "_la", "_ha").join(limits(b, "_lb", "_hb"), list(KEY)).select(
        *KEY, F.least("_la", "_lb").alias("_low"), F.greatest("_ha", "_hb").alias("_high"))
    p = paired(a.select(*KEY, *ZYX, *EXTENTS, "v"), b, mask).where("w <> 0").join(lim, list(KEY))

    def unit(c):
        return F.coalesce(F.try_divide(F.col(c) - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))

    return p.withColumns({"v": unit("v"), "u": unit("u")}).drop("_low", "_high")


def sim_mi(a, b, mask=None, bins: int = 128):
    return mutual_information(_unit_pairs(a, b, mask), bins)


def sim_mip(a, b, mask=None, bins: int = 128, regions: int = 8, ndim: int = 3):
    """Mean of the measure over regions^d blocks; neighbouring blocks share their border voxels."""
    p = _unit_pairs(a, b, mask)
    axes = ("z", "y", "x") if ndim == 3 else ("y", "x")
    for ax in axes:
        n = F.col(lines.EXTENT[ax])
        edge = lambda k: F.round(1 + (n - 1) * k / float(regions)) - 1
        blocks = F.filter(F.sequence(F.lit(0), F.lit(regions - 1)),
                          lambda k: (F.col(ax) >= edge(k)) & (F.col(ax) <= edge(k + 1)))
        p = p.withColumn(f"b{ax}", F.explode(blocks))
    block = [*KEY, *[f"b{ax}" for ax in axes]]
    return mutual_information(p, bins, block).groupBy(*KEY).agg(
        (F.sum("t") / float(regions ** len(axes))).alias("t"))


def modality_check(a, b, bins: int = 60, limit: float = 0.25):
    """'mi' when the value histograms differ by more than ``limit`` in L1, else 'sd'."""
    both = vx.minmax_normalise_pair(a, b)
    bin_ = clip(F.floor(F.col("v") * bins), 0, bins - 1).cast("int")
    h = both.groupBy(*KEY, bin_.alias("bin")).agg(*[
        F.count_if(F.col("image") == i).cast("double").alias(i) for i in ("moving", "static")])
    w = Window.partitionBy(*KEY)  # at most ``bins`` rows
    h = h.withColumn("_m", F.sum("moving").over(w)).withColumn("_s", F.sum("static").over(w))
    l1 = h.groupBy(*KEY).agg(F.sum(F.abs(F.col("moving") / F.col("_m") - F.col("static") / F.col("_s"))).alias("l1"))
    return l1.withColumn("measure", F.when(F.col("l1") > limit, "mi").otherwise("sd"))


# ---- deformation fields ---------------------------------------------------------------------------

def _slope(col: str, axis: str, keys) -> Column:
    w = lines.line_window(keys, axis)
    ahead, behind = F.lead(col).over(w), F.lag(col).over(w)
    return (F.when(ahead.isNull() & behind.isNull(), 0.0).when(behind.isNull(), ahead - F.col(col))
            .when(ahead.isNull(), F.col(col) - behind).otherwise((ahead - behind) / 2))


def strain_tensor(field: DataFrame, axes=("x", "y"), keys=KEY) -> DataFrame:
    """Eulerian strain 0.5*(I - G*G') with G = I - displacement gradient; upper triangle e_<ab>."""
    df = field
    for b in axes:  # one window pass per axis
        df = df.withColumns({f"g{a}{b}": (1.0 if a == b else 0.0) - _slope(f"t{a}", b, keys) for a in axes})
    out = []
    for i, a in enumerate(axes):
        for c in axes[i:]:
            dot = sum([F.col(f"g{a}{b}") * F.col(f"g{c}{b}") for b in axes], F.lit(0.0))
            out.append((0.5 * ((1.0 if a == c else 0.0) - dot)).alias(f"e_{a}{c}"))
    return df.select(*keys, *ZYX, *out)


def forward_field(field: DataFrame, sigma: float = 5 / 6, half: int = 3, keys=KEY) -> DataFrame:
    """Backward to forward displacement: bilinear splat, then a Gaussian, normalised by weight.

    The splat is linear, so 4 targets per voxel are summed first and the 7x7 Gaussian runs
    as two separable passes instead of 196 contributions per voxel.
    """
    px, py = F.col("x") + F.col("tx"), F.col("y") + F.col("ty")
    fx, fy = px - F.floor(px), py - F.floor(py)
    cells = F.array(*[F.struct((F.floor(py) + j).cast("int").alias("y"), (F.floor(px) + i).cast("int").alias("x"), (wy * wx).alias("w"))
                      for j, wy in ((0, 1 - fy), (1, fy)) for i, wx in ((0, 1 - fx), (1, fx))])
    splat = (field.select(*keys, "z", "n_y", "n_x", "tx", "ty", F.explode(cells).alias("c"))
             .where(f"c.y >= -{half} and c.y < n_y + {half} and c.x >= -{half} and c.x < n_x + {half}")
             .groupBy(*keys, "z", F.col("c.y").alias("y"), F.col("c.x").alias("x")).agg(
                 F.sum(-F.col("tx") * F.col("c.w")).alias("sx"), F.sum(-F.col("ty") * F.col("c.w")).alias("sy"),
                 F.sum("c.w").alias("sw")))
    ext = [F.col("n_y"), F.col("n_x")]
    frame = field.select(*keys, "z", *ext).distinct().withColumn(
        "y", F.explode(F.sequence(F.lit(-half), F.col("n_y") + (half - 1)))).withColumn(
        "x", F.explode(F.sequence(F.lit(-half), F.col("n_x") + (half - 1))))
    full = frame.join(lines.by_merge(splat), [*keys, "z", "y", "x"], "left").fillna(0.0, ["sx", "sy", "sw"])
    g = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-half, half + 1)]
    g = [w / sum(g) for w in g]
    for axis in ("x", "y"):
        for c in ("sx", "sy", "sw"):
            full = lines.weighted_pass(full, keys, axis, g, c, edge="zero")
    return full.where("y >= 0 and y < n_y and x >= 0 and x < n_x").select(
        *keys, *ZYX, (F.col("sx") / (F.col("sw") + EPS)).alias("fx"), (F.col("sy") / (F.col("sw") + EPS)).alias("fy"))
