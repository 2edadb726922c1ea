"""Affine and B-spline geometry on point and voxel tables, atlas lookups, profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrid.functions import lines
from cellgrid.functions.exprs import EPS, cubic_bspline, cubic_bspline_slope
from cellgrid.operators import tiles
from cellgrid.operators import voxels as vx
from cellgrid.operators.voxels import ZYX
from cellgrid.session import cut_lineage

KEY = ["section"]
AX3, AX2 = ("x", "y", "z"), ("x", "y")


# ---- affine ---------------------------------------------------------------------------------

def _cofactors(m: dict, axes) -> tuple[dict, Column]:
    """Adjugate entries and determinant of a 2x2 or 3x3 matrix of columns ``m[r, c]``."""
    a = list(axes)
    if len(a) == 2:
        p, q = a
        adj = {(p, p): m[q, q], (p, q): -m[p, q], (q, p): -m[q, p], (q, q): m[p, p]}
        return adj, m[p, p] * m[q, q] - m[p, q] * m[q, p]
    adj = {}
    for i in range(3):
        for j in range(3):
            r1, r2, c1, c2 = a[(j + 1) % 3], a[(j + 2) % 3], a[(i + 1) % 3], a[(i + 2) % 3]
            adj[a[i], a[j]] = m[r1, c1] * m[r2, c2] - m[r1, c2] * m[r2, c1]
    det = m[a[0], a[0]] * adj[a[0], a[0]] + m[a[0], a[1]] * adj[a[1], a[0]] + m[a[0], a[2]] * adj[a[2], a[0]]
    return adj, det


def snap(c: Column) -> Column:
    return F.when(F.abs(c) < 1e-9, 0.0).when(F.abs(c - 1) < 1e-9, 1.0).otherwise(c)


def affine_fit(fiducials: DataFrame, axes=AX3, keys=KEY) -> DataFrame:
    """Least-squares affine mov -> fix per section: columns <out><in> and <out>t.

    One aggregate of covariances (mergeable, numerically centred); the small normal
    equations are solved with column expressions. Sections with under 3 points are dropped.
    """
    m = fiducials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(f"{s}{a}").alias(f"_{s}{a}") for s in "mf" for a in axes],
        *[F.covar_pop(f"m{a}", f"m{b}").alias(f"_c{a}{b}") for a in axes for b in axes],
        *[F.covar_pop(f"m{a}", f"f{b}").alias(f"_k{a}{b}") for a in axes for b in axes]).where("_n >= 3")
    adj, det = _cofactors({(a, b): F.col(f"_c{a}{b}") for a in axes for b in axes}, axes)
    size = F.lit(1.0)
    for a in axes:
        size = size * F.col(f"_c{a}{a}")
    det = F.when(det > size * 1e-9, det)  # collinear or coplanar points have no unique fit: NULL
    m = m.withColumns({"_det": det, **{f"_a{a}{b}": adj[a, b] for a in axes for b in axes}})
    coef = {f"{o}{i}": F.try_divide(sum([F.col(f"_a{i}{j}") * F.col(f"_k{j}{o}") for j in axes], F.lit(0.0)), F.col("_det"))
            for o in axes for i in axes}
    m = m.withColumns(coef)
    shift = {f"{o}t": F.col(f"_f{o}") - sum([F.col(f"{o}{i}") * F.col(f"_m{i}") for i in axes], F.lit(0.0)) for o in axes}
    m = m.withColumns(shift)
    return m.select(*keys, *[snap(F.col(c)).alias(c) for c in [*coef, *shift]])


def affine_apply(points: DataFrame, affine: DataFrame, inverse: bool = False, axes=AX3, keys=KEY) -> DataFrame:
    """Adds q<axis> = A p + t (or the back-mapping). The coefficient table has one row per section."""
    j = points.join(affine, list(keys))
    p = {a: F.col(a) for a in axes}
    m = {(o, i): F.col(f"{o}{i}") for o in axes for i in axes}
    if inverse:
        adj, det = _cofactors(m, axes)
        out = {o: F.try_divide(sum([adj[o, i] * (p[i] - F.col(f"{i}t")) for i in axes], F.lit(0.0)), det) for o in axes}
    else:
        out = {o: sum([m[o, i] * p[i] for i in axes], F.col(f"{o}t")) for o in axes}
    drop = [c for c in affine.columns if c not in keys]
    return j.withColumns({f"q{o}": e for o, e in out.items()}).drop(*drop)


def compose_2d(translate=(0.0, 0.0), scale=(1.0, 1.0), rotate: float = 0.0, shear=(0.0, 0.0)) -> list[list[float]]:
    """translate * resize * rotate (clockwise radians) * shear as a 3x3 matrix."""
    c, s = math.cos(rotate), math.sin(rotate)
    parts = [[[1, 0, translate[0]], [0, 1, translate[1]], [0, 0, 1]], [[scale[0], 0, 0], [0, scale[1], 0], [0, 0, 1]],
             [[c, s, 0], [-s, c, 0], [0, 0, 1]], [[1, shear[0], 0], [shear[1], 1, 0], [0, 0, 1]]]
    out = parts[0]
    for q in parts[1:]:
        out = [[sum(out[i][k] * q[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    return out


def _centred(axes, affine_cols: bool = True, size: str = "n_") -> dict[str, Column]:
    """mean + M (p - mean) with the image centre n/2."""
    half = {a: F.col(f"{size}{a}") / 2.0 for a in axes}
    return {o: half[o] + sum([F.col(f"{o}{i}") * (F.col(i) - half[i]) for i in axes], F.col(f"{o}t")) for o in axes}


#: fixed values: mode number -> interpolation and edge rule
WARP_MODES = {0: ("linear", "replicate"), 1: ("linear", "zero"), 2: ("cubic", "replicate"),
              3: ("cubic", "zero"), 4: ("nearest", "replicate"), 5: ("nearest", "zero")}


def affine_warp_voxels(dense: DataFrame, affine: DataFrame, mode: int = 0, axes=AX2, keys=vx.KEYS) -> DataFrame:
    """Inverse-map resampling about the image centres."""
    on = [k for k in keys if k in affine.columns]
    placed = dense.drop("v").join(lines.by_merge(vx.by_section(affine, on)) if on else affine, on)
    placed = placed.withColumns({f"s{o}": e for o, e in _centred(axes).items()}).drop(
        *[c for c in affine.columns if c not in on])
    method, edge = WARP_MODES[mode]
    return tiles.resample(placed, dense, method, edge, tuple(reversed(axes)), keys).select(*keys, *ZYX, "v")


def affine_point_error(fiducials: DataFrame, affine: DataFrame, sizes: DataFrame, axes=AX3, keys=KEY) -> DataFrame:
    """Strength-weighted squared landmark distance over the squared image diagonal."""
    j = fiducials.join(affine, list(keys)).join(sizes, list(keys))
    j = j.withColumns({a: F.col(f"m{a}") for a in axes})
    moved = _centred(axes)
    d = sum([(moved[a] - F.col(f"f{a}")) * (moved[a] - F.col(f"f{a}")) for a in axes], F.lit(0.0))
    diag = sum([F.col(f"n_{a}") * F.col(f"n_{a}") for a in axes], F.lit(0.0))
    return j.groupBy(*keys).agg(F.sum(d / diag * F.col("strength")).alias("err"))


def field_point_error(fiducials: DataFrame, field: DataFrame, sizes: DataFrame, axes=AX3, keys=KEY) -> DataFrame:
    """The same under a displacement field read at the rounded point; points outside it drop out."""
    at = fiducials.withColumns({a: F.round(F.col(f"m{a}")).cast("int") for a in AX3})
    j = at.join(lines.by_merge(field.select(*keys, *ZYX, *[f"t{a}" for a in axes])), [*keys, *ZYX]).join(sizes, list(keys))
    d = sum([(F.col(a) + F.col(f"t{a}") - F.col(f"f{a}")) * (F.col(a) + F.col(f"t{a}") - F.col(f"f{a}")) for a in axes], F.lit(0.0))
    diag = sum([F.col(f"n_{a}") * F.col(f"n_{a}") for a in axes], F.lit(0.0))
    return j.groupBy(*keys).agg(F.sum(d / diag * F.col("strength")).alias("err"))


# ---- B-spline grids ---------------------------------------------------------------------------

def _gsize(n: Column, spacing: float) -> Column:
    """Knots from -spacing to n + 2*spacing."""
    return F.floor((n + 3 * spacing) / spacing).cast("int") + 1


def bspline_init_grid(sizes: DataFrame, spacing: dict[str, float], affine: DataFrame | None = None, keys=KEY) -> DataFrame:
    """Uniform control points g<axis> (index) and o<axis> (position), optionally moved by an affine."""
    g = sizes
    for a, s in spacing.items():
        g = g.withColumn(f"g{a}", F.explode(F.sequence(F.lit(0), _gsize(F.col(f"n_{a}"), s) - 1)))
    g = g.withColumns({f"o{a}": (F.col(f"g{a}") - 1) * float(s) for a, s in spacing.items()})
    if affine is not None:
        g = g.join(affine, list(keys)).withColumns({a: F.col(f"o{a}") for a in spacing})
        g = g.withColumns({f"o{a}": e for a, e in _centred(list(spacing)).items()})
    return g.select(*keys, *[f"g{a}" for a in spacing], *[f"o{a}" for a in spacing])


def bspline_grid_fit(grid: DataFrame, points: DataFrame, spacing: dict[str, float], sizes: DataFrame, keys=KEY) -> DataFrame:
    """Scattered-data fit: each point votes on its 4^d knots, sums meet per knot (map-side combined).

    ``points``: keys, p<axis>, d<axis>. Returns the grid plus the fitted update.
    """
    axes = list(spacing)
    p = points.join(sizes, list(keys))
    for a, s in spacing.items():
        p = p.withColumn(f"_i{a}", F.floor(F.col(f"p{a}") / s).cast("int"))
        w = cubic_bspline(F.col(f"p{a}") / s - F.col(f"_i{a}"))
        p = p.withColumn(f"_w{a}", F.array(*w))
        p = p.withColumn(f"_q{a}", F.aggregate(f"_w{a}", F.lit(0.0), lambda t, e: t + e * e))
    for a, s in spacing.items():
        last = _gsize(F.col(f"n_{a}"), s) - 1
        p = p.select("*", F.posexplode(f"_w{a}").alias("_k", f"_v{a}")).withColumn(
            f"g{a}", F.least(F.greatest(F.col(f"_i{a}") + F.col("_k"), F.lit(0)), last)).drop("_k")
    weight, total = F.lit(1.0), F.lit(1.0)
    for a in axes:
        weight, total = weight * F.col(f"_v{a}"), total * F.col(f"_q{a}")
    knots = [f"g{a}" for a in axes]
    p = p.withColumn("_w", weight).withColumn("_s", total)
    w3 = F.col("_w") * F.col("_w") * F.col("_w") / F.col("_s")
    sums = p.groupBy(*keys, *knots).agg(F.sum(F.col("_w") * F.col("_w")).alias("_den"),
                                        *[F.sum(w3 * F.col(f"d{a}")).alias(f"_n{a}") for a in axes])
    upd = sums.select(*keys, *knots, *[(F.col(f"_n{a}") / (F.col("_den") + EPS)).alias(f"_u{a}") for a in axes])
    return grid.join(upd, [*keys, *knots], "left").select(*keys, *knots, *[
        (F.col(f"o{a}") + F.coalesce(f"_u{a}", F.lit(0.0))).alias(f"o{a}") for a in axes])


def knot_patches(grid: DataFrame, axes, keys=KEY) -> DataFrame:
    """Per grid cell the list of its 4^d knots as (slot, o...); knots off the grid are absent (count as 0)."""
    cells = grid
    for a in axes:
        cells = cells.withColumn(f"_r{a}", F.explode(F.sequence(F.lit(0), F.lit(3))))
        cells = cells.withColumn(f"i{a}", F.col(f"g{a}") - F.col(f"_r{a}"))
    slot = F.lit(0)
    for a in axes:
        slot = slot * 4 + F.col(f"_r{a}")
    return cells.groupBy(*keys, *[f"i{a}" for a in axes]).agg(F.sort_array(F.collect_list(F.struct(
        slot.alias("slot"), *[f"o{a}" for a in axes]))).alias("knots"))


def _slot_weights(spacing: dict[str, float], slope_axis: str | None = None) -> Column:
    """Array of 4^d products of basis weights for columns p<axis>."""
    combos = [F.lit(1.0)]
    for a, s in spacing.items():
        t = F.col(f"p{a}") / s - F.floor(F.col(f"p{a}") / s)
        w = [x / s for x in cubic_bspline_slope(t)] if a == slope_axis else cubic_bspline(t)
        combos = [c * x for c in combos for x in w]
    return F.array(*combos)


def bspline_eval_points(grid: DataFrame, points: DataFrame, spacing: dict[str, float], slopes: bool = False, keys=KEY) -> DataFrame:
    """Adds T<axis> (and slopes D<axis><wrt>) at p<axis>: one equi-join with the cell's knot list."""
    axes = list(spacing)
    cells = points.withColumns({f"i{a}": F.floor(F.col(f"p{a}") / s).cast("int") for a, s in spacing.items()})
    patches = lines.by_merge(vx.by_section(knot_patches(grid, axes, keys), keys))
    j = cells.join(patches, [*keys, *[f"i{a}" for a in axes]], "left")
    outs = {f"T{a}": (_slot_weights(spacing), a) for a in axes}
    if slopes:
        outs.update({f"D{a}{b}": (_slot_weights(spacing, b), a) for b in axes for a in axes})

    def dot(weights: Column, a: str) -> Column:
        # the weights are an argument, made once per point: in a column of their own Spark would make them once per knot
        total = lambda w: F.aggregate("knots", F.lit(0.0), lambda t, k: t + k[f"o{a}"] * F.element_at(w, k["slot"] + 1))
        return F.coalesce(F.element_at(F.transform(F.array(weights), total), 1), F.lit(0.0))

    return j.withColumns({n: dot(w, a) for n, (w, a) in outs.items()}).drop("knots", *[f"i{a}" for a in axes])


def bspline_refine_grid(grid: DataFrame, spacing: dict[str, float], sizes: DataFrame, keys=KEY) -> DataFrame:
    """Knot doubling per axis: midpoints (P0+P1)/2 and vertices (P0+6*P1+P2)/8, cropped to the new size."""
    axes = list(spacing)
    out = grid
    for a in axes:
        w = Window.partitionBy(*keys, *[f"g{b}" for b in axes if b != a]).orderBy(f"g{a}")
        nxt = {b: (F.lead(f"o{b}", 1).over(w), F.lead(f"o{b}", 2).over(w)) for b in axes}
        cols = [(F.col(f"g{a}") * 2).alias("_even")]
        cols += [((F.col(f"o{b}") + nxt[b][0]) / 2).alias(f"_e{b}") for b in axes]
        cols += [((F.col(f"o{b}") + 6 * nxt[b][0] + nxt[b][1]) / 8).alias(f"_v{b}") for b in axes]
        rows = out.select("*", *cols)
        pair = F.array(F.struct(F.col("_even").alias("g"), *[F.col(f"_e{b}").alias(f"o{b}") for b in axes]),
                       F.struct((F.col("_even") + 1).alias("g"), *[F.col(f"_v{b}").alias(f"o{b}") for b in axes]))
        out = rows.select(*keys, *[f"g{b}" for b in axes if b != a], F.explode(pair).alias("_p")).select(
            *keys, *[f"g{b}" for b in axes if b != a], F.col("_p.g").alias(f"g{a}"), *[F.col(f"_p.o{b}").alias(f"o{b}") for b in axes])
        out = out.where(f"o{a} is not null")
    j = out.join(sizes, list(keys))
    for a, s in spacing.items():
        j = j.where(F.col(f"g{a}") < _gsize(F.col(f"n_{a}"), s / 2))
    return j.select(*keys, *[f"g{a}" for a in axes], *[f"o{a}" for a in axes])


def start_spacing(size: tuple[int, ...]) -> int:
    return 2 ** min(int(math.floor(math.log2(n / 2))) for n in size)


def point_registration(pairs: DataFrame, size: dict[str, int], max_ref: int = 5, keys=KEY):
    """Multi-level fit of a grid that carries m<axis> to f<axis>.

    Returns (grid, spacing, registered points, history of mean distances). Each level is a
    Spark job whose result is checkpointed; the driver holds only the level counter.
    """
    axes = list(size)
    pairs = cut_lineage(pairs)
    sections = pairs.select(*keys).distinct().withColumns({f"n_{a}": F.lit(n) for a, n in size.items()})
    sections = cut_lineage(sections)
    spacing = {a: float(start_spacing(tuple(size.values()))) for a in axes}
    ref = bspline_init_grid(sections, spacing, keys=keys)
    add = ref.withColumns({f"o{a}": F.lit(0.0) for a in axes})
    knots = [*keys, *[f"g{a}" for a in axes]]
    pts = pairs.withColumns({**{f"p{a}": F.col(f"m{a}").cast("double") for a in axes},
                             **{f"d{a}": F.col(f"f{a}") - F.col(f"m{a}") for a in axes}})
    history = []
    for level in range(1, max_ref + 1):
        add = cut_lineage(bspline_grid_fit(add, pts, spacing, sections, keys))
        total = ref.join(add.withColumnsRenamed({f"o{a}": f"_a{a}" for a in axes}), knots).select(
            *knots, *[(F.col(f"o{a}") + F.col(f"_a{a}")).alias(f"o{a}") for a in axes])
        reg = bspline_eval_points(total, pts.drop(*[f"T{a}" for a in axes]), spacing, keys=keys)
        reg = cut_lineage(reg.withColumns({f"d{a}": F.col(f"f{a}") - F.col(f"T{a}") for a in axes}))
        d2 = sum([F.col(f"d{a}") * F.col(f"d{a}") for a in axes], F.lit(0.0))
        history.append(reg.groupBy(*keys).agg(F.lit(level).alias("level"), F.avg(F.sqrt(d2)).alias("mean_distance")))
        pts = reg
        if level < max_ref:
            add = bspline_refine_grid(add, spacing, sections, keys)
            ref = cut_lineage(bspline_refine_grid(ref, spacing, sections, keys))
            spacing = {a: s / 2 for a, s in spacing.items()}
    hist = history[0]
    for h in history[1:]:
        hist = hist.unionByName(h)
    return total, spacing, pts, hist


def bspline_invert(grid: DataFrame, spacing: dict[str, float], size: dict[str, int], max_ref: int = 5, keys=KEY):
    """Sample the grid at spacing/8 inside the image and refit on the swapped pairs."""
    axes = list(spacing)
    pts = grid.select(*keys).distinct()
    for a, s in spacing.items():
        step = s / 8
        last = int(math.floor((size[a] + 3 * step) / step))
        pts = pts.withColumn(f"_k{a}", F.explode(F.sequence(F.lit(0), F.lit(last))))
        pts = pts.withColumn(f"p{a}", (F.col(f"_k{a}") - 1) * float(step)).where(
            (F.col(f"p{a}") >= 1) & (F.col(f"p{a}") <= size[a]))
    moved = bspline_eval_points(grid, pts, spacing, keys=keys)
    pairs = moved.select(*keys, *[F.col(f"T{a}").alias(f"m{a}") for a in axes], *[F.col(f"p{a}").alias(f"f{a}") for a in axes])
    return point_registration(pairs, size, max_ref, keys)


def bspline_warp_voxels(dense: DataFrame, grid: DataFrame, spacing: dict[str, float], mode: int = 0, keys=vx.KEYS) -> DataFrame:
    """Resample each plane or volume through the grid; keeps the displacement t<axis>."""
    axes = list(spacing)
    gkeys = [k for k in keys if k in grid.columns]
    # the spline is costly and the same for all channels, and for all planes where it has no z: it is written once per place
    places = dense.select(*gkeys, *axes).distinct().withColumns({f"p{a}": F.col(a).cast("double") for a in axes})
    moved = cut_lineage(bspline_eval_points(grid, places, spacing, keys=gkeys).select(*gkeys, *axes, *[f"T{a}" for a in axes]))
    on = [*gkeys, *axes]
    at = dense.select(*keys, *ZYX, *[f"n_{a}" for a in axes]).join(lines.by_merge(vx.by_section(moved, on)), on)
    at = at.select(*keys, *ZYX, *[f"n_{a}" for a in axes], *[F.col(f"T{a}").alias(f"s{a}") for a in axes],
                   *[(F.col(f"T{a}") - F.col(a)).alias(f"t{a}") for a in axes])
    method, edge = WARP_MODES[mode]
    out = tiles.resample(at, dense, method, edge, tuple(reversed(axes)), keys)
    return out.select(*keys, *ZYX, "v", *[f"t{a}" for a in axes])


def jacobian_det(grid: DataFrame, sizes: DataFrame, spacing: dict[str, float], keys=KEY) -> DataFrame:
    """Determinant of the grid transform at every voxel of the plane or volume."""
    axes = list(spacing)
    at = sizes
    for a in axes:
        at = at.withColumn(a, F.explode(F.sequence(F.lit(0), F.col(f"n_{a}").cast("int") - 1)))
    at = at.withColumns({f"p{a}": F.col(a).cast("double") for a in axes})
    d = bspline_eval_points(grid, at, spacing, True, keys)
    _, det = _cofactors({(a, b): F.col(f"D{a}{b}") for a in axes for b in axes}, axes)
    return d.select(*keys, *axes, det.alias("det"))


def folding_error(det: DataFrame, keys=KEY) -> DataFrame:
    d = F.greatest(F.col("det"), F.lit(EPS))
    return det.groupBy(*keys).agg(F.avg(F.abs(F.ln(d) / d)).alias("folding"))


def bending_energy(grid: DataFrame, sizes: DataFrame, axes=AX2, keys=KEY) -> DataFrame:
    """Thin-sheet energy from second differences of the knots, scaled by image diagonal and knot count."""
    j = grid.join(sizes, list(keys))
    diag = F.sqrt(sum([F.col(f"n_{a}") * F.col(f"n_{a}") for a in axes], F.lit(0.0)))
    j = j.withColumns({f"o{a}": F.col(f"o{a}") / diag for a in axes})
    parts = []
    for i, a in enumerate(axes):
        w = Window.partitionBy(*keys, *[f"g{b}" for b in axes if b != a]).orderBy(f"g{a}")
        for o in axes:
            name = f"_{o}{a}{a}"
            j = j.withColumn(name, F.lead(f"o{o}").over(w) - 2 * F.col(f"o{o}") + F.lag(f"o{o}").over(w))
            parts.append((name, 1.0))
        for b in axes[i + 1:]:
            wb = Window.partitionBy(*keys, *[f"g{c}" for c in axes if c != b]).orderBy(f"g{b}")
            for o in axes:
                name = f"_{o}{a}{b}"
                j = j.withColumn("_d", F.lead(f"o{o}").over(w) - F.col(f"o{o}"))
                j = j.withColumn(name, F.lead("_d").over(wb) - F.col("_d")).drop("_d")
                parts.append((name, 2.0))
    sums = sum([F.coalesce(F.sum(F.col(n) * F.col(n)), F.lit(0.0)) * k for n, k in parts], F.lit(0.0))
    return j.groupBy(*keys).agg((sums * F.count(F.lit(1)) * float(len(axes)) / 100.0).alias("energy"))


# ---- atlas and landmarks --------------------------------------------------------------------------

def _rotate(axis: str, degrees: float, p: dict[str, Column]) -> dict[str, Column]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    if axis == "x":
        return {"x": p["x"], "y": c * p["y"] - s * p["z"], "z": s * p["y"] + c * p["z"]}
    if axis == "y":
        return {"x": c * p["x"] + s * p["z"], "y": p["y"], "z": -s * p["x"] + c * p["z"]}
    return {"x": c * p["x"] - s * p["y"], "y": s * p["x"] + c * p["y"], "z": p["z"]}


def atlas_back_transform(points: DataFrame, affine: DataFrame, crop: tuple[float, float, float], pitch: float, yaw: float,
                         keys=KEY) -> DataFrame:
    """Inverse affine, + crop offset, pitch and yaw undone, then the two initial -90 degree turns undone."""
    back = affine_apply(points, affine, True, AX3, keys)
    p = {a: F.col(f"q{a}") + float(o) for a, o in zip(AX3, crop)}
    for axis, deg in (("x", pitch), ("y", yaw), ("y", -90.0), ("z", -90.0)):
        p = _rotate(axis, deg, p)
    return back.withColumns({f"a{a}": e for a, e in p.items()}).drop(*[f"q{a}" for a in AX3])


def tax_to_parc(parc_terms: DataFrame, names: list[str], level: str = "structure") -> DataFrame:
    return parc_terms.where(F.col(level).isin(names)).select(F.col("parcellation_index").alias("parc_id")).distinct()


def locate_points(points: DataFrame, annotation: DataFrame, ontology: DataFrame, keys=KEY) -> DataFrame:
    """Structure name at the rounded point; 'outer space' unless exactly one term matches."""
    terms = ontology.groupBy(F.col("id").alias("parc_id")).agg(F.when(F.count(F.lit(1)) == 1, F.min("name")).alias("place"))
    at = points.withColumns({f"_r{a}": F.round(F.col(a)).cast("int") for a in AX3})
    named = annotation.select(*keys, *[F.col(a).alias(f"_r{a}") for a in AX3], "parc_id").join(terms, "parc_id", "left")
    return (at.join(lines.by_merge(named), [*keys, *[f"_r{a}" for a in AX3]], "left")
            .withColumn("place", F.coalesce("place", F.lit("outer space"))).drop(*[f"_r{a}" for a in AX3], "parc_id"))


def contour_unroll(points: DataFrame, keys, order: str, yval: float = 0.0) -> DataFrame:
    """Straighten each polyline: fx = length so far, fy = constant. One polyline is one drawn contour."""
    w = Window.partitionBy(*keys).orderBy(order)
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    step = points.withColumn("_s", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    return step.withColumn("fx", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "fy", F.lit(float(yval))).drop("_s")


def sigmoid_edge(profile: DataFrame, keys, order: str = "x", value: str = "v") -> DataFrame:
    """1-based index where a line profile first rises above half its step (falling profiles are flipped)."""
    keys = list(keys)
    w, whole = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    p = profile.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(whole))
    fifth = F.ceil(F.col("_n") / 5)
    p = p.withColumn("_a", F.avg(F.when(F.col("_i") <= fifth, F.col(value))).over(whole))
    p = p.withColumn("_b", F.avg(F.when(F.col("_i") > F.col("_n") - fifth, F.col(value))).over(whole))
    flip = F.col("_a") > F.col("_b")
    half = F.round((F.col("_a") + F.col("_b")) / 2, 9)
    high = F.col(value) > half
    return p.groupBy(*keys).agg(F.coalesce(
        F.max(F.when(flip & high, F.col("_i"))), F.min(F.when(~flip & high, F.col("_i")))).alias("mid"),
        F.max(F.abs(F.col("_b") - F.col("_a"))).alias("amp"))


def points_near_plane(points: DataFrame, sections: DataFrame, tol: float = 5.51, keys=KEY) -> DataFrame:
    """(point, frame) pairs with |z - frame| < tol; candidate frames are generated, not joined."""
    j = points.join(sections.select(*keys, "n_z"), list(keys))
    lo = F.greatest(F.ceil(F.col("z") - tol), F.lit(0))
    hi = F.least(F.floor(F.col("z") + tol), F.col("n_z") - 1)
    frames = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    return j.withColumn("frame", F.explode(frames)).where(F.abs(F.col("z") - F.col("frame")) < tol).drop("n_z")


def delete_points(fiducials: DataFrame, selected: DataFrame, keys=("section", "pt_id")) -> DataFrame:
    return fiducials.join(selected, list(keys), "left_anti")


def fiducial_check(fiducials: DataFrame, sizes: DataFrame, keys=KEY) -> DataFrame:
    """Points of sections with at least 3 points, none of them outside the volume."""
    j = fiducials.join(sizes, list(keys))
    out = sum([((F.col(f"{s}{a}") > F.col(f"n_{a}")).cast("int")) for s in "fm" for a in AX3], F.lit(0)) > 0
    good = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.bool_or(out).alias("_bad")).where("_n >= 3 and not _bad")
    return fiducials.join(good.select(*keys), list(keys), "left_semi")


