"""Threshold selection from spot-count curves, and per-plane model fits.

A curve is (keys, thr, n); its groups hold as many rows as thresholds or planes, so
windows over one curve are small however large the voxel tables are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrid.functions import lines
from cellgrid.functions.exprs import hash32
from cellgrid.operators import spots as sp, voxels as vx
from cellgrid.session import cut_lineage

#: fixed values: window sizes of the two estimators
FANO_WINDOWS = (3, 5, 7, 9, 11, 13, 15, 17, 19, 21)
SCORE_WINDOWS = (3, 6, 9, 12, 15, 18, 21)


def _ordered(keys, by="thr"):
    return Window.partitionBy(*keys).orderBy(by)


def _whole(keys):
    return Window.partitionBy(*keys)


def _indexed(curve: DataFrame, keys, by="thr") -> DataFrame:
    return (curve.withColumn("i", F.row_number().over(_ordered(keys, by)) - 1)
            .withColumn("cnt", F.count(F.lit(1)).over(_whole(keys))))


def gradient(col: str, w) -> Column:
    """Central difference with unit spacing, one-sided at the ends."""
    ahead, behind = F.lead(col).over(w), F.lag(col).over(w)
    return (F.when(behind.isNull(), ahead - F.col(col)).when(ahead.isNull(), F.col(col) - behind)
            .otherwise((ahead - behind) / 2.0))


def curve_derivative(curve: DataFrame, keys) -> DataFrame:
    """|5-point moving mean of the gradient| with mirrored ends."""
    keys = list(keys)
    g = _indexed(curve, keys).withColumn("_g", gradient("n", _ordered(keys)))
    padded = lines.pad_reflect(g, "i", 2, "cnt")
    mean = F.avg("_g").over(_ordered(keys, "i").rowsBetween(-2, 2))
    out = lines.inside(padded.withColumn("deriv", F.abs(mean)), "i", "cnt")
    return out.select(*keys, "i", "thr", "deriv")


def curve_fano(deriv: DataFrame, keys, windows=FANO_WINDOWS) -> DataFrame:
    """Variance/mean in centred windows of each size; partial windows dropped, all-zero ones give 0."""
    keys = list(keys)
    w = _ordered(keys, "i")
    scored = deriv.withColumn("cnt", F.count(F.lit(1)).over(_whole(keys)))
    cols = []
    for size in windows:
        h = size // 2
        frame = w.rowsBetween(-h, h)
        mean = F.avg("deriv").over(frame)
        fano = F.when(mean == 0, 0.0).otherwise(F.var_pop("deriv").over(frame) / mean)
        ok = (F.col("i") >= h) & (F.col("i") < F.col("cnt") - h)
        cols.append(F.when(ok, fano).alias(f"{size}"))
    wide = scored.select(*keys, "i", "thr", *cols)
    return (wide.unpivot([*keys, "i", "thr"], [f"`{s}`" for s in map(str, windows)], "win", "fano")
            .where("fano is not null").withColumn("win", F.col("win").cast("int")))


def curve_mad_suggestion(fano: DataFrame, keys) -> DataFrame:
    """Mean of the first thresholds at or under median-MAD and median+MAD (first row when none)."""
    keys = list(keys)
    med = fano.withColumn("_med", F.median("fano").over(_whole(keys)))
    mad = med.withColumn("_mad", F.median(F.abs(F.col("fano") - F.col("_med"))).over(_whole(keys)))

    def first(limit: Column) -> Column:
        # compared at 1e-9 so that equal values do not depend on summation order
        return F.coalesce(F.min(F.when(F.round("fano", 9) <= F.round(limit, 9), F.col("thr"))), F.min("thr"))

    return mad.groupBy(*keys).agg(((first(F.col("_med") - F.col("_mad")) + first(F.col("_med") + F.col("_mad"))) / 2)
                                  .alias("mad_sugg"))


def curve_two_piece_fit(curve: DataFrame, keys, x: str = "thr", y: str = "fano") -> DataFrame:
    """Best continuous line of two segments by exact search over the grid of knots.

    The line is b0 + b1 x + b2 max(x - knot, 0); running sums give its squared error at every
    knot. Returns the knot, the right segment's line, and the first crossing of that line
    (not before the knot).
    """
    keys = list(keys)
    base = curve.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    run, whole = _ordered(keys, "x").rowsBetween(Window.unboundedPreceding, 0), _whole(keys)
    sums = {"n": F.lit(1.0), "sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"),
            "sxy": F.col("x") * F.col("y"), "syy": F.col("y") * F.col("y")}
    p = base.select("*", *[F.sum(e).over(run).alias(f"l_{k}") for k, e in sums.items()],
                    *[F.sum(e).over(whole).alias(f"t_{k}") for k, e in sums.items()])
    p = p.select(*keys, "x", "y", *[F.col(f"l_{k}") for k in sums],
                 *[(F.col(f"t_{k}") - F.col(f"l_{k}")).alias(f"r_{k}") for k in sums])

    total = {k: F.col(f"l_{k}") + F.col(f"r_{k}") for k in sums}
    n, c = total["n"], F.col("x")
    h = F.col("r_sx") - c * F.col("r_n")  # sums over max(x - knot, 0)
    hh = F.col("r_sxx") - 2 * c * F.col("r_sx") + c * c * F.col("r_n")
    xx, yy = total["sxx"] - total["sx"] * total["sx"] / n, total["syy"] - total["sy"] * total["sy"] / n
    xy, vh = total["sxy"] - total["sx"] * total["sy"] / n, hh - h * h / n
    xh = F.col("r_sxx") - c * F.col("r_sx") - total["sx"] * h / n
    yh = F.col("r_sxy") - c * F.col("r_sy") - total["sy"] * h / n
    det = xx * vh - xh * xh
    knots = p.where("l_n >= 2 and r_n >= 2").withColumn("_b1", (xy * vh - yh * xh) / det).withColumn("_b2", (yh * xx - xy * xh) / det)
    knots = knots.withColumn("sse", F.round(yy - F.col("_b1") * xy - F.col("_b2") * yh, 6)).withColumn("_slope", F.col("_b1") + F.col("_b2"))
    knots = knots.withColumn("_icept", (total["sy"] - F.col("_b1") * total["sx"] - F.col("_b2") * h) / n - F.col("_b2") * c)
    best = knots.groupBy(*keys).agg(F.min_by(
        F.struct(F.col("x").alias("knot"), F.col("_slope").alias("slope"), F.col("_icept").alias("icept"), "sse"),
        F.struct("sse", "x")).alias("b")).select(*keys, "b.*")
    sign = F.signum(F.round(F.col("y") - (F.col("slope") * F.col("x") + F.col("icept")), 6))
    turns = base.join(best, keys).withColumn("_s", sign)
    turns = turns.withColumn("_turn", F.lead("_s").over(_ordered(keys, "x")) != F.col("_s"))
    return turns.groupBy(*keys, "knot", "slope", "icept", "sse").agg(
        F.greatest(F.col("knot"), F.coalesce(F.min(F.when(F.col("_turn"), F.col("x"))), F.col("knot"))).alias("crossing"))


def suggest_threshold(curve: DataFrame, keys, windows=FANO_WINDOWS) -> DataFrame:
    keys = list(keys)
    by_window = [*keys, "win"]
    fano = curve_fano(curve_derivative(curve, keys), keys, windows)
    both = curve_mad_suggestion(fano, by_window).join(curve_two_piece_fit(fano, by_window), by_window)
    one = (F.col("mad_sugg") + F.col("knot") + F.col("crossing")) / 3.0
    return both.groupBy(*keys).agg(F.avg(one).alias("suggestion")).withColumn("thr", F.rint(F.round("suggestion", 6)))


def threshold_search_range(curve: DataFrame, keys, max_spots: float = 1e5, step: float = 100.0, size: float = 2000.0,
                           n: int = 100) -> DataFrame:
    """Lowest threshold of the walk down from the top of the curve, and the range above it.

    The walk stops at ``max_spots`` spots, below 1, or ``size``/2 under the start; its
    result is read from the curve by conditional maxima.
    """
    keys = list(keys)
    top = curve.withColumn("_x0", F.max("thr").over(_whole(keys)))
    floor = F.greatest(F.lit(1.0), F.col("_x0") - size / 2)
    on_walk = (F.col("thr") < F.col("_x0")) & (F.pmod(F.col("_x0") - F.col("thr"), F.lit(step)) == 0)
    hit = top.groupBy(*keys, "_x0").agg(F.max(F.when(
        on_walk & (F.col("thr") >= floor) & (F.col("n") >= max_spots), F.col("thr"))).alias("_hit"))
    stop = F.col("_x0") - step * (F.floor((F.col("_x0") - floor) / step) + 1)
    low = F.coalesce("_hit", F.when(stop < 1, 1.0).otherwise(F.col("_x0") - size / 2))
    return (hit.withColumn("min_thr", low).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .select(*keys, "min_thr", "k", (F.col("min_thr") + F.lit(size) * F.col("k") / (n - 1.0)).alias("thr")))


# ---- model fits over planes -----------------------------------------------------------------

def robust_line(points: DataFrame, keys, x: str = "z", y: str = "y", seed: int = 0, trials: int = 32) -> DataFrame:
    """Consensus line: seeded half samples, residual limit MAD(y), refit on the best inlier set."""
    keys = list(keys)
    base = points.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    med = base.withColumn("_med", F.median("_y").over(_whole(keys)))
    med = med.withColumn("_lim", F.median(F.abs(F.col("_y") - F.col("_med"))).over(_whole(keys)))
    many = med.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    draw = Window.partitionBy(*keys, "trial").orderBy(hash32(F.col("_x").cast("int"), F.col("trial"), F.lit(seed)), "_x")
    group = _whole([*keys, "trial"])
    picked = many.withColumn("_pick", F.row_number().over(draw) <= F.ceil(F.count(F.lit(1)).over(group) / 2))
    px, py = (F.when(F.col("_pick"), F.col(c)) for c in ("_x", "_y"))
    fitted = picked.withColumn("_slope", F.regr_slope(py, px).over(group)).withColumn(
        "_icept", F.regr_intercept(py, px).over(group))
    resid = F.round(F.abs(F.col("_y") - (F.col("_slope") * F.col("_x") + F.col("_icept"))), 9)
    judged = fitted.withColumn("_in", resid <= F.round("_lim", 9)).withColumn("_r", resid)
    score = judged.groupBy(*keys, "trial").agg(
        F.count_if("_in").alias("inliers"), F.round(F.sum(F.when(F.col("_in"), F.col("_r") * F.col("_r"))), 9).alias("_sse"),
        F.regr_slope(F.when(F.col("_in"), F.col("_y")), F.when(F.col("_in"), F.col("_x"))).alias("slope"),
        F.regr_intercept(F.when(F.col("_in"), F.col("_y")), F.when(F.col("_in"), F.col("_x"))).alias("icept"))
    return score.groupBy(*keys).agg(F.min_by(F.struct("slope", "icept", "inliers"), F.struct(
        -F.col("inliers"), F.col("_sse"), F.col("trial"))).alias("b")).select(*keys, "b.*")


def depth_attenuation(dense: DataFrame, sigma: float | None = None, seed: int = 0, keys=vx.KEYS) -> DataFrame:
    """Undo the exponential loss over depth; rounded half-even. With ``sigma`` the volume is also
    scaled down in 1 % steps (closed form) until its filtered maximum fits 16 bits."""
    keys = list(keys)
    planes = dense.groupBy(*keys, "z").agg(F.median("v").alias("_m"))
    logs = planes.withColumn("y", F.when(F.col("_m") == 0, 0.0).otherwise(F.ln("_m")))
    line = robust_line(logs, keys, seed=seed).select(*keys, (-F.col("slope")).alias("_alpha"))
    fixed = dense.join(line, keys).withColumn("v", F.col("v") * F.exp(F.col("_alpha") * F.col("z"))).drop("_alpha")
    if sigma is not None:
        top = vx.log_filter(fixed, sigma, keys).groupBy(*keys).agg(F.max("v").alias("_top"))
        steps = F.greatest(F.ceil(F.ln(65535.0 / F.col("_top")) / F.ln(F.lit(0.99))), F.lit(0))
        scale = F.when(F.col("_top") > 65535, F.pow(F.lit(0.99), steps)).otherwise(1.0)
        fixed = fixed.join(top, keys).withColumn("v", F.col("v") * scale).drop("_top")
    return fixed.withColumn("v", F.rint(F.round("v", 9)))


def _solve_rows(batches, keys, degree):
    for pdf in batches:
        n = degree + 1
        coef = []
        for powers, moments in zip(pdf["p"], pdf["q"]):
            a = np.array([[powers[i + j] for j in range(n)] for i in range(n)])
            coef.append(np.linalg.lstsq(a, np.asarray(moments), rcond=None)[0].tolist())
        yield pd.concat([pdf[keys], pd.Series(coef, name="coef", index=pdf.index)], axis=1)


def poly_coefficients(points: DataFrame, keys, x: str, y: str, degree: int) -> DataFrame:
    """Least-squares polynomial per group: power sums by Spark, one small solve per group row."""
    keys = list(keys)
    t, v = F.col(x).cast("double"), F.col(y).cast("double")
    sums = points.groupBy(*keys).agg(F.array(*[F.sum(F.pow(t, F.lit(k))) for k in range(2 * degree + 1)]).alias("p"),
                                     F.array(*[F.sum(v * F.pow(t, F.lit(k))) for k in range(degree + 1)]).alias("q"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema if f.name in keys), "coef array<double>"])
    return sums.mapInPandas(lambda it: _solve_rows(it, keys, degree), schema)


def poly_value(x: Column) -> Column:
    """Horner over ``coef`` (ascending powers)."""
    return F.aggregate(F.reverse("coef"), F.lit(0.0), lambda acc, c: acc * x + c)


def poly_fit_purge(points: DataFrame, keys, x: str = "z", y: str = "y", degree: int = 4, tol: float = 0.2) -> DataFrame:
    """Drop points whose relative residual exceeds ``tol`` and refit until none does; returns fitted values.

    Every round but the last drops a point, so the loop ends.
    """
    keys = list(keys)
    scaled = points.withColumn("_t", F.col(x) / F.greatest(F.max(F.abs(F.col(x))).over(_whole(keys)), F.lit(1)))
    kept = cut_lineage(scaled.withColumn("_drop", F.lit(False)))
    while True:
        coef = poly_coefficients(kept.where("not _drop"), keys, "_t", y, degree)
        pred = poly_value(F.col("_t"))
        judged = kept.join(coef, keys).withColumn("fit", pred)
        bad = F.abs(F.col("fit") - F.col(y)) / F.col("fit") > tol
        judged = cut_lineage(judged.withColumn("_new", bad & ~F.col("_drop")).drop("coef"))
        if judged.where("_new").isEmpty():
            break
        kept = judged.withColumn("_drop", F.col("_drop") | F.col("_new")).drop("fit", "_new")
    return judged.select(*points.columns, "fit", F.col("_drop").alias("purged"))


#: fixed values: first rates tried, over the range of x; where a rate is taken as none or as a step
DECAY_START = [10.0 ** (-4 + 7 * k / 42) for k in range(43)]
DECAY_LEAST, DECAY_MOST = 1e-7, 1e6


def _decay_moments(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and rate ``_b``: a and c of the best a * exp(-b x) + c, its squares, and the Gauss-Newton step of ln b.

    a and c are linear, so they are eliminated: what moves with b is the part of a x exp(-b x) that neither the
    exponential nor the constant can take over. All of it follows from one aggregate.
    """
    e = F.exp(-F.col("_b") * F.col("_x"))
    m = points.withColumns({"_e": e, "_u": F.col("_x") * e}).groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_e").alias("_me"), F.avg("_y").alias("_my"), F.var_pop("_e").alias("_ee"), F.var_pop("_y").alias("_yy"),
        F.var_pop("_u").alias("_uu"), F.covar_pop("_y", "_e").alias("_ye"), F.covar_pop("_u", "_e").alias("_ue"), F.covar_pop("_u", "_y").alias("_uy"))
    a = F.try_divide("_ye", "_ee")
    m = m.withColumn("_a", a).withColumn("_c", F.col("_my") - F.col("_a") * F.col("_me"))
    squares = F.greatest(F.col("_yy") - F.col("_a") * F.col("_ye"), F.lit(0.0)) * F.col("_n")
    free = F.col("_uu") - F.try_divide(F.col("_ue") * F.col("_ue"), F.col("_ee"))
    step = -F.try_divide(F.col("_uy") - F.col("_a") * F.col("_ue"), F.col("_a") * free * F.col("_b"))
    return m.select(*keys, "_b", "_a", "_c", squares.alias("_sse"), F.greatest(F.least(step, F.lit(1.0)), F.lit(-1.0)).alias("_step"))


def exp_decay_fit(points: DataFrame, keys, x: str = "z", y: str = "y") -> DataFrame:
    """(keys, a, b, c, sse) of a * exp(-b x) + c by least squares, for any rate b above 0.

    Variable projection: the best of ``DECAY_START`` starts a Gauss-Newton search on ln b, every round one aggregate
    over the points of the curves that still move, a tenth of any step that does not pay, until steps fall below 1e-9.
    A rate that leaves ``DECAY_LEAST``..``DECAY_MOST`` over the range of x (a line, a step) stays there; curves whose x
    or y do not vary have nulls.
    """
    keys = list(keys)
    base = points.select(*keys, F.col(x).cast("double").alias("_x0"), F.col(y).cast("double").alias("_y"))
    low, span = F.min("_x0").over(_whole(keys)), F.max("_x0").over(_whole(keys)) - F.min("_x0").over(_whole(keys))
    base = cut_lineage(base.withColumns({"_low": low, "_span": span}).withColumn("_x", F.col("_x0") - F.col("_low")).drop("_x0"))
    tried = base.withColumn("_b", F.explode(F.array(*[F.lit(s) for s in DECAY_START]))).withColumn("_b", F.try_divide("_b", "_span"))
    start = _decay_moments(tried.where("_b is not null"), keys).where("_sse is not null")
    best = start.groupBy(*keys).agg(F.min_by(F.struct("_a", "_b", "_c", "_sse", "_step"), F.struct("_sse", "_b")).alias("f")).select(*keys, "f.*")
    state = cut_lineage(best.withColumn("_open", F.col("_step").isNotNull()))
    while not (moving := state.where("_open")).isEmpty():
        trial = moving.select(*keys, (F.col("_b") * F.exp("_step")).alias("_try"))
        at = base.join(trial.withColumnRenamed("_try", "_b"), keys)
        edge = (F.max("_span") * F.max("_b")).alias("_turns")
        judged = _decay_moments(at, keys).join(at.groupBy(*keys).agg(edge), keys)
        new = {c: F.col(c).alias(f"_new{c}") for c in ("_a", "_b", "_c", "_sse", "_step")}
        j = state.join(judged.select(*keys, "_turns", *new.values()), keys, "left")
        held = F.coalesce(F.col("_turns").between(DECAY_LEAST, DECAY_MOST), F.lit(False))
        better = held & F.coalesce(F.col("_new_sse") <= F.col("_sse"), F.lit(False))
        step = F.when(better, F.col("_new_step")).otherwise(F.col("_step") / 10)
        state = cut_lineage(j.select(
            *keys, *[F.when(F.col("_open") & better, F.col(f"_new{c}")).otherwise(F.col(c)).alias(c) for c in ("_a", "_b", "_c", "_sse")],
            step.alias("_step"), (F.col("_open") & held & F.coalesce(F.abs(step) >= 1e-9, F.lit(False))).alias("_open")))
    lows = base.groupBy(*keys).agg(F.max("_low").alias("_low"))
    # a belongs to x = 0, the search to the least x
    return lows.join(state, keys, "left").select(*keys, (F.col("_a") * F.exp(F.col("_b") * F.col("_low"))).alias("a"), F.col("_b").alias("b"),
                                                 F.col("_c").alias("c"), F.col("_sse").alias("sse"))


def smooth_thresholds(thr: DataFrame, keys, by: str = "z", col: str = "thr") -> DataFrame:
    return thr.withColumn("smooth", F.avg(col).over(_ordered(list(keys), by).rowsBetween(-1, 1)))


def plane_thresholds(maxima: DataFrame, dense: DataFrame, n: int = 100, keys=vx.KEYS) -> DataFrame:
    """Knee of each plane's spot-count curve, then a 3-plane mean over depth."""
    ranges = vx.threshold_range(dense, n, keys)
    curve = sp.spot_count_curve_at(maxima, ranges, keys, n)
    knees = curve_two_piece_fit(curve, [*keys, "z"], "thr", "n").select(*keys, "z", F.col("knot").alias("thr"))
    return smooth_thresholds(knees, keys)


# ---- knee and curvature ---------------------------------------------------------------------

def curve_knee(curve: DataFrame, keys, x: str = "thr", y: str = "n") -> DataFrame:
    """Concave decreasing knee: largest distance above the falling diagonal of the unit square."""
    keys = list(keys)
    w = _whole(keys)

    def unit(c: str) -> Column:
        return F.coalesce(F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), F.lit(0.0))

    d = curve.withColumn("_d", F.round(unit(x) + unit(y) - 1, 9))
    return d.groupBy(*keys).agg(F.min_by(x, F.struct(-F.col("_d"), F.col(x))).alias("knee"), F.max("_d").alias("height"))


def _rising(values: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the closest non-decreasing sequence."""
    pools: list[list[float]] = []
    for v in values:
        pools.append([v, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            m, k = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][1] + m * k) / (pools[-1][1] + k), pools[-1][1] + k]
    return np.concatenate([np.full(int(k), m) for m, k in pools])


def _local_cubic(y: np.ndarray, width: int) -> np.ndarray:
    """Moving cubic fit evaluated at each point (window clipped at the ends)."""
    n, half = len(y), width // 2
    out = np.empty(n)
    for i in range(n):
        lo = max(0, min(i - half, n - width))
        t = np.arange(lo, min(n, lo + width)) - i
        out[i] = np.polyfit(t, y[lo:lo + len(t)], min(3, len(t) - 1))[-1]
    return out


def curve_curvature(curve: DataFrame, keys, width: int = 35) -> DataFrame:
    """Curvature of the monotone, smoothed derivative. One group is one curve (its thresholds)."""
    keys = list(keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("thr").reset_index(drop=True)
        if len(pdf) < 5:
            return pdf.assign(slope=0.0, kappa=0.0)
        x = pdf["thr"].to_numpy(float)
        slope = _local_cubic(_rising(np.gradient(pdf["n"].to_numpy(float))), width)
        bend = np.gradient(slope, x)
        return pdf.assign(slope=slope, kappa=np.abs(bend) / (1 + slope ** 2) ** 1.5)

    picked = curve.select(*keys, F.col("thr").cast("double").alias("thr"), F.col("n").cast("double").alias("n"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema), "slope double", "kappa double"])
    return picked.groupBy(*keys).applyInPandas(fit, schema)


# ---- the earlier estimator --------------------------------------------------------------------

def winscore_shifted(deriv: DataFrame, keys, sizes=SCORE_WINDOWS, pos: float = 0.5) -> DataFrame:
    """Sample variance/mean of the forward window, moved right by round(size*pos); NULL before that."""
    keys = list(keys)
    w = _ordered(keys, "i")
    cols = []
    for s in sizes:
        frame = w.rowsBetween(0, s - 1)
        cols.append(F.try_divide(F.coalesce(F.var_samp("deriv").over(frame), F.lit(0.0)), F.avg("deriv").over(frame)).alias(f"s{s}"))
    scored = deriv.select(*keys, "i", "thr", *cols)
    moved = [F.lag(f"s{s}", s if pos >= 1 else int(s * pos + 0.5) if pos > 0 else 0).over(w).alias(f"{s}") for s in sizes]
    return (scored.select(*keys, "i", "thr", *moved)
            .unpivot([*keys, "i", "thr"], [f"`{s}`" for s in sizes], "win", "score").withColumn("win", F.col("win").cast("int")))


def curve_scan_test(curve: DataFrame, keys, fmin: float = -1.0, fmax: float = 1.0, y: str = "n") -> DataFrame:
    """First thresholds after the peak where the smoothed curve is at or under median + factor*MAD."""
    keys = list(keys)
    base = _indexed(curve.withColumn("_y", F.col(y).cast("double")), keys)
    base = base.withColumn("_med", F.median("_y").over(_whole(keys)))
    base = base.withColumn("_mad", F.median(F.abs(F.col("_y") - F.col("_med"))).over(_whole(keys)))
    base = base.withColumn("_peak", F.min_by("i", F.struct(-F.col("_y"), F.col("i"))).over(_whole(keys)))
    tail = base.where("i >= _peak and cnt - (_peak + 1) >= 5")
    w = _ordered(keys, "i")
    first, last = F.col("i") - F.col("_peak"), F.col("cnt") - 1 - F.col("i")
    reach = F.least(first, last, F.lit(2))
    smooth = (F.when(reach == 0, F.col("_y")).when(reach == 1, F.avg("_y").over(w.rowsBetween(-1, 1)))
              .otherwise(F.avg("_y").over(w.rowsBetween(-2, 2))))
    steps = int(round((fmax - fmin) / 0.25)) + 1
    many = tail.withColumn("_s", F.round(smooth, 9)).withColumn(
        "factor", F.explode(F.array(*[F.lit(fmin + 0.25 * k) for k in range(steps)])))
    level = F.round(F.col("_med") + F.col("_mad") * F.col("factor"), 9)
    per = many.groupBy(*keys, "factor").agg(F.min(F.when(F.col("_s") <= level, F.col("thr"))).alias("sugg"),
                                            F.max("thr").alias("_maxt"))
    out = per.groupBy(*keys).agg(F.avg("sugg").alias("th_avg"), F.coalesce(F.stddev_samp("sugg"), F.lit(0.0)).alias("th_std"),
                                 F.count("sugg").alias("hits"), F.max("_maxt").alias("_maxt"))
    half = 2.0 * F.col("th_std")
    return out.where("hits > 0").select(*keys, "th_avg", "th_std", "hits",
                                        F.greatest(F.round(F.round(F.col("th_avg") - half, 6)), F.lit(1.0)).alias("th_min"),
                                        F.least(F.round(F.round(F.col("th_avg") + half, 6)), F.col("_maxt")).alias("th_max"))


def pool_suggestions(sugg: DataFrame, keys, weights: dict[str, float], std_factor: float = 0.0,
                     external: tuple[float, float] | None = None) -> DataFrame:
    """Weighted mean + std*factor over suggestion pools, then overlap with an external range.

    Weights are normalised; an empty pool's weight is spread over the others when at
    least two remain.
    """
    keys = list(keys)
    raw = {k: max(0.0, w) for k, w in weights.items()}
    total = sum(raw.values())
    if total == 0:
        raw = {k: 1.0 if k == "fit" else 0.0 for k in raw}
        total = 1.0
    w0 = {k: w / total for k, w in raw.items()}
    aggs = []
    for p in w0:
        v = F.when(F.col("pool") == p, F.col("value"))
        aggs += [F.avg(v).alias(f"m_{p}"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"s_{p}"), F.count(v).alias(f"c_{p}")]
    g = sugg.where(F.col("pool").isin(*w0)).groupBy(*keys).agg(
        *aggs, F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std_all"), F.avg("value").alias("mean_all"))
    have = sum([(F.col(f"c_{p}") > 0).cast("int") for p in w0], F.lit(0))
    spare = sum([F.when(F.col(f"c_{p}") == 0, w).otherwise(0.0) for p, w in w0.items()], F.lit(0.0))
    extra = F.when(have > 1, spare / have).otherwise(0.0)
    share = {p: F.when(F.col(f"c_{p}") > 0, F.lit(w) + extra).otherwise(0.0) for p, w in w0.items()}
    level = sum([F.coalesce(F.col(f"m_{p}") + F.col(f"s_{p}") * std_factor, F.lit(0.0)) * share[p] for p in w0], F.lit(0.0))
    out = g.withColumn("thr", F.round(F.round(level, 6)))
    if external:
        lo, hi = external
        dmin, dmax = F.col("thr") - F.col("std_all"), F.col("thr") + F.col("std_all")
        omin, omax = F.greatest(dmin, F.lit(lo)), F.least(dmax, F.lit(hi))
        moved = F.when(omin > omax, F.when(F.lit(lo) >= dmax, (F.lit(lo) + dmax) / 2).otherwise((F.lit(hi) + dmin) / 2)).otherwise(
            (omin + omax) / 2)
        out = out.withColumn("thr", F.round(F.round(moved, 6)))
    return out.select(*keys, "thr", "mean_all", "std_all")


def score_suggestions(thresholds: DataFrame, sugg: DataFrame, keys) -> DataFrame:
    """Half normal density of the pool plus half share of MAD bands; and hits per threshold bin."""
    keys = list(keys)
    stats = sugg.groupBy(*keys).agg(F.avg("value").alias("_mu"), F.stddev_samp("value").alias("_sd"), F.median("value").alias("_med"))
    dev = sugg.join(stats, keys).groupBy(*keys).agg(F.median(F.abs(F.col("value") - F.col("_med"))).alias("_mad"))
    t = thresholds.join(stats, keys).join(dev, keys)
    nxt = F.coalesce(F.lead("thr").over(_ordered(keys)), F.col("thr") + 1)
    t = t.withColumn("_next", nxt)
    off = F.round(F.abs(F.col("thr") - F.col("_med")), 9)
    bands = F.size(F.filter(F.sequence(F.lit(1), F.lit(32)), lambda k: off <= F.round(k * 0.25 * F.col("_mad"), 9)))
    z = (F.col("thr") - F.col("_mu")) / F.col("_sd")
    norm = F.exp(-0.5 * z * z) / (F.col("_sd") * F.sqrt(F.lit(2 * np.pi)))
    scored = t.withColumn("_b", bands).withColumn("_b", F.try_divide(F.col("_b").cast("double"), F.sum("_b").over(_whole(keys))))
    hits = sugg.groupBy(*keys, F.col("value").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    # each suggestion falls in the bin that starts at the last threshold not above it
    marks = scored.select(*keys, "thr", F.lit(0).cast("long").alias("_c"), F.lit(0).alias("_o")).unionByName(
        hits.select(*keys, F.col("_v").alias("thr"), "_c", F.lit(1).alias("_o")))
    prev = F.last(F.when(F.col("_o") == 0, F.col("thr")), True).over(
        Window.partitionBy(*keys).orderBy("thr", "_o").rowsBetween(Window.unboundedPreceding, 0))
    counts = marks.withColumn("_bin", prev).groupBy(*keys, F.col("_bin").alias("thr")).agg(F.sum("_c").alias("hits"))
    return scored.join(counts, [*keys, "thr"]).select(
        *keys, "thr", (0.5 * norm + 0.5 * F.col("_b")).alias("score"), "hits")


def low_noise_check(curve: DataFrame, volumes: DataFrame, keys) -> DataFrame:
    """Few spots at threshold 1 relative to the voxel count."""
    keys = list(keys)
    at_one = curve.groupBy(*keys).agg(F.min("thr").alias("_lo"), F.min_by("n", "thr").alias("_n"))
    vox = F.log10(F.col("n_z") * F.col("n_y") * F.col("n_x"))
    quiet = (F.col("_lo") == 1) & (vox - F.log10("_n") >= vox * 0.45)
    return at_one.join(volumes, keys).select(*keys, F.coalesce(quiet, F.lit(False)).alias("low_noise"))


def peak_5pct_range(scores: DataFrame, keys, x: str = "thr", y: str = "n") -> DataFrame:
    """Peak and the nearest x on each side whose value falls 5 % of the range below it."""
    keys = list(keys)
    w = _whole(keys)
    s = scores.withColumn("_y", F.col(y).cast("double"))
    s = s.withColumn("_max", F.max("_y").over(w)).withColumn("_min", F.min("_y").over(w))
    s = s.withColumn("_px", F.min(F.when(F.col("_y") == F.col("_max"), F.col(x))).over(w))
    low = F.col("_y") <= F.col("_max") - (F.col("_max") - F.col("_min")) * 0.05
    return s.groupBy(*keys, F.col("_px").alias("peak_x")).agg(
        F.coalesce(F.max(F.when(low & (F.col(x) <= F.col("_px")), F.col(x))), F.min("_px")).alias("min_x"),
        F.coalesce(F.min(F.when(low & (F.col(x) >= F.col("_px")), F.col(x))), F.min("_px")).alias("max_x"))
