"""Neighbourhood passes along one axis of a dense voxel table.

Every pass windows over one image line (bounded by the image width), so no task ever
holds more than a line and lines of all planes, channels and sections run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EXTENT = {"z": "n_z", "y": "n_y", "x": "n_x"}


def by_merge(df: DataFrame) -> DataFrame:
    """A voxel-sized side of a join: sorted and merged, never broadcast.

    Spark guesses the size of generated or exploded voxels from the rows they came from, and that of written ones from
    compressed files, so its own check would send whole images through the driver.
    """
    return df.hint("merge")


def line_window(keys, axis: str, axes=("z", "y", "x")):
    return Window.partitionBy(*keys, *[a for a in axes if a != axis]).orderBy(axis)


def pad_reflect(df: DataFrame, axis: str, r: int, extent: str | None = None) -> DataFrame:
    """Repeat each line mirrored (edge voxel included) ``r`` voxels past both ends."""
    n, c = F.col(extent or EXTENT[axis]), F.col(axis)
    turns = F.sequence(-(F.floor(F.lit(r) / n) + 1), F.floor(F.lit(r) / n) + 1)
    images = F.flatten(F.transform(turns, lambda m: F.array(c + 2 * n * m, 2 * n * m - c - 1)))
    inside = F.filter(images, lambda p: (p >= -r) & (p < n + r))
    # only voxels within r of an end have images besides themselves
    return df.withColumn(axis, F.explode(F.when((c < r) | (c >= n - r), inside).otherwise(F.array(c.cast("bigint")))))


def inside(df: DataFrame, axis: str, extent: str | None = None) -> DataFrame:
    return df.where((F.col(axis) >= 0) & (F.col(axis) < F.col(extent or EXTENT[axis])))


def box_sums(df: DataFrame, keys, axis: str, r: int, cols: list[str]) -> DataFrame:
    """Replace each column by its sum over 2r+1 neighbours (mirror edge).

    Running sums make the cost independent of ``r``.
    """
    w = line_window(keys, axis)
    padded = pad_reflect(df, axis, r)
    run = padded.select("*", *[F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_run_{c}")
                               for c in cols])
    summed = run.select(*[c for c in df.columns if c not in cols], *[
        (F.lead(f"_run_{c}", r).over(w) - F.coalesce(F.lag(f"_run_{c}", r + 1).over(w), F.lit(0.0))).alias(c)
        for c in cols])
    return inside(summed, axis)


def shifted(w, value: str | Column, k: int) -> Column:
    return F.lag(value, k).over(w) if k > 0 else (F.lead(value, -k).over(w) if k < 0 else
                                                  (F.col(value) if isinstance(value, str) else value))


def weighted_pass(df: DataFrame, keys, axis: str, weights: list[float], col: str, out: str | None = None,
                  edge: str = "nearest", axes=("z", "y", "x")) -> DataFrame:
    """Sum of weights[k] * v[i + k - half] along ``axis``; edge 'nearest' or 'zero'."""
    half = len(weights) // 2
    w = line_window(keys, axis, axes)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    terms = []
    for i, wt in enumerate(weights):
        k = i - half
        if wt == 0:
            continue
        v = shifted(w, col, -k)
        if k and edge == "nearest":
            v = F.coalesce(v, (F.first(col) if k < 0 else F.last(col)).over(whole))
        elif k:
            v = F.coalesce(v, F.lit(0.0))
        terms.append(v * F.lit(float(wt)))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn(out or col, total)


def line_minima(df: DataFrame, w, col: str, outs: dict[int, str]) -> DataFrame:
    """Minimum of ``col`` over [-r, r] along the line for every r -> column name of ``outs``.

    Minima over 2^k places behind and ahead are built by doubling, so any radius is the least
    of four of them; places outside the line are null and do not count.
    """
    levels = max(r + 1 for r in outs).bit_length() - 1
    df = df.withColumn("_b0", F.col(col)).withColumn("_f0", F.col(col))
    for k in range(1, levels + 1):
        step = 1 << (k - 1)
        df = df.withColumns({f"_b{k}": F.least(f"_b{k - 1}", F.lag(f"_b{k - 1}", step).over(w)),
                             f"_f{k}": F.least(f"_f{k - 1}", F.lead(f"_f{k - 1}", step).over(w))})

    def least(r: int) -> Column:
        k = (r + 1).bit_length() - 1
        step = r + 1 - (1 << k)
        ends = [F.lag(f"_b{k}", step).over(w), F.lead(f"_f{k}", step).over(w)] if step else []
        return F.least(f"_b{k}", f"_f{k}", *ends)

    return df.withColumns({name: least(r) for r, name in outs.items()}).drop(
        *[f"_{side}{k}" for side in "bf" for k in range(levels + 1)])


def running_extreme(w, col: str, r: int, fn=F.max) -> Column:
    return fn(col).over(w.rowsBetween(-r, r))
