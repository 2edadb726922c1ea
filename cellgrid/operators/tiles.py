"""Image work by tiles: filters over tiles with a halo, resampling from the tiles that are asked for.

A voxel travels once to its own tile and to the few neighbours whose halo it lies in; one exchange deals the tiles, and
numpy works on a stack of planes of one tile in one Arrow table. Tiles are bounded: ``EDGE`` voxels a side, or twice
the halo where that is more, so the copies for halos are at most four times the image. Small images put several planes
into one stack. Nothing is gathered per image, plane or line.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZYX = ["z", "y", "x"]
EXTENT = {"z": "n_z", "y": "n_y", "x": "n_x"}
EXTENTS = list(EXTENT.values())
#: bits of one of the three numbers that share a long: images are less than two million voxels wide
_BITS = 21
#: side of a filter tile, and voxels that a stack of planes of one tile should hold
EDGE, STACK = 1024, 1 << 18
#: sides of a source tile for resampling over 1, 2 or 3 axes; blocks of output are ``BLOCK`` such sides wide
SOURCE_EDGE, BLOCK = {1: 1 << 16, 2: 512, 3: 64}, 4


def _touched(axis: str, below: int, above: int, edge: int) -> Column:
    """Numbers of the tiles whose range, widened by ``below`` at its end and ``above`` at its start, holds the voxel."""
    last = f"({EXTENT[axis]} - 1) div {edge}"
    return F.expr(f"sequence(greatest(({axis} - {below}) div {edge}, 0L), least(({axis} + {above}) div {edge}, {last}))")


def _planes(edge: int, axes=("y", "x")) -> str:
    """Number of planes stacked into one group: SQL text over the extents."""
    area = " * ".join(f"least({EXTENT[a]}, {edge})" for a in axes)
    return f"greatest(1L, {STACK} div ({area}))"


def _columns(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def _floats(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray | None]:
    """Values with 0 for null, and where they are null (None where nowhere)."""
    if not column.null_count:
        return column.to_numpy(), None
    return column.fill_null(0.0).to_numpy(), column.is_null().to_numpy()


# ---- filters --------------------------------------------------------------------------------

def filter_tiles(dense: DataFrame, keys: list[str], halo: tuple[int, int], fn: Callable[..., dict[str, np.ndarray]],
                 outs: list[str], whole: Callable[..., dict[str, np.ndarray]] | None = None, step: int = 1, mode: str | None = "symmetric",
                 carried: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """keys, z, y, x, extents, v and a double column per name of ``outs``.

    ``fn`` gets a stack (planes, rows + 2 halo, columns + 2 halo), padded beyond the image by numpy's ``mode``, and
    returns an array (planes, rows, columns) per name. ``whole``, given instead, gets the stack as cut by the image,
    its origin, the tile's origin and end, the image's extent and where voxels are null (None: nowhere). Tile origins are
    multiples of ``step``. A null voxel counts as 0 for its neighbours and stays null. ``carried`` columns, one value per
    image, come last.
    """
    hy, hx = halo
    # halos come in steps too, so that tiles start at whole blocks
    edge = max(EDGE, -(-2 * max(halo) // step) * step)
    names = [*keys, *ZYX, *EXTENTS, "v", *[n for n in outs if n != "v"]]
    rows = (dense.withColumn("_tz", F.expr(f"z div {_planes(edge)}"))
            .withColumn("_ty", F.explode(_touched("y", hy, hy, edge))).withColumn("_tx", F.explode(_touched("x", hx, hx, edge))))
    # every column costs time on its way to Python: a voxel is its place in the stack, three numbers share a long
    high, wide = (f"(least({n}, {edge} * ({t} + 1) + {h}) - greatest({edge} * {t} - {h}, 0L))" for n, t, h in (("n_y", "_ty", hy), ("n_x", "_tx", hx)))
    spot = (f"((z - _tz * {_planes(edge)}) * {high} + y - greatest({edge} * _ty - {hy}, 0L)) * {wide} + x - greatest({edge} * _tx - {hx}, 0L)")
    packed = lambda z, y, x: F.expr(f"shiftleft(cast({z} as bigint), {2 * _BITS}) + shiftleft(cast({y} as bigint), {_BITS}) + {x}")
    rows = rows.select(*keys, *carried, packed("_tz", "_ty", "_tx").alias("_tile"), packed(*EXTENTS).alias("_extent"),
                       F.expr(spot).cast("int").alias("_at"), F.col("v").cast("double").alias("v"))

    def run(table: pa.Table) -> pa.Table:
        three = lambda c: [table[c][0].as_py() >> shift & (1 << _BITS) - 1 for shift in (2 * _BITS, _BITS, 0)]
        tz, ty, tx = three("_tile")
        n = dict(zip(ZYX, three("_extent")))
        ty, tx = ty * edge, tx * edge
        origin, end = (max(0, ty - hy), max(0, tx - hx)), (min(n["y"], ty + edge + hy), min(n["x"], tx + edge + hx))
        at = table["_at"].to_numpy()
        area = (end[0] - origin[0]) * (end[1] - origin[1])
        held = np.unique(at // area)
        planes = held + tz * max(1, STACK // (min(n["y"], edge) * min(n["x"], edge)))
        stack = np.zeros((held[-1] + 1, end[0] - origin[0], end[1] - origin[1]))
        values, null = _floats(table["v"])
        stack.reshape(-1)[at] = values
        hole = None
        if null is not None:
            hole = np.zeros(stack.shape, bool)
            hole.reshape(-1)[at] = null
        core, stop = (ty, tx), (min(n["y"], ty + edge), min(n["x"], tx + edge))
        if whole:
            made = whole(stack, origin, core, stop, (n["y"], n["x"]), hole)
        else:
            pad = [(0, 0)] + [(h - (c - o), s + h - e) for h, c, o, s, e in zip(halo, core, origin, stop, end)]
            kind = {"constant_values": np.inf} if mode == "constant" else {}
            made = fn(np.pad(stack, pad, mode=mode, **kind) if any(map(any, pad)) else stack)
        inner = tuple(slice(c - o, s - o) for c, o, s in zip(core, origin, stop))
        cut = lambda a: a if len(held) == len(a) else a[held]
        shape = (len(planes), stop[0] - core[0], stop[1] - core[1])
        size = math.prod(shape)
        made = {"v": stack[:, *inner], **made}
        missing = None if hole is None else cut(hole[:, *inner]).ravel()
        spots = np.indices(shape, np.int32)
        columns = [pa.repeat(table[k][0], size) for k in keys]
        columns += [pa.array(planes.astype(np.int32)[spots[0].ravel()]), pa.array((spots[1] + np.int32(core[0])).ravel()), pa.array((spots[2] + np.int32(core[1])).ravel())]
        columns += [pa.repeat(pa.scalar(n[a], pa.int32()), size) for a in ZYX]
        columns += [pa.array(np.ascontiguousarray(cut(made[c])).ravel(), mask=missing) for c in names[len(keys) + 6:]]
        columns += [pa.repeat(table[c][0], size) for c in carried]
        return pa.Table.from_arrays(columns, [*names, *carried])

    schema = [_columns(dense, keys), *[f"{c} int" for c in (*ZYX, *EXTENTS)], *[f"`{c}` double" for c in names[len(keys) + 6:]]]
    schema += [_columns(dense, list(carried))] if carried else []
    out = rows.groupBy(*keys, "_tile").applyInArrow(run, ", ".join(schema))
    kinds = dict(dense.dtypes)
    return out.select(*keys, *[F.col(c).cast(kinds[c]).alias(c) for c in (*ZYX, *EXTENTS)], *names[len(keys) + 6:], *carried)


def box_sum(a: np.ndarray, ry: int, rx: int) -> np.ndarray:
    """Sums over (2 ry + 1) x (2 rx + 1) boxes by a summed-area table; the result is smaller by the radii."""
    table = np.zeros((a.shape[0], a.shape[1] + 1, a.shape[2] + 1))
    np.cumsum(a, axis=1, out=table[:, 1:, 1:])
    np.cumsum(table[:, 1:, 1:], axis=2, out=table[:, 1:, 1:])
    h, w = 2 * ry + 1, 2 * rx + 1
    return table[:, h:, w:] - table[:, :-h, w:] - table[:, h:, :-w] + table[:, :-h, :-w]


def box_moments(a: np.ndarray, ry: int, rx: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation over boxes. Sums start from a whole number near the mean, which keeps them small."""
    n = float((2 * ry + 1) * (2 * rx + 1))
    middle = np.rint(np.nan_to_num(a.mean(axis=(1, 2), keepdims=True)))
    a = a - middle
    mean = box_sum(a, ry, rx) / n
    spread = box_sum(a * a, ry, rx) / n - mean * mean
    return mean + middle, np.sqrt(np.maximum(spread, 0.0))


def correlate(a: np.ndarray, weights: list[float], axis: int) -> np.ndarray:
    """Sum of weights[k] * a[i + k]: shorter by len(weights) - 1 along ``axis``."""
    size = a.shape[axis] - len(weights) + 1
    total = None
    for k, w in enumerate(weights):
        if w:
            part = np.take(a, range(k, k + size), axis) if axis > 2 else a[(slice(None),) * axis + (slice(k, k + size),)]
            total = w * part if total is None else total + w * part
    return total


def running_min(a: np.ndarray, r: int) -> np.ndarray:
    """Minimum over 2r+1 places along the last axis, 2r places shorter: least from the block's start and to its end."""
    if r == 0:
        return a
    w, n = 2 * r + 1, a.shape[-1]
    blocks = np.full((*a.shape[:-1], -(-n // w) * w), np.inf)
    blocks[..., :n] = a
    blocks = blocks.reshape(*a.shape[:-1], -1, w)
    ahead = np.minimum.accumulate(blocks, axis=-1).reshape(*a.shape[:-1], -1)
    behind = np.minimum.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(*a.shape[:-1], -1)
    return np.minimum(behind[..., :n - w + 1], ahead[..., w - 1:n])


def disk_min(a: np.ndarray, r: int) -> np.ndarray:
    """Minimum over a disk of radius r; the stack comes padded by r and loses that border."""
    half = {dy: math.isqrt(r * r - dy * dy) for dy in range(-r, r + 1)}
    height, width = a.shape[1] - 2 * r, a.shape[2] - 2 * r
    out = np.full((a.shape[0], height, width), np.inf)
    for w in sorted(set(half.values())):
        rows = running_min(a[:, :, r - w:a.shape[2] - (r - w)], w)
        for dy, reach in half.items():
            if reach == w:
                np.minimum(out, rows[:, r + dy:r + dy + height], out=out)
    return out


def ball_background(stack: np.ndarray, origin, core, stop, extent, s: int, r: int) -> np.ndarray:
    """Block minima of side s, disk minimum of radius r blocks, bilinear enlargement to the tile's core."""
    planes, rows, columns = stack.shape
    small = np.full((planes, -(-rows // s) * s, -(-columns // s) * s), np.inf)
    small[:, :rows, :columns] = stack
    small = small.reshape(planes, -1, s, small.shape[2] // s, s).min(axis=(2, 4))
    low = disk_min(np.pad(small, ((0, 0), (r, r), (r, r)), constant_values=np.inf), r)

    def taps(axis: int):
        p = np.arange(core[axis], stop[axis])
        count, first = -(-extent[axis] // s), origin[axis] // s
        base = np.clip((p - s // 2) // s, 0, max(count - 2, 0))
        return base - first, np.minimum(base + 1, count - 1) - first, (p + 0.5) / s - (base + 0.5)

    (y0, y1, ty), (x0, x1, tx) = taps(0), taps(1)
    ty = ty[:, None]
    pick = lambda y, x: low[:, y[:, None], x[None, :]]
    return (1 - ty) * ((1 - tx) * pick(y0, x0) + tx * pick(y0, x1)) + ty * ((1 - tx) * pick(y1, x0) + tx * pick(y1, x1))


# ---- resampling -----------------------------------------------------------------------------

#: offsets of the source voxels around the floored coordinate (the rounded one for nearest)
TAPS = {"nearest": [0], "linear": [0, 1], "cubic": [-1, 0, 1, 2]}


def _tap_weights(method: str, t: np.ndarray) -> list[np.ndarray]:
    if method == "nearest":
        return [np.ones_like(t)]
    if method == "linear":
        return [1 - t, t]
    return [-0.5 * t * t * t + t * t - 0.5 * t, 1.5 * t * t * t - 2.5 * t * t + 1.0,
            -1.5 * t * t * t + 2.0 * t * t + 0.5 * t, 0.5 * t * t * t - 0.5 * t * t]


def _sampled(stack: np.ndarray, plane: np.ndarray | None, source: list[np.ndarray], first: list[int], extent: list[int], method: str,
             boundary: str) -> np.ndarray:
    """Values at real coordinates; ``stack`` holds the source from ``first`` on, by plane where there is one."""
    index, weight = [], []
    for s, low, n in zip(source, first, extent):
        base = np.clip(np.floor(s + 0.5) if method == "nearest" else np.floor(s), -3, n + 2).astype(np.int64)
        index.append([])
        weight.append([])
        for k, w in zip(TAPS[method], _tap_weights(method, s - np.floor(s))):
            at = base + k
            index[-1].append(np.clip(at, 0, n - 1) - low)
            weight[-1].append(np.where((at < 0) | (at >= n), 0.0, w) if boundary == "zero" else w)
    total = np.zeros(len(source[0]))
    for combo in np.ndindex(*[len(i) for i in index]):
        w = math.prod(weight[a][k] for a, k in enumerate(combo))
        at = tuple(index[a][k] for a, k in enumerate(combo))
        total += w * stack[at if plane is None else (plane, *at)]
    return total


def resample(coords: DataFrame, dense: DataFrame, method: str = "linear", boundary: str = "replicate", axes=("y", "x"),
             keys=("section", "channel")) -> DataFrame:
    """Value ``v`` of ``dense`` at real-valued source coordinates ``s<axis>`` of each row of ``coords``.

    ``coords``: keys, z, y, x (output), s<axis> for the given axes and source extents; other columns ride along.
    A row goes to the source tile that its coordinate lies in, grouped with the rows of its own block of the output,
    so a group is bounded however the coordinates crowd. Source tiles, widened by the taps, go to the blocks that ask
    for them. Where both sides are dealt by section, nothing is shuffled.
    """
    axes = list(axes)
    edge, half = SOURCE_EDGE[len(axes)], "0.5D" if method == "nearest" else "0.0D"
    others = [a for a in ZYX if a not in axes]
    stacks = others == ["z"]  # planes of one image share a group; other axes outside the resampling are keys
    held = [*keys, *([] if stacks else others)]
    carried = [c for c in coords.columns if c not in (*keys, *ZYX, *EXTENTS, *[f"s{a}" for a in axes])]
    planes = _planes(edge, axes)
    tile = ["_tp", *[f"_t{a}" for a in axes]]
    stack_of = F.expr(f"z div {planes}" if stacks else "0L")
    place = {f"_t{a}": F.expr(f"cast(greatest(least(floor(s{a} + {half}), {EXTENT[a]} - 1L), 0L) as bigint) div {edge}") for a in axes}
    asked = coords.withColumn("_tp", stack_of).withColumns(place).withColumn(
        "_block", F.concat_ws(",", *[F.expr(f"{a} div {BLOCK * edge}") for a in axes]))
    wanted = asked.select(*held, *tile, "_block").distinct()

    low = {a: f"greatest({edge} * _t{a} - 1, 0L)" for a in axes}
    spot = f"(z - _tp * {planes})" if stacks else "0L"
    for a in axes:
        spot = f"({spot}) * (least({EXTENT[a]}, {edge} * (_t{a} + 1) + 2) - {low[a]}) + ({a} - {low[a]})"
    source = dense.withColumn("_tp", stack_of)
    for a in axes:
        source = source.withColumn(f"_t{a}", F.explode(_touched(a, 2, 1, edge)))
    source = source.select(*held, *tile, F.expr(spot).cast("int").alias("_at"), F.col("v").cast("double").alias("v"),
                           *[F.col(EXTENT[a]).cast("int").alias(f"_n{a}") for a in axes])
    sizes = [f"_n{a}" for a in axes]

    def box(extent: list[int], at: list[int]) -> tuple[list[int], list[int]]:
        """First voxel and shape of a source tile with its border."""
        first = [max(edge * t - 1, 0) for t in at]
        return first, [min(n, edge * (t + 1) + 2) - f for n, t, f in zip(extent, at, first)]

    # voxels join the blocks that ask for their tile where both are, in the section's task: packed tiles would be shuffled
    sent = source.join(wanted.hint("merge"), [*held, *tile])
    sent = sent.select(*[F.col(c).alias(c) for c in sent.columns])  # apart from the columns that ``asked`` shares with it
    group = [*held, *tile, "_block"]
    names = [*keys, *ZYX, "v", *carried]

    def run(key: tuple, rows: pa.Table, tiles: pa.Table) -> pa.Table:
        if not rows.num_rows or not tiles.num_rows:
            return pa.Table.from_arrays([rows[c].slice(0, 0) if c != "v" else pa.array([], pa.float64()) for c in names], names)
        extent = [tiles[c][0].as_py() for c in sizes]
        first, shape = box(extent, [k.as_py() for k in key[len(held) + 1:len(held) + 1 + len(axes)]])
        at, plane = tiles["_at"].to_numpy(), None
        if stacks:
            per = max(1, STACK // math.prod(min(n, edge) for n in extent))
            plane = rows["z"].to_numpy().astype(np.int64) - key[len(held)].as_py() * per
            shape = [max(int(plane.max()), int(at.max()) // math.prod(shape)) + 1, *shape]
        stack = np.zeros(shape)
        stack.reshape(-1)[at] = _floats(tiles["v"])[0]
        v = _sampled(stack, plane, [rows[f"s{a}"].to_numpy() for a in axes], first, extent, method, boundary)
        return pa.Table.from_arrays([pa.array(v) if c == "v" else rows[c] for c in names], names)

    left = asked.select(*group, *[c for c in (*keys, *ZYX) if c not in group], *[F.col(f"s{a}").cast("double").alias(f"s{a}") for a in axes], *carried)
    schema = ", ".join(_columns(left, [c]) if c != "v" else "v double" for c in names)
    return left.groupBy(*group).cogroup(sent.groupBy(*group)).applyInArrow(run, schema)
