"""Tile filters and tile-routed resampling against plain numpy, over many small tiles and odd edges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellgrid.functions.exprs import gaussian_weights
from cellgrid.operators import geometry as g
from cellgrid.operators import tiles
from cellgrid.operators import voxels as vx

KEYS = ["section", "channel"]


def image(spark, stack, section=0):
    z, y, x = (i.ravel() for i in np.indices(stack.shape))
    n = stack.shape
    frame = pd.DataFrame({"section": section, "channel": "A", "z": z, "y": y, "x": x, "v": stack.ravel().astype(float), "n_z": n[0], "n_y": n[1], "n_x": n[2]})
    return spark.createDataFrame(frame, "section int, channel string, z int, y int, x int, v double, n_z int, n_y int, n_x int")


def stack_of(df, shape, col="v"):
    out = np.full(shape, np.nan)
    rows = df.select("z", "y", "x", col).toPandas()
    assert len(rows) == np.prod(shape) and not rows.duplicated(["z", "y", "x"]).any()
    out[rows.z, rows.y, rows.x] = rows[col].astype(float)
    return out


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(tiles, "EDGE", 16)
    monkeypatch.setattr(tiles, "STACK", 600)
    monkeypatch.setattr(tiles, "SOURCE_EDGE", {1: 7, 2: 9, 3: 5})
    monkeypatch.setattr(tiles, "BLOCK", 2)


@pytest.fixture
def noise():
    return np.round(np.random.default_rng(7).gamma(2, 20, (3, 41, 37)))


def padded(plane, ry, rx, **kind):
    return np.pad(plane, ((ry, ry), (rx, rx)), **kind)


@pytest.mark.parametrize("rx, ry", [(3, 2), (20, 9), (60, 45)])
def test_box_statistics(spark, small_tiles, noise, rx, ry):
    df = vx.box_statistics(image(spark, noise), rx, ry)
    for col, fn in (("_mean", np.mean), ("_sd", np.std)):
        want = [[[fn(p[y:y + 2 * ry + 1, x:x + 2 * rx + 1]) for x in range(37)] for y in range(41)] for p in (padded(q, ry, rx, mode="symmetric") for q in noise)]
        assert np.allclose(stack_of(df, noise.shape, col), want)


def test_constant_planes_have_no_contrast(spark, small_tiles):
    out = vx.local_contrast(image(spark, np.full((2, 30, 20), 7.25)), 4, 4, 3.0, True, True)
    assert out.where("v is not null").count() == 0 and out.count() == 1200


def test_null_voxels_stay_null_and_count_as_zero(spark, small_tiles, noise):
    holes = (np.add.outer(np.add.outer(np.arange(3), np.arange(41)), np.arange(37)) % 11 == 0)
    df = image(spark, np.where(holes, 0, noise))
    got = vx.gaussian_smooth(df.withColumn("v", F.when((F.col("z") + F.col("y") + F.col("x")) % 11 == 0, None).otherwise(F.col("v"))), 1.0)
    want = stack_of(vx.gaussian_smooth(df, 1.0), noise.shape)
    assert np.allclose(stack_of(got.where("v is not null").unionByName(got.where("v is null").withColumn("v", F.lit(-1.0))), noise.shape), np.where(holes, -1, want))


@pytest.mark.parametrize("radius", [1, 5, 12])
def test_disk_minimum(spark, small_tiles, noise, radius):
    got = stack_of(vx.disk_minimum(image(spark, noise), radius), noise.shape)
    yy, xx = np.mgrid[:41, :37]
    want = [[[p[(yy - y) ** 2 + (xx - x) ** 2 <= radius ** 2].min() for x in range(37)] for y in range(41)] for p in noise]
    assert np.allclose(got, want)


@pytest.mark.parametrize("radius", [8, 12, 31])
def test_rolling_ball(spark, small_tiles, noise, radius):
    s = vx.shrink_factor(radius)
    got = stack_of(vx.rolling_ball_background(image(spark, noise), radius), noise.shape, "ball")
    ny, nx = -(-41 // s), -(-37 // s)
    yy, xx = np.mgrid[:ny, :nx]
    for plane, ball in zip(noise, got):
        small = np.array([[plane[s * y:s * y + s, s * x:s * x + s].min() for x in range(nx)] for y in range(ny)])
        low = np.array([[small[(yy - y) ** 2 + (xx - x) ** 2 <= radius ** 2].min() for x in range(nx)] for y in range(ny)])
        if s == 1:
            assert np.allclose(ball, low)
            continue
        for y in range(41):
            for x in range(37):
                by, bx = (min(max((p - s // 2) // s, 0), max(n - 2, 0)) for p, n in ((y, ny), (x, nx)))
                ty, tx = (y + .5) / s - (by + .5), (x + .5) / s - (bx + .5)
                cy, cx = min(by + 1, ny - 1), min(bx + 1, nx - 1)
                want = (1 - ty) * ((1 - tx) * low[by, bx] + tx * low[by, cx]) + ty * ((1 - tx) * low[cy, bx] + tx * low[cy, cx])
                assert abs(ball[y, x] - want) < 1e-9


def test_gaussian_and_laplacian(spark, small_tiles, noise):
    df, w = image(spark, noise), np.array(gaussian_weights(1.7))
    r = len(w) // 2
    along = lambda p, k: np.array([np.convolve(row, k[::-1], "valid") for row in p])
    smooth = lambda p, a, b, mode: along(along(padded(p, len(a) // 2, len(a) // 2, mode=mode), np.array(a)).T, np.array(b)).T
    assert r and np.allclose(stack_of(vx.gaussian_smooth(df, 1.7), noise.shape), [smooth(p, w, w, "edge") for p in noise])
    g0, g2 = vx.log_kernels(1.4)
    want = [np.maximum(-(smooth(p, g2, g0, "symmetric") + smooth(p, g0, g2, "symmetric")), 0) for p in noise]
    assert np.allclose(stack_of(vx.log_filter(df, 1.4), noise.shape), want)


def test_registration_preprocessing_at_the_usual_radii(spark, noise):
    """Radii 400 and 50 on an odd-sized image far smaller than them equal the stages one by one."""
    df = image(spark, noise)
    first = vx.local_contrast(df, 400, 400, 3.0, True, False)
    want = vx.local_contrast(vx.rolling_ball_subtract(first, 50), 50, 50, 3.0, False, True)
    assert np.allclose(stack_of(vx.preprocess_registration(df), noise.shape), np.nan_to_num(stack_of(want, noise.shape)))


def plain_sample(volume, points, method, boundary):
    """Value at each point by summing over the taps of every axis."""
    out = []
    for p in points:
        total = 0.0
        axes = []
        for s, n in zip(p, volume.shape):
            if method == "nearest":
                axes.append([(int(np.floor(s + .5)), 1.0)])
            else:
                b, t = int(np.floor(s)), s - np.floor(s)
                axes.append([(b + k, w) for k, w in zip(tiles.TAPS[method], (float(np.ravel(x)[0]) for x in tiles._tap_weights(method, np.array([t]))))])
        for combo in np.ndindex(*map(len, axes)):
            taps = [a[k] for a, k in zip(axes, combo)]
            inside = all(0 <= i < n for (i, _), n in zip(taps, volume.shape))
            v = volume[tuple(min(max(i, 0), n - 1) for (i, _), n in zip(taps, volume.shape))] if inside or boundary == "replicate" else 0.0
            total += v * np.prod([w for _, w in taps])
        out.append(total)
    return np.array(out)


@pytest.mark.parametrize("method", ["nearest", "linear", "cubic"])
@pytest.mark.parametrize("boundary", ["replicate", "zero"])
@pytest.mark.parametrize("axes", [("y", "x"), ("z", "y", "x"), ("x",)])
def test_resample_over_many_tiles(spark, small_tiles, method, boundary, axes):
    rng = np.random.default_rng(3)
    volume = rng.random((5, 23, 19)) * 10
    df = image(spark, volume)
    z, y, x = (i.ravel() for i in np.indices(volume.shape))
    own = {"z": z, "y": y, "x": x}
    source = {a: own[a] + rng.normal(0, 6, len(z)) * (rng.random(len(z)) < 0.6) for a in axes}
    frame = pd.DataFrame({"section": 0, "channel": "A", **own, **{f"s{a}": s for a, s in source.items()}, "n_z": 5, "n_y": 23, "n_x": 19, "extra": z * 100 + x})
    coords = spark.createDataFrame(frame, "section int, channel string, z int, y int, x int, " + ", ".join(f"s{a} double" for a in axes) + ", n_z int, n_y int, n_x int, extra int")
    out = tiles.resample(coords, df, method, boundary, axes)
    assert out.where("extra <> z * 100 + x").isEmpty()
    got = stack_of(out, volume.shape)
    if len(axes) == 3:
        want = plain_sample(volume, np.stack([source[a] for a in axes], 1), method, boundary)
    else:
        lines = {"y": lambda k: (volume[z[k]], [source["y"][k], source["x"][k]]), "x": lambda k: (volume[z[k], y[k]], [source["x"][k]])}[axes[0]]
        want = [plain_sample(lines(k)[0], [lines(k)[1]], method, boundary)[0] for k in range(len(z))]
    assert np.allclose(got.ravel(), want)


def test_all_coordinates_in_one_place(spark, small_tiles):
    """A field that sends every voxel to one corner is dealt by blocks of the output."""
    volume = np.arange(2 * 30 * 28.0).reshape(2, 30, 28)
    df = image(spark, volume)
    coords = df.drop("v").withColumn("sy", F.lit(-80.0)).withColumn("sx", F.lit(1e9))
    assert np.allclose(stack_of(tiles.resample(coords, df), volume.shape), np.broadcast_to(volume[:, :1, -1:], volume.shape))
    other = coords.withColumn("section", F.lit(9))  # an image that is not there
    assert tiles.resample(other, df).count() == 0


def test_warps_in_three_dimensions(spark, small_tiles):
    volume = np.random.default_rng(4).random((6, 14, 13))
    df = image(spark, volume)
    shift = {"xx": 1.0, "xy": 0.0, "xz": 0.0, "xt": 1.0, "yx": 0.0, "yy": 1.0, "yz": 0.0, "yt": -2.0, "zx": 0.0, "zy": 0.0, "zz": 1.0, "zt": 1.0}
    affine = spark.createDataFrame([(0, *shift.values())], "section int, " + ", ".join(f"{k} double" for k in shift))
    got = stack_of(g.affine_warp_voxels(df, affine, 0, ("x", "y", "z")), volume.shape)
    clamp = lambda i, n: np.clip(i, 0, n - 1)
    z, y, x = np.indices(volume.shape)
    assert np.allclose(got, volume[clamp(z + 1, 6), clamp(y - 2, 14), clamp(x + 1, 13)])
    big = stack_of(vx.resize_volume(df, df.select(*KEYS, "n_z", "n_y", "n_x").distinct(), (3, 28, 40), "nearest"), (3, 28, 40))
    at = [clamp(np.floor((np.arange(m) + 1.0) * n / m - 1.0 + .5).astype(int), n) for m, n in zip((3, 28, 40), volume.shape)]
    assert np.allclose(big, volume[np.ix_(*at)])


@pytest.mark.parametrize("box, shape", [(50, (1, 203, 151)), (10, (2, 47, 33)), (8, (1, 13, 40))])
def test_background_is_a_cubic_spline_over_the_boxes(spark, box, shape):
    image_ = np.round(np.random.default_rng(9).gamma(3, 30, shape) + np.add.outer(np.arange(shape[1]), 2 * np.arange(shape[2]))[None])
    got = stack_of(vx.estimate_background(image(spark, image_), box), shape, "bg")
    rows = vx.background_boxes(image(spark, image_), box).toPandas()
    ny, nx = -(-shape[1] // box), -(-shape[2] // box)
    assert len(rows) == shape[0] * ny * nx

    def system(n):
        m = np.zeros((n, n))
        for i in range(n):
            for j, w in ((i - 1, 1), (i, 4), (i + 1, 1)):
                m[i, min(max(j, 0), n - 1)] += w / 6  # the mirrored neighbour of an end is the end itself
        return np.linalg.inv(m)

    def basis(n, size):
        out = np.zeros((size, n))
        for p in range(size):
            f = (p + .5) / box - .5
            for j in range(int(np.floor(f)) - 1, int(np.floor(f)) + 3):
                d = abs(f - j)
                w = (4 - 6 * d ** 2 + 3 * d ** 3) / 6 if d < 1 else (2 - d) ** 3 / 6
                k = j % (2 * n)
                out[p, k if k < n else 2 * n - 1 - k] += w
        return out

    for z in range(shape[0]):
        m = np.zeros((ny, nx))
        own = rows[rows.z == z]
        m[own.by, own.bx] = own.m
        want = basis(ny, shape[1]) @ system(ny) @ m @ system(nx).T @ basis(nx, shape[2]).T
        assert np.allclose(got[z], np.clip(want, m.min(), m.max()))
