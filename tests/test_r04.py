"""Regressions of the fourth round of findings; every test builds its own rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.functions.exprs import EPS, gaussian_weights
from cellgrid.operators import neighbours as nb, similarity as sm, spots as sp, tiles, voxels as vx
from cellgrid.schema import SchemaMismatch
from cellgrid.session import join_where_dealt
from cellgrid.sources import sinks as sk
from test_sizes import plan


def test_split_keeps_rows_over_half_the_limit(spark, tmp_path):
    """One text of 0.7 and one of exactly the limit: both are written, no part is over it."""
    sizes = [*range(10, 60), 692, *range(10, 40), 992, 30, 20]
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "id long, text string").repartition(5)
    path = str(tmp_path / "parts")
    sk.sink_split_by_bytes(df, "id", 1000, path)
    back = spark.read.parquet(path)
    parts = back.groupBy("part").agg(F.sum(F.length("text") + 8).alias("b"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("id").alias("n")).orderBy("lo").collect()
    assert max(p["b"] for p in parts) <= 1000 and sum(p["n"] for p in parts) == len(sizes)
    assert all(p["hi"] - p["lo"] + 1 == p["n"] for p in parts) and [p["part"] for p in parts] == sorted(p["part"] for p in parts)
    with pytest.raises(SchemaMismatch):
        sk.sink_split_by_bytes(df, "id", 999, path)


def test_mutual_information_of_filled_bins(spark):
    """Histograms held where they are filled score as whole ones do, at the first and last bins as well."""
    rng = np.random.default_rng(2)
    pairs = {0: rng.random((40, 2)), 1: rng.random((30, 2)) * 0.1 + 0.45, 2: np.array([[0.0, 1.0], [1.0, 0.0], [0.0, 0.0]]), 3: np.full((5, 2), 0.5)}
    df = spark.createDataFrame([(k, float(v), float(u)) for k, rows in pairs.items() for v, u in rows], "section int, v double, u double")
    got = {r["section"]: r["t"] for r in sm.mutual_information(df, 128).collect()}
    w, half = np.array(gaussian_weights(1.0)), len(gaussian_weights(1.0)) // 2

    def entropy(p):
        for axis in range(p.ndim):
            grown = np.pad(p, [(half, half) if a == axis else (0, 0) for a in range(p.ndim)], mode="edge")
            p = np.apply_along_axis(lambda line: np.convolve(line, w, "valid"), axis, grown)
        return -(p * np.log(p + EPS)).sum()

    for k, rows in pairs.items():
        p = np.zeros((128, 128))
        for v, u in rows * 128:
            for a, wa in ((0, 1 - v % 1), (1, v % 1)):
                for b, wb in ((0, 1 - u % 1), (1, u % 1)):
                    p[min(int(v) + a, 127), min(int(u) + b, 127)] += wa * wb
        p /= p.sum()
        assert got[k] == pytest.approx(-(entropy(p.sum(1)) + entropy(p.sum(0))) / entropy(p), rel=1e-9)


def test_sim_mip_is_registered_whole(spark, monkeypatch):
    """The registered query scores 8 x 8 x 8 blocks by 128 bins, the reference's numbers."""
    from cellgrid.plans import load_all, q_similarity
    seen = {}
    monkeypatch.setattr(sm, "mutual_information", lambda p, bins, keys: seen.update(bins=bins, keys=keys) or p.groupBy(*keys).agg(F.lit(1.0).alias("t")))
    monkeypatch.setattr(sm, "_unit_pairs", lambda a, b, mask: a)
    image = vx.grid(spark.createDataFrame([(0, 7, 32, 32)], "section int, n_z int, n_y int, n_x int")).withColumn("v", F.rand(1))
    monkeypatch.setattr(q_similarity, "pair", lambda t: (image, image))
    out = load_all()[0]["sim_mip"](spark, "/nowhere")
    assert seen["bins"] == 128 and seen["keys"] == ["section", "bz", "by", "bx"] and out.first()["t"] == 1.0


def exchanges(df):
    return [line.strip(" :+-") for line in plan(df).splitlines() if "Exchange" in line and "ReusedExchange" not in line]


def images(spark, n=4, ny=9, nx=11, channels="AN"):
    """Sparse voxels and their volumes, with a place that comes twice left out."""
    rng = np.random.default_rng(7)
    rows = [(s, c, int(z), int(y), int(x), float(rng.integers(1, 90))) for s in range(n) for c in channels
            for z, y, x in {tuple(rng.integers(0, (2, ny, nx))) for _ in range(60)}]
    sparse = spark.createDataFrame(rows, "section int, channel string, z int, y int, x int, v double")
    return sparse, spark.createDataFrame([(s, c, 2, ny, nx) for s in range(n) for c in channels], "section int, channel string, n_z int, n_y int, n_x int")


def array(df, shape, col="v"):
    a = np.full(shape, np.nan)
    for r in df.collect():
        a[r["z"], r["y"], r["x"]] = r[col]
    return a


def test_dense_voxels_are_not_shuffled(spark):
    """Everything is exchanged before a voxel is made; sums, windows, tiles and joins of images find their rows in the task."""
    join_where_dealt(spark)
    sparse, volumes = images(spark)
    dense = vx.densify(sparse, volumes)
    sizes = lambda df: sum("REPARTITION_BY_NUM" not in e for e in exchanges(df))
    base = sizes(dense)  # those of the sizes
    lsum = lambda df: df.groupBy("section", "channel", "z", "y").agg(F.sum("v"))
    assert sizes(vx.focus_metrics(dense)) == base
    assert sizes(lsum(vx.local_maxima(dense))) == base
    whole = vx.box_statistics(dense, 1, 1)
    assert sizes(whole) == base
    # the range of the image and a sum of lines that Python made
    assert sizes(lsum(vx.local_contrast(dense, 1, 1))) <= 2 * base + 1
    moved = dense.drop("v").withColumns({"sy": F.col("y") + 0.5, "sx": F.col("x") - 0.5})
    assert sizes(tiles.resample(moved, dense)) <= 3 * base
    field = vx.grid(volumes.select("section", *vx.EXTENTS).distinct()).withColumns({"tx": F.lit(0.1), "ty": F.lit(0.2), "tz": F.lit(0.0)})
    assert sizes(sm.strain_tensor(field, ("x", "y", "z"))) == 1
    assert "BroadcastExchange" not in plan(vx.warp_by_field(field.drop(*vx.EXTENTS).join(volumes.select("section", "channel").hint("merge"), "section"), dense))


def test_registration_steps_on_one_tile(spark):
    """All steps on one tile give what they give one after the other, on images smaller and larger than the halos."""
    for shape, (wide, ball, narrow) in (((2, 9, 11), (6, 12, 4)), ((1, 40, 50), (3, 4, 2)), ((1, 33, 47), (2, 11, 2))):
        a = np.random.default_rng(1).random(shape) * 50
        d = spark.createDataFrame([(0, "A", z, y, x, *shape, float(v)) for (z, y, x), v in np.ndenumerate(a)],
                                  "section int, channel string, z int, y int, x int, n_z int, n_y int, n_x int, v double")
        centred = vx.box_statistics(d, wide, wide).withColumn("v", F.col("v") - F.col("_mean")).drop("_mean", "_sd")
        steps = vx.nan_to_zero(vx.local_contrast(vx.rolling_ball_subtract(centred, ball), narrow, narrow, 3.0, False, True), ["v"])
        assert np.allclose(array(vx.preprocess_registration(d, wide, ball, narrow), shape), array(steps, shape), atol=1e-8)


def test_registration_steps_across_tiles(spark, monkeypatch):
    """Tiles of 64 voxels and one of the whole image agree, null voxels count as zero in every step."""
    a = np.random.default_rng(4).random((1, 150, 140)) * 50
    rows = [(0, "A", z, y, x, *a.shape, None if (y, x) == (70, 63) else float(v)) for (z, y, x), v in np.ndenumerate(a)]
    d = spark.createDataFrame(rows, "section int, channel string, z int, y int, x int, n_z int, n_y int, n_x int, v double")
    whole = array(vx.preprocess_registration(d, 3, 4, 2), a.shape)
    monkeypatch.setattr(tiles, "EDGE", 64)
    assert np.allclose(array(vx.preprocess_registration(d, 3, 4, 2), a.shape), whole, atol=1e-8)


def test_components_across_boxes(spark, monkeypatch):
    """A snake through many boxes is one component, and labels are the least places."""
    cells = {(y, x) for y in range(0, 24, 2) for x in range(24)} | {(y, 0 if y % 4 == 1 else 23) for y in range(1, 23, 2)} | {(30, 30), (31, 31), (40, 2)}
    df = spark.createDataFrame([(0, "A", z, y, x, 1.0) for z in (0, 17) for y, x in cells] + [(None, "A", 0, 1, 1, 1.0), (0, "A", 0, 40, 2, 2.0)],
                               "section int, channel string, z int, y int, x int, v double")
    for edge in (256, 5):
        monkeypatch.setattr(sp, "COMPONENT_EDGE", edge)
        got = sp.plane_components(df).groupBy("z", "lab").agg(F.count(F.lit(1)).alias("n")).collect()
        snake = len(cells) - 3
        assert sorted((r["z"], tuple(r["lab"]), r["n"]) for r in got) == [
            (0, (0, 0), snake), (0, (30, 30), 2), (0, (40, 2), 2), (17, (0, 0), snake), (17, (30, 30), 2), (17, (40, 2), 1)]


def test_routing_sends_bounded_batches(spark, monkeypatch):
    """Queries and copies that go in several batches find the neighbours of all pairs."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((300, 20))
    rows = spark.createDataFrame([(i, f"l{i % 3}", [float(x) for x in r]) for i, r in enumerate(v)], "id long, label string, vec array<double>")
    query, ref = rows.select(F.col("id").alias("query_id"), "vec"), rows.select(F.col("id").alias("ref_id"), "label", "vec")
    monkeypatch.setattr(nb, "ROUTED", 32)
    monkeypatch.setattr(nb, "COPIES", 50)
    got = nb.knn_join(query, ref, 4, "euclidean", skip_self=True, ship_rows=10, pivots=16, block=100).collect()
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), 6)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(300) for j in np.lexsort((np.arange(300), d[i]))[:4]}
    assert {(r["query_id"], r["ref_id"]) for r in got} == want
