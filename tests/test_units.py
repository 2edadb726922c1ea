"""Small literal inputs, invariants and brute-force comparisons."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellgrid.functions.exprs import cubic_bspline, gaussian_weights, psf_sigma
from cellgrid.functions.ranking import exact_percentiles, hash_row_number
from cellgrid.functions.exprs import hash32
from cellgrid.operators import classify as cl, curves as cv, expression as ex, geometry as g, neighbours as nb
from cellgrid.operators import sampling as sa, spots as sp, tiles, voxels as vx
from cellgrid.schema import SchemaMismatch
from cellgrid.sources import scans as sc, sinks as sk
from cellgrid.streaming import work as wk


def test_exact_percentiles_beyond_sketch_accuracy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.exponential(5, 30000), np.full(15000, 2.0), [1e9]])  # ties and an outlier
    df = spark.createDataFrame(pd.DataFrame({"v": x})).repartition(6)
    got = exact_percentiles(df, [], F.col("v"), {"a": 0.1, "b": 0.5, "c": 0.95}, accuracy=500).first()
    assert np.allclose([got["a"], got["b"], got["c"]], np.percentile(x, [10, 50, 95]))


def test_hash_row_number_is_a_permutation_under_skew(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    out = hash_row_number(df, ["k"], hash32(F.col("id")), [F.col("id")], "rn")
    bad = out.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rn").alias("d"), F.max("rn").alias("m")).where("n <> d or n <> m")
    assert bad.isEmpty() and out.count() == 5000


def test_bspline_weights_sum_to_one(spark):
    w = spark.range(11).select((F.col("id") / 10).alias("a")).select(*[c.alias(f"w{i}") for i, c in enumerate(cubic_bspline(F.col("a")))])
    assert all(abs(sum(r) - 1) < 1e-12 for r in w.collect())
    assert abs(sum(gaussian_weights(1.3)) - 1) < 1e-12
    assert abs(psf_sigma("Alexa Fluor 647") - 0.21 * 671 / 1.15 / 325) < 1e-12


def _plane(spark, arr):
    rows = [(0, "A", 0, y, x, float(arr[y, x]), 1, arr.shape[0], arr.shape[1]) for y in range(arr.shape[0]) for x in range(arr.shape[1])]
    return spark.createDataFrame(rows, "section int, channel string, z int, y int, x int, v double, n_z int, n_y int, n_x int")


def _array(df, shape, col="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r[col]
    return out


def test_box_mean_with_radius_wider_than_image(spark):
    a = np.arange(20.0).reshape(4, 5)
    got = _array(vx.local_contrast(_plane(spark, a), 7, 6, 1.0, True, False), a.shape)
    pad = np.pad(a, ((6, 6), (7, 7)), mode="symmetric")
    mean = np.array([[pad[y:y + 13, x:x + 15].mean() for x in range(5)] for y in range(4)])
    assert np.allclose(got, a - mean + a.mean())


def test_disk_minimum_brute_force(spark):
    a = np.random.default_rng(1).random((9, 8))
    got = _array(vx.disk_minimum(_plane(spark, a), 3), a.shape)
    want = [[min(a[j, i] for j in range(9) for i in range(8) if (j - y) ** 2 + (i - x) ** 2 <= 9) for x in range(8)] for y in range(9)]
    assert np.allclose(got, want)


def test_unmix_never_negative_and_ordered(spark):
    rows = [(0, "A", 0, 0, 0, 100.0), (0, "N", 0, 0, 0, 10.0), (0, "R", 0, 0, 0, 7.0)]
    v = spark.createDataFrame(rows, "section int, channel string, z int, y int, x int, v double")
    out = {r["channel"]: r["v"] for r in vx.unmix(v, [("A", "N", 0.0, 0.05, True), ("N", "R", 0.0, 1.0, True)], ["A", "N", "R"]).collect()}
    assert out == {"A": 100.0, "N": 5.0, "R": 2.0}  # the second step sees the first one's result


def test_resample_identity_and_edges(spark):
    a = np.random.default_rng(2).random((6, 7))
    d = _plane(spark, a)
    for method in ("nearest", "linear", "cubic"):
        c = d.drop("v").withColumn("sy", F.col("y") * 1.0).withColumn("sx", F.col("x") * 1.0)
        assert np.allclose(_array(tiles.resample(c, d, method), a.shape), a)
    far = d.drop("v").withColumn("sy", F.lit(-50.0)).withColumn("sx", F.lit(90.0))
    assert np.allclose(_array(tiles.resample(far, d, "cubic", "replicate"), a.shape), a[0, -1])
    assert np.allclose(_array(tiles.resample(far, d, "cubic", "zero"), a.shape), 0)


def test_components_and_split(spark):
    pts = [(0, 0), (0, 1), (1, 2), (5, 5), (6, 6), (3, 0)]
    df = spark.createDataFrame([(0, "A", 0, y, x, 10.0) for y, x in pts], "section int, channel string, z int, y int, x int, v double")
    comp = sp.plane_components(df)
    assert sorted(comp.groupBy("lab").count().select("count").toPandas()["count"]) == [1, 2, 3]
    assert sp.dense_spot_split(df).count() >= 3


def test_affine_fit_recovers_and_inverts(spark):
    rng = np.random.default_rng(5)
    m = rng.random((12, 3)) * 50
    A, t = np.array([[1.1, 0.2, 0], [-.1, .9, .05], [.02, 0, 1.3]]), np.array([3.0, -4.0, 2.0])
    f = m @ A.T + t
    df = spark.createDataFrame([(1, *map(float, a), *map(float, b)) for a, b in zip(m, f)], "section int, mx double, my double, mz double, fx double, fy double, fz double")
    fit = g.affine_fit(df)
    r = fit.first()
    assert np.allclose([[r[o + i] for i in "xyz"] for o in "xyz"], A) and np.allclose([r[o + "t"] for o in "xyz"], t)
    p = spark.createDataFrame([(1, 5.0, 6.0, 7.0)], "section int, x double, y double, z double")
    q = g.affine_apply(p, fit).select("section", *[F.col(f"q{a}").alias(a) for a in "xyz"])
    back = g.affine_apply(q, fit, inverse=True).first()
    assert np.allclose([back["qx"], back["qy"], back["qz"]], [5, 6, 7])


def test_affine_fit_degenerate_is_null(spark):
    df = spark.createDataFrame([(1, float(k), float(k), 0.0, 1.0, 2.0, 3.0) for k in range(5)], "section int, mx double, my double, mz double, fx double, fy double, fz double")
    assert g.affine_fit(df).first()["xx"] is None


def test_point_registration_golden(spark):
    fix = [(1, 1), (1, 128), (96, 64), (32, 64), (128, 1), (128, 128)]
    mov = [(1, 1), (1, 128), (32, 64), (96, 64), (128, 1), (128, 128)]
    rows = [(0, float(m[0]), float(m[1]), float(f[0]), float(f[1])) for m, f in zip(mov, fix)]
    _, spacing, _, hist = g.point_registration(spark.createDataFrame(rows, "section int, mx double, my double, fx double, fy double"), {"x": 128, "y": 128}, 4)
    d = [r["mean_distance"] for r in hist.orderBy("level").collect()]
    assert spacing == {"x": 8.0, "y": 8.0} and all(b < a for a, b in zip(d, d[1:])) and d[-1] < 1.0


def test_knn_paths_agree_with_brute_force(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 0.05, (200, 4)), rng.normal(3, 1, (100, 4))])  # one dense ball holds most rows
    lab = [f"c{i % 3}" for i in range(300)]
    df = spark.createDataFrame([(i, lab[i], x[i].tolist()) for i in range(300)], "cell_id bigint, label string, vec array<double>")
    q, r = df.select(F.col("cell_id").alias("query_id"), "vec"), df.select(F.col("cell_id").alias("ref_id"), "label", "vec")
    for metric in ("euclidean", "cosine"):
        if metric == "euclidean":
            d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        else:
            u = x / np.linalg.norm(x, axis=1, keepdims=True)
            d = 1 - u @ u.T
        np.fill_diagonal(d, np.inf)
        d = np.round(d, 6)
        want = {i: sorted(zip(d[i], range(300)))[:5] for i in range(300)}
        for how in ({}, {"ship_rows": 0, "pivots": 8, "block": 30}):
            got = nb.knn_join(q, r, 5, metric, skip_self=True, **how).collect()
            assert len(got) == 1500
            assert all(want[t["query_id"]][t["rank"] - 1][1] == t["ref_id"] for t in got), (metric, how)


def test_outlier_factor_brute_force(spark):
    """Cell by cell, over genes with repeated values, few cells and many blocks."""
    rng = np.random.default_rng(0)
    genes = {"a": [*rng.integers(0, 90, 200).astype(float).tolist(), 500.0], "b": rng.normal(0, 1, 150).round(3).tolist(), "c": [1.0, 2.0, 9.0], "d": [4.0], "e": [0.0] * 40}
    rows = [(g, v, xs.count(v)) for g, xs in genes.items() for v in sorted(set(xs))]
    got = {(r["gene"], r["value"]): r["factor"] for r in ex.outlier_factors(
        spark.createDataFrame(rows, "gene string, value double, c long"), block=7).collect()}
    assert len(got) == len(rows)
    for g, xs in genes.items():
        k = min(20, len(xs) - 1)
        near = [sorted((abs(y - x), y, j) for j, y in enumerate(xs) if j != i)[:k] for i, x in enumerate(xs)]
        density = [1 / (sum(max(d, near[j][-1][0]) for d, _, j in ns) / k + 1e-10) if k else 1 for ns in near]
        for i, x in enumerate(xs):
            want = sum(density[j] for _, _, j in near[i]) / k / density[i] if k else 1.0
            assert got[g, x] == pytest.approx(want, rel=1e-9)
    assert got["a", 500.0] > 2


def test_parts_keep_to_the_limit(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "x" * int(n), None if i % 7 else [1.0, 2.0]) for i, n in enumerate(rng.integers(0, 400, 500))]
    df = spark.createDataFrame(rows, "id long, text string, v array<double>").repartition(6)
    bytes_of = {i: 8 + len(x) + 8 * len(v or []) for i, x, v in rows}
    got = sorted((r["id"], r["part"]) for r in sk.split_by_bytes(df, "id", 1000).collect())
    sizes = {}
    for i, part in got:
        sizes[part] = sizes.get(part, 0) + bytes_of[i]
    assert [i for i, _ in got] == list(range(500)) and [p for _, p in got] == sorted(p for _, p in got)
    assert max(sizes.values()) <= 1000 and len(sizes) <= 2 * sum(bytes_of.values()) / 1000
    with pytest.raises(SchemaMismatch):
        sk.split_by_bytes(df, "id", 500)
    assert sk.split_by_bytes(df.limit(0), "id", 500).count() == sk.split_by_size(df.limit(0), "id", 500).count() == 0


def test_batches_read_new_rows_only(spark, tmp_path):
    """Four deliveries, each repeating the one before it: a batch reads its own files, and each cell is kept once."""
    schema, root = "cell_id long, type string, at timestamp", str(tmp_path / "in")
    for name, more in (("all", {}), ("timed", {"time": "at"})):
        for d in range(4):
            spark.range(max(0, 100 * d - 100), 100 * d + 100).selectExpr("id as cell_id", "if(id % 2 = 0, 'a', 'b') as type", "timestamp_seconds(1600000000 + id) as at").write.mode(
                "append").parquet(f"{root}-{name}")
            q = wk.incremental_cells(spark.readStream.schema(schema).parquet(f"{root}-{name}"), str(tmp_path / f"table-{name}"), str(tmp_path / f"ckpt-{name}"), **more)
            read = sum(p["numInputRows"] for p in q.recentProgress)
            assert read == (100 if d == 0 else 200)
        assert {r["type"]: r["n"] for r in wk.incremental_totals(spark, str(tmp_path / f"table-{name}")).collect()} == {"a": 200, "b": 200}


def test_bin_gene_without_rows(spark):
    assert ex.bin_gene(spark.createDataFrame([], "cell_id long, gene string, value double")).count() == 0


def test_partial_pointbiserial_golden(spark):
    pdf = pd.DataFrame({
        "treatment_b": [0, 1, 0, 1, 0, 1, 0, 1], "female_b": [1, 1, 0, 0, 1, 0, 1, 0], "smoker_b": [0, 0, 1, 0, 1, 1, 0, 0],
        "reaction_time": [520, 480, 610, 455, 530, 490, 580, 460], "memory_score": [74, 88, 65, 91, 70, 85, 68, 93],
        "anxiety_score": [12, 8, 15, 6, 11, 9, 14, 7]})
    b, c = list(pdf.columns[:3]), list(pdf.columns[3:])
    got = {(r["binary_var"], r["continuous_var"]): r for r in ex.partial_pointbiserial(spark.createDataFrame(pdf), b, c).collect()}
    for y in c:
        o = np.column_stack([np.ones(8), *[pdf[k] for k in c if k != y]])
        e = pdf[y] - o @ np.linalg.lstsq(o, pdf[y], rcond=None)[0]
        for k in b:
            assert abs(got[k, y]["r"] - np.corrcoef(pdf[k], e)[0, 1]) < 1e-9
    with pytest.raises(Exception, match="two values"):
        ex.partial_pointbiserial(spark.createDataFrame(pdf.assign(female_b=1)), b, c).collect()


def test_t_tail_known_values():
    assert abs(ex._beta_tail(2.228138852, 10) - 0.05) < 1e-8 and abs(ex._beta_tail(1.0, 1) - 0.5) < 1e-12


def test_gini_range_and_totals(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 10.0)], "k string, v double")
    gi = {r["k"]: r["gini"] for r in ex.gini(df, ["k"], "v").collect()}
    assert abs(gi["a"]) < 1e-9 and 0.49 < gi["b"] <= 0.5


def test_supercell_totals_match_draws(spark):
    cells = spark.range(40).select(F.col("id").alias("cell_id"), F.concat(F.lit("c"), F.col("id") % 2).alias("cluster"))
    expr = cells.select("cell_id", F.explode(F.array(F.lit("g1"), F.lit("g2"))).alias("gene"), (F.col("cell_id") + 1.0).alias("value"))
    s = sa.supercells(expr, cells, 5, 2.0, 1)
    assert s.count() == 2 * 80
    m = sa.supercell_members(cells, 5, 2.0, 1).join(expr.where("gene='g1'"), "cell_id").agg(F.sum("value")).first()[0]
    assert s.where("gene='g1'").agg(F.sum("value")).first()[0] == m


def test_merge_closest_average_linkage(spark):
    d = {("a", "b"): .1, ("a", "c"): .3, ("a", "d"): .9, ("b", "c"): .32, ("b", "d"): .9, ("c", "d"): .8}
    rows = [(p, q, v) for (p, q), v in d.items()] + [(q, p, v) for (p, q), v in d.items()] + [(x, x, 0.0) for x in "abcd"]
    dm = spark.createDataFrame(rows, "a string, b string, d double")
    groups = lambda step: {r["label"]: r["group"] for r in cl.merge_closest(dm, step).collect()}
    assert groups(0.15) == {"a": "a", "b": "a", "c": "c", "d": "d"}
    assert groups(0.35) == {"a": "a", "b": "a", "c": "a", "d": "d"}  # mean(.3, .32) < .35
    names = {r["label"]: r["name"] for r in cl.label_mapping(spark.createDataFrame([("a, b", "g"), ("c", "g"), ("d", "h")], "label string, group string")).collect()}
    assert names == {"a, b": "a, b, c", "c": "a, b, c", "d": "d"}  # members are rows: a comma inside a label means nothing


def test_two_piece_fit_finds_a_clean_knee(spark):
    rows = [(0, float(x), 100.0 - 9 * x if x <= 10 else 10.0 - 0.1 * (x - 10)) for x in range(40)]  # continuous at the knee
    k = cv.curve_two_piece_fit(spark.createDataFrame(rows, "k int, thr double, n double"), ["k"], "thr", "n").first()
    assert k["knot"] == 10.0 and abs(k["slope"] + 0.1) < 1e-6


def test_poly_fit_purge_drops_the_outlier(spark):
    rows = [(0, z, 1000.0 + 5 * z + (900.0 if z == 11 else 0.0)) for z in range(30)]
    out = cv.poly_fit_purge(spark.createDataFrame(rows, "k int, z int, y double"), ["k"])
    assert [r["z"] for r in out.where("purged").collect()] == [11]


def test_decay_rates_beyond_any_grid(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for k, (a, b, c) in enumerate([(3000, .001, 4000), (3000, 3.0, 4000), (-50, .2, 7), (1e6, 40.0, -3), (2, 1e-5, 0)]):
        x = 5 + np.arange(40) * (0.1 / b)
        rows += [(k, float(v), float(a * np.exp(-b * (v - 5)) + c)) for v in x]
        want[k] = (a, b, c)
    x = np.arange(30.0)
    rows += [(10, float(v), float(8 * np.exp(-.3 * v) + 1 + e)) for v, e in zip(x, rng.normal(0, .2, 30))]  # noisy
    rows += [(11, float(v), 2.0 * float(v)) for v in x] + [(12, 4.0, float(v)) for v in x] + [(13, float(v), 9.0) for v in x] + [(14, 1.0, 1.0)]
    got = {r.k: r for r in cv.exp_decay_fit(spark.createDataFrame(rows, "k int, x double, y double"), ["k"], "x", "y").collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]
    for k, w in want.items():
        assert np.allclose([got[k].a * np.exp(-5 * got[k].b), got[k].b, got[k].c], w, rtol=1e-6, atol=1e-5), k
    r = got[10]
    data = np.array([q[1:] for q in rows if q[0] == 10])
    cost = lambda b: np.linalg.lstsq(np.c_[np.exp(-b * data[:, 0]), np.ones(30)], data[:, 1], rcond=None)[1][0]
    assert abs(cost(r.b) - r.sse) < 1e-9 and all(cost(r.b * f) >= r.sse for f in (.9, .999, 1.001, 1.1))
    assert got[11].sse < 1e-3 and got[12].b is None and got[14].b is None  # a line is the limit of slow decays


def test_curvature_helpers():
    assert np.allclose(cv._rising(np.array([1.0, 3.0, 2.0, 5.0])), [1, 2.5, 2.5, 5])
    x = np.linspace(0, 1, 50)
    assert np.allclose(cv._local_cubic(x ** 3, 11), x ** 3)


def test_schema_guards(spark):
    a, b = spark.range(1).select(F.lit(1).alias("x")), spark.range(1).select(F.lit(1).alias("y"))
    with pytest.raises(SchemaMismatch):
        sc.union_checked(a, b)
    with pytest.raises(SchemaMismatch):
        ex.align_genes(spark.createDataFrame([("g1",)], "gene string"), ["g1", "g2"])


def test_plans_push_filters_and_prune_columns(spark):
    from cellgrid.plans import load_all
    q, _ = load_all()
    plan = q["select_channel"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,N)" in plan and "l_comment" not in plan and "l_shipdate" not in plan


def test_no_cross_joins_in_registered_plans(spark):
    from cellgrid.plans import load_all
    q, _ = load_all()
    for name in ("spots_per_cell", "scale_contrast", "norm_to_median_total", "bootstrap_by_freq", "confusion_matrix", "threshold_range", "joint_histogram"):
        plan = q[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_math_helpers():
    m = g.compose_2d((2, 3), (1.0, 1.1), 1.0)
    assert np.allclose(np.array(m)[:2, :2], [[math.cos(1), math.sin(1)], [-1.1 * math.sin(1), 1.1 * math.cos(1)]])
    assert g.start_spacing((128, 128)) == 64
