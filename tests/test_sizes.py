"""Plans and block sizes that keep memory bounded on large tables."""

import numpy as np
from pyspark.sql import functions as F

from cellgrid.operators import geometry as g, neighbours as nb, regions as rg, similarity as sm, spots as sp, voxels as vx
from cellgrid.sources import scans as sc


def sections(spark):
    return spark.createDataFrame([(0, 2, 8, 8), (1, 2, 8, 8)], "section int, n_z int, n_y int, n_x int")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def voxel_join(df):
    """The joins by coordinates are merged; only lookups of few rows may be sent whole."""
    text = plan(df)
    assert "SortMergeJoin [section" in text, text
    assert not any("BroadcastHashJoin [section" in line for line in text.splitlines()), text


def test_voxel_sides_are_not_broadcast(spark):
    grid = vx.grid(sections(spark)).select("section", "z", "y", "x")
    masks = grid.withColumn("mask_id", F.col("y"))
    annotation = grid.withColumn("parc_id", F.col("x"))
    ids = spark.createDataFrame([(1,), (2,)], "parc_id int")
    voxel_join(rg.clip_masks_to_region(masks, annotation, ids))
    voxel_join(rg.masks_in_region(masks, annotation, ids))
    voxel_join(rg.annotation_boundaries(annotation))
    voxel_join(sp.filter_spots_in_mask(grid, masks))
    voxel_join(rg.label_overlap_filter(masks, grid.withColumn("label", F.lit("A"))))
    points = grid.select("section", F.col("z").cast("double"), F.col("y").cast("double"), F.col("x").cast("double"))
    voxel_join(g.locate_points(points, annotation, spark.createDataFrame([(1, "a")], "id int, name string")))
    field = vx.grid(sections(spark)).withColumns({"tx": F.lit(0.5), "ty": F.lit(0.25)})
    voxel_join(sm.forward_field(field))
    assert rg.clip_masks_to_region(masks, annotation, ids).count() == 2 * 2 * 8 * 2


def test_name_pieces_are_not_broadcast(spark):
    files = spark.createDataFrame([("a/b/s1__x.tif",), ("a/b/s2__x.tif",)], "path string")
    found = sc.find_file_by_uid(files, spark.createDataFrame([("s1",), ("s2",)], "uid string"))
    assert "SortMergeJoin [uid" in plan(found)
    assert {r["uid"]: r["path"] for r in found.collect()} == {"s1": "a/b/s1__x.tif", "s2": "a/b/s2__x.tif"}


def test_grid_is_dealt_to_tasks(spark):
    parts = vx.grid(sections(spark).distinct()).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1


def test_densify_joins_no_generated_grid(spark):
    kinds = "section int, channel string, z int, y int, x int, v double"
    # a repeated place, a null value, places outside and null ones, a volume without voxels, a volume given twice, null keys
    found = [(0, "A", 0, 1, 2, 5.0), (0, "A", 0, 1, 2, 6.0), (0, "A", 1, 0, 0, None), (0, "A", 0, 0, 4, 9.0), (0, "A", None, 0, 0, 9.0),
             (0, "A", 2, 0, 0, 9.0), (0, "A", 0, -1, 0, 9.0), (2, "A", 0, 2, 3, 7.0), (None, "A", 0, 0, 0, 8.0), (9, "A", 0, 0, 0, 8.0)]
    volumes = [(0, "A"), (1, "A"), (2, "A"), (2, "A"), (None, "A")]
    want = []
    for s, c in volumes:
        for place in np.ndindex(2, 3, 4):
            values = [r[5] for r in found if None not in r[:5] and r[:5] == (s, c, *place)]
            want += [(s, c, *place, 2, 3, 4, v or 0.0) for v in values or [0.0]]
    made = vx.densify(spark.createDataFrame(found, kinds), spark.createDataFrame(
        [(*v, 2, 3, 4) for v in volumes], "section int, channel string, n_z int, n_y int, n_x int"))
    assert made.columns == ["section", "channel", "z", "y", "x", "n_z", "n_y", "n_x", "v"]
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in made.collect()) == order(want)
    joins = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("= x#" in line for line in joins), joins


def test_nearest_in_blocks_keeps_ties_by_id():
    rng = np.random.default_rng(5)
    r, q = rng.integers(0, 3, (300, 3)).astype(float), rng.integers(0, 3, (40, 3)).astype(float)
    rid, own = rng.permutation(300), np.arange(40)
    for metric in ("euclidean", "cosine"):
        d = np.round(nb._distances(q, r, metric), 6)
        d[own[:, None] == rid[None, :]] = np.inf
        want = [rid[np.lexsort((rid, row))[:7]] for row in d]
        got = np.concatenate([rid[at] for _, at, _ in nb._best(q, r, rid, 7, metric, own, chunk=16, width=32)])
        assert (got == np.array(want)).all()
    assert [at.shape for _, at, _ in nb._best(q, r[:4], rid[:4], 7, "euclidean", None, chunk=64, width=3)] == [(40, 4)]


def test_nearest_holds_few_distances(monkeypatch):
    held, plain = [], nb._distances
    monkeypatch.setattr(nb, "_distances", lambda q, r, metric: held.append(len(q) * len(r)) or plain(q, r, metric))
    list(nb._best(np.zeros((3000, 2)), np.ones((20_000, 2)), np.arange(20_000), 5, "euclidean", None))
    assert max(held) <= 1 << 22


def test_blocks_replace_balls_that_rule_out_nothing(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 24))
    ref = spark.createDataFrame([(i, f"l{i % 3}", v.tolist()) for i, v in enumerate(x)], "ref_id int, label string, vec array<double>")
    query = ref.where("ref_id % 5 = 0").select(F.col("ref_id").alias("query_id"), "vec")
    found = nb.knn_join(query, ref, 4, "euclidean", skip_self=True, ship_rows=10, pivots=32, block=150)
    got = {}
    for row in found.collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = row["ref_id"]
    d = np.round(nb._distances(x, x, "euclidean"), 6)
    np.fill_diagonal(d, np.inf)
    for i in range(0, 400, 5):
        assert [got[i][k] for k in (1, 2, 3, 4)] == list(np.argsort(d[i], kind="stable")[:4])
    assert "MapInPandas" not in plan(found)


def test_small_blocks_grow_with_the_list(spark):
    n = spark.createDataFrame([(100,), (640_000,), (64_000,)], "n int")
    assert sorted(r[0] for r in n.select(nb._blocks(F.col("n"), 64)).collect()) == [2, 8, 32]
