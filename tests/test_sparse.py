"""Sparse statistics, products and components against dense numpy."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellgrid.operators import classify as cl
from cellgrid.operators import expression as ex
from cellgrid.operators import sparse


def csr_table(spark, x, split=None):
    rows = [(c, int(split[c]) if split is not None else 0, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for c, r in enumerate(x)]
    return spark.createDataFrame(rows, "cell_id long, split int, indices array<int>, data array<double>").repartition(5)


def counts_matrix(cells, genes, seed=0, share=0.2):
    rng = np.random.default_rng(seed)
    x = rng.gamma(2, 2, (cells, genes)) * (rng.random((cells, genes)) < share) * (1 + np.arange(genes) % 7)
    x[:, 5] = 0  # never seen
    x[3] = 0  # a cell without a value
    return x


@pytest.mark.parametrize("block, held", [(2048, 10 ** 7), (7, 120)])
def test_products_and_correlations(spark, monkeypatch, block, held):
    monkeypatch.setattr(sparse, "GENE_BLOCK", block)
    monkeypatch.setattr(sparse, "HELD_DOUBLES", held)
    x = counts_matrix(90, 30)
    found = sparse.products(csr_table(spark, x), 30).toPandas()
    q, s = np.zeros((30, 30)), np.zeros((30, 30))
    q[found.i, found.j], s[found.i, found.j] = found.q, found.s
    assert len(found) == 900 and (found.n == 90).all()
    assert np.allclose(q, x.T @ x) and np.allclose(s, x.sum(0)[:, None])
    r = sparse.correlations(csr_table(spark, x), 30).toPandas()
    got = np.full((30, 30), np.nan)
    got[r.i, r.j] = r.r.astype(float)
    with np.errstate(invalid="ignore"):
        assert np.allclose(got, np.corrcoef(x.T), equal_nan=True)


def test_pairs_come_in_slices(monkeypatch):
    monkeypatch.setattr(sparse, "PAIRS", 10)
    a, b = np.repeat(np.arange(6), [3, 0, 9, 1, 1, 2]), np.repeat(np.arange(6), [2, 4, 5, 0, 7, 1])
    found = [(int(p), int(q)) for left, right in sparse._meet(a, b) for p, q in zip(left, right)]
    assert sorted(found) == [(p, q) for p in range(len(a)) for q in range(len(b)) if a[p] == b[q]] and len(found) == len(set(found))


def test_atlas_width_stays_in_bounded_memory(spark, monkeypatch):
    genes, rng = 32_285, np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, genes, 1500)) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([r.astype(np.int32) for r in rows]), pa.array([np.ones(len(r)) for r in rows])], ["indices", "data"])
    run = sparse._block_sums([(0, 0), (0, 1), (14, 15)], genes, 2048)
    tracemalloc.start()
    out = sum(len(b) for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out and peak < 400e6  # three blocks of 34 MB, the pairs of one slice and the batch
    # components of the full width: a subspace per task, nothing of genes x genes
    wide = spark.createDataFrame([(0, r.tolist(), np.r_[5.0 * (c % 3), np.ones(len(r) - 1)].tolist()) for c, r in enumerate(rows[:60])],
                                 "split int, indices array<int>, data array<double>")
    monkeypatch.setattr(sparse, "SPARE", 70)
    model = sparse.fit_components(wide, 3, genes=genes, tolerance=1e-6).collect()
    dense = np.zeros((60, genes))
    for c, r in enumerate(rows[:60]):
        dense[c, r] = np.r_[5.0 * (c % 3), np.ones(len(r) - 1)]
    want = np.linalg.svd(dense - dense.mean(0), compute_uv=False)[:3] ** 2 / 60
    assert np.allclose([r.variance for r in sorted(model, key=lambda r: r.comp)], want) and len(model[0].loading) == genes


@pytest.mark.parametrize("dense", [True, False])
def test_components_against_the_dense_form(spark, monkeypatch, dense):
    monkeypatch.setattr(sparse, "SPARE", 24)
    monkeypatch.setattr(sparse, "SENT_DOUBLES", 3000)  # one key to a pass
    rng = np.random.default_rng(3)
    x = counts_matrix(160, 60, 3) @ np.diag(0.9 ** np.arange(60))
    split = rng.integers(0, 2, 160)
    df = csr_table(spark, x, split)
    if dense:
        df = df.select("cell_id", "split", F.transform(F.sequence(F.lit(0), F.lit(59)), lambda g: F.coalesce(
            F.element_at(F.map_from_arrays("indices", "data"), g), F.lit(0.0))).alias("vec"))
    model = sparse.fit_components(df, 5).persist()
    scores = {(r.split, r.cell_id): np.array(r.vec) for r in sparse.apply_components(df, model).collect()}
    assert len(scores) == 160
    for s in range(2):
        own = x[split == s]
        value, vector = np.linalg.eigh(np.cov(own.T, bias=True))
        rows = sorted((r for r in model.collect() if r.split == s), key=lambda r: r.comp)
        load = np.array([r.loading for r in rows])
        assert np.allclose([r.variance for r in rows], value[::-1][:5], rtol=1e-8)
        assert np.allclose(load @ load.T, np.eye(5), atol=1e-9)
        assert np.allclose(np.abs(np.sum(load * vector[:, ::-1].T[:5], 1)), 1, atol=1e-6)
        centred = own - own.mean(0)
        got = np.array([scores[s, c] for c in np.flatnonzero(split == s)])
        assert np.allclose(got, centred @ load.T)
        lost = ((centred - got @ load) ** 2).mean(0)  # reconstruction error per gene
        best = ((centred - centred @ vector[:, ::-1][:, :5] @ vector[:, ::-1][:, :5].T) ** 2).mean(0)
        assert np.allclose(lost, best, atol=1e-7)


def test_components_of_few_cells_and_none(spark):
    x = counts_matrix(4, 12, 5, 0.9)
    model = sparse.fit_components(csr_table(spark, x), 50)
    assert model.count() == 3  # of four cells one component is left out
    assert sparse.fit_components(csr_table(spark, x).limit(0), 5).count() == 0
    assert sparse.apply_components(csr_table(spark, x), model.limit(0)).count() == 0


def long(spark, x, by=None):
    rows = [(c, f"g{g:02d}", float(v)) for c, r in enumerate(x) for g, v in enumerate(r) if v]
    return spark.createDataFrame(rows, "cell_id long, gene string, value double")


def test_moments_see_the_zeros(spark):
    x = counts_matrix(60, 9, 6, 0.5) - 1.0 * (np.arange(9) == 2) * (np.arange(60)[:, None] % 2)  # a gene with negative values too
    x[:, 7] = 2.0 + np.arange(60) % 3  # no zeros
    x[40:, 8] = 0  # absent from a whole group
    group = (np.arange(60) // 20).tolist()
    df = long(spark, x).withColumn("boot", F.floor(F.col("cell_id") / 20))
    counts = spark.createDataFrame([(b, 20) for b in range(3)], "boot long, n long")
    names = spark.createDataFrame([(f"g{g:02d}",) for g in range(9)], "gene string")
    got = {(r.boot, r.gene): r for r in sparse.grouped_moments(df, ["boot"], counts, names).collect()}
    assert len(got) == 27
    for b in range(3):
        own = x[np.array(group) == b]
        for g in range(9):
            r = got[b, f"g{g:02d}"]
            assert np.allclose([r.mean, r.var, r.low, r.high], [own[:, g].mean(), own[:, g].var(), own[:, g].min(), own[:, g].max()])
    rdr = {r.gene: r.rdr for r in ex.robust_dynamic_range(df, counts).collect()}
    for g in range(9):
        if x[:, g].any():
            spans = [min(o.max(), o.mean() + 3 * o.std()) - max(o.min(), o.mean() - 3 * o.std()) for o in (x[20 * b:20 * b + 20, g] for b in range(3))]
            assert abs(rdr[f"g{g:02d}"] - np.log1p(np.mean(spans))) < 1e-9


def test_split_scaling_counts_zeros(spark):
    x = counts_matrix(40, 6, 8, 0.4)
    cells = spark.range(40).selectExpr("0 as split", "case when id < 30 then 'train' else 'test' end as part", "id as cell_id", "concat('t', id % 3) as label")
    boots = cells.join(long(spark, x), "cell_id")
    out = cl.preprocess_splits(boots, cells=cells).toPandas()
    seen = [g for g in range(6) if x[:, g].any()]
    z = np.log1p(x)
    sd = z[:30].std(0)
    z = (z - z[:30].mean(0)) / np.where(sd == 0, 1, sd)
    assert len(out) == 40 * len(seen)
    assert np.allclose(out.value, [z[c, int(g[1:])] for c, g in zip(out.cell_id, out.gene)])
