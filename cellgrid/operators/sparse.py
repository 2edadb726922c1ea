"""Statistics, products and components of expression tables that list non-zeros only.

A cell is a row of gene positions and values (``indices``, ``data``); what is not listed is zero. Nothing is made
dense: moments put the missing zeros back by counting, products multiply the pairs of non-zeros that meet in a cell,
and centring is a rank-one correction afterwards. Components come from a small subspace that is multiplied with the
covariance pass by pass; the covariance itself is never formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.session import cut_lineage

#: genes to a side of a block of products, doubles of blocks that a task adds up, pairs of non-zeros formed at once
GENE_BLOCK, HELD_DOUBLES, PAIRS = 2048, 16_000_000, 2_000_000
#: doubles of subspaces or loadings that are sent to the tasks of one pass; more keys take more passes
SENT_DOUBLES = 4_000_000
#: directions that a subspace holds beyond the components asked for
SPARE = 64


# ---- moments that see the zeros ---------------------------------------------------------------------

def grouped_moments(nonzeros: DataFrame, by: list[str], counts: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """(by, gene, n, mean, var, low, high) over all ``n`` cells of each group, non-zeros listed in (by, gene, value).

    ``counts`` is (by, n). Only genes with a value in the group appear, unless ``genes`` (gene) lists all of them.
    """
    sums = nonzeros.groupBy(*by, "gene").agg(
        F.count("value").alias("_c"), F.sum("value").alias("_s"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("_v"),
        F.min("value").alias("_low"), F.max("value").alias("_high"))
    if genes is not None:
        names = genes.select("gene").distinct().agg(F.sort_array(F.collect_list("gene")).alias("_g"))  # as wide as the panel
        every = counts.select(*by).withColumn("gene", F.explode(names.scalar()))
        sums = every.join(sums, [*by, "gene"], "left").fillna(0, ["_c"]).fillna(0.0, ["_s", "_v"])
    j = sums.join(counts.select(*by, "n"), by)
    n, c = F.col("n"), F.col("_c")
    mean, own, absent = F.col("_s") / n, F.coalesce(F.try_divide(F.col("_s"), c), F.lit(0.0)), n - c
    var = (c * F.col("_v") + c * (own - mean) * (own - mean) + absent * mean * mean) / n
    edge = lambda pick, name: F.when(absent > 0, pick(F.coalesce(F.col(name), F.lit(0.0)), F.lit(0.0))).otherwise(F.col(name))
    return j.select(*by, "gene", "n", mean.alias("mean"), var.alias("var"), edge(F.least, "_low").alias("low"), edge(F.greatest, "_high").alias("high"))


# ---- products ---------------------------------------------------------------------------------------

def csr(expr: DataFrame, names: DataFrame, key: str = "cell_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, key, indices, data) of a long table (key, gene, value) and its gene positions ``names`` (gene, i).

    A cell with zeros only keeps an empty row.
    """
    entry = F.when(F.col("value") != 0, F.struct("i", F.col("value").cast("double").alias("value")))
    rows = expr.join(names, "gene").groupBy(*keys, key).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    return rows.select(*keys, key, F.col("_e.i").alias("indices"), F.col("_e.value").alias("data"))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, value) of all non-zeros of a batch of rows."""
    index, data = batch.column("indices"), batch.column("data")
    row = np.repeat(np.arange(len(index)), np.diff(index.offsets.to_numpy()))
    return row, index.flatten().to_numpy().astype(np.int64), data.flatten().to_numpy().astype(np.float64)


def _meet(row_a: np.ndarray, row_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of all pairs of entries with the same row, some ``PAIRS`` at a time; rows ascend."""
    first, last = np.searchsorted(row_b, row_a), np.searchsorted(row_b, row_a, "right")
    width = last - first
    upto = np.cumsum(width)
    at = 0
    while at < len(row_a):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        w = width[at:to]
        left = np.repeat(np.arange(at, to), w)
        right = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first[at:to], w)
        if len(left):
            yield left, right
        at = to


def _block_sums(blocks: list[tuple[int, int]], genes: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up the given blocks of products over a task's cells; hands on the rows that are not all zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = lambda a: min(block, genes - a * block)
        held = {p: np.zeros((side(p[0]), side(p[1]))) for p in blocks}
        wanted = sorted({a for p in blocks for a in p})
        for batch in batches:
            row, i, v = _flat(batch)
            part = i // block
            split = {a: np.flatnonzero(part == a) for a in wanted}
            for (a, b), total in held.items():
                x, y = split[a], split[b]
                for left, right in _meet(row[x], row[y]):
                    p, q = x[left], y[right]
                    flat = (i[p] - a * block) * total.shape[1] + i[q] - b * block
                    total += np.bincount(flat, v[p] * v[q], total.size).reshape(total.shape)
        for (a, b), total in held.items():
            filled = np.flatnonzero(total.any(1))
            for k in range(0, len(filled), 256):
                r = filled[k:k + 256]
                yield pa.RecordBatch.from_arrays([pa.array((a * block + r).astype(np.int32)), pa.array(np.full(len(r), b * block, np.int32)),
                                                  pa.array(list(total[r]), pa.list_(pa.float64()))], ["i", "j0", "row"])

    return run


def products(rows: DataFrame, genes: int) -> DataFrame:
    """(i, j, n, s, q) for all gene positions: cells, sum of x_i and sum of x_i * x_j over all cells.

    Blocks of ``GENE_BLOCK`` genes a side are dealt to passes over the cells, so many to a pass as ``HELD_DOUBLES``
    allow. A pass runs in so few tasks that what they hand on is no more than the non-zeros they read.
    """
    nnz, n = rows.agg(F.sum(F.size("indices")), F.count(F.lit(1))).first()
    block = min(GENE_BLOCK, genes)
    sides = -(-genes // block)
    pairs = [(a, b) for a in range(sides) for b in range(a, sides)]
    each = max(1, HELD_DOUBLES // (block * block))
    tasks = max(1, min((nnz or 0) // (genes * genes), rows.sparkSession.sparkContext.defaultParallelism))
    found = [rows.select("indices", "data").coalesce(tasks).mapInArrow(_block_sums(pairs[k:k + each], genes, block), "i int, j0 int, row array<double>")
             for k in range(0, len(pairs), each)]
    part = reduce(DataFrame.unionByName, found).select("i", "j0", F.posexplode("row").alias("_j", "q")).where("q <> 0")
    upper = part.withColumn("j", F.col("j0") + F.col("_j"))
    # blocks on the diagonal hold both triangles, the others one
    other = upper.where(F.floor(F.col("i") / block) != F.floor(F.col("j") / block)).select(F.col("j").alias("i"), F.col("i").alias("j"), "q")
    spread = F.expr(f"sequence(0, {genes - 1})")
    empty = rows.sparkSession.range(genes).select(F.col("id").cast("int").alias("i"), F.explode(spread).alias("j"), F.lit(0.0).alias("q"))
    q = upper.select("i", "j", "q").unionByName(other).unionByName(empty).groupBy("i", "j").agg(F.sum("q").alias("q"))
    own = rows.select(F.explode(F.arrays_zip("indices", "data")).alias("e")).groupBy(F.col("e.indices").alias("i")).agg(F.sum("e.data").alias("s"))
    return q.join(own, "i", "left").select("i", "j", F.lit(n).cast("bigint").alias("n"), F.coalesce("s", F.lit(0.0)).alias("s"), "q")


def correlations(rows: DataFrame, genes: int) -> DataFrame:
    """(i, j, r): Pearson r of all genes, the means taken off the products afterwards; null where a gene never varies."""
    found = cut_lineage(products(rows, genes))
    n, mean = F.col("n"), F.col("s") / F.col("n")
    own = found.where("i = j").select(F.col("i").alias("g"), mean.alias("m"), F.sqrt(F.greatest(F.col("q") / n - mean * mean, F.lit(0.0))).alias("d"))
    left, right = (own.select(F.col("g").alias(c), F.col("m").alias(f"m{c}"), F.col("d").alias(f"d{c}")) for c in "ij")
    return found.join(left, "i").join(right, "j").select(
        "i", "j", F.try_divide(F.col("q") / n - F.col("mi") * F.col("mj"), F.col("di") * F.col("dj")).alias("r"))


# ---- components -------------------------------------------------------------------------------------

class _Cells:
    """Cells of one key out of a batch, dense (``vec``) or sparse, multiplied in slices of bounded size."""

    def __init__(self, batch: pa.RecordBatch, mine: np.ndarray):
        self.count = len(mine)
        if "vec" in batch.schema.names:
            flat = batch.column("vec").take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            self.x: np.ndarray | None = flat.reshape(self.count, -1)
            return
        self.x = None
        row, i, v = _flat(batch)
        number = np.full(batch.num_rows, -1)
        number[mine] = np.arange(self.count)
        pick = number[row] >= 0
        self.row, self.i, self.v = number[row[pick]], i[pick], v[pick]

    def sums(self, genes: int) -> np.ndarray:
        return np.bincount(self.i, self.v, genes) if self.x is None else self.x.sum(0)

    def times(self, q: np.ndarray) -> np.ndarray:
        if self.x is not None:
            return self.x @ q
        return self._gathered(np.arange(len(self.i)), self.row, self.i, q, np.zeros((self.count, q.shape[1])))

    def turned(self, y: np.ndarray, total: np.ndarray) -> None:
        """total += cells transposed times y."""
        if self.x is not None:
            total += self.x.T @ y
        else:
            self._gathered(np.argsort(self.i, kind="stable"), self.i, self.row, y, total)

    def _gathered(self, order: np.ndarray, to: np.ndarray, source: np.ndarray, m: np.ndarray, out: np.ndarray) -> np.ndarray:
        step = max(1, PAIRS // max(1, m.shape[1]))
        for k in range(0, len(order), step):
            o = order[k:k + step]
            heads = np.flatnonzero(np.concatenate([[True], to[o][1:] != to[o][:-1]]))
            out[to[o][heads]] += np.add.reduceat(self.v[o, None] * m[source[o]], heads)
        return out


def _by_key(batch: pa.RecordBatch, keys: list[str], known: dict) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the key, its rows) for the keys of this pass."""
    columns = [batch.column(c).to_pylist() for c in keys]
    of = np.array([known.get(k, -1) for k in zip(*columns)] if keys else [0] * batch.num_rows, np.int64)
    for k in np.unique(of[of >= 0]).tolist():
        yield k, np.flatnonzero(of == k)


def _rows_out(kind: int, k: int, m: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    whole = lambda x: pa.array(np.full(len(at), x, np.int32))
    return pa.RecordBatch.from_arrays([whole(kind), whole(k), pa.array(at.astype(np.int32)), pa.array(list(m), pa.list_(pa.float64()))], ["kind", "k", "i", "row"])


def _of_keys(df: DataFrame, keys: list[str], chosen: list[tuple]) -> DataFrame:
    if not keys:
        return df
    return df.where(reduce(Column.__or__, [reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(keys, k)]) for k in chosen]))


class _Pass:
    """The cells of some keys, read once per call; few enough tasks that they hand on no more than they read."""

    def __init__(self, cells: DataFrame, keys: list[str], chosen: list[tuple], entries: int, genes: int):
        held = [c for c in ("vec", "indices", "data") if c in cells.columns]
        self.cells, self.keys, self.genes, self.entries = _of_keys(cells, keys, chosen).select(*keys, *held), keys, genes, entries
        self.known = {k: at for at, k in enumerate(chosen)}

    def _dealt(self, width: int) -> DataFrame:
        parallel = self.cells.sparkSession.sparkContext.defaultParallelism
        return self.cells.coalesce(max(1, min(self.entries // (len(self.known) * self.genes * width), parallel)))

    def sums(self) -> list[np.ndarray]:
        keys, known, genes = self.keys, self.known, self.genes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict = {}
            for batch in batches:
                for k, mine in _by_key(batch, keys, known):
                    total[k] = total.get(k, 0.0) + _Cells(batch, mine).sums(genes)
            for k, s in total.items():
                yield _rows_out(0, k, s[:, None], np.arange(genes))

        out = [np.zeros(genes) for _ in known]
        part = self._dealt(1).mapInArrow(run, _SHAPE)
        got = part.groupBy("k", "i").agg(F.sum(F.col("row")[0]).alias("s")).toArrow()
        k, i, s = (got[c].to_numpy() for c in ("k", "i", "s"))
        for at, m in enumerate(out):
            m[i[k == at]] = s[k == at]
        return out

    def multiplied(self, bases: list[np.ndarray], means: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per key: sum of x (x - mean) Q (genes x directions), and the triangle R of a QR of all rows (x - mean) Q.

        Sums meet in a grouped sum. Triangles are stacked and factored again, first in ``_TREES`` groups, then in one.
        """
        keys, known = self.keys, self.known
        sent = self.cells.sparkSession.sparkContext.broadcast((bases, [m @ q for m, q in zip(means, bases)]))  # SENT_DOUBLES at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bases, shifts = sent.value
            sums: dict = {}
            triangles: dict = {}
            for batch in batches:
                for k, mine in _by_key(batch, keys, known):
                    cells = _Cells(batch, mine)
                    y = cells.times(bases[k]) - shifts[k]
                    cells.turned(y, sums.setdefault(k, np.zeros(bases[k].shape)))
                    triangles[k] = np.linalg.qr(np.vstack([triangles.get(k, y[:0]), y]), mode="r")
            for k, m in sums.items():
                at = np.flatnonzero(m.any(1))
                yield _rows_out(0, k, m[at], at)
                yield _rows_out(1, k, triangles[k], np.arange(len(triangles[k])))

        found = cut_lineage(self._dealt(max(b.shape[1] for b in bases)).mapInArrow(run, _SHAPE).withColumn("tree", F.spark_partition_id() % _TREES))
        w = [np.zeros(b.shape) for b in bases]
        entries = found.where("kind = 0").select("k", "i", F.posexplode("row").alias("j", "x")).groupBy("k", "i", "j").agg(F.sum("x").alias("x"))
        got = entries.toArrow()  # SENT_DOUBLES at most
        k, i, j, x = (got[c].to_numpy() for c in ("k", "i", "j", "x"))
        for at, m in enumerate(w):
            own = k == at
            m[i[own], j[own]] = x[own]

        def stacked(table: pa.Table) -> pa.Table:
            m = np.linalg.qr(np.array(table["row"].to_pylist()), mode="r")
            return pa.table({"k": pa.repeat(table["k"][0], len(m)), "row": pa.array(list(m), pa.list_(pa.float64()))})

        tri = found.where("kind = 1").groupBy("k", "tree").applyInArrow(stacked, "k int, row array<double>")
        rows: list[list] = [[] for _ in bases]
        for r in tri.groupBy("k").applyInArrow(stacked, "k int, row array<double>").toLocalIterator():
            rows[r.k].append(r.row)
        return w, [np.array(r).reshape(-1, b.shape[1]) for r, b in zip(rows, bases)]


_SHAPE = "kind int, k int, i int, row array<double>"
#: groups in which triangles of the tasks are stacked before they meet
_TREES = 32


def _chosen(sizes: list[tuple[tuple, int]]) -> Iterator[list[tuple]]:
    """Keys in order, as many at a time as ``SENT_DOUBLES`` allow, one at least."""
    held: list[tuple] = []
    total = 0
    for key, size in sizes:
        if held and total + size > SENT_DOUBLES:
            yield held
            held, total = [], 0
        held.append(key)
        total += size
    if held:
        yield held


def fit_components(cells: DataFrame, k: int = 50, keys=("split",), genes: int | None = None, tolerance: float = 1e-7) -> DataFrame:
    """Leading principal components per key: (keys, comp, variance, loading, mean).

    ``cells`` holds dense rows ``vec`` or sparse rows ``indices`` and ``data`` (wide panels: a task then holds non-zeros
    and subspaces only). A subspace of k + ``SPARE`` directions, all of them where the panel has no more, is multiplied
    with the centred cells; a tall-skinny QR over the partitions gives its variances, the product what is missing from
    it. The next subspace is the product itself beside the components found, until the covariance moves no component
    off itself by more than ``tolerance`` of the largest variance. As many keys share a pass as ``SENT_DOUBLES`` allow. As many components as cells or genes are
    one too many: the last is left out.
    """
    keys = list(keys)
    spark = cells.sparkSession
    dense = "vec" in cells.columns
    held = F.size("vec" if dense else "indices")
    top = F.max(held) if dense else F.max(F.array_max("indices")) + 1
    info = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(held).alias("_e"), top.alias("_d")).collect()  # one row per key
    genes = genes or max((r["_d"] or 0 for r in info), default=0)
    kinds = dict(cells.dtypes)
    shape = "".join(f"`{c}` {kinds[c]}, " for c in keys) + "comp int, variance double, loading array<double>, mean array<double>"
    counts = {tuple(r[c] for c in keys): (r["_n"], r["_e"]) for r in info}
    out = [spark.createDataFrame([], shape)]
    wide = min(genes, 2 * k + SPARE)
    for chosen in _chosen([(key, genes * wide) for key in counts] if genes else []):
        part = _Pass(cells, keys, chosen, sum(counts[key][1] for key in chosen), genes)
        n = [counts[key][0] for key in chosen]
        means = [s / c for s, c in zip(part.sums(), n)]
        wanted = [max(1, min(k, genes, c) - (1 if k >= min(genes, c) else 0)) for c in n]
        start = np.random.default_rng(0)
        bases = [np.eye(genes) if genes <= k + SPARE else np.linalg.qr(start.standard_normal((genes, k + SPARE)))[0] for _ in chosen]
        done: dict[int, tuple] = {}
        while len(done) < len(chosen):
            open_ = [at for at in range(len(chosen)) if at not in done]
            part = _Pass(cells, keys, [chosen[at] for at in open_], sum(counts[chosen[at]][1] for at in open_), genes)
            for at, w, r in zip(open_, *part.multiplied([bases[a] for a in open_], [means[a] for a in open_])):
                _, scale, turn = np.linalg.svd(r, full_matrices=True)
                turn = turn.T
                variance = np.zeros(turn.shape[1])
                variance[:len(scale)] = scale * scale / n[at]
                vectors, moved = bases[at] @ turn, w @ turn / n[at]
                missing = moved - vectors * variance
                if (np.linalg.norm(missing[:, :wanted[at]], axis=0) <= tolerance * max(variance[0], 1e-300)).all():
                    done[at] = (variance[:wanted[at]], vectors[:, :wanted[at]].T)
                else:
                    bases[at] = np.linalg.qr(np.hstack([moved[:, :k + SPARE], vectors[:, :k]]))[0]
        made = []
        for at, key in enumerate(chosen):
            variance, load = done[at]
            load = load * np.sign(load[np.arange(len(load)), np.abs(load).argmax(1)])[:, None]  # fixed sign
            made += [(*key, c, float(variance[c]), load[c].tolist(), means[at].tolist()) for c in range(len(load))]
        out.append(cut_lineage(spark.createDataFrame(made, shape)))
    return reduce(DataFrame.unionByName, out[1:]) if len(out) > 1 else out[0]


def apply_components(cells: DataFrame, model: DataFrame, keys=("split",)) -> DataFrame:
    """``cells`` with ``vec`` as component scores (in place of ``indices`` and ``data`` where rows are sparse).

    Models are sent to the tasks, as many keys to a pass as ``SENT_DOUBLES`` allow; cells of a key without a model drop out.
    """
    keys = list(keys)
    sizes = [(tuple(r[c] for c in keys), r["_s"]) for r in model.groupBy(*keys).agg(F.sum(F.size("loading")).alias("_s")).collect()]
    kept = [c for c in cells.columns if c not in ("vec", "indices", "data")]
    names = ["vec" if c == "indices" else c for c in cells.columns if c != "data"]
    kinds = dict(cells.dtypes) | {"vec": "array<double>"}
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    out = []
    for chosen in _chosen(sizes):
        parts: dict = {}
        for r in _of_keys(model, keys, chosen).collect():  # SENT_DOUBLES at most
            parts.setdefault(tuple(r[c] for c in keys), []).append((r["comp"], r["loading"], r["mean"]))
        known = {key: at for at, key in enumerate(parts)}
        loads = [np.array([load for _, load, _ in sorted(v)]).T for v in parts.values()]
        sent = cells.sparkSession.sparkContext.broadcast((known, loads, [np.array(v[0][2]) @ load for v, load in zip(parts.values(), loads)]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known, loads, shifts = sent.value
            for batch in batches:
                for k, mine in _by_key(batch, keys, known):
                    scores = _Cells(batch, mine).times(loads[k]) - shifts[k]
                    own = {c: batch.column(c).take(pa.array(mine)) for c in kept}
                    yield pa.RecordBatch.from_arrays([own[c] if c in own else pa.array(list(scores), pa.list_(pa.float64())) for c in names], names)

        out.append(_of_keys(cells, keys, chosen).mapInArrow(run, shape))
    return reduce(DataFrame.unionByName, out) if out else cells.sparkSession.createDataFrame([], shape)
