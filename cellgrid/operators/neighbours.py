"""Exact k-nearest-neighbour joins without forming all pairs.

Small reference sides (checked by count) are shipped to the tasks. Larger ones are split
around pivots: every reference row belongs to its nearest pivot's ball, a query row visits
only the balls that its distance bound cannot rule out, crowded balls are cut into blocks
and crowded query lists into salts, and each visit returns at most k rows. The bound is
exact, so no neighbour is lost. Where it rules out so little that a query would be copied to
more balls than there are blocks of all rows, every block of queries meets every block of
rows instead. Distances are held for a bounded number of pairs at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrid.functions.exprs import hash32

#: reference rows (times width) that may be shipped whole to every task
SHIP_ROWS, SHIP_DOUBLES = 200_000, 20_000_000
SLACK = 1e-5
#: lists are cut into no more than ``SPLITS`` blocks before a block holds ``HELD`` rows: every block of one side meets every block of the other
SPLITS, HELD = 8, 20_000
#: queries whose bounds are held at once, and their copies to balls that are sent on at once
ROUTED, COPIES = 1024, 8192


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1.0, norm)


def _distances(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return 1.0 - _unit(q) @ _unit(r).T
    d2 = (q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2.0 * q @ r.T
    return np.sqrt(np.maximum(d2, 0.0))


def _least(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least values of every row, ties by column; NaN must not occur."""
    if d.shape[1] <= k:
        return np.argsort(d, axis=1, kind="stable")
    rows, cols = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1:k])
    order = np.lexsort((cols, d[rows, cols], rows))
    first = np.searchsorted(rows, np.arange(len(d)))
    return cols[order][first[:, None] + np.arange(k)]


def _best(q: np.ndarray, r: np.ndarray, rid: np.ndarray, k: int, metric: str, own: np.ndarray | None, chunk: int = 512, width: int = 8192):
    """Per query row the k nearest reference positions and distances, ties by reference id.

    Distances are held for ``chunk`` queries and ``width`` references at a time, with the k best so far before them.
    """
    by_id = np.argsort(rid, kind="stable")
    r, rid = r[by_id], rid[by_id]
    for a in range(0, len(q), chunk):
        part = q[a:a + chunk]
        at, best = np.empty((len(part), 0), np.int64), np.empty((len(part), 0))
        for b in range(0, len(r), width):
            d = np.round(_distances(part, r[b:b + width], metric), 6)
            d[np.isnan(d)] = np.inf  # no neighbour
            if own is not None:
                d[own[a:a + chunk][:, None] == rid[None, b:b + width]] = np.inf
            seen = at.shape[1]
            d = np.concatenate([best, d], axis=1) if seen else d
            pick = _least(d, k)
            best = np.take_along_axis(d, pick, 1)
            old = np.take_along_axis(at, np.minimum(pick, seen - 1), 1) if seen else pick
            at = np.where(pick < seen, old, pick - seen + b)
        yield a, by_id[at], best


def _emit(qpdf: pd.DataFrame, q, rpdf: pd.DataFrame, r, keys, k, metric, skip_self):
    frames = []
    ids = rpdf["ref_id"].to_numpy()
    own = qpdf["query_id"].to_numpy() if skip_self else None
    for a, pos, dist in _best(q, r, ids, k, metric, own):
        n, w = pos.shape
        rows = np.repeat(np.arange(a, a + n), w)
        out = {c: qpdf[c].to_numpy()[rows] for c in [*keys, "query_id"]}
        out["ref_id"], out["label"] = ids[pos.ravel()], rpdf["label"].to_numpy()[pos.ravel()]
        out["dist"] = dist.ravel()
        frames.append(pd.DataFrame(out)[np.isfinite(dist.ravel())])
    return pd.concat(frames) if frames else None


def _blocks(n: Column, block: int) -> Column:
    """Number of blocks of a list of ``n`` rows."""
    return F.ceil(n / F.greatest(F.lit(block), F.least(F.lit(HELD), F.ceil(n / SPLITS)))).cast("int")


def _stack(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["vec"].to_numpy())


def knn_join(query: DataFrame, ref: DataFrame, k: int = 5, metric: str = "cosine", keys: list[str] | None = None,
             skip_self: bool = False, ship_rows: int = SHIP_ROWS, pivots: int = 256, block: int = 20_000) -> DataFrame:
    """query(keys, query_id, vec) x ref(keys, ref_id, label, vec) -> (keys, query_id, ref_id, label, dist, rank)."""
    keys = keys or []
    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in query.schema if f.name in keys)
    types = {f.name: f.dataType.simpleString() for f in ref.schema}
    qtype = dict((f.name, f.dataType.simpleString()) for f in query.schema)["query_id"]
    schema = head + f"query_id {qtype}, ref_id {types['ref_id']}, label {types['label']}, dist double"
    size = ref.limit(ship_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("w")).first()
    if size["n"] <= ship_rows and size["n"] * (size["w"] or 0) <= SHIP_DOUBLES:
        found = _shipped(query, ref, k, metric, keys, skip_self, schema)
    else:
        found = _partitioned(query, ref, k, metric, keys, skip_self, schema, types, pivots, block)
    order = Window.partitionBy(*keys, "query_id").orderBy("dist", "ref_id")  # a few multiples of k rows
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _shipped(query, ref, k, metric, keys, skip_self, schema):
    pdf = ref.select(*keys, "ref_id", "label", "vec").toPandas()  # row count checked by the caller
    groups = {}
    for key, g in (pdf.groupby(keys, sort=False) if keys else [((), pdf)]):
        if len(g):
            groups[key if isinstance(key, tuple) else (key,)] = (g.drop(columns="vec").reset_index(drop=True), _stack(g))
    sent = query.sparkSession.sparkContext.broadcast(groups)

    def scan(batches):
        for qpdf in batches:
            for key, g in (qpdf.groupby(keys, sort=False) if keys else [((), qpdf)]):
                hit = sent.value.get(key if isinstance(key, tuple) else (key,))
                if hit is not None and len(g):
                    out = _emit(g.reset_index(drop=True), _stack(g), hit[0], hit[1], keys, k, metric, skip_self)
                    if out is not None:
                        yield out

    # dealt to all tasks: the work is queries times references, whatever files the queries came from
    spread = query.select(*keys, "query_id", "vec").repartition(int(query.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInPandas(scan, schema)


def _partitioned(query, ref, k, metric, keys, skip_self, schema, types, pivots, block):
    """Pivot balls with exact pruning. Cosine ranks like the Euclidean distance of unit vectors."""
    spark = query.sparkSession
    space = (lambda x: _unit(x)) if metric == "cosine" else (lambda x: x)
    sampled = ref.select(*keys, "ref_id", "vec", hash32(F.col("ref_id"), F.lit("pivot")).alias("_h"))
    # one pivot per hash slice and key: ``pivots`` rows per key whatever the size of ref
    sampled = sampled.withColumn("_b", F.floor(F.col("_h") / (2 ** 32 / pivots)))
    chosen = (sampled.groupBy(*keys, "_b").agg(F.min_by("vec", F.struct("_h", "ref_id")).alias("vec")))
    n_piv = chosen.count()
    if n_piv > 100_000:
        raise ValueError("too many key groups for driver-side pivots; lower ``pivots``")
    pdf = chosen.toPandas()
    table = {}
    for key, g in (pdf.groupby(keys, sort=False) if keys else [((), pdf)]):
        table[key if isinstance(key, tuple) else (key,)] = space(_stack(g))
    piv = spark.sparkContext.broadcast(table)
    khead = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in query.schema if f.name in keys)

    def assign(batches):
        for rpdf in batches:
            for key, g in (rpdf.groupby(keys, sort=False) if keys else [((), rpdf)]):
                if len(g):
                    d = _distances(space(_stack(g)), piv.value[key if isinstance(key, tuple) else (key,)], "euclidean")
                    yield g.assign(ball=d.argmin(1).astype("int32"), radius=d.min(1))

    rschema = khead + f"ref_id {types['ref_id']}, label {types['label']}, vec array<double>, ball int, radius double"
    balls = ref.select(*keys, "ref_id", "label", F.col("vec").cast("array<double>").alias("vec")).mapInPandas(assign, rschema)
    small = Window.partitionBy(*keys, "ball", "_s").orderBy("radius", "ref_id")
    # the k rows nearest each pivot, first within 64 hash slices, then over their survivors
    near = (balls.select(*keys, "ball", "ref_id", "radius", F.pmod(hash32(F.col("ref_id")), F.lit(64)).alias("_s"))
            .withColumn("_r", F.row_number().over(small)).where(F.col("_r") <= k + 1))
    # size of the stats: pivots x (k+1) numbers
    stats = near.groupBy(*keys, "ball").agg(F.slice(F.sort_array(F.collect_list("radius")), 1, k + 1).alias("near"))
    sizes = balls.groupBy(*keys, "ball").agg(F.max("radius").alias("reach"), F.count(F.lit(1)).alias("n"))
    bounds: dict = {}
    for r in stats.join(sizes, [*keys, "ball"]).collect():
        bounds.setdefault(tuple(r[c] for c in keys), []).append((r["ball"], r["near"], r["reach"]))
    sent = spark.sparkContext.broadcast({key: (np.array([b for b, _, _ in v]), [n for _, n, _ in v], np.array([m for _, _, m in v]))
                                         for key, v in bounds.items()})
    need = k + 1 if skip_self else k

    def visited(batches):
        """(key, queries, ball numbers, which query visits which ball) for a bounded number of queries at a time."""
        for qpdf in batches:
            for key, g in (qpdf.groupby(keys, sort=False) if keys else [((), qpdf)]):
                key = key if isinstance(key, tuple) else (key,)
                if key not in sent.value or not len(g):
                    continue
                ids, near_lists, reach = sent.value[key]
                for a in range(0, len(g), ROUTED):
                    part = g.iloc[a:a + ROUTED]
                    d = _distances(space(_stack(part)), piv.value[key][ids], "euclidean")
                    upper = np.concatenate([d[:, [j]] + np.array(n)[None, :] for j, n in enumerate(near_lists)], axis=1)
                    pos = min(need, upper.shape[1]) - 1
                    limit = np.partition(upper, pos, axis=1)[:, pos] if upper.shape[1] > need else np.full(len(part), np.inf)
                    yield key, part, ids, d - reach[None, :] <= limit[:, None] + SLACK

    def route(batches):
        for _, part, ids, visit in visited(batches):
            rows, cols = np.nonzero(visit)
            for a in range(0, len(rows), COPIES):
                yield part.iloc[rows[a:a + COPIES]].assign(ball=ids[cols[a:a + COPIES]].astype("int32"))

    def tally(batches):
        """Visits and queries only: the copies themselves may be far more than the rows."""
        for key, part, _, visit in visited(batches):
            yield pd.DataFrame([(*key, int(visit.sum()), len(part))], columns=[*keys, "_v", "_q"])

    qschema = khead + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in query.schema if f.name == "query_id") + ", vec array<double>, ball int"
    cells = [*keys, "ball"]
    whole = query.select(*keys, "query_id", F.col("vec").cast("array<double>").alias("vec"))
    visits = whole.mapInPandas(route, qschema)
    met = whole.mapInPandas(tally, khead + "_v long, _q long").groupBy(*keys).agg(F.sum("_v").alias("_v"), F.sum("_q").alias("_q"))
    rows = sizes.groupBy(*keys).agg(F.sum("n").alias("_n"))
    cost = (met.join(rows, keys) if keys else met.crossJoin(rows)).agg(F.sum("_v").alias("v"), F.sum(F.col("_q") * _blocks(F.col("_n"), block)).alias("b")).first()
    if cost["v"] is not None and cost["v"] > cost["b"]:
        # the bound rules out little: a query would be copied to more balls than there are blocks of all rows
        visits = whole.withColumn("ball", F.lit(0))
        balls = ref.select(*keys, "ref_id", "label", F.col("vec").cast("array<double>").alias("vec"), F.lit(0).alias("ball"))
        sizes = ref.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("ball", F.lit(0))
    blocks = sizes.select(*cells, _blocks(F.col("n"), block).alias("_nb"))
    crowd = visits.groupBy(*cells).agg(_blocks(F.count(F.lit(1)), block).alias("_ns"))
    plan = blocks.join(crowd, cells)
    last = F.lit(0)
    left = (visits.join(plan, cells).withColumn("block", F.explode(F.sequence(last, F.col("_nb") - 1)))
            .withColumn("salt", F.pmod(hash32(F.col("query_id")), F.col("_ns")).cast("int")).drop("_nb", "_ns"))
    right = (balls.drop("radius").join(plan, cells).withColumn("salt", F.explode(F.sequence(last, F.col("_ns") - 1)))
             .withColumn("block", F.pmod(hash32(F.col("ref_id")), F.col("_nb")).cast("int")).drop("_nb", "_ns"))
    group = [*cells, "block", "salt"]

    def match(qpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) and len(rpdf):
            out = _emit(qpdf.reset_index(drop=True), _stack(qpdf), rpdf.reset_index(drop=True), _stack(rpdf), keys, k, metric, skip_self)
            if out is not None:
                return out
        return pd.DataFrame(columns=[*keys, "query_id", "ref_id", "label", "dist"])

    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(match, schema)


def knn_classify(test: DataFrame, train: DataFrame, k: int = 5, metric: str = "cosine", keys: list[str] | None = None, **how) -> DataFrame:
    """Majority vote of the k nearest; ties go to the smallest label. test/train(keys, cell_id, label, vec)."""
    keys = keys or []
    q = test.select(*keys, F.col("cell_id").alias("query_id"), "vec")
    r = train.select(*keys, F.col("cell_id").alias("ref_id"), "label", "vec")
    votes = knn_join(q, r, k, metric, keys, **how).groupBy(*keys, "query_id", "label").agg(F.count(F.lit(1)).alias("_n"))
    best = votes.groupBy(*keys, "query_id").agg(F.min_by("label", F.struct(-F.col("_n"), F.col("label"))).alias("pred"))
    return best.withColumnRenamed("query_id", "cell_id")


def knn_graph(points: DataFrame, k: int = 15, metric: str = "euclidean", **how) -> DataFrame:
    """Undirected edges (a < b) between each point and its k nearest others. points(cell_id, vec)."""
    q = points.select(F.col("cell_id").alias("query_id"), "vec")
    r = points.select(F.col("cell_id").alias("ref_id"), F.lit("").alias("label"), "vec")
    e = knn_join(q, r, k, metric, skip_self=True, **how)
    return e.select(F.least("query_id", "ref_id").alias("a"), F.greatest("query_id", "ref_id").alias("b")).distinct()
