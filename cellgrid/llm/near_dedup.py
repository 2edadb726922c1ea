"""MinHash near-dedup by ProbMinHash over weighted word shingles.

A text is the multiset of its five-word shingles (A-Z lower-cased; a text of one to four
words is one shingle). In the signature every shingle is a Poisson process whose rate is its
count: arrivals fall on random components, each component keeps its first arrival, and a
shingle stops once its next arrival is later than all that the text still waits for. Two
texts agree in a component with the probability of their probability Jaccard similarity.

Texts with the same shingle multiset are one node. Nodes sharing a band of the signature are
candidates; a link is a candidate pair whose similarity, computed exactly from both whole
texts, reaches the threshold. A bucket is never expanded into all its pairs. First every
node is compared with its bucket's centre, the node that meets most others over all bands,
which joins most of a group at once. Then, in each bucket, only nodes outside the bucket's
largest component are left: they are matched with the whole bucket in blocks of bounded
size, by their signatures, and pairs that agree in at least ``AGREE`` components are compared:
each such node's ``BEST`` likeliest partners first, and all of them if it then still stands
apart. A pair at the threshold fails to share a band with probability 2e-5 and fails to
agree so often with probability 4e-5; nothing else is left out.

Defined results: null and empty texts, and texts of blanks, have no shingle and are alone in
their class; rows equal in id and text share one class; a null id ranks as 0; empty tables
give empty tables; other columns are ignored, and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import BLANKS, SubstringHash, chunks, keyed, mix, text_view
from cellgrid.llm.graphs import components
from cellgrid.session import cut_lineage

WORDS = 5
THRESHOLD = 0.8
#: bands times rows of the signature, and its components in all
BANDS, ROWS, SIZE = 36, 6, 432
#: components in which a pair must agree to be compared: four standard deviations below the threshold
AGREE = 312
#: partners of a node that are compared before all others, and nodes in a block
BEST, BLOCK = 6, 256

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(data: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count) of the distinct shingles of every row of a byte view, rows ascending."""
    data = _LOWER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    word = ~_BLANK[data]
    begins = np.flatnonzero(word & (~np.concatenate([[False], word])[:len(data)] | edge[:len(data)]))
    ends = np.flatnonzero(word & (~np.concatenate([word, [False]])[1:] | edge[1:])) + 1
    row = np.searchsorted(offs, begins, "right") - 1
    hashes = SubstringHash(data).of(begins, ends)
    n = np.bincount(row, minlength=len(offs) - 1)
    first = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        def chain(at: np.ndarray, length: int) -> np.ndarray:
            h = np.zeros(len(at), np.uint64)
            for i in range(length):
                h = mix(h + hashes[at + i])
            return h

        inside = np.flatnonzero((first + n)[row] - np.arange(len(row)) >= words) if len(row) else np.zeros(0, np.int64)
        out_row, out_hash = [row[inside]], [chain(inside, words)]
        for length in range(1, words):
            short = np.flatnonzero(n == length)
            out_row.append(short)
            out_hash.append(chain(first[short], length))
        rows, values = np.concatenate(out_row), np.concatenate(out_hash)
        key = mix(values + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, where, count = np.unique(key, return_index=True, return_counts=True)
    rows, values = rows[where], values[where]
    order = np.argsort(rows, kind="stable")
    return rows[order], values[order], count[order]


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, size: int) -> np.ndarray:
    """ProbMinHash signatures, ``n`` by ``size``; rows without shingles stay zero."""
    best = np.full(n * size, np.inf)
    arrivals = np.zeros(len(row))
    live = np.arange(len(row))
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = 0
    with np.errstate(over="ignore"):
        while len(live):
            step += 1
            random = mix(shingle[live] + np.uint64(step) * np.uint64(0xA24BAED4963EE407))
            arrivals[live] -= np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / count[live]
            cell = row[live] * size + (mix(random ^ np.uint64(0x9FB21C651E98DF25)) % np.uint64(size)).astype(np.int64)
            x = arrivals[live]
            early = x < best[cell]
            np.minimum.at(best, cell[early], x[early])
            seen.append((cell[early], x[early], shingle[live][early]))
            live = live[x < best.reshape(n, size).max(axis=1)[row[live]]]
    out = np.zeros(n * size, np.uint64)
    for cell, x, value in seen:
        won = best[cell] == x
        out[cell[won]] = value[won]
    return out.reshape(n, size)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two weighted sets given as (sorted ids, weights)."""
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])] = a[1]
    y[np.searchsorted(every, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    low = np.searchsorted(ratio, ratio, "left")
    before = np.concatenate([[0.0], np.cumsum(y)])
    behind = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])
    both = (x > 0) & (y > 0)
    return float((1.0 / (behind[low[both]] / x[both] + before[low[both]] / y[both])).sum())


def signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_id, _th, _doc, _fa, _fb, _n, _bands, _sig): multiset fingerprint, shingle count, band keys and a byte per component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text", 2 << 20):
            n = part.num_rows
            row, shingle, count = shingles(*text_view(part.column("_text")))
            whole = signatures(row, shingle, count, n, SIZE)
            sig = whole[:, :BANDS * ROWS].reshape(n, BANDS, ROWS)
            fa, fb = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            with np.errstate(over="ignore"):
                weight = count.astype(np.uint64)
                np.add.at(fa, row, mix(shingle) * weight)
                np.add.at(fb, row, mix(shingle ^ np.uint64(0x5851F42D4C957F2D)) * weight)
                key = np.zeros((n, BANDS), np.uint64)
                for i in range(ROWS):
                    key = mix(key + sig[:, :, i])
                key = mix(key + np.arange(BANDS, dtype=np.uint64))
            total = np.bincount(row, weights=count, minlength=n).astype(np.int64)
            short = (mix(whole) & np.uint64(255)).astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)),
                                             pa.array(key.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("_th"), part.column("_doc"), pa.array(fa.view(np.int64)),
                 pa.array(fb.view(np.int64)), pa.array(total), lists, pa.array([x.tobytes() for x in short], pa.binary())],
                ["_id", "_th", "_doc", "_fa", "_fb", "_n", "_bands", "_sig"])

    return keyed(docs, doc_id, text).mapInArrow(
        run, "_id bigint, _th bigint, _doc bigint, _fa bigint, _fb bigint, _n bigint, _bands array<bigint>, _sig binary")


def texts_of(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, text) of the given nodes: the one shuffle of whole texts, planned alike at every size."""
    wanted = nodes.select("node", F.col("node._id").alias("_id"), F.col("node._th").alias("_th"))
    return cut_lineage(rows.select("_id", "_th", "_text").join(wanted.hint("merge"), ["_id", "_th"])
                       .groupBy("node").agg(F.first("_text").alias("text")))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose exact similarity reaches the threshold, with ``similarity``."""
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("_ta")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("_tb")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
            coded = column.dictionary_encode()  # a text stands in many pairs
            row, shingle, count = shingles(*text_view(coded.dictionary))
            ends = np.searchsorted(row, np.arange(len(coded.dictionary) + 1))
            each = []
            for s, e in zip(ends, ends[1:], strict=False):
                order = np.argsort(shingle[s:e])
                each.append((shingle[s:e][order], count[s:e][order].astype(np.float64)))
            return [each[i] for i in coded.indices.to_pylist()]

        for half in chunks(batches, "_ta", 1 << 20):
            for part in chunks(iter([half]), "_tb", 1 << 20):
                same = [probability_jaccard(x, y) for x, y in zip(sets(part.column("_ta")), sets(part.column("_tb")), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(same, pa.float64())], ["a", "b", "similarity"])

    return both.select("a", "b", "_ta", "_tb").mapInArrow(run, f"a {_NODE}, b {_NODE}, similarity double").where(
        F.col("similarity") >= THRESHOLD - 1e-12)


_NODE = "struct<_id:bigint,_th:bigint>"


def likely_pairs(held: DataFrame, nodes: DataFrame, labels: DataFrame, best: int | None) -> DataFrame:
    """(a, b): pairs of one bucket but different components whose signatures agree often enough.

    Of each node outside its bucket's largest component, the ``best`` likeliest partners in
    a block, or all. Both sides of a bucket are dealt to a grid of blocks. A pair is given by
    the first band it shares only.
    """
    tagged = cut_lineage(held.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
    per_label = tagged.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = per_label.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("n")).where("top.c < n")
    grid = largest.select("key", F.col("top.label").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"),
                          F.ceil((F.col("n") - F.col("top.c")) / BLOCK).cast("int").alias("na"))
    unsettled = cut_lineage(tagged.join(grid, "key").join(nodes.select("node", "_sig", "_bands"), "node"))

    def dealt(side: int, own: str, other: str) -> DataFrame:
        """Each node in its block of one side, for every block of the other side."""
        rows = unsettled.where("label != main") if side == 0 else unsettled
        rows = rows.withColumn("_own", F.pmod(F.xxhash64("node"), F.col(own)).cast("int")).withColumn(
            "_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        ba, bb = ("_own", "_other") if side == 0 else ("_other", "_own")
        return rows.select("key", F.col(ba).alias("ba"), F.col(bb).alias("bb"), F.lit(side).alias("side"), "node", "label", "_sig", "_bands")

    both = dealt(0, "na", "nb").union(dealt(1, "nb", "na"))
    sorted_blocks = both.repartition("key", "ba", "bb").sortWithinPartitions("key", "ba", "bb", "side")
    numbered = sorted_blocks.select(F.xxhash64("key", "ba", "bb").alias("g"), "side", "node", F.xxhash64("label").alias("l"), "key", "_sig", "_bands")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rows: list[pa.RecordBatch] = []
        for batch in batches:
            held_rows.append(batch)
            table = pa.Table.from_batches(held_rows).combine_chunks()
            group = table.column("g").to_numpy()
            new = np.flatnonzero(group[1:] != group[:-1]) + 1
            if len(new):
                yield from matched(table.slice(0, int(new[-1])))
                held_rows = table.slice(int(new[-1])).combine_chunks().to_batches()
            else:
                held_rows = table.to_batches()
        if held_rows:
            yield from matched(pa.Table.from_batches(held_rows))

    def matched(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        group, side, label, key = (table.column(c).to_numpy() for c in ("g", "side", "l", "key"))
        bands = np.array(table.column("_bands").to_pylist(), np.int64).reshape(len(group), BANDS)
        sig = np.frombuffer(b"".join(table.column("_sig").to_pylist()), np.uint8).reshape(len(group), -1)
        bounds = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        left, right = [], []
        for s, e in zip(bounds, bounds[1:], strict=False):
            if s == e:
                continue
            at = np.arange(s, e)
            ours, theirs = at[side[s:e] == 0], at[side[s:e] == 1]
            for i in ours:
                agree = (sig[theirs] == sig[i]).sum(axis=1)
                shared = bands[theirs] == bands[i]
                first = bands[i][shared.argmax(axis=1)]
                agree[(label[theirs] == label[i]) | (first != key[i])] = 0
                picked = np.flatnonzero(agree >= AGREE)
                if best is not None and len(picked) > best:
                    picked = picked[np.argsort(-agree[picked], kind="stable")[:best]]
                left += [i] * len(picked)
                right.append(theirs[picked])
        node = table.column("node")
        node = node.chunk(0) if isinstance(node, pa.ChunkedArray) else node
        right_at = np.concatenate([np.zeros(0, np.int64), *right])
        yield pa.RecordBatch.from_arrays([node.take(pa.array(left, pa.int64())), node.take(pa.array(right_at))], ["a", "b"])

    found = numbered.mapInArrow(run, f"a {_NODE}, b {_NODE}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _th, _doc, _label, _links): one row per row of ``docs``, labelled by the least node of its class."""
    rows = keyed(docs, doc_id, text)
    signed_rows = cut_lineage(signed(docs, doc_id, text))
    nodes = cut_lineage(signed_rows.where("_n > 0").groupBy("_fa", "_fb").agg(
        F.min(F.struct("_id", "_th")).alias("node"), F.first("_bands").alias("_bands"), F.first("_sig").alias("_sig")))
    members = nodes.select("node", F.explode("_bands").alias("key"))
    full = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = cut_lineage(members.join(full, "key"))
    # the centre of a bucket is its node with most company over all bands
    company = held.groupBy("node").agg(F.sum("n").alias("met"))
    ranked = held.select("key", "node").join(company, "node")
    centres = ranked.groupBy("key").agg(F.max(F.struct("met", "node")).alias("c")).select("key", F.col("c.node").alias("a"))
    pairs = held.join(centres, "key").where("node != a").select(
        F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    held = held.select("key", "node")
    texts = texts_of(company.select("node"), rows)
    links = labels = None
    tested: DataFrame | None = None
    for best in (BEST, None, 0):  # centres, then the likeliest partners, then all others
        pairs = cut_lineage(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            break
        tested = pairs if tested is None else cut_lineage(tested.union(pairs))
        found = verified(pairs, texts)
        links = cut_lineage(found if links is None else links.union(found))
        labels = cut_lineage(components(links))
        if best != 0:
            pairs = likely_pairs(held, nodes, labels, best)
    if labels is None:
        labelled = nodes.select("_fa", "_fb", F.col("node").alias("_label"), F.lit(0).cast("bigint").alias("_links"))
    else:
        ends = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("_links"))
        labelled = nodes.join(labels, "node", "left").join(ends, "node", "left").select(
            "_fa", "_fb", F.coalesce("label", "node").alias("_label"), F.coalesce("_links", F.lit(0)).alias("_links"))
    known = signed_rows.where("_n > 0").join(labelled, ["_fa", "_fb"]).select("_id", "_th", "_doc", "_label", "_links")
    alone = signed_rows.where("_n = 0").select("_id", "_th", "_doc", F.struct("_id", "_th").alias("_label"), F.lit(0).cast("bigint").alias("_links"))
    return known.union(alone)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (least id of the class), n_joins, kept.

    n_joins counts the verified pairs of the row's distinct text that were looked at while the classes were joined;
    pairs whose texts had met in one class by then are not looked at, so it is no degree.
    """
    found = near_classes(docs, doc_id, text)
    return found.select(F.col("_doc").alias(doc_id), F.col("_label._id").alias("class_id"), F.col("_links").alias("n_joins"),
                        (F.struct("_id", "_th") == F.col("_label")).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class, with their own columns; of equal rows one stays."""
    names = docs.columns
    stay = near_classes(docs, doc_id, text).where(F.struct("_id", "_th") == F.col("_label")).select("_id", "_th").distinct()
    whole = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"),
                        F.coalesce(docs[doc_id], F.lit(0)).cast("long").alias("_id"),
                        F.xxhash64(docs[doc_id], docs[text]).alias("_th"))
    return whole.join(stay, ["_id", "_th"]).groupBy("_id", "_th").agg(F.first("_row").alias("_row")).select("_row.*")
