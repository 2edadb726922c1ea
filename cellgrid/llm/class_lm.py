"""Class-based bigram language model with exchange clustering (Brown classes).

P(text) is the product over its tokens of P(class | previous class) * P(token | class). All
counts cover all training texts:

* every word's count is kept in a table that grows with the corpus;
* words that occur ``LEAST`` times or more, however many these are, get classes by exchange:
  their neighbours are written once, as packed lists, many words to a row; in each round half of the words
  move, each to the class that raises the mutual information of adjacent classes most; rounds
  end when ``PATIENCE`` in a row have not raised it, and the best round is kept;
* other words belong to fixed classes by their shape (length, last character), within which
  they are told apart by their counts.

Words with at least ``SENT`` of the tokens (at most 1 / SENT words), and all clustered ones
while these are at most ``LISTED``, are looked up in a broadcast list; all others, clustered or not, are joined with the count table, in training
and in scoring. Besides that list the driver holds one byte per clustered word, its class.

Words are known by 64-bit hashes. Defined results: null text is empty and holds the end
token alone; with no training text every token has probability 1 in the base score and the
model falls back to even classes; rows equal in id and text are scored each on its own;
empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrid.llm.common import HashIndex, SubstringHash, chunks, id_crc_mod, lowered, mix, text_view, word_bounds
from cellgrid.session import cut_lineage

#: least count of a word that is clustered
LEAST = 20
#: least share of a word whose count is broadcast: at most 5 000 000 words
SENT = 2e-7
#: clustered words that are broadcast whole, whatever their share, at most
LISTED = 2_000_000
#: classes made by exchange, and fixed classes by shape
CLASSES, SHAPES = 32, 16
#: rounds in a row without a rise of the information after which exchange ends
PATIENCE = 2
#: neighbours of a word that a task meets at most, about; words that may have more are cut into blocks
BLOCK = 1 << 16
#: tokens whose neighbours one task merges, about; tokens or neighbours held unsorted; neighbours to a row of the exchange table, about
PART, HELD, ROW = 1 << 20, 1 << 21, 1 << 18
#: parts written as one file of the exchange table
FILE = 4
#: counts up to which the gain beside a class is looked up
FEW = 8
#: class 0 and type 0 are the end token; shapes follow, then clustered words
ALL_CLASSES = 1 + SHAPES + CLASSES


def word_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, shape) of every word of a byte view."""
    data = lowered(data)
    begins, ends, row = word_bounds(data, offs)
    keys = SubstringHash(data).of(begins, ends).view(np.int64)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    mark = (last < 128) & ~((last >= 97) & (last <= 122))
    return row, keys, np.minimum((ends - begins) // 2, SHAPES // 2 - 1) * 2 + mark


def word_counts(texts: DataFrame) -> DataFrame:
    """(key, shape, c): the count of every word of the column _text; a task sends each word once per block of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(parts):
            keys, shapes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            unique, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
            return unique, shapes[where], np.bincount(inverse, counts).astype(np.int64)

        held, size = [], 0
        for part in chunks(batches, "_text", 1 << 20):
            _, keys, shape = word_keys(*text_view(part.column("_text")))
            held.append(table([(keys, shape, np.ones(len(keys)))]))
            size += len(held[-1][0])
            if size > 2_000_000:
                held = [table(held)]
                size = len(held[0][0])
                if size > 1_500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["key", "shape", "c"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in table(held)], ["key", "shape", "c"])

    return texts.mapInArrow(run, "key bigint, shape bigint, c bigint").groupBy("key").agg(
        F.max("shape").cast("int").alias("shape"), F.sum("c").alias("c"))


def token_types(row: np.ndarray, types: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Types of all tokens with the end token after each row, and the row of each."""
    ends = np.cumsum(np.bincount(row, minlength=n))
    return np.insert(types, ends, 0), np.insert(row, ends, np.arange(n))


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with type: 1 + SHAPES for the most frequent, and so on; ties are ordered by key."""
    order = [F.col("c").desc(), F.col("key")]
    dealt = cut_lineage(words.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_place", place).join(F.broadcast(starts), "_part").select(
        *words.columns, (F.col("_start") + F.col("_place") + F.lit(SHAPES)).alias("type"))


def bigram_counts(texts: DataFrame, lexicon: Lexicon, counts: DataFrame) -> DataFrame:
    """The neighbours of each type with their counts, as ``Links.lists``; the two types of a pair meet in both their lists."""
    links = lexicon.links
    if lexicon.partial:
        rows = open_bigrams(texts, lexicon, counts)
        sent = rows.mapInArrow(links.of_pairs, "part int, links binary")
    else:
        shared = texts.sparkSession.sparkContext.broadcast(lexicon)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here = shared.value
            index = HashIndex(here.keys[:here.clustered])
            held, size = [], 0
            for part in chunks(batches, "_text", 1 << 18):
                row, keys, shape = word_keys(*text_view(part.column("_text")))
                at = index.find(keys)
                held.append(token_types(row, np.where(at >= 0, at + 1 + SHAPES, shape + 1), part.num_rows)[0].astype(np.int32))
                size += len(held[-1])
                if size > HELD:
                    yield from links.of_tokens(np.concatenate(held))
                    held, size = [], 0
            if held:
                yield from links.of_tokens(np.concatenate(held))

        sent = texts.mapInArrow(run, "part int, links binary")
    lists = sent.repartitionById(links.parts, F.col("part")).mapInArrow(
        links.lists, "kind int, words binary, left binary, right binary, edge binary")
    # parts are merged one by one, but FILE of them are written as one file: each round starts a task or two per file
    return lists.coalesce(max(min(links.parts, FILE), links.parts // FILE))


def open_bigrams(texts: DataFrame, lexicon: Lexicon, counts: DataFrame) -> DataFrame:
    """(a, b, n): counts of adjacent types; words that the broadcast list lacks are joined with ``counts``."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = shared.value
        index = HashIndex(here.keys[:here.clustered])

        def table(parts):
            rows = [np.concatenate(x) for x in zip(*parts, strict=True)]
            order = np.lexsort(rows[3::-1])
            rows = [x[order] for x in rows]
            new = np.ones(len(order), bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in rows[:4]], axis=0)
            return *(x[new] for x in rows[:4]), np.bincount(np.cumsum(new) - 1, rows[4]).astype(np.int64)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["a", "b", "a_open", "b_open", "n"])

        held, size = [], 0
        for part in chunks(batches, "_text", 1 << 20):
            row, keys, shape = word_keys(*text_view(part.column("_text")))
            at = index.find(keys)
            # a word outside the list stands with its key, and its shape's type as mark
            away = at < 0
            tokens, _ = token_types(row, np.where(away, keys, at + 1 + SHAPES), part.num_rows)
            marks, _ = token_types(row, np.where(away, shape + 1, 0), part.num_rows)
            held.append(table([(np.append(0, tokens[:-1]), tokens, np.append(0, marks[:-1]), marks, np.ones(len(tokens)))]))
            size += len(held[-1][0])
            if size > 1_000_000:
                held = [table(held)]
                size = len(held[0][0])
                if size > 600_000:
                    yield batch(held[0])
                    held, size = [], 0
        if held:
            yield batch(table(held))

    rows = texts.mapInArrow(run, "a bigint, b bigint, a_open bigint, b_open bigint, n bigint")
    rows = rows.groupBy("a", "b", "a_open", "b_open").agg(F.sum("n").alias("n"))
    names = counts.where(F.col("type").isNotNull())
    for side in ("a", "b"):
        found = names.select(F.col("key").alias(side), F.col("type").alias("_type"))
        away = rows.where(F.col(f"{side}_open") > 0).join(found, side, "left").withColumn(
            side, F.coalesce("_type", f"{side}_open")).select(rows.columns)
        rows = rows.where(F.col(f"{side}_open") == 0).unionByName(away)
    return rows.groupBy("a", "b").agg(F.sum("n").alias("n"))


@dataclass
class Links:
    """How neighbours travel: word, side (0 left, 1 right), neighbour and count share one integer.

    Words of types below ``often`` are dealt by ``blocks`` blocks of neighbours (all alike, or as many as stand there for the type),
    others whole, to ``parts`` parts. Pairs of two fixed types stand on the left of the second one.
    """
    types: int
    often: int
    blocks: int | np.ndarray
    parts: int

    @property
    def bits(self) -> int:
        """Bits of a count; larger counts stand more than once."""
        return 63 - (2 * self.types**2).bit_length()

    def packed(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        most = (1 << self.bits) - 1
        times = -(-n // most)
        each = np.full(times.sum(), most, np.int64)
        each[np.cumsum(times) - 1] = n - (times - 1) * most
        return (np.repeat(codes, times) << self.bits) | each

    def summed(self, packed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(code, count) of each link, in order."""
        rows = np.sort(np.concatenate([np.zeros(0, np.int64), *packed]))
        codes, n = rows >> self.bits, rows & ((1 << self.bits) - 1)
        starts = _starts(codes)
        return codes[starts], np.add.reduceat(n, starts) if len(starts) else n

    def sides(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(codes, where these come from) of pairs of types, seen from each of the two."""
        for side, word, other in ((0, b, a), (1, a, b)):
            of = np.flatnonzero((word > SHAPES) | (side == 0) & (other <= SHAPES))
            yield (word[of].astype(np.int64) * 2 + side) * self.types + other[of], of

    def sent(self, codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        word, other = np.divmod(codes, 2 * self.types)
        hot, blocks = np.flatnonzero(word < self.often), np.broadcast_to(self.blocks, self.often)
        part = word % self.parts
        part[hot] = (word[hot] + other[hot] % blocks[word[hot]]) % self.parts
        order = np.argsort(part.astype(np.uint16) if self.parts <= 1 << 16 else part, kind="stable")
        part, codes, n = part[order], codes[order], n[order]
        starts = _starts(part)
        for at, to in zip(starts, np.append(starts, len(part))[1:], strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array([part[at]], pa.int32()), pa.array([self.packed(codes[at:to], n[at:to]).tobytes()], pa.binary())], ["part", "links"])

    def of_tokens(self, tokens: np.ndarray) -> Iterator[pa.RecordBatch]:
        for codes, _ in self.sides(np.append(np.int32(0), tokens[:-1]), tokens):
            codes = np.sort(codes)
            starts = _starts(codes)
            yield from self.sent(codes[starts], np.diff(np.append(starts, len(codes))))

    def of_pairs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(held):
            a, b, n = (np.concatenate(x) for x in zip(*held, strict=True))
            for codes, of in self.sides(a, b):
                yield from self.sent(codes, n[of])

        held, size = [], 0
        for batch in batches:
            held.append([batch.column(x).to_numpy() for x in ("a", "b", "n")])
            size += batch.num_rows
            if size > HELD:
                yield from sent(held)
                held, size = [], 0
        if held:
            yield from sent(held)

    def lists(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (kind, words, left, right, edge): words in order with their neighbours as ``_packed``; about ``ROW`` neighbours to a row.

        Kind 0 are fixed types, 2 the often words, 1 all others. Edge are the fixed types on the right, once more.
        """
        held, size = [], 0
        for batch in batches:
            for links in batch.column("links"):
                held.append(np.frombuffer(links.as_buffer(), np.int64).copy())
                size += len(held[-1])
                if size > HELD:
                    held = [self.packed(*self.summed(held))]
                    size = 0
        codes, n = self.summed(held)
        word, other = np.divmod(codes, 2 * self.types)
        starts = _starts(word)
        first = word[starts]
        kind = np.where(first <= SHAPES, 0, np.where(first < self.often, 2, 1))
        cuts = starts[_starts(starts // ROW * 3 + kind)]
        for at, to in zip(cuts, np.append(cuts, len(word))[1:], strict=True):
            here = starts[np.searchsorted(starts, at):np.searchsorted(starts, to)] - at
            w, o, m = word[at:to], other[at:to], n[at:to]
            row = np.repeat(np.arange(len(here)), np.diff(np.append(here, to - at)))
            right = o >= self.types
            columns = [_packed(row[x], len(here), o[x] - shift, m[x]) for x, shift in (
                (~right, 0), (right, self.types), (right & (o - self.types <= SHAPES), self.types))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind[starts == at], pa.int32()), *(pa.array([x], pa.binary()) for x in (w[here].astype(np.int32).tobytes(), *columns))],
                ["kind", "words", "left", "right", "edge"])


def _starts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])[:len(x)])


def _packed(row: np.ndarray, rows: int, others: np.ndarray, n: np.ndarray) -> bytes:
    """Lists of neighbours: their lengths, the neighbours, their counts in as many bytes as the largest one needs."""
    return b"".join(x.tobytes() for x in (np.bincount(row, minlength=rows).astype(np.int32), others.astype(np.int32),
                                          n.astype(np.min_scalar_type(n.max(initial=0)))))


def _unpacked(links: pa.Scalar, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length of each list, neighbours, counts)."""
    data = links.as_buffer()
    lengths = np.frombuffer(data, np.int32, rows)
    total = int(lengths.sum())
    size = (len(data) - 4 * (rows + total)) // max(total, 1)
    return lengths, np.frombuffer(data, np.int32, total, 4 * rows), np.frombuffer(data, f"u{size or 1}", total, 4 * (rows + total))


def blocks_of(counts: np.ndarray, often: int, blocks: int) -> tuple[int, np.ndarray | int]:
    """``Links.often`` and ``Links.blocks``: a word has at most two neighbours per occurrence, so that all blocks together grow with the tokens.

    ``counts`` are those of the most frequent words, in the order of the types; of ``often`` words that it lacks, each has ``blocks``.
    """
    if blocks == 1:
        return 0, 1
    known = counts[:often]
    few = np.minimum(blocks, -(-2 * known // BLOCK))
    # fixed types have fixed neighbours only
    return 1 + SHAPES + often, np.concatenate([np.ones(1 + SHAPES, np.int64), few, np.full(often - len(known), blocks)])


@dataclass
class Lexicon:
    """The words of the broadcast list, most frequent first; the first ``clustered`` have classes by exchange.

    ``partial``: more words have such classes than the list holds; ``types`` counts all of them.
    """
    keys: np.ndarray
    counts: np.ndarray
    clustered: int
    types: int
    links: Links

    @property
    def partial(self) -> bool:
        return self.types > 1 + SHAPES + self.clustered


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def information(matrix: np.ndarray) -> float:
    """Mutual information of adjacent classes, up to terms that no exchange changes."""
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(axis=0)).sum() - _xlogx(matrix.sum(axis=1)).sum())


def _dense_classes(matrix: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, itself: np.ndarray) -> np.ndarray:
    """``best_classes`` from a whole class matrix for each word."""
    best = np.zeros(len(own), np.int64)
    to = np.arange(1 + SHAPES, ALL_CLASSES)
    for at in range(0, len(own), 128):
        o, l, r, s = own[at:at + 128], left[at:at + 128].astype(float), right[at:at + 128].astype(float), itself[at:at + 128].astype(float)
        i = np.arange(len(o))
        m = np.repeat(matrix[None].astype(float), len(o), axis=0)
        m[i, o] -= r
        m[i, :, o] -= l
        m[i, o, o] += s
        l[i, o] -= s
        r[i, o] -= s
        rows, columns = m[:, to], m[:, :, to].transpose(0, 2, 1)
        gain = (_xlogx(rows + r[:, None]) - _xlogx(rows)).sum(axis=2) + (_xlogx(columns + l[:, None]) - _xlogx(columns)).sum(axis=2)
        corner, bare = m[:, to, to], _xlogx(m[:, to, to])
        gain -= _xlogx(corner + r[:, to]) + _xlogx(corner + l[:, to]) - 2 * bare
        gain += _xlogx(corner + r[:, to] + l[:, to] + s[:, None]) - bare
        out, into = m.sum(axis=2)[:, to], m.sum(axis=1)[:, to]
        gain -= _xlogx(out + (r.sum(axis=1) + s)[:, None]) - _xlogx(out) + _xlogx(into + (l.sum(axis=1) + s)[:, None]) - _xlogx(into)
        best[at:at + 128] = to[gain.argmax(axis=1)]
    return best


def best_classes(matrix: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, itself: np.ndarray) -> np.ndarray:
    """The exchange class of each word, now in class ``own``, that gives the most information; ties keep the lower class.

    ``left`` and ``right`` are the words' counts beside each class, ``itself`` beside themselves, one row per word.
    Only classes that a word stands beside are looked at. Words with two best classes nearer than rounding
    can tell are decided from whole matrices.
    """
    matrix = matrix.astype(float)
    first, to = 1 + SHAPES, slice(1 + SHAPES, ALL_CLASSES)
    diagonal = np.diag(matrix)[to]
    slack = 1e-13 * float(_xlogx(matrix.sum()))
    # row c, column t: what stands between class c and exchange class t, and the rise of its term by each small count
    sides = []
    for base in (matrix[to].T, matrix[:, to]):
        base = np.ascontiguousarray(base)
        bare = _xlogx(base)
        steps = _xlogx(base + np.arange(1, FEW + 1)[:, None, None]) - bare
        sides.append((base, bare, steps.reshape(-1, CLASSES), matrix.sum(axis=len(sides) ^ 1)[to]))
    best = np.zeros(len(own), np.int64)
    for at in range(0, len(own), 128):
        o, l, r, s = own[at:at + 128], left[at:at + 128].astype(float), right[at:at + 128].astype(float), itself[at:at + 128].astype(float)
        i, t = np.arange(len(o)), o - first
        corner = matrix[o, o] - r[i, o] - l[i, o] + s
        l[i, o] -= s
        r[i, o] -= s
        gain = np.zeros((len(o), CLASSES))
        for (base, bare, steps, sums), mine, other in zip(sides, (r, l), (l, r), strict=True):
            row, c = np.nonzero(mine)
            x, k, home = mine[row, c], t[row], c == o[row]
            small = x <= FEW
            # rows are looked up and added, for a matrix product starts BLAS threads that spin between calls
            few = np.flatnonzero(small & ~home)
            if len(few):
                starts = _starts(row[few])
                gain[row[few[starts]]] += np.add.reduceat(steps.take((x[few].astype(np.int64) - 1) * ALL_CLASSES + c[few], axis=0), starts, axis=0)
            many = np.flatnonzero(~small & ~home)
            if len(many):
                starts = _starts(row[many])
                gain[row[many[starts]]] += np.add.reduceat(_xlogx(base[c[many]] + x[many, None]) - bare[c[many]], starts, axis=0)
            # the word has left its own class
            of = np.flatnonzero(~home)
            b, plain = base[c[of], k[of]], bare[c[of], k[of]]
            gain[i, t] += np.bincount(row[of], 2 * plain - _xlogx(b - x[of]) - _xlogx(b + x[of]), len(o))
            of = np.flatnonzero(home)
            v = base[c[of]] - other[row[of], to]
            v[np.arange(len(of)), k[of]] = corner[row[of]]
            gain[row[of]] += _xlogx(v + x[of, None]) - _xlogx(v)
            whole = (mine.sum(axis=1) + s)[:, None]
            left_over = sums - other[:, to]
            left_over[i, t] -= whole[:, 0]
            gain -= _xlogx(left_over + whole) - _xlogx(left_over)
        v = np.repeat(diagonal[None], len(o), axis=0)
        v[i, t] = corner
        gain += _xlogx(v) - _xlogx(v + r[:, to]) - _xlogx(v + l[:, to]) + _xlogx(v + r[:, to] + l[:, to] + s[:, None])
        found = first + gain.argmax(axis=1)
        top = np.partition(gain, -2, axis=1)
        near = top[:, -1] - top[:, -2] <= slack
        if near.any():
            found[near] = _dense_classes(matrix, *(x[at:at + 128][near] for x in (own, left, right, itself)))
        best[at:at + 128] = found
    return best


def best_class(matrix: np.ndarray, own: int, left: np.ndarray, right: np.ndarray, itself: float) -> int:
    """``best_classes`` of one word."""
    return int(best_classes(matrix, np.array([own]), left[None], right[None], np.array([itself]))[0])


def _sides(row: dict, now: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Counts of the ``chosen`` words of a row beside each class on the left, on the right, and beside themselves."""
    words = np.frombuffer(row["words"].as_buffer(), np.int32)
    n_chosen = int(chosen.sum())
    sides = np.zeros((n_chosen, 2 * ALL_CLASSES + 1))
    for side, name in enumerate(("left", "right")):
        lengths, others, n = _unpacked(row[name], len(words))
        use = np.repeat(chosen, lengths)
        others, n = others[use], n[use]
        place = np.repeat(np.arange(n_chosen), lengths[chosen])
        sides[:, side * ALL_CLASSES:(side + 1) * ALL_CLASSES] = np.bincount(
            place * ALL_CLASSES + now[others], n, n_chosen * ALL_CLASSES).reshape(n_chosen, -1)
        if not side:
            twin = others == words[chosen][place]
            sides[:, -1] = np.bincount(place[twin], n[twin], n_chosen)
    return sides


def _merged(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(words, sides): the sums of each word's sides."""
    words, sides = zip((np.zeros(0, np.int64), np.zeros((0, 2 * ALL_CLASSES + 1))), *parts, strict=True)
    words, row = np.unique(np.concatenate(words), return_inverse=True)
    total = np.zeros((len(words), 2 * ALL_CLASSES + 1))
    np.add.at(total, row, np.concatenate(sides))
    return words, total


def _moved(matrix: np.ndarray, now: np.ndarray, word: np.ndarray, sides: np.ndarray) -> np.ndarray:
    return best_classes(matrix, now[word].astype(np.int64), sides[:, :ALL_CLASSES], sides[:, ALL_CLASSES:-1], sides[:, -1])


def exchange(bigrams: DataFrame, types: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(class of each type, class bigram matrix, information by round) of the best round.

    ``bigrams`` are lists of neighbours. Per round the driver gets the class matrix and the class of each
    word that moves; the parts of an often word meet as one row of sums from each task.
    """
    first = 1 + SHAPES
    classes = np.arange(types).astype(np.uint8)
    classes[first:] = first + (np.arange(types - first) % CLASSES)
    table = cut_lineage(bigrams)
    files = len(table.inputFiles())
    fixed = np.zeros((ALL_CLASSES, ALL_CLASSES))
    for row in table.where("kind = 0").select("words", "left").toArrow().to_pylist():
        words = np.frombuffer(row["words"], np.int32)
        lengths, others, n = _unpacked(pa.scalar(row["left"]), len(words))
        np.add.at(fixed, (others, np.repeat(words, lengths)), n)
    if types == first:
        return classes, fixed, [information(fixed)]
    table = table.where("kind > 0")
    # the often words' lists once more on their own, so that a round need not read all for them
    seldom, hot = table.where("kind = 1"), cut_lineage(table.where("kind = 2").coalesce(max(1, files // FILE)))
    often = not hot.isEmpty()

    def matrix_of(now: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, at = np.zeros((ALL_CLASSES, ALL_CLASSES)), now.astype(np.int64)
            for batch in batches:
                for words, *links in zip(*(batch.column(x) for x in ("words", "left", "edge")), strict=True):
                    mine = at[np.frombuffer(words.as_buffer(), np.int32)]
                    # a pair of two clustered words is taken from the right one
                    for side, x in enumerate(links):
                        lengths, others, n = _unpacked(x, len(mine))
                        got = np.bincount(np.repeat(mine * ALL_CLASSES, lengths) + at[others], n, ALL_CLASSES**2).reshape(total.shape)
                        total += got if side else got.T
            total = total.ravel()
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.int64))], ["cell", "n"])

        total = fixed.copy().ravel()
        got = table.select("words", "left", "edge").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        total[got.column("cell").to_numpy()] += got.column("n").to_numpy()
        return total.reshape(fixed.shape)

    def turned(now: np.ndarray, matrix: np.ndarray, turn: int) -> np.ndarray:
        def half(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            at = now.astype(np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {x: batch.column(x)[i] for x in ("words", "left", "right")}
                    word = np.frombuffer(row["words"].as_buffer(), np.int32)
                    chosen = (mix(word.astype(np.uint64) + np.uint64((turn // 2 + 1) << 40)) & np.uint64(1)) == turn % 2
                    if chosen.any():
                        yield word[chosen].astype(np.int64), _sides(row, at, chosen)

        def moved(word: np.ndarray, sides: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(_moved(matrix, now, word, sides))], ["word", "class"])

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for word, sides in half(batches):
                yield moved(word, sides)

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            word, sides = _merged(half(batches))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array([x.tobytes() for x in sides], pa.binary())], ["word", "sides"])

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield moved(*_merged((batch.column("word").to_numpy(), np.frombuffer(b"".join(batch.column("sides").to_pylist())).reshape(
                -1, 2 * ALL_CLASSES + 1)) for batch in batches))

        out = now.copy()
        lists, chosen = ("words", "left", "right"), "word bigint, class bigint"
        choices = seldom.select(*lists).mapInArrow(decide, chosen)
        if often:
            choices = choices.unionByName(hot.select(*lists).mapInArrow(parts, "word bigint, sides binary").repartition("word").mapInArrow(whole, chosen))
        got = choices.toArrow()
        out[got.column("word").to_numpy()] = got.column("class").to_numpy()
        return out

    seen: list[float] = []
    best, since = None, 0
    while True:
        matrix = matrix_of(classes)
        seen.append(information(matrix))
        if best is None or seen[-1] > best[0]:
            best, since = (seen[-1], classes, matrix), 0
        else:
            since += 1
        if since == PATIENCE:
            return best[1], best[2], seen
        classes = turned(classes, matrix, len(seen) - 1)


@dataclass
class Model:
    lexicon: Lexicon
    classes: np.ndarray
    transitions: np.ndarray
    emissions: np.ndarray
    shape_bottom: np.ndarray
    own: np.ndarray
    tokens: int
    distinct: int
    texts: int


def train(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the table of word counts, from all rows of the column _text."""
    counts = cut_lineage(word_counts(texts))
    often_enough = F.col("c") >= LEAST
    counts = cut_lineage(numbered(counts.where(often_enough)).unionByName(
        counts.where(~often_enough).withColumn("type", F.lit(None).cast("bigint"))))
    n_texts = texts.count()
    rare = F.col("type").isNull()
    shapes = {r.shape: r for r in counts.groupBy("shape").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count("type").alias("named"), F.count(F.when(F.col("c") > BLOCK // 2, 1)).alias("often"),
        F.sum(F.when(rare, F.col("c")).otherwise(0)).alias("rare_n"), F.count(F.when(rare, 1)).alias("rare_v")).collect()}
    words, distinct, named, often = (sum(r[x] for r in shapes.values()) for x in ("n", "v", "named", "often"))
    tokens = words + n_texts
    least = max(1, math.ceil(SENT * tokens))
    common = counts.where(F.col("c") >= (min(least, LEAST) if named <= LISTED else least)).toArrow()
    keys, c = common.column("key").to_numpy(), common.column("c").to_numpy()
    order = np.lexsort((keys, -c))
    keys, c = keys[order], c[order]
    types = 1 + SHAPES + named
    blocks = -(-types // BLOCK)
    links = Links(types, *blocks_of(c, often, blocks), max(1, -(-tokens // PART)))
    lexicon = Lexicon(keys, c, int((c >= LEAST).sum()), types, links)
    classes, matrix, _ = exchange(bigram_counts(texts, lexicon, counts), lexicon.types)
    column = matrix.sum(axis=0)
    base = (column + 1) / (column.sum() + ALL_CLASSES)
    kinds = (matrix > 0).sum(axis=1, keepdims=True)
    row = matrix.sum(axis=1, keepdims=True)
    transitions = np.where(row > 0, (matrix + kinds * base) / np.maximum(row + kinds, 1), base)
    # every token stands once on the right, so the columns hold the tokens of each class
    own = np.log10(np.maximum(column, 1))
    emissions = np.log10(c[:lexicon.clustered]) - own[classes[1 + SHAPES:1 + SHAPES + lexicon.clustered]]
    # rare words of a shape: counts plus one half, and one half for all words never seen
    bottom = np.array([shapes[s].rare_n + 0.5 * (shapes[s].rare_v + 1) if s in shapes else 0.5 for s in range(SHAPES)])
    model = Model(lexicon, classes, np.log10(transitions), emissions, np.log10(bottom), own,
                  int(tokens), int(distinct + (n_texts > 0)), int(n_texts))
    return model, counts


def score(spark: SparkSession, docs: DataFrame, model: Model, counts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for every row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        index = HashIndex(m.lexicon.keys)
        share = m.lexicon.clustered
        for part in chunks(batches, "_text", 1 << 20):
            n = part.num_rows
            row, keys, shape = word_keys(*text_view(part.column("_text")))
            at = index.find(keys)
            seen = at >= 0
            rest = np.bincount(row[~seen], minlength=n)
            tokens, where = token_types(row, np.where(seen & (at < share), at + 1 + SHAPES, shape + 1), n)
            classes = m.classes[tokens]
            size = np.bincount(row, minlength=n) + 1
            # a row with words that may be clustered outside the list is finished after the join
            later = (rest > 0) & m.lexicon.partial
            here = ~later[where]
            lm = np.where(here, m.transitions[np.append(0, classes[:-1]), classes], 0)
            named = tokens > SHAPES
            lm[named] += m.emissions[tokens[named] - 1 - SHAPES]
            rare = (tokens > 0) & ~named & here
            lm[rare] -= m.shape_bottom[tokens[rare] - 1]
            total = np.bincount(where, lm, minlength=n)
            middle = seen & (at >= share)
            total += np.bincount(row[middle], np.log10(m.lexicon.counts[at[middle]] + 0.5), minlength=n)
            base = np.bincount(row[seen], np.log10(m.lexicon.counts[at[seen]] + 1.0), minlength=n) + np.log10(m.texts + 1.0)
            known = np.bincount(row[seen], minlength=n) + (m.texts > 0)
            base -= size * math.log10(m.tokens + m.distinct + 1)
            ends = pa.array(np.append(0, np.cumsum(rest)).astype(np.int32))
            place = np.arange(len(row)) - np.append(0, np.cumsum(size - 1))[row]
            data, stops = classes.astype(np.uint8).tobytes(), np.cumsum(size)
            kept = pa.array([data[e - z:e] if x else None for e, z, x in zip(stops, size, later, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("_doc"), pa.array(size), pa.array(known.astype(np.int64)), pa.array(base), pa.array(total), kept,
                 pa.ListArray.from_arrays(ends, pa.array(keys[~seen])), pa.ListArray.from_arrays(ends, pa.array(place[~seen]))],
                ["_doc", "n_tokens", "n_known", "base_score", "score", "_seq", "_rare", "_at"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            total = batch.column("score").to_numpy().copy()
            columns = [batch.column(x) for x in ("_seq", "_ats", "_types", "_cs")]
            for i in np.flatnonzero(columns[0].is_valid().to_numpy(zero_copy_only=False)):
                seq = np.frombuffer(columns[0][i].as_py(), np.uint8).copy()
                if columns[1][i].is_valid:
                    at, types, c = (x[i].values.to_numpy() for x in columns[1:])
                    seq[at] = m.classes[types]
                    total[i] += (np.log10(c) - m.own[seq[at]]).sum()
                total[i] += m.transitions[np.append(0, seq[:-1]), seq].sum()
                total[i] -= m.shape_bottom[seq[(seq > 0) & (seq <= SHAPES)] - 1].sum()
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("_doc", "n_tokens", "n_known", "base_score")), pa.array(total)],
                                             ["_doc", "n_tokens", "n_known", "base_score", "score"])

    lean = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    out = f"_doc {kind}, n_tokens bigint, n_known bigint, base_score double, score double"
    # written once, so that row numbers are fixed
    rows = cut_lineage(lean.mapInArrow(run, f"{out}, _seq binary, _rare array<bigint>, _at array<bigint>")
                       .withColumn("_row", F.monotonically_increasing_id()))
    c, zero = F.coalesce("c", F.lit(0)).cast("double"), F.lit(0.0)
    if model.lexicon.partial:
        rare = rows.select("_row", F.explode(F.arrays_zip(F.col("_rare").alias("key"), F.col("_at").alias("at"))).alias("_z")).select(
            "_row", "_z.key", "_z.at").join(counts.select("key", "c", "type"), "key", "left")
        named = F.col("type").isNotNull()
        sums = rare.groupBy("_row").agg(
            F.sum(F.log10(c + 1)).alias("_b"), F.sum(F.when(~named, F.log10(c + 0.5))).alias("_s"), F.count("c").alias("_k"),
            F.collect_list(F.when(named, F.struct("at", "type", "c"))).alias("_l"))
    else:
        rare = rows.select("_row", F.explode("_rare").alias("key")).join(counts.select("key", "c"), "key", "left")
        sums = rare.groupBy("_row").agg(F.sum(F.log10(c + 1)).alias("_b"), F.sum(F.log10(c + 0.5)).alias("_s"), F.count("c").alias("_k"))
    summed = rows.drop("_rare", "_at").join(sums, "_row", "left").select(
        "_doc", "n_tokens", (F.col("n_known") + F.coalesce("_k", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("_b", zero)).alias("base_score"), (F.col("score") + F.coalesce("_s", zero)).alias("score"),
        *(("_seq", F.col("_l.at").alias("_ats"), F.col("_l.type").alias("_types"), F.col("_l.c").alias("_cs")) if model.lexicon.partial else ()))
    if model.lexicon.partial:
        summed = summed.mapInArrow(settle, out)
    return summed.withColumnRenamed("_doc", doc_id)


def held_out(doc_id: str = "doc_id"):
    return id_crc_mod(doc_id, 7) == 2
