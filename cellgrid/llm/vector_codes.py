"""Vector code compression: product codes of integer vectors, trained and assigned in exact arithmetic.

A component x becomes floor(scale * x). Vectors are cut into equal parts, and every part has a codebook that starts
as that part of the vectors with the least ids. A round assigns each part to its nearest entry and replaces the entry
by the floored mean of its parts. Rows never leave their tasks: a round is one pass that sends one partial sum per
entry and component, so what is shuffled and collected is bounded by the codebooks (entries times dimension), and so
is what is sent to the tasks.

Distances are exact. |x|^2 - 2 x.c + |c|^2 needs x.c as a whole number: integers are cut into limbs so short that a
float64 product of limb matrices stays below 2^53, the products are recombined in int64, and the first least distance
wins. Parts whose distances might pass 2^62 are computed with Python's integers instead, by the same formula.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are dropped; every other row is
returned, also with equal ids or vectors. A vector shorter than the longest, or a length that the parts do not divide,
counts as padded with zeros at the end. Starting entries are the first by (id, vector), null ids last; fewer vectors
than entries make smaller codebooks. An error beyond 64 bits is null, and is left out of its label's sum. An empty
table, or one without a usable vector, gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.session import cut_lineage, ship_package

#: distances below this bound are computed in int64
_SAFE = 1 << 62
#: bits of a digit of the partial sums; 2^23 tasks may add up before a long overflows
_DIGIT = 40


def limb_bits(width: int) -> int:
    """Limbs of this many bits keep a dot product of ``width`` limb products below 2^53."""
    return (53 - max(1, width).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """x = sum of limb[i] * 2^(bits * i): all limbs but the last in 0..2^bits-1, the last one signed."""
    out = []
    while x.size and max(int(x.max()), -int(x.min())) >= 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices whose true products fit 64 bits."""
    bits = limb_bits(a.shape[1])
    total = np.zeros((len(a), len(b)), np.int64)
    right = [limb.T.copy() for limb in limbs(b, bits)]
    for i, left in enumerate(limbs(a, bits)):
        for j, other in enumerate(right):
            total += (left @ other).astype(np.int64) << (bits * (i + j))
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first nearest entry, squared distance) of each row of one part."""
    bound = math.isqrt(_SAFE // (4 * max(1, x.shape[1])))
    if not len(x) or _peak(book) >= bound:
        return _nearest_wide(x, book)
    if _peak(x) >= bound:
        slow = (np.abs(x) >= bound).any(1)
        at, least = np.zeros(len(x), np.int64), np.zeros(len(x), object)
        at[slow], least[slow] = _nearest_wide(x[slow], book)
        at[~slow], least[~slow] = nearest(x[~slow].astype(np.int64), book)
        return at, least
    x, book = x.astype(np.int64), book.astype(np.int64)
    far = (x * x).sum(1)[:, None] - 2 * exact_dot(x, book) + (book * book).sum(1)[None, :]
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at]


def _nearest_wide(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    entries = [[int(c) for c in entry] for entry in book]
    at, least = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    for row, part in enumerate(x):
        part = [int(v) for v in part]
        far = [sum((v - c) ** 2 for v, c in zip(part, entry)) for entry in entries]
        least[row] = min(far)
        at[row] = far.index(least[row])
    return at, least


def _peak(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) exactly: int64 where all results fit, else Python integers."""
    if not values.size or np.abs(values).max() * scale < 1 << 53:
        return np.floor(values * scale).astype(np.int64)
    out = np.empty(values.shape, object)
    out.ravel()[:] = [(top * scale) // bottom for top, bottom in map(float.as_integer_ratio, values.ravel().tolist())]
    return out


def parts_of(column: pa.Array, layout: Layout) -> np.ndarray:
    """(rows, parts, width) integers of a column of float lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    room = layout.parts * layout.width
    if len(sizes) and (sizes == room).all():
        dense = flat.reshape(-1, room)
    else:
        dense = np.zeros((len(sizes), room))
        dense[np.arange(room)[None, :] < sizes[:, None]] = flat
    return integers(dense, layout.scale).reshape(len(sizes), layout.parts, layout.width)


@dataclass(frozen=True)
class Layout:
    parts: int
    width: int
    scale: int


@dataclass(frozen=True)
class Codebooks:
    """entries[part][entry] is a tuple of integers."""

    layout: Layout
    entries: tuple

    def arrays(self) -> list[np.ndarray]:
        wide = any(abs(c) >= 1 << 62 for book in self.entries for entry in book for c in entry)
        return [np.array(book, object if wide else np.int64).reshape(len(book), self.layout.width) for book in self.entries]

    def sha256(self) -> str:
        """Of all components in decimal by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(c) for book in self.entries for entry in book for c in entry).encode()).hexdigest()


def usable(df: DataFrame, vec_id: str, vector: str, label: str | None = None) -> DataFrame:
    """(_id, _label, _v): rows whose vector has finite components only."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(v.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col(vec_id).alias("_id"), (F.col(label) if label else F.lit(None).cast("int")).alias("_label"), v.alias("_v"))


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) with value = sum of digit * 2^(_DIGIT * place); only the last digit may be negative."""
    place = 0
    while not -(1 << _DIGIT) <= value < 1 << _DIGIT:
        yield place, value & ((1 << _DIGIT) - 1)
        value >>= _DIGIT
        place += 1
    if value:
        yield place, value


def part_sums(x: np.ndarray, at: np.ndarray, entries: int) -> np.ndarray:
    """(entries, width) exact sums of the rows of one part by entry, as Python integers."""
    if x.dtype == object:
        total = np.zeros((entries, x.shape[1]), object)
        np.add.at(total, at, x)
        return total
    total = np.zeros((entries, x.shape[1]), object)
    for i, limb in enumerate(limbs(x, 24)):  # a batch has far fewer than 2^29 rows, so float sums of a limb are whole
        for j in range(x.shape[1]):
            total[:, j] += np.bincount(at, limb[:, j], entries).astype(np.int64).astype(object) * (1 << 24 * i)
    return total


def _summer(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partial sums of one task: (slot, place, digit, value), place -1 for the number of parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, layout = books.arrays(), books.layout
        counts = [np.zeros(len(b), np.int64) for b in arrays]
        sums = [np.zeros((len(b), layout.width), object) for b in arrays]
        for batch in batches:
            x = parts_of(batch.column("_v"), layout)
            for p, book in enumerate(arrays):
                at, _ = nearest(x[:, p], book)
                counts[p] += np.bincount(at, minlength=len(book))
                sums[p] += part_sums(x[:, p], at, len(book))
        rows = []
        for p, book in enumerate(arrays):
            for e in np.flatnonzero(counts[p]).tolist():
                rows.append((p, e, -1, 0, int(counts[p][e])))
                rows += [(p, e, j, digit, v) for j in range(layout.width) for digit, v in _digits(int(sums[p][e, j]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["part", "entry", "place", "digit", "value"])

    return run


def refined(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks after one round; entries without a part stay."""
    sums = (vectors.select("_v").mapInArrow(_summer(books), "part int, entry int, place int, digit int, value long")
            .groupBy("part", "entry", "place", "digit").agg(F.sum("value").alias("value")))
    total: dict[tuple[int, int, int], int] = {}
    for r in sums.collect():  # at most entries x (dimension + 1) sums
        key = (r.part, r.entry, r.place)
        total[key] = total.get(key, 0) + (r.value << _DIGIT * r.digit)

    def moved(p: int, e: int, entry: tuple) -> tuple:
        n = total.get((p, e, -1))
        return tuple(total.get((p, e, j), 0) // n for j in range(len(entry))) if n else entry

    return Codebooks(books.layout, tuple(tuple(moved(p, e, entry) for e, entry in enumerate(book))
                                         for p, book in enumerate(books.entries)))


def train(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64,
          rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks of all usable vectors; None where there is no such vector."""
    if not 1 <= entries <= 256:
        raise ValueError("a code holds two hex digits per part: 1 to 256 entries")
    ship_package(df.sparkSession)
    vectors = usable(df, vec_id, vector)
    longest = vectors.agg(F.max(F.size("_v")).alias("n")).first().n
    if longest is None:
        return None
    layout = Layout(parts, -(-longest // parts), scale)
    first = vectors.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).collect()
    start = parts_of(pa.array([r._v for r in first], pa.list_(pa.float64())), layout)
    books = Codebooks(layout, tuple(tuple(tuple(int(c) for c in row[p]) for row in start) for p in range(parts)))
    for _ in range(rounds):
        books = refined(vectors, books)
    return books


def _coder(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = books.arrays()
        pairs = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            x = parts_of(batch.column("_v"), books.layout)
            codes, error = np.full(len(x), "", "U1"), np.zeros(len(x), object)
            for p, book in enumerate(arrays):
                at, far = nearest(x[:, p], book)
                codes = np.char.add(codes, pairs[at])
                error = error + far.astype(object)
            held = [int(e) if e < 1 << 63 else None for e in error]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array(codes.tolist(), pa.string()),
                                              pa.array(held, pa.int64())], ["_id", "_label", "code", "error"])

    return run


def encode(df: DataFrame, books: Codebooks, vec_id: str = "vec_id", vector: str = "embedding",
           label: str | None = None) -> DataFrame:
    """(_id, _label, code, error) of every usable row: two hex digits per part, summed squared distance."""
    ship_package(df.sparkSession)
    vectors = usable(df, vec_id, vector, label)
    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(_coder(books), f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error long")


def decode(coded: DataFrame, books: Codebooks, code: str = "code", to: str = "vector") -> DataFrame:
    """Adds the vector that a code stands for: the entries of its parts over the scale."""
    flat = F.array(*[F.array(*[F.array(*[F.lit(c / books.layout.scale) for c in entry]) for entry in book])
                     for book in books.entries])
    index = lambda p: F.conv(F.substring(F.col(code), p * 2 + 1, 2), 16, 10).cast("int")
    return coded.withColumn(to, F.flatten(F.array(*[F.get(F.get(flat, F.lit(p)), index(p)) for p in range(books.layout.parts)])))


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16,
             entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """Per usable row: the id, code, error, label_error (errors summed over equal labels, nulls together), codebooks_sha256."""
    books = train(df, vec_id, vector, parts, entries, rounds, scale)
    if books is None:
        return df.select(F.col(vec_id), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                         F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).where(F.lit(False))
    coded = cut_lineage(encode(df, books, vec_id, vector, label))
    # summed per label and task first; the label side has one row per label, so a hot label is split, not gathered
    by_label = (coded.groupBy("_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
                .select(F.col("_label").alias("_of"), F.coalesce("_sum", F.lit(0)).try_cast("long").alias("label_error")))
    return coded.join(by_label, F.col("_label").eqNullSafe(F.col("_of")), "left").select(
        F.col("_id").alias(vec_id), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
