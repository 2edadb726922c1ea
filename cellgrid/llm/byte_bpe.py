"""Byte-level BPE encoding and decoding.

Texts are cut by the splitting pattern; distinct pieces of a block of texts become rows of
padded matrices, bucketed by length. In each round every row merges its leftmost pair of
minimum rank, pairs are looked up in an open-addressed table, rows are compacted in place,
and finished rows leave the matrix. The ids of a text are gathered from those of its pieces.

A cut is also possible at any single blank between two non-blanks, since no match of the
pattern crosses such a place; the pattern itself therefore runs over distinct chunks only.

Defined results: null text is empty and has no ids; empty tables give empty tables; repeated
rows are encoded each on its own; other columns are ignored by ``digest`` and kept by ``encode``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import chunks, ragged

#: a row this long goes through a heap instead of a matrix, whose cost is quadratic in the length
WIDE = 2048
#: pieces remembered by a worker between blocks; the memory is emptied when full, never the result
REMEMBERED = 800_000
_NONE = np.int64(1 << 40)


class Ranks:
    """A rank file with hashed pair lookup."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.bytes_of = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.lengths = np.array([len(t) for t in self.bytes_of], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        bits = max(4, (4 * len(pairs)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, np.int64)
        self._values = np.full(1 << bits, _NONE, np.int64)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        at = self._slot(keys)
        while len(keys):  # one entry per free slot is placed in each pass, the others step on
            free = self._keys[at] < 0
            self._keys[at[free]] = keys[free]
            won = self._keys[at] == keys
            self._values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair; a large number where the pair has none."""
        out = np.full(left.shape, _NONE, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[todo] << 32 | right[todo]
        at = self._slot(key)
        while len(todo):
            found = self._keys[at]
            hit = found == key
            out[todo[hit]] = self._values[at[hit]]
            on = ~hit & (found >= 0)
            todo, key, at = todo[on], key[on], (at[on] + 1) & self._mask
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, by a heap over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or self.pairs.get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (q := self.pairs.get(ids[k] << 32 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (q, k))
        return np.array([x for x in ids if x >= 0], np.int64)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, flat, and the number of ids of each."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(sizes > WIDE):
            got = self.merge_long(pieces[i])
            done.append((np.array([i]), np.array([len(got)]), got))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.cumsum(sizes) - sizes
        low = 0
        for width in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, 128, 256, 512, 1024, WIDE):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            step = max(1, (1 << 20) // width)
            for at in range(0, len(rows), step):
                done += self._matrix(rows[at:at + step], flat, starts, sizes, width)
        counts = np.zeros(len(pieces), np.int64)
        for index, n, _ in done:
            counts[index] = n
        out = np.empty(int(counts.sum()), np.int64)
        begin = np.cumsum(counts) - counts
        for index, n, ids in done:
            out[ragged(begin[index], n)] = ids
        return out, counts

    def _matrix(self, rows, flat, starts, sizes, width):
        n = sizes[rows]
        columns = np.arange(width)
        cells = np.full((len(rows), width), -1, np.int64)
        filled = columns < n[:, None]
        cells[filled] = self.single[flat[ragged(starts[rows], n)]]
        ranks = np.full((len(rows), width), _NONE, np.int64)
        if width > 1:
            ranks[:, :-1] = self.rank(cells[:, :-1].ravel(), cells[:, 1:].ravel()).reshape(len(rows), -1)
        done = []
        while len(rows):
            at = ranks.argmin(axis=1)
            line = np.arange(len(rows))
            best = ranks[line, at]
            over = best == _NONE
            if over.any():
                gone = cells[over]
                done.append((rows[over], n[over], gone[columns < n[over][:, None]]))
                on = ~over
                rows, n, cells, ranks, at, best = rows[on], n[on], cells[on], ranks[on], at[on], best[on]
                if not len(rows):
                    break
                width = int(n.max())
                columns, cells, ranks, line = columns[:width], cells[:, :width], ranks[:, :width], np.arange(len(rows))
            source = columns + (columns > at[:, None])
            source[:, -1] = np.minimum(source[:, -1], width - 1)
            cells, ranks = np.take_along_axis(cells, source, 1), np.take_along_axis(ranks, source, 1)
            cells[line, at] = best
            n = n - 1
            cells[line, n], ranks[line, n] = -1, _NONE
            for place in (at - 1, at):
                left = np.where(place >= 0, cells[line, np.maximum(place, 0)], -1)
                right = np.where(place + 1 < n, cells[line, np.minimum(place + 1, width - 1)], -1)
                fresh = self.rank(left, right)
                inside = place >= 0
                ranks[line[inside], place[inside]] = fresh[inside]
        return done


@lru_cache(maxsize=4)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


#: two white-space characters in a row, or one at an end: such a text is cut with more care
_CAREFUL = re.compile(r"\s\s|\A\s|\s\Z")


class _Numbers(dict):
    """Numbers strings as they come and lists them, after ``lead``, in ``chunks``."""

    def __init__(self, chunks: list[str], lead: str):
        self.chunks, self.lead = chunks, lead

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self.chunks)
        self.chunks.append(self.lead + part)
        return n


class Encoder:
    """Encodes blocks of texts; remembers the ids of the chunks it has met."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self._chunks: list[str] = []
        self._heads, self._rest = _Numbers(self._chunks, ""), _Numbers(self._chunks, " ")
        self._lengths, self._ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _cut(self, text: str) -> list[str]:
        """Chunks whose borders no match crosses: single blanks between non-blanks end a chunk and are left out."""
        parts = text.split(" ")
        if not _CAREFUL.search(text):
            return parts
        out = [parts[0]]
        for a, b in zip(parts, parts[1:], strict=False):
            if a and b and not a[-1].isspace() and not b[0].isspace():
                out.append(b)
            else:
                out[-1] += " " + b
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each."""
        if len(self._chunks) > REMEMBERED:
            self._forget()
        known = len(self._chunks)
        numbers = [np.zeros(0, np.int64)]
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                cut = self._cut(text)
                sizes[i] = len(cut)
                line = np.empty(len(cut), np.int64)
                line[0] = self._heads[cut[0]]
                line[1:] = np.fromiter(map(self._rest.__getitem__, cut[1:]), np.int64, len(cut) - 1)
                numbers.append(line)
        order_a = np.concatenate(numbers)
        fresh = self._chunks[known:]
        if fresh:
            found = [self.pattern.findall(c) for c in fresh]
            index: dict[str, int] = {}
            use = np.array([index.setdefault(p, len(index)) for f in found for p in f], np.int64)
            flat, counts = self.ranks.merge([p.encode() for p in index])
            starts = np.cumsum(counts) - counts
            ids = flat[ragged(starts[use], counts[use])]
            per = np.fromiter(map(len, found), np.int64, len(found))
            total = np.concatenate([[0], np.cumsum(counts[use])])
            ends = np.cumsum(per)
            self._lengths = np.concatenate([self._lengths, total[ends] - total[ends - per]])
            self._ids = np.concatenate([self._ids, ids])
        lengths = self._lengths
        starts = np.cumsum(lengths) - lengths
        ids = self._ids[ragged(starts[order_a], lengths[order_a])] if len(order_a) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(lengths[order_a])]).astype(np.int64)
        ends = np.cumsum(sizes)
        return ids, total[ends] - total[ends - sizes]


@lru_cache(maxsize=2)
def encoder_of(path: str, pattern: str) -> Encoder:
    """One encoder to a worker process, so that later tasks find its chunks."""
    return Encoder(ranks_of(path), pattern)


def decode_ids(ranks: Ranks, ids: np.ndarray) -> np.ndarray:
    """The bytes of all ids, one after the other."""
    return ranks.flat[ragged(ranks.starts[ids], ranks.lengths[ids])]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids (array of int)."""
    names = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs[text].alias("_text"))
    row = packed.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_of(path, pattern)
        for part in chunks(batches, "_text"):
            flat, counts = coder.encode([t or "" for t in part.column("_text").to_pylist()])
            offs = np.concatenate([[0], np.cumsum(counts)])
            lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("_row"), lists], ["_row", "_ids"])

    return packed.mapInArrow(run, f"_row {row}, _ids array<int>").select(
        *[F.col(f"_row.`{c}`").alias(c) for c in names if c != ids], F.col("_ids").alias(ids))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of a column of ids; null ids decode to no bytes."""
    names = rows.columns
    packed = rows.select(F.struct(*[rows[c] for c in names]).alias("_row"), rows[ids].alias("_ids"))
    row = packed.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array([decode_ids(ranks, x).tobytes() for x in lists], pa.binary())], ["_row", "_out"])

    return packed.mapInArrow(run, f"_row {row}, _out binary").select(
        *[F.col(f"_row.`{c}`").alias(c) for c in names if c != out], F.col("_out").alias(out))


def digest(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256 (little-endian uint32), decoded_sha256."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path)
        coder = encoder_of(path, pattern)
        for part in chunks(batches, "_text"):
            flat, counts = coder.encode([t or "" for t in part.column("_text").to_pylist()])
            ends = np.cumsum(counts)
            back = decode_ids(ranks, flat).tobytes()
            cut = np.concatenate([[0], np.cumsum(ranks.lengths[flat])])[np.concatenate([[0], ends])].tolist()
            raw = memoryview(flat.astype("<u4").tobytes())
            upto = [0, *(4 * ends).tolist()]
            yield pa.RecordBatch.from_arrays([
                part.column("_doc"), pa.array(counts),
                pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(upto, upto[1:], strict=False)], pa.string()),
                pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)], pa.string()),
            ], ["_doc", "n_tokens", "ids_sha256", "decoded_sha256"])

    lean = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    out = lean.mapInArrow(run, f"_doc {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("_doc", doc_id)
