"""Best-fit packing of tokenised documents into sequences, after dominance reduction.

Only piece lengths matter for packing, so the instance is the histogram of lengths: at most
``capacity`` rows, however many documents there are. On it, sets that provably dominate all
others holding their largest item are fixed for good (Martello and Toth), what is left is
packed best-fit decreasing, and the outcome is a short list of patterns with counts. Pieces
are then numbered within their length, in hash buckets, so that no task holds a whole length
(about the square root of the number of pieces meet in one window), and each looks its place
up in the pattern list.

Defined results: null text is empty; an empty text is one piece holding the end id alone;
repeated rows are packed each on its own; an empty table gives an empty table; columns other
than id and text are ignored.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.ranking import bucketed_row_number
from cellgrid.llm.common import chunks, ragged
from cellgrid.session import cut_lineage

#: words a worker remembers between blocks; when full, only those seen again since they came are kept, at most half as many
REMEMBERED = 300_000


#: a word that the tokenizer's normalizer only lower-cases and its pre-tokenizer leaves whole, but for one mark at its end
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256)}


class WordEncoder:
    """Ids of whole texts by a tokenizer that never joins what a blank or line break parts.

    Each distinct word is encoded once by the library; a text's ids are those of its words.
    Plain words go straight to the library's merge model, any others through its whole chain.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self._letters = _byte_letters()
        self._mark = {m: self.tokenizer.encode(m, add_special_tokens=False).ids if m else [] for m in ("", ".", ",")}
        self._forget()

    def _forget(self, kept: np.ndarray | None = None) -> None:
        """Keeps only the words of these numbers."""
        if kept is None or not len(kept):
            self._words = pa.array([], pa.large_string())
            self._lengths, self._ids, self._blocks = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
            return
        self._words = self._words.take(pa.array(kept))
        starts = (np.cumsum(self._lengths) - self._lengths)[kept]
        self._lengths = self._lengths[kept]
        self._ids = self._ids[ragged(starts, self._lengths)]
        self._blocks = np.zeros(len(kept), np.int64)

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        other = []
        model, letters, match = self.tokenizer.model, self._letters, _PLAIN.fullmatch
        bases: dict[str, list[int]] = {}
        for i, word in enumerate(words):
            m = match(word)
            if m is None:
                other.append(i)
                continue
            base, mark = m.groups()
            base = base.lower()
            got = bases.get(base)
            if got is None:
                form = base if base.isascii() else base.encode().decode("latin-1").translate(letters)
                got = bases[base] = [t.id for t in model.tokenize(form)]
            out[i] = got + self._mark[mark] if mark else got
        for at in range(0, len(other), 20_000):
            some = other[at:at + 20_000]
            for i, got in zip(some, self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = got.ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each."""
        if len(self._words) > REMEMBERED:
            again = np.flatnonzero(self._blocks > 1)
            self._forget(again[np.argsort(-self._blocks[again], kind="stable")[:REMEMBERED // 2]])
        lines = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        met = lines.flatten().dictionary_encode()
        place = pc.fill_null(pc.index_in(met.dictionary, self._words), -1).to_numpy().astype(np.int64)
        # new words are numbered as they come
        new = place < 0
        place[new] = len(self._words) + np.arange(new.sum())
        unknown = met.dictionary.filter(pa.array(new))
        self._words = pa.concat_arrays([self._words, unknown])
        got = self._encode_words(unknown.to_pylist())
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self._lengths = np.concatenate([self._lengths, sizes])
        self._ids = np.concatenate([self._ids, np.fromiter(chain.from_iterable(got), np.int32, sizes.sum())])
        self._blocks = np.concatenate([self._blocks, np.zeros(len(got), np.int64)])
        self._blocks[place] += 1
        starts = np.cumsum(self._lengths) - self._lengths
        order = place[met.indices.to_numpy()]
        lengths = self._lengths[order]
        total = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        ends = np.cumsum(lines.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        return self._ids[ragged(starts[order], lengths)], np.diff(total[np.concatenate([[0], ends])])


@lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0,
           doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``, array of int, if asked for).

    A document is its ids and the end id; one longer than ``capacity`` is cut into pieces of
    that length, the last one shorter.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"_doc {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_of(path)
        for part in chunks(batches, "_text"):
            flat, counts = coder.encode([t or "" for t in part.column("_text").to_pylist()])
            whole = np.insert(flat, np.cumsum(counts), end_id).astype("<i4")
            sizes = counts + 1
            cuts = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), cuts)
            piece = ragged(np.zeros(len(cuts)), cuts)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            at = (np.cumsum(sizes) - sizes)[row] + start
            raw = memoryview(whole.tobytes())
            crc = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [part.column("_doc").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
                       pa.array(length), pa.array(crc, pa.int64())]
            if ids:
                offs = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(whole.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["_doc", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])

    lean = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    return lean.mapInArrow(run, schema).withColumnRenamed("_doc", doc_id)


#: lengths with multiplicity, in order of place, and the number of bins filled so
Pattern = tuple[tuple[tuple[int, int], ...], int]


def dominance_reduction(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Fixes dominating sets and takes their items out of ``counts`` (changed in place).

    A set dominates another if the other's items can be grouped so that each group fits in
    place of one of its items. For the largest item j with room r beside it, and k the
    largest item that fits there, these sets dominate all that hold j:
    {j} if nothing fits; {j, k} if k fills the room, if no two items fit, or if only pairs
    fit and none is larger than k; {j, k, b} if only pairs fit and every pair's smaller
    item is at most the b that fits beside k.
    """
    fixed: list[Pattern] = []

    def fix(*items: int) -> None:
        need: dict[int, int] = {}
        for i in items:
            need[i] = need.get(i, 0) + 1
        bins = min(int(counts[i]) // n for i, n in need.items())
        for i, n in need.items():
            counts[i] -= bins * n
        fixed.append((tuple(need.items()), bins))

    def smallest(n: int, but: int) -> list[int]:
        """The n smallest items left beside one item ``but``."""
        out: list[int] = []
        for i in np.flatnonzero(counts)[:n + 1]:
            out += [int(i)] * min(n, int(counts[i]) - (i == but))
            if len(out) >= n:
                break
        return out[:n]

    def largest(room: int, taken: list[int]) -> int:
        """The largest item of at most ``room`` that is left beside those taken; 0 if none."""
        for i in np.flatnonzero(counts[:max(room, 0) + 1])[::-1]:
            if counts[i] > taken.count(int(i)):
                return int(i)
        return 0

    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(counts)[::-1].tolist():
            while counts[j]:
                room = capacity - j
                k = largest(room, [j])
                if not k:
                    fix(j)
                elif k == room or sum(smallest(2, j)) > room or len(smallest(2, j)) < 2:
                    fix(j, k)
                elif len(three := smallest(3, j)) < 3 or sum(three) > room:
                    values = np.flatnonzero(counts[:room + 1])
                    best, second = 0, 0
                    for x in values[::-1].tolist():
                        y = largest(min(room - x, x), [j, x])
                        best, second = max(best, (x + y) * bool(y)), max(second, y)
                    b = largest(room - k, [j, k])
                    if k >= best:
                        fix(j, k)
                    elif b and second <= b:
                        fix(j, k, b)
                    else:
                        break
                else:
                    break
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over the histogram; bins alike are handled together."""
    bins: dict[int, list[list]] = {}
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            room = min((r for r in bins if r >= size), default=None)
            if room is None:
                each = min(capacity // size, left)
                bins.setdefault(capacity - each * size, []).append([((size, each),), left // each])
                left %= each
                continue
            group = bins[room][-1]
            each = min(room // size, left)
            filled = min(group[1], left // each)
            group[1] -= filled
            if not group[1]:
                bins[room].pop()
                if not bins[room]:
                    del bins[room]
            bins.setdefault(room - each * size, []).append([(*group[0], (size, each)), filled])
            left -= filled * each
    return [(tuple(items), n) for groups in bins.values() for items, n in groups]


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        if not 0 < size <= capacity:
            raise ValueError(f"a piece of {size} does not fit in {capacity}")
        counts[size] = n
    fixed = dominance_reduction(counts, capacity)
    return fixed + best_fit(counts, capacity)


def slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, items of the length in a bin, offset) by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for items, bins in patterns:
        offset = 0
        for size, each in items:
            rank = taken.get(size, 0)
            out.setdefault(size, []).append((rank, sequence, each, offset))
            taken[size] = rank + each * bins
            offset += size * each
        sequence += bins
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def pack(rows: DataFrame, capacity: int, order: list[str], length: str = "length") -> DataFrame:
    """``rows`` with sequence_id and offset; ``order`` names columns that tell rows apart.

    Rows equal in all of ``order`` may change places with each other.
    """
    rows = cut_lineage(rows)
    histogram = {r[0]: r[1] for r in rows.groupBy(length).count().collect()}  # at most ``capacity`` rows
    places = slots(plan(histogram, capacity))
    width = max(1, math.isqrt(sum(histogram.values())))
    bucket = F.pmod(F.xxhash64(*order), F.lit(width))
    ranked = bucketed_row_number(rows, [length], [F.col(c) for c in order], bucket, "_rank")
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(length).to_numpy(), batch.column("_rank").to_numpy() - 1
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for n in np.unique(size).tolist():
                at, table = np.flatnonzero(size == n), places[n]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                inside = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + inside // row[:, 2]
                offset[at] = row[:, 3] + inside % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                                             [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text",
                   ids: bool = False) -> DataFrame:
    return pack(pieces(docs, path, capacity, doc_id=doc_id, text=text, ids=ids), capacity, [doc_id, "piece", "ids_crc32"])
