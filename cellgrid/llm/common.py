"""What the text operators share: row keys, byte views of Arrow text columns, substring hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: the six characters of [\x20\x09-\x0D]
BLANKS = " \t\n\x0b\x0c\r"
#: bytes of text handled at once inside a task; a longer document is handled alone
CHUNK_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _th, _text): the row identity used inside operators.

    ``_th`` hashes id and text, so rows that share an id but not a text stay apart, and
    rows equal in both share one identity (and one result, returned once per row). A null
    id gets the identity 0 with its own hash; a null text reads as empty.
    """
    return docs.select(F.coalesce(F.col(doc_id), F.lit(0)).cast("long").alias("_id"),
                       F.xxhash64(doc_id, text).alias("_th"),
                       F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(doc_id).alias("_doc"))


def id_crc_mod(doc_id: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array, and the n+1 offsets of the rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches holding at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def per_doc(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` over each row's bytes."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one run after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.asarray(starts, np.int64) - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total)


_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x ^= x >> np.uint64(33)
    x *= _MIX2
    return x ^ (x >> np.uint64(33))


#: a random 64-bit value per byte, and the base of the substring polynomials
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


class SubstringHash:
    """64-bit hashes of any substrings of one byte array; equal strings hash alike wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            down = np.full(n + 1, _INVERSE, np.uint64)
            down[0] = 1
            np.cumprod(down, out=down)
            self._sum = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE_VALUES[data] * down[:n], out=self._sum[1:])
            up = np.full(n + 1, _BASE, np.uint64)
            up[0] = 1
            self._up = np.cumprod(up)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self._sum[ends] - self._sum[starts]) * self._up[starts]
            return mix(raw + (ends - starts).astype(np.uint64))


_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, row) of the words [^\\x20\\x09-\\x0D]+ of every row of a byte view."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    word = ~_BLANK[data]
    begins = np.flatnonzero(word & (~np.concatenate([[False], word])[:len(data)] | edge[:len(data)]))
    ends = np.flatnonzero(word & (~np.concatenate([word, [False]])[1:] | edge[1:])) + 1
    return begins, ends, np.searchsorted(offs, begins, "right") - 1


class HashIndex:
    """Position of 64-bit keys in a list of distinct ones, by an open-addressed table."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length() + 1)
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._place = np.zeros(1 << bits, np.int64), np.full(1 << bits, -1, np.int64)
        place = np.arange(len(keys))
        at = self._slot(keys)
        while len(place):
            free = self._place[at] < 0
            self._place[at[free]] = place[free]
            won = self._place[at] == place
            self._keys[at[won]] = keys[place[won]]
            place, at = place[~won], (at[~won] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 where a key is not in the list."""
        out = self._place[at := self._slot(keys)]
        todo = np.flatnonzero((out >= 0) & (self._keys[at] != keys))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self._mask
            out[todo] = self._place[at]
            on = (out[todo] >= 0) & (self._keys[at] != keys[todo])
            todo, at = todo[on], at[on]
        return out
