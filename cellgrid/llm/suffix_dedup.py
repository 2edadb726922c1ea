"""Suffix-array dedup: every byte covered by a repeated string of ``SPAN`` bytes goes.

Suffixes of a whole corpus meet in no single task. Every start of a ``SPAN``-byte string is
keyed by the least hash among the short strings inside it, which equal strings share
wherever they stand; consecutive starts with one key are a unit (about 85 starts). Keys that
occur once in the corpus, with one inner string, cannot hold a repeat and are dropped. Equal units collapse to one
context with a count. The texts of the contexts left are suffix-sorted, key by key:

* two-stage sorting: suffixes smaller than their successors are sorted directly, the others
  are induced from them by scanning the buckets of first bytes in order;
* adjacent common prefixes of at least ``SPAN`` bytes join suffixes to runs, and a run that
  stands for two or more starts of the corpus is a repeat.

A key with more than ``HOT`` different contexts (the border of a passage found everywhere)
is never sorted in one task: its contexts are keyed again by longer inner strings, level by
level, until at the last level a key is the whole string and has one context. So work per
task is bounded, nothing is capped, and no start is left out.

Hashes (64 bits for keys, 64 more for contexts of one key and length) only bring equal
strings together; strings are compared as bytes. Collapsing contexts trusts 128 bits.

Defined results: null text is empty; texts shorter than ``SPAN`` lose nothing; rows that
repeat another row count as further occurrences and are cut alike; empty tables give empty
tables; other columns pass through ``remove_repeats`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import SubstringHash, chunks, keyed, ragged, text_view
from cellgrid.session import cut_lineage

SPAN = 200
#: lengths of the inner strings that key a start, coarse to whole
LEVELS = (24, 128, 184, 198, 200)
#: different contexts of one key that may meet in one sort
HOT = 200
#: starts in one unit at most; longer runs (periodic texts) are cut, which loses nothing
UNIT = 256
#: bytes of context sorted at once
BLOCK = 2 << 20


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] for every i that has so many."""
    n = len(values)
    if n < width:
        return values[:0]
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def units(data: np.ndarray, offs: np.ndarray, inner: int):
    """Runs of starts that share a key: (row, first start in the row, number of starts, key, context hash, looped).

    ``looped`` is set where the inner string behind the key stands twice in the unit: only
    then can a unit repeat a string by itself.
    """
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none, none, none, none, none
    hashes = SubstringHash(data)
    at = np.arange(len(data) - inner + 1)
    width = SPAN - inner + 1
    strings = hashes.of(at, at + inner)
    keys = sliding_min(strings, width)
    room = np.maximum(np.diff(offs) - SPAN + 1, 0)
    row = np.repeat(np.arange(len(room)), room)
    where = ragged(offs[:-1], room)
    if not len(where):
        return none, none, none, none, none, none
    key = keys[where]
    new = np.ones(len(where), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(where)))
    cuts = -(-count // UNIT)
    if (cuts > 1).any():
        step = ragged(np.zeros(len(cuts)), cuts) * UNIT
        head, count = np.repeat(head, cuts) + step, np.minimum(np.repeat(count, cuts) - step, UNIT)
    begin = where[head]
    context = hashes.of(begin, begin + count + SPAN - 1)
    # an inner string is the least of some window around it if the greatest of those minima is its own
    around = np.full(len(strings) + width - 1, np.iinfo(np.uint64).max, np.uint64)
    around[width - 1:len(strings)] = ~keys
    least = np.flatnonzero(~sliding_min(around, width) == strings)
    low = np.searchsorted(least, begin)
    many = np.searchsorted(least, begin + count + width - 1) - low
    match = strings[least[ragged(low, many)]] == np.repeat(key[head], many)
    twice = np.bincount(np.repeat(np.arange(len(head)), many), match, minlength=len(head)) > 1.5
    return (row[head], begin - offs[:-1][row[head]], count, key[head].view(np.int64), context.view(np.int64), twice.astype(np.int64))


def _smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the next one; the last is not (the end is smallest)."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    turn = np.flatnonzero(step)
    return step[turn[np.searchsorted(turn, np.arange(n))]] > 0


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one big-endian number."""
    n = len(text)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = text
    out = np.empty(n + 8, np.uint64)
    for r in range(8):
        part = padded[r:r + (len(padded) - r) // 8 * 8].view(">u8")
        out[r::8] = part[:len(out[r::8])]
    return out


def _sort_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffix positions ordered by their first ``depth`` bytes; equal ones keep text order."""
    last = len(words) - 1
    at = at[np.argsort(words[at], kind="stable")]
    first = words[at]
    group = np.zeros(len(at), np.int64)
    np.cumsum(first[1:] != first[:-1], out=group[1:])
    slot = np.arange(len(at))
    for step in range(8, depth, 8):
        size = np.bincount(group) if len(group) else group
        tied = size[group] > 1
        slot, group = slot[tied], group[tied]
        if not len(slot):
            break
        key = words[np.minimum(at[slot] + step, last)]
        joint = group[1:] == group[:-1]
        split = joint & (key[1:] != key[:-1])
        if not split.any():
            continue
        # only groups in which the next eight bytes differ are sorted anew
        mixed = np.zeros(int(group[-1]) + 1, bool)
        mixed[group[1:][split]] = True
        move = np.flatnonzero(mixed[group])
        order = move[np.lexsort((key[move], group[move]))]
        at[slot[move]] = at[slot[order]]
        key[move] = key[order]
        new = np.ones(len(slot), bool)
        new[1:] = ~joint | (key[1:] != key[:-1])
        group = np.cumsum(new) - 1
    return at


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """The ``wanted`` suffix positions (a mask) in the order of their first ``depth`` bytes, by two-stage sorting.

    Besides the wanted positions only their successors up to the next directly sorted suffix
    take part, since an induced suffix depends on just those.
    """
    n = len(text)
    words = _words(text) if words is None else words
    small = _smaller_than_next(text)
    # positions from a wanted one through the next suffix that is sorted directly
    stop = np.flatnonzero(small)
    nearest = np.full(n, n - 1)
    if len(stop):
        index = np.searchsorted(stop, np.arange(n))
        nearest = np.where(index < len(stop), stop[np.minimum(index, len(stop) - 1)], n - 1)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, np.flatnonzero(wanted), 1)
    np.subtract.at(mark, nearest[wanted] + 1, 1)
    live = np.cumsum(mark[:n]) > 0
    direct = _sort_directly(np.flatnonzero(live & small), words, depth)
    byte = text[direct]
    ends = np.searchsorted(byte, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    take = live & ~small

    def induce(scanned: np.ndarray, bucket: int) -> np.ndarray:
        """Deals the larger predecessors of scanned suffixes to their buckets; returns those of this bucket."""
        before = scanned[scanned > 0] - 1
        before = before[take[before]]
        if not len(before):
            return before
        first = text[before]
        own = before[first == bucket]
        rest, first = before[first != bucket], first[first != bucket]
        if len(rest):
            order = np.argsort(first, kind="stable")
            rest, first = rest[order], first[order]
            for part in np.split(rest, np.flatnonzero(first[1:] != first[:-1]) + 1):
                induced[text[part[0]]].append(part)
        return own

    if n and take[n - 1]:
        induced[text[n - 1]].append(np.array([n - 1]))
    out = []
    for bucket in range(256):
        fresh = np.concatenate(induced[bucket]) if induced[bucket] else np.zeros(0, np.int64)
        while len(fresh):
            out.append(fresh)
            fresh = induce(fresh, bucket)
        sorted_part = direct[ends[bucket]:ends[bucket + 1]]
        if len(sorted_part):
            out.append(sorted_part)
            induce(sorted_part, bucket)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefix_reaches(order: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """For each suffix but the first, whether it shares ``length`` bytes (a multiple of 8) with the one before."""
    same = np.arange(max(len(order) - 1, 0))
    for step in range(0, length, 8):
        same = same[words[order[same] + step] == words[order[same + 1] + step]]
    out = np.zeros(max(len(order) - 1, 0), bool)
    out[same] = True
    return out


def repeated_starts(data: np.ndarray, offs: np.ndarray, copies: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per context (a row of the byte view) the ranges of starts whose string stands for several starts."""
    n = len(offs) - 1
    room = np.diff(offs) - SPAN + 1
    wanted = np.zeros(len(data), bool)
    wanted[ragged(offs[:-1], room)] = True
    words = _words(data)
    order = suffix_order(data, wanted, SPAN + 8, words)
    joint = common_prefix_reaches(order, words, SPAN)
    run = np.concatenate([[0], np.cumsum(~joint)]) if len(order) else np.zeros(0, np.int64)
    row = np.searchsorted(offs, order, "right") - 1
    repeated = np.bincount(run, copies[row])[run] > 1.5 if len(order) else np.zeros(0, bool)
    hit = np.zeros(len(data) + 1, bool)
    hit[order[repeated]] = True
    at = np.flatnonzero(hit)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if len(at):
        of = np.searchsorted(offs, at, "right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(at)) - 1
        for a, b, r in zip(at[head].tolist(), at[tail].tolist(), of[head].tolist(), strict=True):
            out[r].append((a - int(offs[r]), b - int(offs[r]) + 1))
    return out


_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_CONTEXT = ["key", "ctx", "m"]


def _packed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_id, _th, _doc, _z): texts in compressed form, which is what the joins move."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for part in chunks(batches, "_text"):
            z = [press.compress(t.as_buffer()) for t in part.column("_text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("_id", "_th", "_doc")), pa.array(z, pa.binary())],
                                             ["_id", "_th", "_doc", "_z"])

    rows = keyed(docs, doc_id, text).select("_id", "_th", "_doc", "_text")
    return rows.mapInArrow(run, "_id bigint, _th bigint, _doc bigint, _z binary")


def _unpacked(column: pa.Array) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(z.as_buffer()) for z in column]


def _occurrences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_rid, _id, _th, u): the units of every text, written once so that row numbers are fixed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text", 1 << 20):
            row, start, count, key, context, loop = units(*text_view(part.column("_text")), LEVELS[0])
            per = np.bincount(row, minlength=part.num_rows)
            flat = pa.StructArray.from_arrays([pa.array(key), pa.array(context), pa.array(start << 16 | loop << 15 | count)], ["key", "ctx", "sm"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_th"), lists], ["_id", "_th", "u"])

    found = keyed(docs, doc_id, text).select("_id", "_th", "_text").mapInArrow(
        run, "_id bigint, _th bigint, u array<struct<key:bigint,ctx:bigint,sm:bigint>>")
    return cut_lineage(found.where(F.size("u") > 0).withColumn("_rid", F.monotonically_increasing_id()))


def _texts_of(contexts: DataFrame, rows: DataFrame, packed: DataFrame) -> DataFrame:
    """Adds the bytes of each context, taken from the row it was first seen in."""
    wanted = contexts.groupBy("_rid").agg(F.collect_list(F.struct("key", "ctx", "m", "s", "n")).alias("c"))
    joined = packed.join(wanted.join(rows, "_rid"), ["_id", "_th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_z", 1 << 20):
            out: list[list] = [[], [], [], [], []]
            for text, c in zip(_unpacked(part.column("_z")), part.column("c").to_pylist(), strict=True):
                for x in c:
                    for column, value in zip(out, (x["key"], x["ctx"], x["m"], x["n"], text[x["s"]:x["s"] + x["m"] + SPAN - 1]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(
                out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["key", "ctx", "m", "n", "t"])

    # rows equal in id and text may have several numbers; each number is served by one of them
    return joined.dropDuplicates(["_rid"]).select("_z", "c").mapInArrow(run, "key bigint, ctx bigint, m int, n bigint, t binary")


def _sorted_contexts(contexts: DataFrame) -> DataFrame:
    """(key, ctx, m, r): ranges of repeated starts of each context; whole keys meet in a block."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("t").nbytes
            if size < BLOCK:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if cut:
                yield table.slice(0, cut)
            rest = table.slice(cut)
            held, size = rest.combine_chunks().to_batches(), rest.nbytes
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (b for whole in batches for b in chunks(iter([whole]), "t", BLOCK))
        for table in blocks(small):
            data, offs = text_view(table.column("t"))
            found = repeated_starts(data, offs, table.column("n").to_numpy())
            ranges = pa.array([[{"a": a, "b": b} for a, b in r] for r in found], _RANGES)
            keep = np.flatnonzero([bool(r) for r in found])
            columns = [table.column(c).combine_chunks() for c in _CONTEXT] + [ranges]
            yield pa.RecordBatch.from_arrays([(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c).take(pa.array(keep)) for c in columns], [*_CONTEXT, "r"])

    dealt = contexts.repartition("key").sortWithinPartitions("key")
    return dealt.select(*_CONTEXT, "n", "t").mapInArrow(run, "key bigint, ctx bigint, m int, r array<struct<a:int,b:int>>")


def _finer(hot: DataFrame, inner: int) -> DataFrame:
    """Units of contexts under a longer inner string, with their parent and place in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "t", 1 << 20):
            data, offs = text_view(part.column("t"))
            row, start, count, key, context, loop = units(data, offs, inner)
            begin = offs[:-1][row] + start
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(begin.tolist(), (begin + count + SPAN - 1).tolist(), strict=True)]
            parent = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                *(part.column(c).take(parent) for c in ("key", "ctx", "m", "n")), pa.array(key), pa.array(context),
                pa.array(count.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(loop), pa.array(texts, pa.binary()),
            ], ["pkey", "pctx", "pm", "n", "key", "ctx", "m", "s", "l", "t"])

    return hot.mapInArrow(run, "pkey bigint, pctx bigint, pm int, n bigint, key bigint, ctx bigint, m int, s int, l bigint, t binary")


def _split_hot(contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    per_key = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("d"))
    tagged = contexts.join(per_key, "key")
    return tagged.where(F.col("d") <= HOT).drop("d"), tagged.where(F.col("d") > HOT).drop("d")


def repeated_ranges(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _th, r): ranges [a, b) of bytes covered by repeated strings, possibly overlapping."""
    packed = _packed(docs, doc_id, text)
    rows = _occurrences(docs, doc_id, text)
    every = rows.select("_rid", F.explode("u").alias("u")).select("_rid", "u.*")
    loop = F.shiftright("sm", 15).bitwiseAND(F.lit(1))
    twice = every.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(loop).alias("l")).where("c > 1 or l > 0").select("key")
    seen = cut_lineage(every.join(twice, "key").select(
        "_rid", "key", "ctx", F.shiftright("sm", 16).cast("int").alias("s"), F.col("sm").bitwiseAND(F.lit(0x7FFF)).cast("int").alias("m")))
    contexts = seen.groupBy(*_CONTEXT).agg(F.count(F.lit(1)).alias("n"), F.first("_rid").alias("_rid"), F.first("s").alias("s"))
    now = cut_lineage(_texts_of(contexts, rows.select("_rid", "_id", "_th"), packed))
    parents: list[DataFrame] = []
    found: list[DataFrame] = []
    for inner in LEVELS[1:]:
        cold, hot = _split_hot(now)
        found.append(cut_lineage(_sorted_contexts(cold)))
        hot = cut_lineage(hot)
        if hot.isEmpty():
            break
        children = cut_lineage(_finer(hot, inner))
        again = children.groupBy("key").agg(F.sum("n").alias("c"), F.max("l").alias("l")).where("c > 1 or l > 0").select("key")
        children = cut_lineage(children.drop("l").join(again, "key"))
        parents.append(children.select("key", "ctx", "m", "s", "pkey", "pctx", "pm"))
        now = cut_lineage(children.groupBy(*_CONTEXT).agg(F.sum("n").alias("n"), F.first("t").alias("t")))
    else:
        # a key of the last level is a whole string: one context to a key
        found.append(cut_lineage(_sorted_contexts(now)))
    result = found[-1]
    for children, own in zip(parents[::-1], found[-2::-1], strict=True):
        up = result.join(children, _CONTEXT).select(
            F.col("pkey").alias("key"), F.col("pctx").alias("ctx"), F.col("pm").alias("m"),
            F.transform("r", lambda x: F.struct((x.a + F.col("s")).alias("a"), (x.b + F.col("s")).alias("b"))).alias("r"))
        result = cut_lineage(own.unionByName(up))
    # a context that met finer levels has one row per child; occurrences meet one row per context
    result = _joined_ranges(result.groupBy(*_CONTEXT).agg(F.flatten(F.collect_list("r")).alias("r")))
    hits = seen.join(result, _CONTEXT).select("_rid", F.transform("r", lambda x: F.struct(
        (F.col("s") + x.a).alias("a"), (F.col("s") + x.b + SPAN - 1).alias("b"))).alias("r"))
    return hits.groupBy("_rid").agg(F.flatten(F.collect_list("r")).alias("r")).join(
        rows.select("_rid", "_id", "_th"), "_rid").groupBy("_id", "_th").agg(F.flatten(F.collect_list("r")).alias("r"))


def joined_runs(lists: pa.ListArray) -> pa.ListArray:
    """Each row's ranges as maximal runs in order; ranges that meet are joined."""
    lens = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lens), dtype=np.int64), lens) << 32  # keeps the rows apart
    a, b = (flat.field(c).to_numpy().astype(np.int64) + row for c in ("a", "b"))
    order = np.argsort(a, kind="stable")
    a, b, row = a[order], b[order], row[order]
    reach = np.maximum.accumulate(b) if len(b) else b
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > reach[:-1]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(a))[:len(head)] - 1
    runs = pa.StructArray.from_arrays([pa.array((v - row[head]).astype(np.int32)) for v in (a[head], reach[tail])], ["a", "b"])
    ends = np.searchsorted(row[head] >> 32, np.arange(len(lens) + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), runs)


def _joined_ranges(contexts: DataFrame) -> DataFrame:
    """(key, ctx, m, r) with the ranges of each context as maximal runs, which is what every occurrence then carries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in _CONTEXT), joined_runs(part.column("r"))], [*_CONTEXT, "r"])

    return contexts.mapInArrow(run, "key bigint, ctx bigint, m int, r array<struct<a:int,b:int>>")


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges as maximal disjoint runs in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in ranges or []):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def repeat_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the remaining bytes."""
    ranges = repeated_ranges(docs, doc_id, text)
    full = _packed(docs, doc_id, text).join(ranges, ["_id", "_th"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_z", 1 << 20):
            texts = _unpacked(part.column("_z"))
            runs = [merged(r) for r in part.column("r").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                part.column("_doc"), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()), pa.array([len(r) for r in runs], pa.int64()),
                pa.array([hashlib.sha256(without(t, r)).hexdigest() for t, r in zip(texts, runs, strict=True)], pa.string()),
            ], ["_doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return full.select("_doc", "_z", "r").mapInArrow(
        run, "_doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").withColumnRenamed("_doc", doc_id)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every repeated byte taken out of its texts; a null text stays null.

    Where a repeat begins or ends inside a character, the character's remaining bytes go too.
    """
    names = docs.columns
    ranges = repeated_ranges(docs, doc_id, text)
    rest = [c for c in names if c != text]
    whole = docs.select(F.struct(*[docs[c] for c in rest], docs[text].isNull().alias("_void")).alias("_row"),
                        F.coalesce(docs[doc_id], F.lit(0)).cast("long").alias("_id"),
                        F.xxhash64(docs[doc_id], docs[text]).alias("_th"), F.coalesce(docs[text], F.lit("")).alias("_text"))
    row = whole.schema["_row"].dataType.simpleString()

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for part in chunks(batches, "_text"):
            z = [squeeze.compress(t.as_buffer()) for t in part.column("_text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("_row", "_id", "_th")), pa.array(z, pa.binary())],
                                             ["_row", "_id", "_th", "_z"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_z", 1 << 20):
            texts = [without(t, merged(r)).decode("utf-8", "ignore")
                     for t, r in zip(_unpacked(part.column("_z")), part.column("r").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(texts, pa.string())], ["_row", "_text"])

    joined = whole.mapInArrow(press, f"_row {row}, _id bigint, _th bigint, _z binary").join(ranges, ["_id", "_th"], "left")
    kept = joined.select("_row", "_z", "r").mapInArrow(cut, f"_row {row}, _text string")
    return kept.select(*[F.when(~F.col("_row._void"), F.col("_text")).alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in names])
