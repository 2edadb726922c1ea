"""Merkle manifest of a dataset: a leaf per row, a tree per group in key order, a tree over the groups, a proof per row.

Rows get their position in their group from a range shuffle: the rank inside a range part plus the counts of the parts
before it, so a group of any size is spread over as many tasks as its size asks for. Trees are then climbed in strides
of ``LEVELS`` levels. A stride deals rows by (group, position // span), sorts each run of ``span`` rows once, and
adds the levels as columns: on level l the rows at multiples of fanout^l are the nodes, lag and lead by fixed
multiples of fanout^l, masked by the node's slot and by the end of the run, are its siblings, and the first child's
row hashes the parent. Only nodes hash; the other rows take siblings from the last node above them. Each stride
passes one row per run to the next, whose paths come back by a join of one row per run, so the whole tree costs two
hashes and a few hundred bytes a row, and the number of jobs grows with the logarithm of the largest group.

A digest is lowercase hex SHA-256 of concatenated strings. A path step is (before, after): the digests of the siblings
left and right of the node, both empty where it is alone in its run.

Defined results: null, empty and very long values are hashed as they are, a null apart from any text. Null keys come
first in their group; rows that share a key are ordered by leaf, and equal rows each have a place and a proof. A null
group is a group of its own, before all others. A group of one row has its leaf as subroot. An empty table gives an
empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrid.session import cut_lineage

#: rows of a run are at most this many; a power of the fanout near it is taken
RUN_ROWS = 1024
#: bits that number the rows of one partition in monotonically_increasing_id
_ROW_BITS = 33


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """'-' for null, else byte count, ':', value: no two rows of fields read alike."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: list[Column]) -> Column:
    return digest(*[field(c) for c in columns])


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds _pos, the 0-based place in the group in ``order`` (nulls first), and _n, the group's size."""
    columns = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    tagged = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    # written, so that a lost executor cannot deal the rows anew under numbers already used
    tagged = cut_lineage(tagged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _ROW_BITS)
    held = tagged.groupBy(group, part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    by = Window.partitionBy(group)
    starts = held.select(F.col(group).alias("_of_group"), F.col("_part").alias("_of_part"), "_first",
                         (F.sum("_size").over(by.orderBy("_part")) - F.col("_size")).alias("_before"),
                         F.sum("_size").over(by).alias("_n"))
    return (tagged.join(starts, F.col(group).eqNullSafe(F.col("_of_group")) & (part == F.col("_of_part")))
            .withColumn("_pos", F.col("_before") + F.col("_at") - F.col("_first"))
            .drop("_at", "_of_group", "_of_part", "_first", "_before"))


def _run_levels(fanout: int) -> int:
    levels = 1
    while fanout ** (levels + 1) <= RUN_ROWS:
        levels += 1
    return levels


def _stride(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Climbs ``levels`` levels from (_g, _pos, _h, _n): adds _run, _path, _top (the run's root)."""
    span = fanout ** levels
    by = Window.partitionBy("_g", "_run").orderBy("_pos")
    out = nodes.withColumn("_run", F.floor(F.col("_pos") / span).cast("long")).withColumn("_h0", F.col("_h"))
    for level in range(levels):
        step, held = fanout ** level, f"_h{level}"
        slot = F.floor(F.col("_pos") / step).cast("long") % fanout
        node = (F.col("_pos") % step == 0) & (F.col("_n") > step)
        beside = range(1, fanout)
        sides = out.select("*", *[F.lag(held, j * step).over(by).alias(f"_left{j}") for j in beside],
                           *[F.lead(held, j * step).over(by).alias(f"_right{j}") for j in beside])
        before = F.concat(F.lit(""), *[F.coalesce(F.when(slot >= j, F.col(f"_left{j}")), F.lit("")) for j in reversed(beside)])
        after = F.concat(F.lit(""), *[F.coalesce(F.when(slot + j < fanout, F.col(f"_right{j}")), F.lit("")) for j in beside])
        out = sides.select(
            *out.columns,
            F.when(node, F.struct(before.alias("before"), after.alias("after"))).alias(f"_s{level}"),
            # a group that has ended keeps its root; else the first child's row hashes the parent
            F.when(F.col("_n") <= step, F.col(held)).when(F.col("_pos") % (step * fanout) == 0, digest(F.col(held), after))
            .alias(f"_h{level + 1}"))
    sofar = by.rowsBetween(Window.unboundedPreceding, 0)
    steps = F.array(*[F.last(f"_s{level}", ignorenulls=True).over(sofar) for level in range(levels)])
    return out.select(*nodes.columns, "_run", F.filter(steps, lambda s: s.isNotNull()).alias("_path"),
                      F.first(f"_h{levels}").over(sofar).alias("_top"))


def climb(nodes: DataFrame, fanout: int) -> DataFrame:
    """Adds _path and _root to rows (_g, _pos, _h, _n): the steps from each leaf to the root of its group, and that root."""
    levels = _run_levels(fanout)
    span = fanout ** levels
    largest = nodes.agg(F.max("_n")).first()[0] or 0
    low = _stride(nodes, fanout, levels)
    if largest <= span:
        return low.withColumnRenamed("_top", "_root").drop("_run")
    low = cut_lineage(low)
    upper = (low.where((F.col("_pos") % span == 0) & (F.col("_n") > span))
             .select("_g", F.col("_run").alias("_pos"), F.col("_top").alias("_h"), F.ceil(F.col("_n") / span).cast("long").alias("_n")))
    upper = climb(upper, fanout).select(F.col("_g").alias("_ug"), F.col("_pos").alias("_up"), F.col("_path").alias("_more"), "_root")
    joined = low.join(upper, F.col("_g").eqNullSafe(F.col("_ug")) & (F.col("_run") == F.col("_up")), "left")
    return joined.select(*nodes.columns, F.concat("_path", F.coalesce("_more", F.slice("_path", 1, 0))).alias("_path"),
                         F.coalesce("_root", "_top").alias("_root"))


def manifest(leaves: DataFrame, group: str, order: list[str], leaf: str = "leaf", fanout: int = 2) -> DataFrame:
    """``leaves`` with subroot, root and path (from the leaf via the subroot to the root)."""
    if fanout < 2:
        raise ValueError("a node has two children or more")
    kept = leaves.columns
    rows = leaves.select(F.col(group).alias("_g"), F.col(leaf).alias("_h"), F.struct(*order).alias("_key"), F.struct(*kept).alias("_row"))
    low = cut_lineage(climb(positions(rows, "_g", ["_key", "_h"]), fanout))
    subroots = (low.where("_pos = 0").select(F.lit(0).alias("_all"), F.col("_g").alias("_of"), F.col("_root").alias("_h")))
    high = climb(positions(subroots, "_all", ["_of"]).withColumnRenamed("_all", "_g"), fanout)
    high = high.select("_of", F.col("_path").alias("_more"), F.col("_root").alias("root"))
    return low.join(high, F.col("_g").eqNullSafe(F.col("_of"))).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in kept], F.col("_root").alias("subroot"), "root", F.concat("_path", "_more").alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, leaf, lambda h, s: digest(s.before, h, s.after))


def proof_digest(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.before, s.after)), ""), 256)


def audit(docs: DataFrame, columns: list[str], group: str, key: str, tampered: dict[str, Column], where: Column,
          fanout: int = 2) -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256 of the table as it is; folded_root of the row with the columns in
    ``tampered`` replaced where ``where`` holds; verified, whether that is the root."""
    changed = leaf_of([tampered.get(c, F.col(c)) for c in columns])
    leaves = docs.select(F.col(key).alias("_id"), F.col(group).alias("_group"), leaf_of([F.col(c) for c in columns]).alias("_leaf"),
                         F.when(where, changed).alias("_seen"))
    proved = manifest(cut_lineage(leaves), "_group", ["_id"], "_leaf", fanout)
    folded = fold(F.coalesce("_seen", "_leaf"), F.col("path"))
    out = proved.select(F.col("_id").alias(key), F.col("_leaf").alias("leaf"), "subroot", "root",
                        proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
