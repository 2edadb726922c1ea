"""Ranks and exact quantiles that never put one large group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrid.session import cut_lineage


def bucketed_row_number(df: DataFrame, keys: list[str], order: list, bucket: Column, name: str) -> DataFrame:
    """1-based row number of each row within ``keys`` ordered by ``order``.

    ``bucket`` must be a monotone, coarse form of the leading order column. Rows are
    numbered inside (keys, bucket), and bucket sizes are prefix-summed, so the widest
    window holds one bucket instead of one whole (possibly very large) group.
    """
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (tagged.join(offsets, [*keys, "_bucket"])
            .withColumn(name, F.row_number().over(inside) + F.col("_offset"))
            .drop("_bucket", "_offset"))


def hash_row_number(df: DataFrame, keys: list[str], hashed: Column, tie: list, name: str) -> DataFrame:
    """Row number by a 32-bit hash: the top 12 bits make 4096 even buckets."""
    return bucketed_row_number(df.withColumn("_h", hashed), keys, [F.col("_h"), *tie],
                               F.shiftright(F.col("_h"), 20), name).drop("_h")


def range_row_number(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """1-based row number within ``keys`` ordered by ``order``, for values of any spread.

    Rows are dealt by ranges of (keys, order), so a large group spans many parts; they are
    written once, which fixes the part numbers, and part sizes are prefix-summed.
    """
    dealt = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    return bucketed_row_number(dealt, keys, order, F.col("_part"), name).drop("_part")


def range_running_sum(df: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to and including this one in ``order``.

    Rows are dealt by ranges of the order and written once; each part's sum is carried
    to the parts after it, so the only window without a key has one row per part.
    """
    dealt = cut_lineage(df.withColumn(name, value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.sum(name).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(starts, "_part").withColumn(name, F.sum(name).over(inside) + F.col("_start")).drop("_part", "_start")


def overlapping_blocks(df: DataFrame, keys: list[str], order: list, halo: int, size: int = 4096) -> DataFrame:
    """Rows in blocks of ``size`` consecutive ranks, with the ``halo`` rows before and after each block.

    Adds ``_block`` and ``_core`` (false for the repeated rows): a window over (keys, _block)
    sees all rows within ``halo`` ranks of a core row and never a whole group.
    """
    rank = F.col("_rank") - 1
    spread = F.sequence(F.greatest(F.floor((rank - halo) / size), F.lit(0)), F.floor((rank + halo) / size))
    return (range_row_number(df, keys, order, "_rank").withColumn("_block", F.explode(spread))
            .withColumn("_core", F.col("_block") == F.floor(rank / size)).drop("_rank"))


def exact_percentiles(df: DataFrame, keys: list[str], value: Column, ps: dict[str, float],
                      accuracy: int = 10000, rule: str = "linear") -> DataFrame:
    """Exact linear-interpolated percentiles per group, one column per entry of ``ps``.

    A mergeable sketch brackets each wanted rank; only rows inside the bracket are
    sorted. Groups no larger than ``accuracy`` are bracketed by their whole range.
    ``rule`` is 'linear' (0-based rank p*(n-1)) or 'quick' (1-based rank n*p, ends clamped).
    """
    keys_in = keys
    base = df.select(*keys, value.cast("double").alias("_v")).where("_v is not null")
    if not keys:
        # a key the optimizer cannot fold away, so the join below stays a hash join
        base, keys = base.withColumn("_g", F.pmod(F.hash("_v"), F.lit(1))), ["_g"]
    eps = 3.0 / accuracy
    probes = [q for p in ps.values() for q in (max(0.0, p - eps), min(1.0, p + eps))]
    sketch = base.groupBy(*keys).agg(
        F.percentile_approx("_v", probes, accuracy).alias("_b"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.count("_v").alias("_n"))
    small = F.col("_n") <= accuracy

    def position(p: float) -> Column:
        if rule == "linear":
            return F.lit(p) * (F.col("_n") - 1)
        return F.least(F.greatest(F.col("_n") * F.lit(p) - 1.0, F.lit(0.0)), F.col("_n") - 1.0)

    brackets = sketch.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(name).alias("_p"), position(p).alias("_pos"),
                 F.when(small, F.col("_min")).otherwise(F.col("_b")[2 * i]).alias("_lo"),
                 F.when(small, F.col("_max")).otherwise(F.col("_b")[2 * i + 1]).alias("_hi"))
        for i, (name, p) in enumerate(ps.items())])).alias("_s")).select(*keys, "_s.*")
    if not keys_in:
        brackets = F.broadcast(brackets)  # len(ps) rows
    counted = (base.join(brackets, keys).where(F.col("_v") <= F.col("_hi"))
               .groupBy(*keys, "_p", "_pos", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_x"))
               .agg(F.count(F.lit(1)).alias("_c")))
    upto = Window.partitionBy(*keys, "_p").orderBy(F.col("_x").asc_nulls_first())
    ranked = counted.withColumn("_end", F.sum("_c").over(upto.rowsBetween(Window.unboundedPreceding, 0)))

    def at(rank: Column) -> Column:
        inside = (F.col("_end") - F.col("_c") <= rank) & (rank < F.col("_end"))
        return F.max(F.when(inside, F.col("_x")))

    floor, ceil = F.floor("_pos"), F.ceil("_pos")
    picked = ranked.groupBy(*keys, "_p", "_pos").agg(at(floor).alias("_a"), at(ceil).alias("_z"))
    valued = picked.withColumn("_q", F.col("_a") + (F.col("_pos") - F.floor("_pos")) * (F.col("_z") - F.col("_a")))
    wide = valued.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_p") == name, F.col("_q"))).alias(name) for name in ps])
    return wide.drop("_g") if not keys_in else wide
