"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.ranking import bucketed_row_number, range_running_sum
from cellgrid.schema import SchemaMismatch
from cellgrid.session import shared_path as scratch_path  # noqa: F401


def sink_cells_csv(cells: DataFrame, path: str) -> None:
    cells.write.mode("overwrite").option("header", True).csv(path)


def mapper_input(expr: DataFrame) -> DataFrame:
    """Genes capitalised, counts as range-checked 16-bit integers."""
    v = F.col("value")
    checked = F.when((v >= 0) & (v <= 65535), F.floor(v).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("value outside 16-bit range: "), v.cast("string"))).cast("int"))
    return expr.select("cell_id", F.initcap("gene").alias("gene"), checked.alias("count"))


def sink_mapper_input(expr: DataFrame, path: str) -> None:
    mapper_input(expr).write.mode("overwrite").parquet(path)


#: fixed values: bytes of one value of each type of fixed width
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8}


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values: fixed widths, UTF-8 lengths, elements of arrays; nulls take none, nested rows their JSON."""
    def of(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in WIDTHS:
            return F.when(c.isNotNull(), F.lit(WIDTHS[kind])).otherwise(F.lit(0))
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0))
        element = kind.removeprefix("array<").removesuffix(">")
        if element in WIDTHS:
            return F.when(c.isNotNull(), F.size(c) * WIDTHS[element]).otherwise(F.lit(0))
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))

    return sum((of(f.name, f.dataType.simpleString()).cast("long") for f in df.schema.fields), F.lit(0).cast("long"))


def split_by_size(df: DataFrame, order: str, bytes_per_file: int) -> DataFrame:
    """Add ``part``: ceil(measured bytes/limit) contiguous, equal row ranges; the remainder joins the last part.

    Rows of one size keep to the limit but for that remainder; ``split_by_bytes`` keeps to it at any row sizes.
    ``order`` must be a numeric id; row numbers are built bucket by bucket.
    """
    if df.schema[order].dataType.typeName() not in ("long", "integer"):
        raise SchemaMismatch(f"{order} must be an integer id")
    measured = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df)).alias("bytes")).first()
    parts = max(1, -(-(measured["bytes"] or 0) // bytes_per_file))
    size = max(1, measured["n"] // parts)
    numbered = bucketed_row_number(df, [], [order], F.floor(F.col(order) / 65536), "_rn")
    return numbered.withColumn("part", F.least(F.floor((F.col("_rn") - 1) / size), F.lit(parts - 1)).cast("int")).drop("_rn")


def split_by_bytes(df: DataFrame, order: str, bytes_per_file: int, room: int = 2) -> DataFrame:
    """Add ``part``: contiguous ranges in ``order``, cut by the running sum of row bytes, none over ``bytes_per_file``.

    A part ends where the sum passes a multiple of the limit less the largest row, so the
    row that lies across the cut still fits. Where ``room`` rows of the largest size are over the limit,
    ``SchemaMismatch`` is raised: at 2 parts are half full at least, at 1 each row just fits a part and parts may
    hold little besides. Numbers of parts may have gaps.
    """
    largest = df.agg(F.max(row_bytes(df))).first()[0] or 0
    if room * largest > bytes_per_file:
        raise SchemaMismatch(f"a row of {largest} bytes needs a limit of at least {room} times as much")
    step = max(1, bytes_per_file - largest)
    summed = range_running_sum(df, [F.col(order)], row_bytes(df), "_upto")
    return summed.withColumn("part", F.greatest(F.floor((F.col("_upto") - 1) / step), F.lit(0)).cast("long")).drop("_upto")


def sink_split_by_size(df: DataFrame, order: str, bytes_per_file: int, path: str) -> None:
    split_by_size(df, order, bytes_per_file).write.mode("overwrite").partitionBy("part").parquet(path)


def sink_split_by_bytes(df: DataFrame, order: str, bytes_per_file: int, path: str) -> None:
    """One folder per part of at most ``bytes_per_file`` bytes of values, for rows of any size up to that."""
    split_by_bytes(df, order, bytes_per_file, 1).write.mode("overwrite").partitionBy("part").parquet(path)
