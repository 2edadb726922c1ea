"""Registry of queries with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.plans.bindings import Inputs, with_bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: moves exact decimal ties off the rounding boundary, where summation order would decide
NUDGE = 3.7e-10


def query(name: str, sql: str | None = None, d: str = "", i: str = "", digits: int = 6):
    """Register ``fn(inputs) -> DataFrame``.

    ``d`` names double columns (rounded on both sides), ``i`` names integer columns
    (cast to BIGINT on both sides). ``sql`` is the independent DuckDB statement.
    """
    doubles, ints = d.split(), i.split()

    def register(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(Inputs(spark, sf_dir))
            cols = []
            for c in out.columns:
                if c in doubles:
                    cols.append((F.round(F.col(c).cast("double") + F.lit(NUDGE), digits) + F.lit(0.0)).alias(c))
                elif c in ints:
                    cols.append(F.col(c).cast("bigint").alias(c))
                else:
                    cols.append(F.col(c))
            return out.select(*cols)

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            swaps = [f"(round(({c})::double + {NUDGE}::double, {digits}) + 0.0) AS {c}" for c in doubles]
            swaps += [f"({c})::bigint AS {c}" for c in ints]
            body = with_bindings(sql.strip())
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(swaps)}) FROM (\n{body}\n)" if swaps else body
        return fn

    return register
