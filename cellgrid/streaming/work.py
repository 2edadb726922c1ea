"""Work ledger (what is still to do) and incremental pick-up of new cell tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: order of the processing operations; each needs the one before it
OPERATIONS = ["stitch", "unmix", "register", "quantify"]


def _with_prerequisite(work_log: DataFrame) -> DataFrame:
    """Adds the previous operation's done flag of the same file (NULL for the first operation)."""
    needs = F.create_map(*[x for a, b in zip(OPERATIONS[1:], OPERATIONS) for x in (F.lit(a), F.lit(b))])
    left = work_log.withColumn("needs", F.try_element_at(needs, F.col("operation")))
    prev = work_log.select("path", F.col("operation").alias("needs"), F.col("done").alias("_ready"))
    return left.join(prev, ["path", "needs"], "left")


def pending_work(work_log: DataFrame, redo: bool = False) -> DataFrame:
    """Enabled operations whose prerequisite is done and which are not done yet (or all of them on redo)."""
    w = _with_prerequisite(work_log)
    ready = F.col("needs").isNull() | F.coalesce("_ready", F.lit(False))
    todo = F.lit(True) if redo else ~F.col("done")
    return w.where(F.col("enabled") & ready & todo).select("path", "operation")


def skipped_work_report(work_log: DataFrame) -> DataFrame:
    """Every incomplete operation with the reason it is not runnable, or 'ready'."""
    w = _with_prerequisite(work_log).where(~F.col("done"))
    reason = (F.when(~F.col("enabled"), "disabled")
              .when(F.col("needs").isNotNull() & ~F.coalesce("_ready", F.lit(False)), F.concat(F.lit("needs "), F.col("needs")))
              .otherwise("ready"))
    return w.select("path", "operation", reason.alias("reason"))


#: state kept on disk beside the checkpoint, not on the executors' heaps
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def incremental_cells(stream: DataFrame, table_path: str, checkpoint: str, key: str = "cell_id",
                      time: str | None = None, delay: str = "7 days"):
    """Pick up new per-section files once and keep each cell once.

    Seen keys are state, dealt by key hash and kept in the checkpoint; a batch looks up its
    own keys and never reads the table again, so its cost does not grow with the table. With
    an event-time column ``time`` keys are forgotten ``delay`` after the watermark passes
    them, which bounds the state; rows that come later than that, or carry a time before 1970, are
    dropped as late, so leave ``time`` out where every row counts. The file sink records each batch
    once, also when it is replayed. Null keys are one key. Returns the finished query; read totals
    with ``incremental_totals``.
    """
    once = stream.dropDuplicates([key]) if time is None else stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE)
    conf.set(STATE_STORE, ROCKS)
    try:
        q = (once.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        conf.set(STATE_STORE, before)
    return q


def incremental_totals(spark, table_path: str, by: str = "type") -> DataFrame:
    return spark.read.parquet(table_path).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
