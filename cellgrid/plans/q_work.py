"""Work-ledger and incremental queries."""

from pyspark.sql import functions as F

from cellgrid.plans.catalog import query
from cellgrid.sources.sinks import scratch_path
from cellgrid.streaming import work as wk

PRE = """w as (select *, case operation when 'unmix' then 'stitch' when 'register' then 'unmix' when 'quantify' then 'register' end as needs from work_log),
j as (select w.*, p.done as ready from w left join work_log p on p.path=w.path and p.operation=w.needs)"""


@query("pending_work", f"with {PRE} select path, operation from j where enabled and not done and (needs is null or coalesce(ready,false))")
def _(t):
    return wk.pending_work(t.work_log)


@query("pending_work_redo", f"with {PRE} select path, operation from j where enabled and (needs is null or coalesce(ready,false))")
def _(t):
    return wk.pending_work(t.work_log, redo=True)


@query("skipped_work_report", f"""with {PRE} select path, operation, case when not enabled then 'disabled' when needs is not null and not coalesce(ready,false)
    then 'needs '||needs else 'ready' end as reason from j where not done""")
def _(t):
    return wk.skipped_work_report(t.work_log)


@query("incremental_cells", "select event_type as type, count(*) as n from events group by 1", i="n")
def _(t):
    """Day files arrive in two deliveries (one file twice); every event is counted once."""
    root, table, ckpt = (scratch_path(t.spark, n) for n in ("incoming", "table", "ckpt"))
    e = t.events.select(F.col("event_id").alias("cell_id"), F.col("event_type").alias("type"), F.to_date("ts").alias("day"))
    schema = "cell_id bigint, type string, day date"
    first = e.where("dayofmonth(day) <= 15")
    first.repartition("day").write.mode("append").parquet(root)
    stream = lambda: t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(root)
    wk.incremental_cells(stream(), table, ckpt)
    e.repartition("day").write.mode("append").parquet(root)  # redelivers the first half
    wk.incremental_cells(stream(), table, ckpt)
    return wk.incremental_totals(t.spark, table)
