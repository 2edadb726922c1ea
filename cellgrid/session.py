"""Session defaults and lineage cutting that survives executor loss."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit every operator here; cluster sizing stays with spark-submit.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def build_session(app: str = "cellgrid", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only in local mode, where all tasks share this machine."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="cellgrid-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers once per application, so that Python functions import there."""
    sc = spark.sparkContext
    if getattr(sc, "_cellgrid_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="cellgrid-pkg-"), "cellgrid.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._cellgrid_shipped = True


def join_where_dealt(spark: SparkSession) -> None:
    """Joins by more keys than rows are dealt by take them where they are, as windows and sums do.

    Voxels are dealt by section; Spark would shuffle whole images again for a join by section, channel and coordinates.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, visible to all executors."""
    return f"{ensure_checkpoint_dir(spark)}/cellgrid-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame as a table in the shared checkpoint folder and read it back.

    The result survives lost executors. Unlike ``checkpoint()`` it carries the true size
    (so small tables are broadcast) and none of the old plan's inferred constraints, which
    would grow from round to round in loops.
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
