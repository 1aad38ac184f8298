"""Folders that the driver and all executors see, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder below spark.checkpoint.dir.

    Without that setting a local master gets a temporary folder, and a cluster
    the warehouse, unless that lies on a machine's own disk, which is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master == "local" or master.startswith("local["):
            base = tempfile.mkdtemp(prefix="sparkloom-")
        else:
            base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
            if base.startswith(("file:", "/")):
                raise ValueError("a cluster needs spark.checkpoint.dir, or a warehouse, in a shared file system")
    return f"{base.rstrip('/')}/sparkloom/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: it is computed once and outlives executors."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: a table in the shared folder, made at once.

    Not a checkpoint: that keeps the size that was estimated for df, and the
    estimate of a join is its sides' product, so that its digits double in each
    round of a loop until the driver's memory is full of them. A table has the
    size of its files.
    """
    return written(df, "cut")
