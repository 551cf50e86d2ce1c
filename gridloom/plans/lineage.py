"""Cutting lineage so that a lost executor costs little, and bounds for what may be broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows of a handful of numbers each that may be broadcast: a few MB.
MAX_BROADCAST_ROWS = 65_536


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset a session on one machine gets a temporary
    folder; on a cluster, whose executors do not share one, that is an error."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Tables estimated below this many bytes may come in one partition or a few, whatever work their rows stand for.
SMALL_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal a small table's rows to all cores before a join multiplies them; larger ones stay as they were read."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else df
