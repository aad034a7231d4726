"""Where stored intermediate tables go: the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; without that setting, a new temporary one for a local session, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def checkpoint(df: DataFrame) -> DataFrame:
    """df, cut from its lineage and stored in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def loop_checkpoint(df: DataFrame) -> DataFrame:
    """A stored table for loops that join tables with themselves. A checkpoint keeps the size that Spark guessed for its plan, a product for a join,
    so guesses square each round until planning computes with numbers of a million digits; files have their own size."""
    path = f"{shared_root(df.sparkSession)}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
