"""Tables cut from their lineage, in the folder that the cluster names."""

from __future__ import annotations

import gc
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a local one where the session names none and runs in local
    mode, as in tests."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            named = os.path.join(tempfile.gettempdir(), "kinlink-checkpoints")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, written once and read again from there on, so that later steps don't compute them anew and survive lost
    executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def by_shuffle(df: DataFrame) -> DataFrame:
    """For a join with a table that grows with the input: both sides are shuffled. Spark's estimates go by the size of the files
    and know nothing of what explode() or a checkpoint made of them, so it may send such a table through the driver."""
    return df.hint("merge")


def drop_shuffles(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files and checkpoints that no table refers to any more. It does so when the driver's memory is
    collected, which may else be long after, with all of them on disk."""
    for _ in range(2):  # what the first lets go of may hold others
        gc.collect()
        time.sleep(0.5)  # Python tells the driver what it has let go of in a thread of its own, every 0.1 s
        spark.sparkContext._jvm.System.gc()
