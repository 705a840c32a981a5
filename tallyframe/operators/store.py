"""What iterative plans keep between rounds: in the shared checkpoint folder, so that a lost executor costs a read."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a new temporary folder, if all runs on one machine; an error on a cluster."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallyframe-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def held(df: DataFrame) -> DataFrame:
    """`df`, computed once and checkpointed."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the files of shuffles whose plans nothing refers to any more, before more is shuffled; else that is left to when the driver's heap fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
