"""Cutting of lineage in loops, and tables of the library's own: both in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder under spark.checkpoint.dir that this application's checkpoints go to. Where the setting is unset, a local master (as in
    tests) gets a folder of our own; on a cluster that is an error, as each executor would write to its own disk."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quorum-loops-"))
    return context.getCheckpointDir()


def checkpointed(frame: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)
