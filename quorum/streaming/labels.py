"""The label loop as a stream: new files of questions are labelled batch by batch, each batch written exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DONE = "_SUCCESS"


def label_loop(questions: DataFrame, label: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Label all that the stream has, and stop; started again, it goes on with what is new.

    A batch is written to a folder of its number, replacing what is there. The engine's log says which rows a number has, so a
    batch that is run again, because the driver died before its commit, writes the same rows to the same place. ``label`` should be
    deterministic where that matters; ``after`` is called between a batch's write and its commit.
    """

    def write(rows: DataFrame, number: int) -> None:
        label(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if after is not None:
            after(number)

    return questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def labelled(spark: SparkSession, out: str) -> DataFrame | None:
    """The rows of all batches whose write has ended, with their ``batch``; none if there is no such batch.

    The number of batches, not of rows, is listed on the driver.
    """
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*/{DONE}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    paths = [f.getPath().getParent().toString() for f in found or []]
    return spark.read.option("basePath", out).parquet(*paths).withColumn("batch", F.col("batch").cast("long")) if paths else None
