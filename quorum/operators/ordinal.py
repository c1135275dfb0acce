"""Numbers of rows in a global order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..names import fresh


def numbered(frame: DataFrame, order: list[str], name: str = "rn", total: Column | None = None, running: str = "running") -> DataFrame:
    """Add ``name``, from 1 in the order of the columns (which must tell all rows apart), and the running sum of ``total`` if given.

    Rows are dealt out by ranges of the order and checkpointed, so that the ranges are drawn once; rows are numbered inside
    their range, and the counts of the ranges before (one row for each partition, broadcast) are added. Helper columns take free names;
    ``name`` and, with a total, ``running`` replace columns of these names.
    """
    part, n, s, first, start, value = fresh([*frame.columns, name, running], "range", "n", "s", "first", "start", "value")
    weighed = frame.withColumn(value, total) if total is not None else frame.withColumn(value, F.lit(0))
    dealt = checkpointed(weighed.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    own = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(n), F.sum(value).alias(s))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first), F.coalesce(F.sum(s).over(before), F.lit(0)).alias(start))
    made = {name: F.count(F.lit(1)).over(own) + F.col(first)} | ({running: F.sum(value).over(own) + F.col(start)} if total is not None else {})
    return dealt.join(F.broadcast(starts), part).withColumns(made).drop(part, first, start, value)


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], name: str = "row_id") -> DataFrame:
    """Rows of both side by side, by their places in their orders (J11). The action fails where one has more rows than the other."""
    here, there = fresh([*left.columns, *right.columns, name], "here", "there")
    a, b = (numbered(f, order, name).withColumn(mark, F.lit(True)) for f, order, mark in ((left, left_order, here), (right, right_order, there)))
    alone = F.concat(F.lit("lengths differ: row "), F.col(name).cast("string"), F.lit(" has no partner"))
    both = F.when(F.col(here) & F.col(there), F.col(name)).otherwise(F.raise_error(alone).cast("long"))
    return a.join(b, name, "full_outer").withColumn(name, both).drop(here, there)


def micro_batches(frame: DataFrame, order: list[str], size: int) -> DataFrame:
    """Add ``batch``, from 0: ``size`` rows in order each, the last may be short (T4)."""
    return numbered(frame, order, "__at").withColumn("batch", F.floor((F.col("__at") - 1) / size)).drop("__at")
