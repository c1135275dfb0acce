"""Evaluation metrics as aggregations: calibration error, ranking, losses, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_statistics import ranked_value

BINS = 15


def ece(frame: DataFrame, confidence: Column, accuracy: Column, *by: str) -> DataFrame:
    """Expected calibration error over equal-width bins, the last closed at one (M1). Two aggregations, no window."""
    b = F.least(F.floor(confidence * BINS), F.lit(BINS - 1))
    bins = frame.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(confidence).alias("c"), F.sum(accuracy).alias("a"))
    return bins.groupBy(*by).agg((F.sum(F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def auroc(frame: DataFrame, score: Column, positive: Column, *by: str) -> DataFrame:
    """Area under the curve by average ranks, ties count a half; null if a class is empty (M2).

    Counts by distinct score come first, so the ordered window runs over distinct scores and not over rows.
    """
    counts = frame.groupBy(*by, score.alias("s")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return counts.withColumn("below", below).groupBy(*by).agg((u / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auroc"), F.sum("pos").alias("positives"))


def in_groups(frame: DataFrame, groups: Column) -> DataFrame:
    """One row for each group that a row belongs to."""
    return frame.withColumn("grp", F.explode(F.filter(groups, lambda g: g.isNotNull())))


def grid_fit(frame: DataFrame, grid: DataFrame, loss: Column, by: list[str], keys: list[str]) -> DataFrame:
    """For each type the first grid point with the least mean loss (M5, M6). The grid is small and broadcast."""
    mean = frame.crossJoin(F.broadcast(grid)).groupBy(*by, "idx", *keys).agg(F.avg(loss).alias("loss"))
    best = F.min(F.struct(F.round("loss", 9).alias("loss"), "idx", *keys)).alias("best")
    return mean.groupBy(*by).agg(best).select(*by, *(F.col(f"best.{k}").alias(k) for k in keys), F.col("best.loss").alias("loss"))


__all__ = ["BINS", "auroc", "ece", "grid_fit", "in_groups", "ranked_value"]
