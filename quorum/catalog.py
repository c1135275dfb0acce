"""Collects the registered queries of the library and their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

MODULES = ("build", "merge", "select", "calibrate", "evaluate", "check", "stateful", "targets", "reports", "written", "recalibrate", "selection")


def _modules():
    return [importlib.import_module(f"quorum.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in _modules() for k, q in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote spreads to yes/no targets, then questions and mean P(yes) by hash split."""
    from pyspark.sql import functions as F

    from .functions.hashing import split_of
    from .plans.build import vote_spread_bool

    bools = vote_spread_bool(spark, sf_dir)
    return bools.groupBy(split_of(F.concat(F.lit("p_"), F.col("part_id").cast("string"))).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_yes"), 6).alias("mean_p_yes"))
