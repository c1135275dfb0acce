"""Helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evaluated(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row. Plain ones are put in again wherever they are used: in a filter with all that they are made
    of, and in a lambda once for each element."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def h32(e: str) -> str:
    """SQL of the first 32 bits of SHA-1."""
    return f"('0x' || substr(sha1({e}), 1, 8))::BIGINT"


def uniform(e: str) -> str:
    return f"(({h32(e)} + 0.5::DOUBLE) / 4294967296::DOUBLE)"


def split_of(e: str) -> str:
    return f"(case when {h32(e)} % 100 < 90 then 'train' when {h32(e)} % 100 < 95 then 'val' else 'test' end)"
