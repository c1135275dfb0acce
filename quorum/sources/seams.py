"""Seams to what lies outside: model calls and fetching. The engine provides the relational shell, tests a fake.

A seam takes a factory, which builds the caller once in each task, and rows partitioned so that neighbours meet.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_retries(call: Callable, attempts: int = 4, base: float = 2.0, sleep: Callable[[float], None] = time.sleep):
    """Call until it succeeds, waiting base * 2**k seconds after the k-th failure."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(base * 2**k)
    raise AssertionError("unreachable")


def call_model(rows: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], list]], prompt: str, out: str, ddl: str, near: str) -> DataFrame:
    """Add what a model says to each row (X2-X4). Rows with the same ``near`` are neighbours, for caches of prefixes."""
    others = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` {ddl}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for part in parts:
            yield part.assign(**{out: model(part)})[[*others, out]]

    return rows.repartition(near).sortWithinPartitions(near, prompt).mapInPandas(run, schema)


def mean_verdict(answers: DataFrame, keys: list[str], p: str, threshold: float = 0.5) -> DataFrame:
    """The mean over presentations and whether it reaches the threshold."""
    return answers.groupBy(*keys).agg(F.avg(p).alias("p_yesno")).withColumn("yesno_ok", F.col("p_yesno") >= threshold)


def fetch(manifest: DataFrame, factory: Callable[[], Callable[[str | None, str | None, str | None], bytes]], attempts: int = 4, base: float = 2.0) -> DataFrame:
    """image_id, content, reason of each row (D15, S11-S13): one archive's members go to one task, so it is opened once."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = factory()
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                try:
                    out.append((r.image_id, with_retries(lambda r=r: get(r.url, r.archive, r.member), attempts, base), None))
                except Exception as error:
                    out.append((r.image_id, None, str(error)[:200]))
            yield pd.DataFrame(out, columns=["image_id", "content", "reason"])

    near = F.coalesce("archive", "url")
    return manifest.select("image_id", "url", "archive", "member").repartition(near).sortWithinPartitions("archive", "member").mapInPandas(run, "image_id string, content binary, reason string")
