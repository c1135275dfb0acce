"""Sinks: JSON Lines with a count, nested by image, append and resume, id lists by split, dead letters, reports (K1-K7)."""

from __future__ import annotations

import html
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from .readers import exists


def write_json_lines(frame: DataFrame, path: str) -> int:
    """Overwrite a folder of JSON Lines; the number of rows is observed while they are written (K1)."""
    seen = Observation("rows")
    frame.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def nested(frame: DataFrame, key: str, order: list[str], name: str = "questions") -> DataFrame:
    """One row for each key, with its other columns as an ordered array of structs (K2, A1)."""
    others = [c for c in frame.columns if c != key and c not in order]
    return frame.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*others).alias("__q")))), lambda x: x["__q"]).alias(name))


def append_missing(work: DataFrame, path: str, keys: list[str], fn: Callable[[DataFrame], DataFrame], chunks: int = 4) -> None:
    """Apply ``fn`` to the rows whose key is not yet in the output, in chunks that are appended one by one.

    A run that breaks off keeps the chunks that it wrote; the next run goes on with the rest. Chunks are by hash of the key.
    """
    spark = work.sparkSession
    part = F.pmod(F.xxhash64(*keys), F.lit(chunks))
    for k in range(chunks):
        todo = work.where(part == k)
        if exists(spark, path):
            todo = todo.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        fn(todo).write.mode("append").parquet(path)


def write_ids_by_split(frame: DataFrame, path: str, split: str = "split", key: str = "image_id") -> None:
    """A text folder of ids for each split (K4)."""
    frame.select(split, F.col(key).cast("string").alias("value")).write.mode("overwrite").partitionBy(split).text(path)


def write_with_dead_letters(frame: DataFrame, failed: Column, path: str, dead: str) -> None:
    """Good rows to one folder; failed ones to another, written only if there are any (K5). The input is evaluated once, so that
    requests are not sent again and each row lands in one of the folders."""
    judged = checkpointed(frame.withColumn("__failed", F.coalesce(failed, F.lit(False))))
    judged.where("not __failed").drop("__failed").write.mode("overwrite").parquet(path)
    bad = judged.where("__failed").drop("__failed")
    if not bad.isEmpty():
        bad.write.mode("overwrite").json(dead)


def report_json(small: DataFrame, limit: int = 10_000) -> str:
    """A small table as JSON text (K6). Refuses tables beyond the limit: reports are of aggregates."""
    rows = small.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    return json.dumps([r.asDict(recursive=True) for r in rows], indent=1, default=str)


def report_html(small: DataFrame, title: str, limit: int = 1_000) -> str:
    """A small table as a page, byte for byte the same for the same rows (K7)."""
    rows = json.loads(report_json(small, limit))
    cell = lambda v: f"<td>{html.escape('' if v is None else str(v))}</td>"
    head = "".join(f"<th>{html.escape(c)}</th>" for c in small.columns)
    body = "\n".join("<tr>" + "".join(cell(r[c]) for c in small.columns) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title>\n<table><tr>{head}</tr>\n{body}</table>\n"
