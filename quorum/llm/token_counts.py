"""Token counts behind a digest cache.

A text's digest is the SHA-256 of its normalised content; with the tokenizer's digest (of its file) it is the key of
the cache, a Parquet folder of (digest, version, n_tokens). Texts are joined to it; of those missed, one row for each
digest is encoded and the counts are appended. The tokenizers served here tell apart any two texts that a Unicode or
space normalisation would merge, so the normalisation that keeps counts right is the identity (null becomes empty);
another one can be given as a column function for tokenizers that allow it.

Scale: counts and digests move as narrow rows, combined before the shuffle, so a text that a third of all rows repeat
is one row for each task. The texts of the documents are shuffled once, by a row key that has no hot values, to meet
the chosen representatives; they are never sorted. The last join is by digest, with a skewed side that AQE can split.

Cases: null text counts as empty (0 bytes, 0 tokens); rows with repeated or null ids are each returned; an empty table
gives no rows and appends nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import col, shared_dir, slices, staged
from .tokens import piece_counter

CACHE = "digest binary, version string, n_tokens long"


def version_of(path: str) -> str:
    """The digest of the tokenizer's file: a changed vocabulary never meets old counts."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _counter(path: str):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        return lambda text: len(model.encode(text, add_special_tokens=False).ids)
    return piece_counter(path).count


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for some in slices(batches, "text", rows=2000):
            texts = [t or "" for t in some.column("text").to_pylist()]
            if any(hashlib.sha256(t.encode()).digest() != d for t, d in zip(texts, some.column("digest").to_pylist(), strict=True)):
                raise RuntimeError("the documents are not the same in two passes")
            counts = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([some.column("digest").cast(pa.binary()), pa.array([version] * len(counts)), pa.array(counts, pa.int64())], names=["digest", "version", "n_tokens"])

    return run


def _cached(spark, cache: str, version: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version)
    return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, normalise=lambda c: c) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. ``cache`` is the folder of stored counts; by default a new
    one in the shared folder. ``docs`` is read twice and must give the same rows in the same order, as a table does, which is
    checked. Runs the encoding of misses and appends them to the cache before it returns.
    """
    spark, version = docs.sparkSession, version_of(tokenizer)
    cache = cache or f"{shared_dir(spark)}/quorum-counts-{version[:12]}-{uuid.uuid4().hex}"
    text: Column = F.coalesce(normalise(col(text_col)), F.lit(""))
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("row_key", F.monotonically_increasing_id())
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    narrow = staged(rows.select("row_key", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest), "digests")
    known = _cached(spark, cache, version)
    chosen = narrow.groupBy("digest").agg(F.min("row_key").alias("row_key")).join(known.select("digest"), "digest", "left_anti")
    missed = rows.join(chosen.hint("shuffle_hash"), "row_key").select("digest", "text")
    missed.mapInArrow(_encode(tokenizer, version), CACHE).write.mode("append").parquet(cache)
    # Two writers may have appended one digest. Staged, as AQE splits a hot digest only where no aggregation lies between shuffle and join.
    counts = staged(_cached(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return narrow.join(counts.hint("merge"), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
