"""Registered queries of the token operators (4, 9, 10, 13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tree_bpe
from .byte_bpe import decode, encode
from .packing import pack
from .token_counts import count_tokens


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of the ids and of the decoded bytes."""
    ranks = _vocabulary("byte_bpe_multi_50k.tiktoken")
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, _pattern()), ranks)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document through the digest cache (a new one, so that no earlier run helps)."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary("piece_bpe_32k.model"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 tokens."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary("byte_bpe_50k.json"), _pattern())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document by tree concatenation; digests of the ids and of the decoded text."""
    vocabulary = _vocabulary("word_bpe_49k.json")
    both = tree_bpe.decode(tree_bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary), vocabulary)
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op4_byte_bpe": op4_byte_bpe, "op9_token_counts": op9_token_counts, "op10_packing": op10_packing, "op13_word_bpe": op13_word_bpe}
SQL: dict[str, str] = {}
