"""A corpus pipeline of five stages, each on the rows that the one before it kept.

Quality rules and toxicity drop the documents that they reject, the n-gram join keeps one document of each group of near
copies, the secret scans mask secrets inside the texts, and packing lays the tokens of what is left into windows.
Every stage takes (spark, docs, sf_dir); ``run`` writes each stage's rows as Parquet to the shared folder and rereads them
for the next; then a stage's own tables and the rows that it read are removed. All but the last stage return the columns of
``docs``. Models are fitted on labelled rows of the original documents table, toxicity without the rows that its query holds out.

Cases, for every stage: a null or blank text has no words, so the quality rules drop it (the other stages pass it on as it is, and
packing makes it one end id); repeated rows are rows of their own up to the n-gram join, which keeps one of them; null ids, languages
and sources are carried along; very long texts are read whole; columns of any further name are carried along by all stages but
packing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.llm import ngram_join, quality, secrets, toxicity
from quorum.llm.packing import pack
from quorum.llm.queries_corpus import held_out
from quorum.llm.shared import hand_on, release, scratch, staged


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the base rule and the trees."""
    forest = quality.train(*_tables(spark, sf_dir))
    return quality.passing(docs, forest)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the machine does not predict as toxic."""
    machine = toxicity.train(*_tables(spark, sf_dir), where=~held_out(F.col("doc_id")))
    return toxicity.passing(docs, machine)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near copies: five words, similarity 0.8."""
    return ngram_join.deduplicate(docs, width=5, per_cent=80)


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets inside the texts."""
    return secrets.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("n-gram join", near_copies),
    ("secret scans", secret_masks),
    ("packing", packing),
]

#: The first two stages are learnt models, which SQL can't express; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch():
            kept = hand_on(staged(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        release(docs)
        docs = kept
    return docs
