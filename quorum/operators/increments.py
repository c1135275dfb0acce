"""Merging in increments: what earlier merges kept is a table of keys in buckets, and only new rows are shuffled."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed, shared_dir
from ..names import fresh


class KeptKeys:
    """The keys that merges kept, by the number of their batch: a catalog table in buckets of the key, its files in a given folder.

    One batch is one partition. A batch that is merged again replaces its own keys and is held against those of earlier
    numbers only, so a repeated or resumed merge gives what it gave before. ``buckets`` stays as it was at the table's creation.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, folder: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"kept_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = folder or f"{shared_dir(spark)}/{self.name}"
        path = self._path()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
        spark.sql(f"create table if not exists {self.name} (key string, batch bigint) using parquet partitioned by (batch) clustered by (key) into {self.buckets} buckets location '{self.folder}'")
        spark.sql(f"alter table {self.name} recover partitions")  # where the catalog is new and the files are not

    def _path(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)

    def before(self, batch: int) -> DataFrame:
        """The keys of earlier batches; each is there once."""
        return self.spark.table(self.name).where(F.col("batch") < batch).select("key")

    def put(self, keys: DataFrame, batch: int) -> None:
        keys.select("key").createOrReplaceTempView(f"{self.name}_new")
        self.spark.sql(f"insert overwrite table {self.name} partition (batch = {batch}) select key from {self.name}_new")
        self.spark.catalog.dropTempView(f"{self.name}_new")

    def drop(self) -> None:
        """Forget the table and remove its files."""
        self.spark.sql(f"drop table if exists {self.name}")
        path = self._path()
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def known_keys(firsts: DataFrame, kept: KeptKeys, batch: int) -> DataFrame:
    """(key, first) with ``known``: whether an earlier batch kept the key. The kept keys are read bucket by bucket, without a shuffle."""
    old = kept.before(batch).withColumn("known", F.lit(True))
    dealt = firsts.repartition(kept.buckets, "key")
    return dealt.join(old.hint("shuffle_hash"), "key", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def merge_increment(rows: DataFrame, key: list[str], order: list[Column], invalid: Column, held_out: Column, kept: KeptKeys, batch: int) -> DataFrame:
    """Add ``reason`` as merge_reasons does over all batches up to this one, in the order of their numbers, and store the keys newly kept.

    A batch's rows come down to one row for each key before they meet the kept keys, so a key that a third of the rows share is one row of
    each task; what comes of that is checkpointed, so that AQE splits such a key when it is joined back to the rows.
    Null key columns count as a key of their own; an empty batch stores nothing.
    """
    k, at, bad, held, first, known = fresh([*rows.columns, "reason"], "key", "at", "bad", "held", "first", "known")
    marked = rows.withColumns({k: F.sha2(F.to_json(F.struct(*key)), 256), at: F.struct(*order), bad: invalid, held: F.coalesce(held_out, F.lit(False))})
    firsts = marked.where(F.col(bad).isNull()).groupBy(F.col(k).alias("key")).agg(F.min(F.when(~F.col(held), F.col(at))).alias("first"))
    met = checkpointed(known_keys(firsts, kept, batch))
    kept.put(met.where("not known and first is not null"), batch)
    joined = marked.join(met.select(F.col("key").alias(k), F.col("first").alias(first), F.col("known").alias(known)), k, "left")
    repeated = F.col(known) | (F.col(at) > F.col(first))
    reason = F.when(F.col(bad).isNotNull(), F.col(bad)).when(repeated, "duplicate").when(F.col(held), "held-out")
    return joined.withColumn("reason", reason).drop(k, at, bad, held, first, known)
