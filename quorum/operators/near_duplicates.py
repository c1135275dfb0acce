"""Pairs of near duplicates of one group: Jaccard of word sets, by prefixes of the rarest words.

Rows with equal sets are a class, which its smallest key stands for: each other row is paired with that key at 1, and
classes are paired by their keys. Words are hashes of 64 bits, in the order of how many rows have them (counted in a bounded
number of buckets, so that the counts can be broadcast). Two similar sets share a word among the first of both, of so many as
the threshold allows to differ; pairs that do, and whose parities allow it (in 256 cells before a pair is a row, then in 2048 for the long sets that fill those), are
held against each other by their whole sets.

Cases: rows without words, group or key take no part; repeated rows are one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed

BUCKETS = 1 << 17
#: Cells of parities: for all candidates, and for those that are left.
COARSE, FINE = 1 << 8, 1 << 11
#: So many candidates at most are broadcast, as pairs of hashes.
SMALL = 100_000
WORD = re.compile("[a-z0-9]+")


def hashes(text: str | None) -> np.ndarray:
    """The distinct words of a text as sorted hashes."""
    words = set(WORD.findall((text or "").lower()))
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)))


def parities(words: np.ndarray, of: int) -> list[int]:
    """Of so many cells, which hold an odd number of the words: in as many cells at most do two sets differ as in words."""
    cells = ((words >> np.uint64(32)) % np.uint64(of)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=of).astype(np.uint8) & 1).view(np.int64).tolist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in batch.column("t"):
            np.add.at(counts, (hashes(text.as_py()) % np.uint64(BUCKETS)).astype(np.int64), 1)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])


def pairs(rows: DataFrame, group: str, key: str, text: str, per_cent: int = 80) -> DataFrame:
    """group, ``key``_a, ``key``_b, j: pairs of rows of one group whose sets of words have a Jaccard of ``per_cent`` or more."""
    texts = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("g").isNotNull() & F.col("k").isNotNull())
    counts = np.zeros(BUCKETS, np.int64)
    for r in texts.select("t").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        counts[r["bucket"]] = r["n"]
    rarity = rows.sparkSession.sparkContext.broadcast(counts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                some = batch.slice(begin, 256)
                found = [hashes(t.as_py()) for t in some.column("t")]
                ordered = [w[np.lexsort((w, rarity.value[(w % np.uint64(BUCKETS)).astype(np.int64)]))].view(np.int64) for w in found]
                cells = [pa.array([parities(w, of) for w in found], pa.list_(pa.int64())) for of in (COARSE, FINE)]
                yield pa.RecordBatch.from_arrays([some.column("g"), some.column("k"), *cells, pa.array(ordered, pa.list_(pa.int64()))], names=["g", "k", "s", "f", "w"])

    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    sets = texts.mapInArrow(scan, f"g {kinds['g']}, k {kinds['k']}, s array<long>, f array<long>, w array<long>").where(F.size("w") > 0)
    sets = checkpointed(sets.select("g", "k", F.xxhash64("g", "w").alias("h"), "s", "f", "w"))
    classes = sets.groupBy("h").agg(F.first("g").alias("g"), F.min("k").alias("id"))
    copies = sets.select("h", "k").join(classes, "h").where(F.col("k") > F.col("id")).select("g", F.col("id").alias("a"), F.col("k").alias("b"), F.lit(1.0).alias("j")).distinct()
    least = lambda num, den: F.expr(f"cast(n - ({num} * n + {den} - 1) div {den} + 1 as int)")
    nodes = sets.select("g", "k", "h", "s", "f", "w", F.size("w").alias("n")).withColumn("w", F.slice("w", F.lit(1), least(per_cent, 100)))
    nodes = nodes.join(classes.select("h", F.col("id").alias("k")), ["h", "k"], "left_semi")
    first = nodes.select("h", "n", "s", "g", F.posexplode("w").alias("at", "t")).select("h", "n", "s", "at", F.xxhash64("g", "t").alias("t"))
    a, b = first.alias("a"), first.alias("b")  # alike, so that they are shuffled once
    both = (F.col("a.t") == F.col("b.t")) & (F.struct("a.n", "a.h") < F.struct("b.n", "b.h")) & (F.col("b.n") * per_cent <= F.col("a.n") * 100)
    left = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))  # words that can be common if this one is the first
    differing = lambda x, y, of: sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(of // 64)), F.lit(0))  # noqa: E731, at most what the sets differ in
    sizes = F.col("a.n") + F.col("b.n")
    # both bounds hold before a pair is a row, so that few pairs are shuffled
    met = a.join(b, both & (left * (100 + per_cent) >= sizes * per_cent) & (differing("a.s", "b.s", COARSE) * (100 + per_cent) <= sizes * (100 - per_cent)))
    maybe = met.select(F.col("a.h").alias("ha"), F.col("b.h").alias("hb")).distinct()
    for side in "ab":
        maybe = maybe.join(nodes.select(F.col("h").alias(f"h{side}"), F.col("n").alias(f"n{side}"), F.col("f").alias(f"f{side}")), f"h{side}")
    maybe = checkpointed(maybe.where(differing("fa", "fb", FINE) * (100 + per_cent) <= (F.col("na") + F.col("nb")) * (100 - per_cent)).select("ha", "hb"))
    needed = maybe.select(F.explode(F.array("ha", "hb")).alias("h")).distinct()
    needed = F.broadcast(needed) if maybe.count() <= SMALL else needed
    whole = sets.select("h", "w").join(needed, "h", "left_semi").dropDuplicates(["h"]).join(classes, "h")
    of = lambda s: whole.select(F.col("h").alias(f"h{s}"), F.col("g").alias(f"g{s}"), F.col("id").alias(s), F.col("w").alias(f"w{s}"))
    found = maybe.join(of("a"), "ha").join(of("b"), "hb").where(F.col("ga") == F.col("gb"))
    found = found.select(F.col("ga").alias("g"), "a", "b", F.size(F.array_intersect("wa", "wb")).alias("i"), (F.size("wa") + F.size("wb")).alias("s")).where(F.col("i") * 100 >= (F.col("s") - F.col("i")) * per_cent)
    found = found.select("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("i") / (F.col("s") - F.col("i"))).alias("j"))
    return copies.unionByName(found).select(F.col("g").alias(group), F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"), F.round("j", 6).alias("j"))
