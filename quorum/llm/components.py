"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hand_on, release, scratch, staged


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (long columns u, v); a root is the smallest node of its component.

    Each round lets every node connect its larger neighbours, then its smaller ones, to the smallest it knows, until
    the edges are stars. Minima are combined before the shuffle and staged, so that AQE can split the join of a node with very
    many neighbours (it does not where an aggregation lies between shuffle and join). Each round is staged in the shared folder, so
    lineage stays short, and removes the tables of the one before. Nothing is collected but two numbers a round.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    with scratch():
        pairs, before = staged(pairs, "edges"), None
        for _ in range(most_rounds):
            with scratch():
                new = hand_on(_round(pairs))
            release(pairs)
            pairs = new
            after = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"the components have not settled after {most_rounds} rounds")
        hand_on(pairs)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _round(pairs: DataFrame) -> DataFrame:
    """A large and a small star."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    own = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(own, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return staged(small.unionByName(own.select("u", F.col("m").alias("v"))).distinct(), "edges")
