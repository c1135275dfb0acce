"""Integration: unions, manifests, verdicts, duplicates, caps, samples."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions import hashing
from ..names import fresh
from . import order_statistics
from .ordinal import numbered


def union_ranked(frames: list[DataFrame]) -> DataFrame:
    """Union in a fixed order, with the place of each source as src_rank."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (f.withColumn("src_rank", F.lit(k)) for k, f in enumerate(frames)))


def _one_of_each(frame: DataFrame, key: list[str], pick: Callable[[Column], Column]) -> DataFrame:
    """One whole row of each key, by an aggregation that combines before its shuffle, so a hot key is a row of each task."""
    rest = [c for c in frame.columns if c not in key]
    if not rest:
        return frame.distinct()
    row = frame.groupBy(*key).agg(pick(F.struct(*rest)).alias("__row"))
    return row.select(*(F.col(c) if c in key else F.col("__row")[c].alias(c) for c in frame.columns))


def last_wins(frame: DataFrame, key: str, *order: Column) -> DataFrame:
    """The row of each key that comes last."""
    return _one_of_each(frame, [key], lambda row: F.max_by(row, F.struct(*order)))


def first_wins(frame: DataFrame, key: list[str], *order: Column) -> DataFrame:
    return _one_of_each(frame, key, lambda row: F.min_by(row, F.struct(*order)))


def merge_reasons(frame: DataFrame, key: list[str], order: list[Column], invalid: Column, held_out: Column) -> DataFrame:
    """Add ``reason``: the invalidity, "duplicate", "held-out" or null for kept rows.

    Only a kept row is remembered, so the first valid row of a key that is not held out is kept; every valid row after
    it is a duplicate; what else is held out gets that reason. ``order`` must tell the rows of a key apart. Keys meet by their SHA-256,
    so no long key is shuffled; the first kept row of each is an aggregation that combines before its shuffle, checkpointed so that AQE
    splits a hot key when it is joined back.
    """
    k, at, bad, held, first = fresh([*frame.columns, "reason"], "key", "at", "bad", "held", "first")
    marked = frame.withColumns({k: F.sha2(F.to_json(F.struct(*key)), 256), at: F.struct(*order), bad: invalid, held: F.coalesce(held_out, F.lit(False))})
    kept = marked.where(F.col(bad).isNull() & ~F.col(held)).groupBy(k).agg(F.min(at).alias(first))
    joined = marked.join(checkpointed(kept), k, "left")
    reason = F.when(F.col(bad).isNotNull(), F.col(bad)).when(F.col(at) > F.col(first), "duplicate").when(F.col(held), "held-out")
    return joined.withColumn("reason", reason).drop(k, at, bad, held, first)


def with_verdicts(rows: DataFrame, verdicts: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Left join to three-valued verdicts: false drops, true tags, missing keeps without a tag.

    Of repeated verdicts on a key one counts: no before yes, and either before none, so that no row multiplies.
    """
    verdicts = verdicts.groupBy(*keys).agg(F.min(flag).alias(flag))
    return rows.join(verdicts, keys, "left").where(F.coalesce(flag, F.lit(True)))


def owned_once(frame: DataFrame, key: str) -> DataFrame:
    """A small table, one row for each key; the action fails if a key has several owners or none is named."""
    n = fresh(frame.columns, "n")[0]
    single = frame.withColumn(n, F.count(F.lit(1)).over(Window.partitionBy(key)))
    wrong = F.concat(F.lit("not owned exactly once: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    checked = F.when((F.col(n) == 1) & F.col(key).isNotNull(), F.col(key)).otherwise(F.raise_error(wrong).cast(frame.schema[key].dataType))
    return single.withColumn(key, checked).drop(n)


def bottom_k(frame: DataFrame, group: str, k: Column | int, *key: Column | str) -> DataFrame:
    """The k rows of each group with the smallest hashes, numbered as ``rk``; a row's fate depends on its own hash and few others."""
    limit = k if isinstance(k, Column) else F.lit(k)
    return order_statistics.bottom_k(frame, [group], hashing.order_key(*key), limit, rank="rk")


def stratified(frame: DataFrame, strata: list[str], n: int, *key: Column | str) -> DataFrame:
    """A proportional sample with at least one row of each stratum, cut to n in hash order (O9). Strata are counted, not gathered."""
    own, every, quota, h = fresh(frame.columns, "own", "every", "quota", "h")
    sizes = frame.groupBy(*strata).agg(F.count(F.lit(1)).alias(own))
    shares = sizes.crossJoin(F.broadcast(sizes.agg(F.sum(own).alias(every)))).select(*strata, F.greatest(F.lit(1), F.bround(n * F.col(own) / F.col(every), 0)).cast("long").alias(quota))
    chosen = order_statistics.bottom_k(order_statistics.with_group(frame, shares, strata), strata, hashing.order_key(*key), F.col(quota))
    return chosen.withColumn(h, hashing.order_key(*key)).orderBy(h).limit(n).drop(h, quota)


def prefix_until(frame: DataFrame, order: list[Column], value: Column, total: Column, count: Column, goal: float) -> DataFrame:
    """Rows to drop, in order, until the mean of what remains first reaches the goal.

    ``total`` and ``count`` are those before any drop. Running sums come from ranges of the order and the sums of those before.
    """
    dropped, mean, stop, *names = fresh(frame.columns, "dropped", "mean_after", "stop", *(f"o{k}" for k in range(len(order))))
    keyed = frame.withColumns(dict(zip(names, order, strict=True)))
    left = F.try_divide(total - F.col(dropped), (count - F.col("rn")).cast("double"))  # nothing may be left
    run = numbered(keyed, names, "rn", value, dropped).withColumn(mean, left)
    first = run.agg(F.min(F.when(F.col(mean) <= goal, F.col("rn"))).alias(stop))
    out = run.crossJoin(F.broadcast(first)).where(F.col(stop).isNull() | (F.col("rn") <= F.col(stop))).drop(stop, dropped, *names)
    return out.withColumnRenamed(mean, "mean_after")


def resume(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that are still to do."""
    return work.join(done.select(*keys), keys, "left_anti")


def visible_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, visible: how many turns a turn sees, from the sizes of blocks."""
    turns = rows.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("m"))
    turns = turns.withColumn("blk", F.when(F.col("turn") < 2, 0).otherwise(F.floor(F.col("turn") / 2)).cast("long"))
    turns = turns.withColumn("parent", F.when(F.col("blk") > 1, F.floor(F.col("blk") / 2)).otherwise(0).cast("long"))
    sizes = turns.groupBy("conv_id", "blk").agg(F.sum("m").alias("size"))
    prefix = sizes.where("blk = 0").select("conv_id", F.col("size").alias("before"))
    parents = sizes.where("blk > 0").select("conv_id", F.col("blk").alias("parent"), F.col("size").alias("above"))
    own = F.sum("m").over(Window.partitionBy("conv_id", "blk").orderBy("turn"))
    joined = turns.withColumn("own", own).join(prefix, "conv_id", "left").join(parents, ["conv_id", "parent"], "left")
    others = F.when(F.col("blk") > 0, F.coalesce("before", F.lit(0)) + F.coalesce("above", F.lit(0))).otherwise(0)
    return joined.select("conv_id", "turn", (F.col("m") * (F.col("own") + others)).alias("visible"))
