"""Order statistics of groups of any size: smallest rows, ranks and running sums, without one task for a whole group.

``bottom_k`` counts rows by the leading digits of a hash, finds the digits at which a group's limit falls, counts by further digits
there, and sorts only what is left; so it shuffles counts, not rows. ``grouped_running`` deals rows out by ranges of group and order and adds
the sums of the ranges before. Null groups are groups like others; helper columns take names that are free.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..names import fresh


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equality join on columns that may be null; ``right`` has no other column of ``left``."""
    if not on:
        return left.crossJoin(F.broadcast(right))  # totals: one row
    names = fresh([*left.columns, *right.columns], *(f"{c}_" for c in on))
    other = right.withColumnsRenamed(dict(zip(on, names, strict=True)))
    same = reduce(Column.__and__, (left[c].eqNullSafe(other[n]) for c, n in zip(on, names, strict=True)))
    return left.join(other, same, how).drop(*names)


def with_group(rows: DataFrame, table: DataFrame, group: list[str]) -> DataFrame:
    """The columns of a table with one row for each group, joined to all rows; null groups too."""
    return _joined(rows, table, group, "left")


def cutoffs(rows: DataFrame, group: list[str], key: str, limit: str, ties: list[str], cut: str, levels: tuple[int, ...] = (4, 8)) -> DataFrame:
    """(group, cut): for each group that has as many rows, the ``limit``-th smallest struct of the key (text) and the ties.

    ``levels`` are numbers of leading characters: each is one aggregation, the first over all rows, the next over those that share the
    prefix at which the limit falls. With 16 hexadecimal digits of a hash, a group of 2^40 rows leaves some 2^8 to sort.
    """
    at, n, lim, before = fresh(rows.columns, "at", "n", "lim", "before")
    keyed, known = rows.where(F.col(limit) >= 1), None

    def here(size: int) -> DataFrame:
        some = keyed.withColumn(at, F.substring(key, 1, size))
        return some if known is None else _joined(some, known, [*group, at])

    for shorter, longer in zip((0, *levels), levels, strict=False):
        start = F.lit(0) if known is None else F.first(before)
        found = here(shorter).withColumn(at, F.substring(key, 1, longer))
        counts = found.groupBy(*group, at).agg(F.count(F.lit(1)).alias(n), F.max(limit).cast("long").alias(lim), start.cast("long").alias(before))
        ahead = Window.partitionBy(*group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        summed = counts.withColumn(before, F.col(before) + F.coalesce(F.sum(n).over(ahead), F.lit(0)))
        known = summed.where((F.col(before) < F.col(lim)) & (F.col(before) + F.col(n) >= F.col(lim))).select(*group, at, lim, before)
    last = here(levels[-1]).withColumn(n, F.row_number().over(Window.partitionBy(*group).orderBy(key, *ties)))
    return last.where(F.col(before) + F.col(n) == F.col(lim)).select(*group, F.struct(key, *ties).alias(cut))


def smallest(rows: DataFrame, key: str, limit: int, ties: list[str], levels: tuple[int, ...] = (4, 8)) -> Column | None:
    """The condition that a row is among the ``limit`` smallest of all rows by key (text) and ties; none if there are no more rows.

    As ``cutoffs`` for one group: a job for each level returns one row to the driver, so that the condition is a literal and nothing is joined.
    """
    at, n, before = fresh(rows.columns, "at", "n", "before")
    ahead, known, taken = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1), F.lit(True), 0
    for longer in levels:
        counts = rows.where(known).groupBy(F.substring(key, 1, longer).alias(at)).agg(F.count(F.lit(1)).alias(n))
        summed = counts.withColumn(before, F.coalesce(F.sum(n).over(ahead), F.lit(0)) + taken)  # one row for each prefix
        found = summed.where((F.col(before) < limit) & (F.col(before) + F.col(n) >= limit)).first()
        if found is None:
            return None
        known, taken = F.substring(key, 1, longer) == found[at], found[before]
    last = rows.where(known).orderBy(key, *ties).limit(limit - taken).select(F.struct(key, *ties).alias(at)).agg(F.max(at).alias(at)).first()[at]
    return F.struct(key, *ties) <= F.struct(*(F.lit(v).alias(c) for c, v in zip((key, *ties), last, strict=True)))


def bottom_k(frame: DataFrame, group: list[str], key: Column, limit: Column, ties: list[str] | None = None, rank: str | None = None, levels: tuple[int, ...] = (4, 8)) -> DataFrame:
    """The ``limit`` rows (a column that is the same within a group; null or below one: none) of each group with the smallest keys.

    ``ties`` must tell rows of equal keys apart; by default they are all columns that can be ordered, so of wholly equal rows
    none is preferred and all that tie with the last are kept. ``rank`` numbers what is kept.
    """
    ties = [c for c in frame.columns if frame.schema[c].dataType.typeName() not in ("map", "variant")] if ties is None else ties
    k, lim, cut, *names = fresh(frame.columns, "key", "limit", "cut", *(f"g{i}" for i in range(len(group))), *(f"t{i}" for i in range(len(ties))))
    own, tied = names[: len(group)], names[len(group) :]
    keyed = frame.withColumns({k: key, lim: limit})
    slim = keyed.select(*(F.col(c).alias(a) for c, a in zip(group, own, strict=True)), k, lim, *(F.col(c).alias(a) for c, a in zip(ties, tied, strict=True)))
    cuts = cutoffs(slim, own, k, lim, tied, cut, levels)
    same = reduce(Column.__and__, (keyed[c].eqNullSafe(cuts[a]) for c, a in zip(group, own, strict=True)))
    this = F.struct(k, *(F.col(c).alias(a) for c, a in zip(ties, tied, strict=True)))
    kept = keyed.where(F.col(lim) >= 1).join(cuts, same, "left").where(F.col(cut).isNull() | (this <= F.col(cut)))
    if rank:
        kept = kept.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(k, *ties)))
    return kept.drop(k, lim, cut, *own)


def grouped_running(frame: DataFrame, group: list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of the weights of the group's rows before this one in the order (which must tell them apart)."""
    part, value, total, start = fresh([*frame.columns, name], "part", "value", "total", "start")
    dealt = checkpointed(frame.withColumn(value, weight).repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id()))
    inside = Window.partitionBy(part, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(part, *group).agg(F.sum(value).alias(total))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(part, *group, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(start))
    run = dealt.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return _joined(run, starts, [part, *group]).withColumn(name, F.col(name) + F.col(start)).drop(part, value, start)


def ranked_value(frame: DataFrame, value: str, share: float, *by: str) -> DataFrame:
    """The value at index int(share * n) of the sorted values of each group (W7), from counts by distinct value."""
    n, before, total = fresh(frame.columns, "n", "before", "total")
    counts = frame.groupBy(*by, value).agg(F.count(F.lit(1)).alias(n))
    run = grouped_running(counts, list(by), [value], F.col(n), before)
    totals = counts.groupBy(*by).agg(F.sum(n).alias(total))
    at = F.floor(F.col(total) * share)
    return _joined(run, totals, list(by)).where((F.col(before) <= at) & (at < F.col(before) + F.col(n))).select(*by, value)
