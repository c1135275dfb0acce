"""Balancing of a training selection: caps by topic and by opening, then the share of yes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions import hashing
from ..names import fresh
from .order_statistics import smallest


def capped_groups(rows: DataFrame, group: str, image: str, row_id: str, share: float, initial: int, density: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Drop rows of groups above ``int(share * initial)``, those of the densest images first, ties by hash.

    Groups are taken in order and each sees the densities that the ones before it left. Only groups above the cap matter, and
    there are at most 1 / share of them, so the loop over them is bounded. Within a group, the row at which the cap falls is found by counts of
    densities and of hash digits; no group is ranked in one task. Returns what is kept and the new densities.
    """
    cap, rows, density = int(share * initial), checkpointed(rows), checkpointed(density)
    over = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap).orderBy(group).collect()
    (k,) = fresh([*rows.columns, "density"], "key")
    drops = []
    for value, n in over:
        own = rows.where(F.col(group).eqNullSafe(F.lit(value))).join(density, image)
        densest = F.lpad(F.hex((F.lit(1 << 40) - F.col("density")).cast("long")), 12, "0")
        hashed = hashing.order_key(F.lit(name), F.col(group).cast("string"), F.col(row_id).cast("string"))
        keyed = own.select(group, image, row_id, F.concat(densest, hashed).alias(k))
        drops.append(keyed.where(smallest(keyed, k, n - cap, [row_id], (12, 16, 20))))  # deterministic, so it need not be stored
        fewer = drops[-1].groupBy(image).agg(F.count(F.lit(1)).alias("less"))
        density = checkpointed(density.join(fewer, image, "left").select(image, (F.col("density") - F.coalesce("less", F.lit(0))).alias("density")))
    if drops:
        rows = checkpointed(rows.join(reduce(DataFrame.unionAll, drops).select(row_id), row_id, "left_anti"))
    return rows, density
