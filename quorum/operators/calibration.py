"""Readouts over rotated letters: long form, letter bias, priors, aggregation of rotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions import dist, hashing

#: Cyclic shifts of n labels that the rotations use.
SHIFTS = {2: (0, 1), 3: (0, 1, 2), 4: (0, 1, 2, 3), 5: (0, 1, 2, 4), 6: (0, 2, 3, 4), 7: (0, 2, 4, 5), 8: (0, 2, 4, 6), 9: (0, 2, 4, 7)}
CLIP = -20.0


def long_readout(rows: DataFrame, key: str, lp: str, n: int) -> DataFrame:
    """(key, rot, pos, item, lp): ``lp`` is an array over rotations of floored log-softmax arrays by position."""
    shifts = F.array(*(F.lit(s) for s in SHIFTS[n]))
    e = rows.select(key, F.posexplode(lp).alias("rot", "row")).select(key, "rot", F.posexplode("row").alias("pos", "lp"))
    return e.withColumn("item", (F.col("pos") + F.element_at(shifts, F.col("rot") + 1)) % n)


def letter_bias(long: DataFrame, key: str, steps: int = 25) -> DataFrame:
    """Additive bias of each letter: alternating means of lp ~ a[key, item] + b[pos], clipped and centred by rotation.

    The centred table is checkpointed once; each step is two aggregations over it, the second with a result of at most twelve rows.
    """
    w = Window.partitionBy(key, "rot")
    x = long.withColumn("x", F.greatest(F.lit(CLIP), F.col("lp")))
    x = checkpointed(x.withColumn("x", F.col("x") - F.avg("x").over(w)).select(key, "item", "pos", "x"))
    bias = x.select("pos").distinct().withColumn("b", F.lit(0.0))
    for step in range(steps):
        a = x.join(F.broadcast(bias), "pos").groupBy(key, "item").agg(F.avg(F.col("x") - F.col("b")).alias("a"))
        bias = x.join(a, [key, "item"]).groupBy("pos").agg(F.avg(F.col("x") - F.col("a")).alias("b"))
        bias = checkpointed(bias) if step % 5 == 4 else bias
    mean = bias.agg(F.avg("b").alias("m"))
    return bias.crossJoin(F.broadcast(mean)).select("pos", (F.col("b") - F.col("m")).alias("bias"))


def aggregate_rotations(rows: DataFrame, key: str, by_position: list[Column], n: int) -> DataFrame:
    """Per key the mean distribution over rotations by item, and the largest divergence of a rotation from it.

    ``by_position`` has one distribution by letter for each rotation; all of a key lies in its row, so nothing is shuffled. It is one
    expression, so that a filter on its result, which Spark puts below it, costs one more evaluation and not one for each use.
    """

    def by_item(p: Column, shift: int) -> Column:
        return dist.bound(p, lambda v: hashing.rotated(v, (n - shift) % n))

    parts = [by_item(p, s) for p, s in zip(by_position, SHIFTS[n], strict=False)]

    def mean(rows: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(rows, F.lit(0.0), lambda a, p: a + p[i]) / len(parts))

    def judged(rows: Column, m: Column) -> Column:
        return F.struct(m.alias("dist"), F.array_max(F.transform(rows, lambda p: dist.jensen_shannon(p, m))).alias("stability"))

    both = dist.bound(F.array(*parts), lambda rows: dist.bound(mean(rows), lambda m: judged(rows, m)))
    return rows.select(key, both.alias("x")).select(key, "x.dist", "x.stability")


def readout(raw, temperature: float = 1.0):
    """Floored log-softmax of raw letter scores."""
    return dist.log_softmax(dist.floored(F.transform(raw, lambda v: v / temperature)))
