"""Recalibration: letter preferences from sufficient statistics, then temperatures, biases and priors anew, before and after.

A question is a row: ``type`` ("bool", "choice" or "score"), ``lp`` (for each reading the log probabilities by letter), ``orders`` (for
each reading the item that each letter stood for, from 0; see ``orders_of``), and for judged ones ``target`` (shares of the answers; null
if there is none) and ``na``. The last item is N/A.

Cases: a question with null or empty ``lp`` takes no part; types that no judged row has are not fitted and keep temperature one and
no bias; a number of letters that no labelled row has gets no correction; empty tables give empty reports.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions import dist, targets
from . import metrics
from .calibration import CLIP, SHIFTS


def orders_of(kind: Column, n: Column) -> Column:
    """The readings of a question of n letters: a score's scale up and, with N/A first, down; else the fixed ``SHIFTS``."""
    up = F.sequence(F.lit(0), n - 1)
    table = F.create_map(*(x for k, v in SHIFTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    shifted = F.transform(table[n], lambda s: F.transform(up, lambda j: (j + s) % n))
    return F.when(kind == "score", F.array(up, F.reverse(up))).otherwise(shifted)


def solved(stats: pd.DataFrame, n: int) -> np.ndarray:
    """The letters' effects b in lp[question, reading, letter] = a[question, item] + b[letter], by least squares, centred.

    ``stats`` has the mean centred readouts (orders as JSON, rot, pos, x) and the number of questions (q) for each set of orders. Questions of
    one set share their design and the model is linear, so their mean says all that they say about b. The items' effects are
    eliminated, which leaves n normal equations; where letters are never compared, the smallest solution.
    """
    gram, right = np.zeros((n, n)), np.zeros(n)
    for orders, own in stats.groupby("orders"):
        order, x = np.array(json.loads(orders)), np.zeros((len(json.loads(orders)), n))
        x[own["rot"], own["pos"]] = own["x"]
        q = float(own["q"].iloc[0])
        for item in range(n):
            rot, pos = np.nonzero(order == item)
            seen = np.bincount(pos, minlength=n).astype(float)
            gram += q * (np.diag(seen) - np.outer(seen, seen) / len(pos))
            right += q * (np.bincount(pos, x[rot, pos], n) - seen * x[rot, pos].mean())
    b = np.linalg.lstsq(gram, right, rcond=1e-9)[0]
    return b - b.mean()


def letter_biases(rows: DataFrame, *by: str, places: int = 4) -> DataFrame:
    """(by, n, bias): additive biases of the letters, for each number of letters.

    One aggregation to at most readings times letters rows for each type and set of orders; each type's are solved in closed form.
    That is the limit of alternating means over all readouts, without their steps.
    """
    sized = rows.where(F.size("lp") > 0).select(*by, F.size(F.get("lp", F.lit(0))).alias("n"), F.to_json("orders").alias("orders"), F.posexplode("lp").alias("rot", "row"))
    clipped = F.transform("row", lambda x: F.greatest(F.lit(CLIP), x))
    centred = dist.bound(clipped, lambda v: dist.bound(dist.total(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m)))
    stats = sized.select(*by, "n", "orders", "rot", F.posexplode(centred).alias("pos", "x")).groupBy(*by, "n", "orders", "rot", "pos").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("q"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*by).schema)

    def solve(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{c: [v] for c, v in zip(by, key, strict=False)}, "n": [key[-1]], "bias": [[round(float(x), places) + 0.0 for x in solved(own, int(key[-1]))]]})

    return stats.groupBy(*by, "n").applyInPandas(solve, f"{kinds}n int, bias array<double>")


def read(lp: Column, orders: Column, t: Column, na_bias: Column, bias: Column) -> Column:
    """struct(dist, stability): the mean over readings of the calibrated distribution by item, N/A last."""
    n = F.size(F.get(lp, F.lit(0)))
    every = F.sequence(F.lit(0), n - 1)

    def by_item(row: Column, order: Column) -> Column:
        z = F.transform(row, lambda x, j: (x - F.coalesce(F.get(bias, j), F.lit(0.0))) / t + F.when(order[j] == n - 1, na_bias).otherwise(0.0))
        return dist.bound(dist.softmax(z), lambda p: F.transform(every, lambda i: F.element_at(p, F.array_position(order, i).cast("int"))))

    def judged(parts: Column) -> Column:
        mean = F.transform(every, lambda i: F.aggregate(parts, F.lit(0.0), lambda a, p: a + p[i]) / F.size(parts))
        return dist.bound(mean, lambda m: F.struct(m.alias("dist"), F.array_max(F.transform(parts, lambda p: dist.jensen_shannon(p, m))).alias("stability")))

    return dist.bound(F.zip_with(lp, orders, by_item), judged)


def _with(rows: DataFrame, biases: DataFrame) -> DataFrame:
    """Each question with the bias of its type and number of letters; the table has a row for each of those, so it is small."""
    return rows.where(F.size("lp") > 0).withColumn("n", F.size(F.get("lp", F.lit(0)))).join(biases, ["type", "n"], "left").withColumn("bias", F.coalesce("bias", F.array().cast("array<double>")))


def fit(rows: DataFrame, biases: DataFrame) -> DataFrame:
    """(type, t, na_bias) with the least mean loss over a grid: temperatures, biases of N/A where it occurs, temperatures again."""
    spark, own = rows.sparkSession, _with(rows, biases)
    ts = spark.range(48).select(F.col("id").alias("idx"), F.round(0.3 * F.pow(F.lit(1.1), F.col("id")), 4).alias("t"))
    bs = spark.range(33).select(F.col("id").alias("idx"), (F.col("id") / 4 - 4).alias("na_bias"))

    def best(grid: DataFrame, known: DataFrame | None, key: str, t: Column, b: Column) -> DataFrame:
        guess = dist.bound(read(F.col("lp"), F.col("orders"), t, b, F.col("bias")), lambda x: targets.target_of(x["dist"]))
        loss = dist.bound(guess, lambda g: targets.loss(F.col("target"), F.col("na"), g["target"], g["na"]))
        found = metrics.grid_fit(own if known is None else own.join(known, "type"), grid, loss, ["type"], [key]).drop("loss")
        return checkpointed(found)  # a row for each type, which the next grid and the caller read

    zero = F.lit(0.0)
    one = best(ts, None, "t", F.col("t"), zero).withColumnRenamed("t", "t1")
    with_na = rows.groupBy("type").agg(F.max((F.col("na") >= 0.5).cast("int")).alias("some"))
    two = best(bs, one, "na_bias", F.col("t1"), F.col("na_bias")).join(with_na, "type").select("type", F.when(F.col("some") == 1, F.col("na_bias")).otherwise(0.0).alias("b1"))
    return best(ts, two, "t", F.col("t"), F.col("b1")).join(two, "type").select("type", "t", F.col("b1").alias("na_bias"))


def _read_all(rows: DataFrame, fitted: DataFrame, biases: DataFrame) -> DataFrame:
    known = _with(rows, biases).join(fitted, "type", "left")
    return known.withColumn("x", read(F.col("lp"), F.col("orders"), F.coalesce("t", F.lit(1.0)), F.coalesce("na_bias", F.lit(0.0)), F.col("bias")))


def index_priors(rows: DataFrame, fitted: DataFrame, biases: DataFrame, places: int = 5) -> DataFrame:
    """(regime, k, prior): the mean answer by position of choice questions, apart for those that mostly have no answer."""
    own = _read_all(rows.where("type = 'choice'"), fitted, biases).withColumn("g", targets.target_of(F.col("x.dist"))).where(F.col("g.target").isNotNull())
    each = own.select(targets.regime(F.col("g.na")).alias("regime"), F.size("g.target").alias("k"), F.posexplode("g.target").alias("pos", "q"))
    mean = each.groupBy("regime", "k", "pos").agg(F.round(F.avg("q"), places).alias("prior"))
    return mean.groupBy("regime", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "prior"))), lambda x: x["prior"]).alias("prior"))


def evaluate(rows: DataFrame, fitted: DataFrame, biases: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """(type, n, loss, ece, acc, stability, auroc): by type, and N/A over all types as type "na"."""
    known = _read_all(rows, fitted, biases).drop("n")
    if priors is not None:
        known = known.withColumns({"regime": targets.regime(F.element_at("x.dist", -1)), "k": F.when(F.col("type") == "choice", F.size("x.dist") - 1)}).join(priors, ["regime", "k"], "left")
    else:
        known = known.withColumn("prior", F.lit(None).cast("array<double>"))
    done = known.withColumn("g", targets.target_of(F.col("x.dist"), F.col("prior"))).withColumn("loss", targets.loss(F.col("target"), F.col("na"), F.col("g.target"), F.col("g.na")))
    answered = done.where(F.col("target").isNotNull() & F.col("g.target").isNotNull() & (F.col("na") < 0.5))
    scored = answered.select("type", F.array_max("g.target").alias("conf"), dist.soft_accuracy(F.col("target"), F.col("g.target")).alias("acc"))
    sums = done.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"))
    right = scored.groupBy("type").agg(F.avg("acc").alias("acc"))
    stable = metrics.ranked_value(done.select("type", F.col("x.stability").alias("stability")), "stability", 0.95, "type")
    by_type = sums.join(metrics.ece(scored, F.col("conf"), F.col("acc"), "type").select("type", "ece"), "type", "left").join(right, "type", "left").join(stable, "type", "left")
    of_na = metrics.auroc(done.select(F.lit("na").alias("type"), F.col("g.na").alias("guess"), F.col("na").alias("true")), F.col("guess"), F.col("true") >= 0.5, "type")
    empty = F.lit(None).cast("double")
    return by_type.select("type", "n", "loss", "ece", "acc", "stability", empty.alias("auroc")).unionByName(
        of_na.select("type", F.col("positives").alias("n"), empty.alias("loss"), empty.alias("ece"), empty.alias("acc"), empty.alias("stability"), "auroc")
    )


def recalibrate(judged: DataFrame, labelled: DataFrame, old: DataFrame, types: tuple[str, ...] = ("choice", "score")) -> dict[str, DataFrame]:
    """Biases of the given types from all labelled readouts; temperatures, N/A biases and priors with them; both evaluations.

    ``judged`` has ``half`` ("fit" or "eval"); ``old`` has (type, t, na_bias) of the calibration so far. Returns ``biases``, ``fitted``,
    ``priors`` (each a table of a few rows) and ``report``: the evaluations before and after by ``phase``.
    """
    of_types = labelled.where(F.col("type").isin(*types))
    biases = checkpointed(letter_biases(of_types, "type"))
    none = biases.limit(0)
    fitted = fit(judged.where("half = 'fit'"), biases)
    priors = checkpointed(index_priors(of_types, fitted, biases))
    held = judged.where("half = 'eval'")
    before, after = evaluate(held, old, none), evaluate(held, fitted, biases, priors)
    return {"biases": biases, "fitted": fitted, "priors": priors, "report": before.withColumn("phase", F.lit("before")).unionByName(after.withColumn("phase", F.lit("after")))}
