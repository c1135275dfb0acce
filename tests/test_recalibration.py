import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorum.operators import recalibration as rc

SCHEMA = "type string, n int, lp array<array<double>>, target array<double>, na double, half string"


def orders(kind, n):
    if kind == "score":
        return [list(range(n)), list(range(n))[::-1]]
    return [[(j + s) % n for j in range(n)] for s in rc.SHIFTS[n]]


def log_softmax(x):
    m = max(x)
    z = m + math.log(sum(math.exp(v - m) for v in x))
    return [v - z for v in x]


def planted(kind, n, bias, many, seed=0):
    rng, out = random.Random(seed), []
    for k in range(many):
        content = [rng.gauss(0, 1) for _ in range(n)]
        lp = [log_softmax([content[i] + bias[j] for j, i in enumerate(o)]) for o in orders(kind, n)]
        best = max(range(n - 1), key=content.__getitem__)
        out.append((kind, n, lp, [float(i == best) for i in range(n - 1)], 0.0, "fit" if k % 2 else "eval"))
    return out


def made(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.withColumn("orders", rc.orders_of(F.col("type"), F.col("n"))).drop("n")


def alternating(rows, n, steps=400):
    cells = [((k, o[j]), j, max(x, -20.0)) for k, (kind, m, lp, *_) in enumerate(rows) if m == n for o, row in zip(orders(kind, m), lp, strict=True) for j, x in enumerate(np.array(row) - np.mean(np.maximum(row, -20.0)))]
    b = np.zeros(n)
    for _ in range(steps):
        sums = {}
        for key, j, v in cells:
            s = sums.setdefault(key, [0.0, 0])
            s[0], s[1] = s[0] + v - b[j], s[1] + 1
        each = [[] for _ in range(n)]
        for key, j, v in cells:
            each[j].append(v - sums[key][0] / sums[key][1])
        b = np.array([np.mean(e) for e in each])
        b -= b.mean()
    return b


def test_planted_preferences_are_found(spark):
    bias = [0.8, -0.2, 0.1, -0.3, -0.4]
    rows = planted("choice", 5, bias, 200) + planted("bool", 3, [0.5, 0.0, -0.5], 50, 1) + planted("score", 4, [0.3, 0.1, -0.2, -0.2], 60, 2)
    got = {(r.type, r.n): r.bias for r in rc.letter_biases(made(spark, rows), "type", places=9).collect()}
    assert set(got) == {("choice", 5), ("bool", 3), ("score", 4)}
    assert np.abs(np.array(got["choice", 5]) - (np.array(bias) - np.mean(bias))).max() < 1e-6
    for kind, n in got:
        assert np.abs(np.array(got[kind, n]) - alternating([r for r in rows if r[0] == kind], n)).max() < 1e-6, kind


def test_orders(spark):
    got = made(spark, [("score", 4, [], None, 1.0, "fit"), ("choice", 5, [], None, 1.0, "fit"), ("bool", 3, None, None, 1.0, "fit")])
    assert [r.orders for r in got.collect()] == [orders("score", 4), orders("choice", 5), orders("bool", 3)]
    assert rc.letter_biases(got, "type").count() == 0  # nothing was read


def test_letters_never_compared_get_the_smallest_solution():
    import pandas as pd

    own = pd.DataFrame({"orders": json.dumps([[0, 1]]), "rot": [0, 0], "pos": [0, 1], "x": [1.0, -1.0], "q": [3, 3]})
    assert np.allclose(rc.solved(own, 2), 0)


@pytest.mark.parametrize("bias", [[1.5, 0.2, -0.3, -0.6, -0.8]])
def test_recalibration_lowers_the_loss(spark, bias):
    rows = made(spark, planted("choice", 5, bias, 120))
    old = spark.createDataFrame([("choice", 2.0, 0.5)], "type string, t double, na_bias double")
    done = rc.recalibrate(rows, rows, old)
    report = {(r.phase, r.type): r for r in done["report"].collect()}
    assert set(report) == {("before", "choice"), ("before", "na"), ("after", "choice"), ("after", "na")}
    assert report["after", "choice"].loss < report["before", "choice"].loss and report["after", "choice"].stability < 1e-4 < report["before", "choice"].stability
    assert report["after", "na"].auroc is None  # no question without an answer, so there is no area and no bias
    assert [r.na_bias for r in done["fitted"].collect()] == [0.0]
    assert all(len(r.prior) == r.k == 4 for r in done["priors"].collect())
