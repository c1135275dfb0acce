"""Distributions as arrays of doubles: softmax, divergence, argmax, scores.

Functions over arrays are interpreted, and what stands inside a lambda is evaluated again for each element; ``bound`` has a
value evaluated once and named.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = -100.0


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalised(p: Column) -> Column:
    return bound(p, lambda q: bound(total(q), lambda s: F.transform(q, lambda x: x / s)))


def shown(p: Column, digits: int) -> Column:
    """The numbers with so many decimals, joined by commas. Rounded from the exact binary value, ties to even, as printf does in other
    engines; format_string rounds a tie such as 13 / 32 up."""
    unit = f"{10**-digits:.{digits}f}"
    half = float(unit) / 2
    up = half if Fraction(half) > Fraction(1, 2 * 10**digits) else math.nextafter(half, 1)  # format_number makes "5E-5" nothing
    return F.array_join(F.transform(p, lambda v: F.when(v.between(up, half), unit).otherwise(F.call_function("format_number", v, F.lit("0." + "0" * digits)))), ",")


def floored(lp: Column) -> Column:
    """Log probabilities with null, NaN, infinite ones and anything below the floor set to it."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.transform(lp, lambda x: F.when(fine(x.cast("double")), F.greatest(F.lit(FLOOR), x.cast("double"))).otherwise(FLOOR))


def log_softmax(x: Column) -> Column:
    of = lambda y, m: bound(m + F.log(F.aggregate(y, F.lit(0.0), lambda a, v: a + F.exp(v - m))), lambda z: F.transform(y, lambda v: v - z))
    return bound(x, lambda y: bound(F.array_max(y), lambda m: of(y, m)))


def softmax(x: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return normalised(bound(x, lambda y: bound(F.array_max(y), lambda m: F.transform(y, lambda v: F.exp((v - m) / t)))))


def one_hot(n: Column | int, k: Column) -> Column:
    last = (n if isinstance(n, Column) else F.lit(n)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.when(i == k, 1.0).otherwise(0.0))


def argmax(p: Column) -> Column:
    """Index from 0; the first maximum wins."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def at(p: Column, index: Column) -> Column:
    return F.element_at(p, index + 1)


def soft_accuracy(target: Column, p: Column) -> Column:
    """The target's mass on the predicted argmax."""
    return at(target, argmax(p))


def kl(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)))


def jensen_shannon(p: Column, q: Column) -> Column:
    return bound(F.zip_with(p, q, lambda a, b: (a + b) / 2), lambda m: (kl(p, m) + kl(q, m)) / 2)


def nll(target: Column, p: Column, floor: float = 1e-12) -> Column:
    return -total(F.zip_with(target, p, lambda t, x: t * F.log(F.greatest(x, F.lit(floor)))))


def cumulative(p: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: total(F.slice(p, 1, i)))


def ranked_probability_score(target: Column, p: Column) -> Column:
    """Mean squared distance of the cumulative distributions, over all steps but the last."""
    steps = F.size(p) - 1
    sq = F.zip_with(F.slice(cumulative(target), F.lit(1), steps), F.slice(cumulative(p), F.lit(1), steps), lambda a, b: (a - b) * (a - b))
    return total(sq) / steps


def entropy_bernoulli_loss(t: Column, p: Column, eps: float = 1e-9) -> Column:
    return -(t * F.log(p + eps) + (1 - t) * F.log(1 - p + eps))
