"""From readouts to targets: calibrated distributions, N/A shares, position priors, losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dist


def calibrated(lp: Column, bias: Column, temperature: float, na_bias: float) -> Column:
    """Distribution of log probabilities by letter, N/A last: letter biases removed, temperature, a bias on N/A."""
    last = F.size(lp) - 1
    z = F.zip_with(lp, bias, lambda x, b: (x - b) / temperature)
    return dist.softmax(F.transform(z, lambda x, i: x + F.when(i == last, na_bias).otherwise(0.0)))


def regime(na: Column) -> Column:
    """Priors of positions are estimated apart for questions that have no answer."""
    return F.when(na >= 0.5, "na").otherwise("answerable")


def answer_part(p: Column) -> Column:
    """The distribution over the answers, without N/A."""
    return F.slice(p, F.lit(1), F.size(p) - 1)


def target_of(p: Column, prior: Column | None = None) -> Column:
    """struct(target, na) of a distribution with N/A last: each answer divided by the prior of its position (if there is one) and
    renormalised; without any answer's mass the target is null and na is one."""
    na, rest = F.element_at(p, -1), answer_part(p)
    if prior is not None:
        rest = F.when(prior.isNull(), rest).otherwise(F.zip_with(rest, prior, lambda x, y: x / y))
    alive = (na < 1) & (dist.total(rest) > 0)
    return F.struct(F.when(alive, dist.normalised(rest)).alias("target"), F.when(alive, na).otherwise(1.0).alias("na"))


def loss(true_target: Column, true_na: Column, target: Column, na: Column, eps: float = 1e-9) -> Column:
    """Cross entropy of N/A, and of the answers in so far as the question has one."""
    ln = lambda x: F.log(F.greatest(x, F.lit(eps)))
    of_na = -(true_na * ln(na) + (1 - true_na) * ln(1 - na))
    return of_na + F.when(true_target.isNull() | target.isNull(), 0.0).otherwise((1 - true_na) * dist.nll(true_target, target, eps))
