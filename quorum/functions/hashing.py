"""Deterministic decisions from SHA-1: the same bytes give the same split, pick, coin or order, wherever a row is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str) -> Column:
    """Hex SHA-1 of the parts joined by a bar."""
    return F.sha1(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts)).cast("binary"))


def h32(*parts: Column | str) -> Column:
    """The first 32 bits as a number."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("bigint")


def h64(*parts: Column | str) -> Column:
    """The first 64 bits, unsigned, so as a decimal."""
    return F.conv(F.substring(digest(*parts), 1, 16), 16, 10).cast("decimal(20,0)")


def order_key(*parts: Column | str) -> Column:
    """The first 64 bits as text: its order is that of the numbers."""
    return F.substring(digest(*parts), 1, 16)


def uniform(*parts: Column | str) -> Column:
    """A number strictly between 0 and 1."""
    return (h32(*parts) + 0.5) / float(1 << 32)


def split_of(key: Column, train: int = 90, val: int = 95) -> Column:
    """train, val or test by the hash modulo 100."""
    r = h32(key) % 100
    return F.when(r < train, "train").when(r < val, "val").otherwise("test")


def pick(values: Column, key: Column) -> Column:
    """One element of an array, chosen by the key; null for an empty array."""
    return F.when(F.size(values) > 0, F.element_at(values, (h32(key) % F.size(values) + 1).cast("int")))


def rotated(values: Column, shift: Column | int) -> Column:
    """The array beginning at ``shift``, its head moved to the end."""
    s = shift if isinstance(shift, Column) else F.lit(shift)
    return F.concat(F.slice(values, s + 1, F.size(values)), F.slice(values, F.lit(1), s))


def exponential_key(weight: Column, *parts: Column | str) -> Column:
    """-ln(u)/w: the smallest k keys are a weighted sample without replacement."""
    return -F.log(uniform(*parts)) / weight
