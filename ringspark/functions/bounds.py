"""Order bounds of regular graphs with given girth, as numbers and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check(k: int, g: int) -> None:
    if k < 2 or g < 3:
        raise ValueError("k must be at least 2 and g at least 3")


def powers(k: int, n: int) -> int:
    return sum((k - 1) ** i for i in range(n))


def moore(k: int, g: int) -> int:
    """Least order that a k-regular graph of girth g can have."""
    check(k, g)
    return 1 + k * powers(k, (g - 1) // 2) if g % 2 else 2 * powers(k, g // 2)


def upper(k: int, g: int) -> int:
    """An order at which such graphs are known to exist (a stand-in; see README)."""
    check(k, g)
    return 4 * sum((k - 1) ** t for t in range(1, g - 1))


def power_sum(base: Column, first: Column, last: Column) -> Column:
    """base^first + ... + base^last, 0 if last < first."""
    terms = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda s, i: s + F.pow(base, i).cast("bigint"))


def moore_column(k: Column, g: Column) -> Column:
    k, g = k.cast("int"), g.cast("int")
    half = F.when(g % 2 == 1, ((g - 1) / 2).cast("int")).otherwise((g / 2).cast("int"))
    total = power_sum(k - 1, F.lit(0), half - 1)
    return F.when((k >= 2) & (g >= 3), F.when(g % 2 == 1, 1 + k * total).otherwise(2 * total)).cast("bigint")


def upper_column(k: Column, g: Column) -> Column:
    k, g = k.cast("int"), g.cast("int")
    return F.when((k >= 2) & (g >= 3), 4 * power_sum(k - 1, F.lit(1), g - 2)).cast("bigint")


def valid_column(k: Column, g: Column) -> Column:
    """Whether there are bounds for k and g at all."""
    return (k >= 2) & (g >= 3)
