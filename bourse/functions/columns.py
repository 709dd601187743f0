"""Small column helpers shared by all operators.

Two rules hold everywhere in the package: a ratio with a zero denominator is
NULL (never an error, never infinity), and a rolling statistic is NULL until
its window holds the full number of non-NULL values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """a / b, NULL when b is zero or either side is NULL."""
    return as_col(a) / F.nullif(as_col(b), F.lit(0.0))


#: rounding is shifted by this part of a unit, away from exact halves (prices
#: such as 1.0000005 are common, and engines differ on halves)
HALF_SHIFT = 0.0314159


def rnd(c, digits: int = 6) -> Column:
    """Round a reported number so that results compare equal across engines (no -0.0)."""
    return F.round(as_col(c) + F.lit(HALF_SHIFT * 10.0 ** -digits), digits) + F.lit(0.0)


def clip(c, lo, hi) -> Column:
    return F.least(F.greatest(as_col(c), F.lit(lo)), F.lit(hi))


def roll(agg, c, n: int, series) -> Column:
    """`agg(c)` over the trailing `n` rows, NULL until `n` values are present."""
    w = series.rows(n)
    return F.when(F.count(as_col(c)).over(w) == n, agg(as_col(c)).over(w))


def growth(new, old) -> Column:
    """(new - old) / |old|, NULL when old is zero or missing."""
    return (as_col(new) - as_col(old)) / F.nullif(F.abs(as_col(old)), F.lit(0.0))


def flag(cond: Column) -> Column:
    """1 when the condition holds, 0 when it is false or NULL."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def total(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)
