"""Small statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Z95 = 1.959964


def ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1)."""
    return a.cast("double") / F.greatest(b, F.lit(1))


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def bool_or(cond: Column) -> Column:
    return F.coalesce(F.bool_or(F.coalesce(cond, F.lit(False))), F.lit(False))


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson interval, clipped to [0, 1]; (0, 0) when n is zero."""
    s, m = successes.cast("double"), n.cast("double")
    p = s / m
    z2 = Z95 * Z95
    centre = (p + z2 / (2 * m)) / (1 + z2 / m)
    half = Z95 * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m)) / (1 + z2 / m)
    low = F.when(m > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0)
    high = F.when(m > 0, F.least(F.lit(1.0), centre + half)).otherwise(0.0)
    return low, high


def entropy_term(count: Column, total: Column) -> Column:
    """One summand of the Shannon entropy in bits."""
    p = count / total
    return -p * F.log2(p)


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def level(c: Column, bounds: list[tuple[float, str]], otherwise: str, *, strict: bool = False) -> Column:
    """Label of the first bound reached, tested from the top."""
    out = None
    for bound, label in bounds:
        test = c > bound if strict else c >= bound
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)
