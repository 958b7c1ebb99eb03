"""McNemar statistics over the two disagreement counts b and c."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi_square(b: Column, c: Column, corrected: bool = True) -> Column:
    """(|b - c| - 1)^2 / (b + c), 0 without disagreement; without the correction
    (b - c)^2 / (b + c), undefined (NULL) without disagreement."""
    n = (b + c).cast("double")
    gap = F.abs(b - c).cast("double")
    if corrected:
        return F.when(n == 0, 0.0).otherwise(F.try_divide((gap - 1) * (gap - 1), n))
    return F.try_divide(gap * gap, n)


def _upper_tail(chi2: float | None) -> float | None:
    return None if chi2 is None else math.erfc(math.sqrt(chi2 / 2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    front, back = 1.0, 1.0 / ((1.0 - (a + b) * x / (a + 1.0)) or tiny)
    value = back
    for m in range(1, 100_000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            back = 1.0 / ((1.0 + term * back) or tiny)
            front = (1.0 + term / front) or tiny
            change = back * front
            value *= change
        if abs(change - 1.0) < 1e-15:
            break
    return value


def _binomial_cdf_half(k: int, n: int) -> float:
    """P(X <= k) for n fair trials: the incomplete beta function at one half."""
    if k >= n:
        return 1.0
    a, b = float(n - k), float(k + 1)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a + b) * math.log(0.5)
    if 0.5 < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, 0.5) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 0.5) / b


def _exact(b: int | None, c: int | None) -> float | None:
    if b is None or c is None:
        return None
    return min(1.0, 2.0 * _binomial_cdf_half(min(b, c), b + c))


def _tails(chi2: pa.Array) -> pa.Array:
    return pa.array([_upper_tail(x) for x in chi2.to_pylist()], pa.float64())


def _exacts(b: pa.Array, c: pa.Array) -> pa.Array:
    return pa.array([_exact(*bc) for bc in zip(b.to_pylist(), c.to_pylist())], pa.float64())


def chi_square_p(chi2: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return F.arrow_udf(_tails, T.DoubleType())(chi2)


def exact_p(b: Column, c: Column) -> Column:
    """Two-sided exact p-value: b against a fair binomial of b + c trials."""
    return F.arrow_udf(_exacts, T.DoubleType())(b.cast("long"), c.cast("long"))
