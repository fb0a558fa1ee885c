"""Column functions with the engine's rules: missing is NULL, never NaN or infinite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rational approximation of the normal quantile function: fixed values of the published algorithm.
PPF_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
PPF_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
PPF_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
PPF_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
PPF_TAIL = 0.02425
PPF_LEAST = 1e-9

INFINITE = float("inf")


def number(x) -> Column:
    return x if isinstance(x, Column) else F.lit(None if x is None else float(x)).cast("double")


def fin(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.abs(x) < INFINITE, x)


def both(a: Column, b: Column, value: Column) -> Column:
    """value where neither is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), value)


def divide(a, b) -> Column:
    return fin(F.try_divide(number(a), number(b)))


def flag(condition: Column) -> Column:
    return condition.cast("double")


def clip(x: Column, low, high) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, number(high)), number(low)))


def _polynomial(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def norm_ppf(p: Column) -> Column:
    """Normal quantile of p, kept within [1e-9, 1 - 1e-9]; NULL stays NULL."""
    p = clip(p, PPF_LEAST, 1 - PPF_LEAST)
    q = p - 0.5
    middle = q * _polynomial(q * q, PPF_A) / _polynomial(q * q, (*PPF_B, 1.0))

    def tail(x: Column) -> Column:
        t = F.sqrt(-2 * F.log(x))
        return _polynomial(t, PPF_C) / _polynomial(t, (*PPF_D, 1.0))

    return F.when(p < PPF_TAIL, tail(p)).when(p > 1 - PPF_TAIL, -tail(1 - p)).when(p.isNotNull(), middle)
