"""Elementwise operators: arithmetic, logic, conditions, clipping, arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave.functions.columns import both, clip, divide, fin, flag, number
from panelweave.operators.registry import CROSS, of_date, op
from panelweave.plans.syntax import ExpressionError


def power(a: Column, b: Column) -> Column:
    return fin(F.pow(a, b))


INFIX = {
    "+": lambda a, b: fin(a + b),
    "-": lambda a, b: fin(a - b),
    "*": lambda a, b: fin(a * b),
    "/": divide,
    "^": power,
}
COMPARE = {
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def truth(x: Column) -> Column:
    """Known and not zero."""
    return F.coalesce(x != 0, F.lit(False))


@op("abs", 1, gives="first")
def _abs(x):
    """absolute value"""
    return F.abs(x)


@op("sign", 1, gives="first")
def _sign(x):
    """-1, 0 or 1"""
    return F.signum(x)


@op("log", 1, gives="first")
def _log(x):
    """natural logarithm; missing unless positive"""
    return F.when(x > 0, F.log(F.greatest(x, F.lit(1e-300))))


@op("sqrt", 1, gives="first")
def _sqrt(x):
    """square root; 0 for negative values"""
    return F.sqrt(F.greatest(x, F.lit(0.0))) * F.when(x.isNotNull(), 1.0)


@op("max", 2, gives="first")
def _max(a, b):
    """larger of two; missing if one is"""
    return both(a, b, F.greatest(a, b))


@op("min", 2, gives="first")
def _min(a, b):
    """smaller of two; missing if one is"""
    return both(a, b, F.least(a, b))


def _fold(symbol: str):
    def build(a, b, filled=0, *more):
        if isinstance(filled, Column):
            raise ExpressionError("the filter argument must be a number")
        parts = [F.coalesce(x, F.lit(0.0)) if filled else x for x in (a, b, *more)]
        return reduce(INFIX[symbol], parts)

    build.__doc__ = f"a {symbol} b; with filter 1 missing values count as 0; a fourth argument is folded in too"
    return build


for _name, _symbol in (("add", "+"), ("subtract", "-"), ("multiply", "*"), ("divide", "/"), ("power", "^")):
    op(_name, 2, 4, literals=(2,), gives="first")(_fold(_symbol))


@op("inverse", 1, gives="first")
def _inverse(x):
    """1 / x"""
    return divide(1.0, x)


@op("reverse", 1, gives="first")
def _reverse(x):
    """-x"""
    return -x


@op("signed_power", 2, gives="first")
def _signed_power(a, b):
    """sign(a) * |a| ^ b"""
    return fin(F.signum(a) * F.pow(F.abs(a), b))


@op("and", 2)
def _and(a, b):
    """1 if both are not zero; missing if one is"""
    return both(a, b, flag((a != 0) & (b != 0)))


@op("or", 2)
def _or(a, b):
    """1 if one is not zero; missing if one is"""
    return both(a, b, flag((a != 0) | (b != 0)))


@op("not", 1, gives="pure")
def _not(x):
    """1 for 0, else 0"""
    return flag(x == 0)


@op("is_nan", 1, gives="pure")
def _is_nan(x):
    """1 where missing"""
    return flag(x.isNull())


@op("if_else", 3)
def _if_else(c, a, b):
    """a where c is known and not zero, else b"""
    return F.when(truth(c), a).otherwise(b)


@op("truncate", 1, 2, literals=(1,), gives="first")
def _truncate(x, most=0.05):
    """clip to +-|most|"""
    return clip(x, -abs(most), abs(most))


def _check_bucket(*limits):
    if len(limits) == 1 and (not isinstance(limits[0], int) or limits[0] < 2):
        raise ExpressionError("bucket: the number of buckets must be an integer of 2 or more")
    if len(limits) > 1 and not (limits[2] if len(limits) == 3 else limits[1] - limits[0]):
        raise ExpressionError("bucket: the step must not be 0")


@op("bucket", 2, 4, axis=CROSS, literals=(1, 2, 3), check=_check_bucket, gives="pure")
def _bucket(x, *limits):
    """bucket(x, n): n buckets by rank; bucket(x, low, high[, step]): steps from low"""
    if len(limits) == 1:
        n = limits[0]
        from panelweave.operators.cross_section import ordinal

        return F.floor(clip(ordinal(x), 0, 1 - 1e-9) * n).cast("double")
    low, high = limits[:2]
    step = limits[2] if len(limits) == 3 else (high - low) / 10
    return F.floor((x - low) / number(step)).cast("double")


# -- arrays of parts in a cell


def known(v: Column) -> Column:
    return F.filter(v.cast("array<double>"), lambda x: F.abs(x) < float("inf"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _some(v: Column, value: Column, least: int = 1) -> Column:
    return F.when(F.size(v) >= least, value)


@op("vec_avg", 1, vectors=(0,))
def _vec_avg(v):
    """mean of the known parts"""
    k = known(v)
    return _some(k, total(k) / F.size(k))


op("vec_mean", 1, vectors=(0,))(_vec_avg)


@op("vec_sum", 1, vectors=(0,))
def _vec_sum(v):
    """sum of the known parts"""
    k = known(v)
    return _some(k, total(k))


@op("vec_max", 1, vectors=(0,))
def _vec_max(v):
    """largest known part"""
    return F.array_max(known(v))


@op("vec_min", 1, vectors=(0,))
def _vec_min(v):
    """smallest known part"""
    return F.array_min(known(v))


@op("vec_std", 1, vectors=(0,))
def _vec_std(v):
    """sample deviation of the known parts"""
    k = known(v)
    mean = total(k) / F.size(k)
    return _some(k, F.sqrt(total(F.transform(k, lambda x: (x - mean) * (x - mean))) / (F.size(k) - 1)), 2)


def _check_part(k):
    if not isinstance(k, int) or k < 0:
        raise ExpressionError("vec_choose: the part must be an integer literal from 0")


@op("vec_choose", 2, vectors=(0,), literals=(1,), check=_check_part)
def _vec_choose(v, k):
    """part k, from 0"""
    return fin(F.try_element_at(v.cast("array<double>"), F.lit(k + 1)))


@op("densify", 1, axis=CROSS, gives="pure")
def _densify(x):
    """code 0..K-1 of the date's distinct values"""
    return F.when(x.isNotNull(), F.dense_rank().over(of_date().orderBy(x.asc_nulls_last())) - 1).cast("double")
