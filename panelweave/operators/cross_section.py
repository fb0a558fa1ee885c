"""Operators over the instruments of a date, or of a group on a date."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave.functions.columns import both, clip, divide, fin, norm_ppf, number
from panelweave.operators.registry import CROSS, FRAME, of_date, op
from panelweave.plans.syntax import ExpressionError

TINY = 1e-12


def place(x: Column, *by) -> Column:
    """0-based place of x; equal values by sid, missing ones last."""
    return F.row_number().over(of_date(*by).orderBy(x.asc_nulls_last(), "sid")) - 1


def ordinal(x: Column) -> Column:
    n = F.count(x).over(of_date())
    return F.when(x.isNotNull() & (n > 1), place(x) / (n - 1))


@op("rank", 1, axis=CROSS, gives="pure")
def _rank(x):
    """place among the date's values, from 0 to 1"""
    return ordinal(x)


@op("quantile", 1, 2, axis=CROSS, literals=(1,), gives="pure")
def _quantile(x, driver=1):
    """rank mapped to a distribution: 0 uniform, 1 normal, 2 Cauchy"""
    p = clip(ordinal(x), 1e-9, 1 - 1e-9)
    if driver == 0:
        return p
    return F.tan(F.lit(3.141592653589793) * (p - 0.5)) if driver == 2 else norm_ppf(p)


@op("zscore", 1, axis=CROSS, gives="pure")
def _zscore(x):
    """(x - mean) / sample deviation"""
    d = F.stddev_samp(x).over(of_date())
    return fin(F.when(d > TINY, F.try_divide(x - F.avg(x).over(of_date()), d)))


@op("normalize", 1, 3, axis=CROSS, literals=(1, 2), gives="pure")
def _normalize(x, use_std=0, limit=0):
    """x - mean, by the sample deviation if asked, clipped if asked"""
    out = x - F.avg(x).over(of_date())
    if use_std:
        d = F.stddev_samp(x).over(of_date())
        out = fin(F.when(d > TINY, F.try_divide(out, d)))
    return clip(out, -abs(limit), abs(limit)) if limit else out


@op("winsorize", 1, 2, axis=CROSS, literals=(1,), gives="pure")
def _winsorize(x, std=4):
    """clip to mean +- std sample deviations"""
    mean, reach = F.avg(x).over(of_date()), F.coalesce(F.stddev_samp(x).over(of_date()), F.lit(0.0)) * number(std)
    return clip(x, mean - reach, mean + reach)


@op("scale", 1, 4, axis=CROSS, literals=(1, 2, 3), gives="pure")
def _scale(x, size=1, long=1, short=1):
    """positives sum to size * long, negatives to -size * short"""
    up = F.sum(F.when(x > 0, x)).over(of_date())
    down = F.sum(F.when(x < 0, -x)).over(of_date())
    return F.when(x > 0, F.when(up > TINY, F.try_divide(x * float(size * long), up)).otherwise(0.0)).when(x < 0, F.when(down > TINY, F.try_divide(x * float(size * short), down)).otherwise(0.0)).when(x.isNotNull(), 0.0)


def _project(x: Column, f: Column, *by) -> Column:
    """x without its part along f, through the origin."""
    seen = both(x, f, F.lit(1.0))
    xy, yy = F.sum(both(x, f, x * f)).over(of_date(*by)), F.sum(both(x, f, f * f)).over(of_date(*by))
    beta = F.when(yy > TINY, F.try_divide(xy, yy)).otherwise(0.0)
    return F.when(seen.isNotNull(), x - beta * f)


@op("vector_neut", 2, 3, axis=CROSS)
def _vector_neut(x, f, _=None):
    """x without its projection on f; at least two names"""
    n = F.count(both(x, f, F.lit(1.0))).over(of_date())
    return F.when(n >= 2, _project(x, f))


@op("group_vector_neut", 3, axis=CROSS, groups=(2,))
def _group_vector_neut(x, f, g):
    """x without its projection on f within the group"""
    return F.when(g.isNotNull(), _project(x, f, g))


@op("group_neutralize", 2, axis=CROSS, groups=(1,))
def _group_neutralize(x, g):
    """x - group mean"""
    return F.when(g.isNotNull(), x - F.avg(x).over(of_date(g)))


@op("group_mean", 2, axis=CROSS, groups=(1,), gives="first")
def _group_mean(x, g):
    """group mean, where x is known"""
    return both(x, g, F.avg(x).over(of_date(g)))


@op("group_rank", 2, axis=CROSS, groups=(1,), gives="pure")
def _group_rank(x, g):
    """place in the group from 0 to 1; 0 alone"""
    return both(x, g, place(x, g) / F.greatest(F.count(x).over(of_date(g)) - 1, F.lit(1)))


@op("group_zscore", 2, axis=CROSS, groups=(1,), gives="pure")
def _group_zscore(x, g):
    """(x - group mean) / population deviation; 0 for constant groups"""
    d = F.stddev_pop(x).over(of_date(g))
    return both(x, g, F.when(d > TINY, F.try_divide(x - F.avg(x).over(of_date(g)), d)).otherwise(0.0))


@op("group_scale", 2, axis=CROSS, groups=(1,), gives="pure")
def _group_scale(x, g):
    """x / sum of |x| in the group"""
    s = F.sum(F.abs(x)).over(of_date(g))
    return both(x, g, F.when(s > TINY, F.try_divide(x, s)).otherwise(0.0))


@op("group_backfill", 2, 4, axis=CROSS, groups=(1,), literals=(2, 3), gives="first")
def _group_backfill(x, g, *_):
    """missing values become the group's mean; the window is accepted and not used"""
    return F.coalesce(x, F.when(g.isNotNull(), F.avg(x).over(of_date(g))))


@op("regression_neut", 2, 6, axis=FRAME)
def _regression_neut(df, out, x, *factors):
    """residual of x on up to five factors and a constant, by date; minimum-norm solution.

    Means and then sums of centred products are taken by date, a row for each
    date is solved, and the coefficients are joined back: the cells themselves
    never leave the JVM.
    """
    import numpy as np

    if not factors:
        raise ExpressionError("regression_neut needs a factor")
    seen = F.lit(True)
    for c in (x, *factors):
        seen = seen & c.isNotNull()
    k = len(factors)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    # centred by date before products are taken: sums of raw products would lose half the digits
    columns = [x, *factors]
    means = df.groupBy("t").agg(F.count(F.when(seen, 1)).alias("__n"), *[F.avg(F.when(seen, c)).alias(f"__m{i}") for i, c in enumerate(columns)]).where(F.col("__n") >= k + 2)
    near = df.join(F.broadcast(means), "t")  # a row for each date
    centred = [F.when(seen, c - F.col(f"__m{i}")) for i, c in enumerate(columns)]
    sums = [F.sum(centred[i + 1] * centred[j + 1]).alias(f"a{i}_{j}") for i, j in pairs] + [F.sum(centred[i + 1] * centred[0]).alias(f"b{i}") for i in range(k)]
    daily = near.groupBy("t").agg(*[F.first(f"__m{i}").alias(f"m{i}") for i in range(k + 1)], *sums)

    @F.pandas_udf("array<double>")
    def solve(sums: pd.DataFrame) -> pd.Series:
        out = []
        for row in sums.itertuples(index=False):
            means, row = row[: k + 1], row[k + 1 :]
            gram = np.zeros((k, k))
            for (i, j), v in zip(pairs, row, strict=False):
                gram[i, j] = gram[j, i] = v
            size = np.sqrt(np.maximum(np.diag(gram), 1e-300))
            slopes = np.linalg.pinv(gram / np.outer(size, size), rcond=1e-12, hermitian=True) @ (np.array(row[len(pairs) :]) / size) / size
            out.append([means[0] - float(slopes @ np.array(means[1:])), *slopes.tolist()])
        return pd.Series(out)

    beta = daily.select(F.col("t").alias("__t"), solve(F.struct(*[f"m{i}" for i in range(k + 1)], *[f"a{i}_{j}" for i, j in pairs], *[f"b{i}" for i in range(k)])).alias("__beta"))
    design = [F.lit(1.0), *factors]
    fit = F.lit(0.0)
    for i, c in enumerate(design):
        fit = fit + F.col("__beta")[i] * c
    return df.join(F.broadcast(beta), F.col("t") == F.col("__t"), "left").withColumn(out, F.when(seen, x - fit)).drop("__t", "__beta")
