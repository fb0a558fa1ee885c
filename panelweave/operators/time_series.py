"""Operators over an instrument's history, by rows of the dense date index."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import both, divide, fin, norm_ppf
from panelweave.operators.registry import FRAME, TIME, of_time, op, rows
from panelweave.plans.syntax import ExpressionError

TINY = 1e-12
UNBOUNDED = None


def warm(w: int, x: Column) -> Column:
    """Nothing before a whole window has passed."""
    return F.when(F.col("t") >= w - 1, x)


def _windowed(name: str, build, text: str, gives: str = "first") -> None:
    def made(x, w):
        return warm(w, build(x, w))

    made.__doc__ = text
    op(name, 2, axis=TIME, windows=(1,), lookback=lambda w: w - 1, gives=gives)(made)


_windowed("ts_mean", lambda x, w: F.avg(x).over(rows(w)), "mean of the last w rows")
_windowed("ts_sum", lambda x, w: F.sum(x).over(rows(w)), "sum of the last w rows")
_windowed("ts_std_dev", lambda x, w: F.stddev_pop(x).over(rows(w)), "population deviation of the last w rows")
_windowed("ts_product", lambda x, w: fin(F.product(x).over(rows(w))), "product of the last w rows")
_windowed("ts_count_nans", lambda x, w: (F.lit(w) - F.count(x).over(rows(w))).cast("double"), "missing values in the last w rows", "pure")
_windowed("ts_av_diff", lambda x, w: x - F.avg(x).over(rows(w)), "x - mean of the last w rows")
_windowed("ts_zscore", lambda x, w: divide(x - F.avg(x).over(rows(w)), F.stddev_pop(x).over(rows(w))), "(x - mean) / population deviation of the last w rows", "pure")


@op("ts_scale", 2, 3, axis=TIME, windows=(1,), literals=(2,), lookback=lambda w: w - 1, gives="first")
def _ts_scale(x, w, shift=0):
    """place of x between the least and the greatest of the last w rows, plus a constant"""
    low, high = F.min(x).over(rows(w)), F.max(x).over(rows(w))
    return warm(w, divide(x - low, high - low) + float(shift))


@op("ts_delay", 2, axis=TIME, windows=(1,), lookback=lambda w: w, gives="first")
def _ts_delay(x, w):
    """value w rows ago"""
    return F.lag(x, w).over(of_time())


@op("ts_delta", 2, axis=TIME, windows=(1,), lookback=lambda w: w)
def _ts_delta(x, w):
    """x - value w rows ago"""
    return fin(x - F.lag(x, w).over(of_time()))


@op("ts_backfill", 2, axis=TIME, windows=(1,), lookback=lambda w: w, gives="first")
def _ts_backfill(x, w):
    """latest known value of today and the w rows before"""
    return F.last(x, ignorenulls=True).over(rows(w + 1))


@op("ts_decay_linear", 2, axis=TIME, windows=(1,), lookback=lambda w: w - 1, gives="first")
def _ts_decay_linear(x, w):
    """mean of the last w rows with weights w, w - 1, ..., 1 back in time"""
    t = F.when(x.isNotNull(), F.col("t").cast("double"))
    base = F.lit(float(w)) - F.col("t")
    top = base * F.sum(x).over(rows(w)) + F.sum(x * t).over(rows(w))
    weight = base * F.count(x).over(rows(w)) + F.sum(t).over(rows(w))
    return warm(w, divide(top, weight))


def _share_below(x: Column, w: int) -> Column:
    held = F.collect_list(x).over(rows(w))
    return warm(w, F.when(x.isNotNull(), F.size(F.filter(held, lambda v: v < x)) / F.size(held)))


@op("ts_rank", 2, axis=TIME, windows=(1,), lookback=lambda w: w - 1, gives="pure")
def _ts_rank(x, w):
    """share of the last w rows' known values below x"""
    return _share_below(x, w)


@op("ts_quantile", 2, 3, axis=TIME, windows=(1,), literals=(2,), lookback=lambda w: w - 1, gives="first")
def _ts_quantile(x, w, _=None):
    """normal quantile of ts_rank"""
    return norm_ppf(_share_below(x, w))


def _since(x: Column, w: int, sign: int) -> Column:
    t = F.col("t")
    # the greatest (or least) value, then the oldest row
    best = F.max(F.when(x.isNotNull(), F.struct((x * sign).alias("v"), (-t).alias("back")))).over(rows(w))
    return warm(w, (t + best["back"]).cast("double"))


@op("ts_arg_max", 2, axis=TIME, windows=(1,), lookback=lambda w: w - 1, gives="pure")
def _ts_arg_max(x, w):
    """rows since the greatest of the last w; of equals the oldest"""
    return _since(x, w, 1)


@op("ts_arg_min", 2, axis=TIME, windows=(1,), lookback=lambda w: w - 1, gives="pure")
def _ts_arg_min(x, w):
    """rows since the least of the last w; of equals the oldest"""
    return _since(x, w, -1)


@op("ts_covariance", 3, axis=TIME, windows=(2,), lookback=lambda w: w - 1, gives="pure")
def _ts_covariance(x, y, w):
    """population covariance over rows where both are known"""
    return warm(w, F.covar_pop(x, y).over(rows(w)))


@op("ts_corr", 3, axis=TIME, windows=(2,), lookback=lambda w: w - 1, gives="pure")
def _ts_corr(x, y, w):
    """correlation over rows where both are known"""
    seen = both(x, y, F.lit(1.0))
    n = F.count(seen).over(rows(w))
    spread = F.sqrt(F.var_pop(x * seen).over(rows(w)) * F.var_pop(y * seen).over(rows(w)))
    # not corr(): it divides by zero on constant windows
    return warm(w, F.when((n >= 2) & (spread * n > TINY), divide(F.covar_pop(x, y).over(rows(w)), spread)))


@op("ts_regression", 3, 5, axis=TIME, windows=(2,), literals=(3, 4), lookback=lambda w, lag=0, *_: w - 1 + lag, gives="pure")
def _ts_regression(y, x, w, lag=0, kind=0):
    """least squares of y on x, lagged if asked: 0 slope, 1 constant, 2 today's residual"""
    raise AssertionError("built in two steps")


def regression(y: Column, x: Column, w: int, kind: int) -> Column:
    seen = both(x, y, F.lit(1.0))
    n = F.count(seen).over(rows(w))
    spread = F.var_pop(x * seen).over(rows(w)) * n
    slope = F.regr_slope(y, x).over(rows(w))
    constant = F.regr_intercept(y, x).over(rows(w))
    out = (slope, constant, y - (constant + slope * x))[kind]
    return warm(w, F.when((n >= 2) & (spread > TINY), fin(out)))


def _check_kth(_, k):
    if not isinstance(k, int) or k < 1:
        raise ExpressionError("kth_element: k must be an integer literal from 1")


@op("kth_element", 3, axis=TIME, windows=(1,), literals=(2,), lookback=lambda w, *_: w - 1, check=_check_kth, gives="pure")
def _kth_element(x, w, k):
    """k-th latest known value of the last w rows"""
    return warm(w, F.try_element_at(F.collect_list(x).over(rows(w)), F.lit(-k)))


@op("last_diff_value", 2, axis=TIME, windows=(1,), lookback=lambda w: w, gives="pure")
def _last_diff_value(x, w):
    """latest known value of the w rows before today that differs from today's"""
    held = F.collect_list(x).over(of_time().rowsBetween(-w, -1))
    return F.when(x.isNotNull(), F.try_element_at(F.filter(held, lambda v: v != x), F.lit(-1)))


@op("days_from_last_change", 1, axis=TIME, lookback=UNBOUNDED, gives="pure")
def _days_from_last_change(x):
    """rows since the value changed"""
    before = F.lag(x).over(of_time())
    return F.col("t") - F.last(F.when(x.isNotNull() & ~x.eqNullSafe(before), F.col("t")), ignorenulls=True).over(of_time().rowsBetween(Window.unboundedPreceding, 0))


@op("ts_step", 1, literals=(0,))
def _ts_step(_):
    """row of the date, from 0"""
    return F.col("t").cast("double")


@op("trade_when", 3, axis=TIME, lookback=UNBOUNDED)
def _trade_when(c, a, e):
    """a while c is true, then held until e is above 0, which empties it"""
    event = F.when(F.coalesce(e > 0, F.lit(False)), F.struct(F.lit(None).cast("double").alias("p"))).when(F.coalesce(c != 0, F.lit(False)), F.struct(a.alias("p")))
    return F.last(event, ignorenulls=True).over(of_time().rowsBetween(Window.unboundedPreceding, 0))["p"]


@op("hump", 1, 2, axis=FRAME, literals=(1,), lookback=UNBOUNDED, gives="first")
def _hump(df, out, x, h=0.01):
    """hold the last value until x is more than h away from it

    A missing value holds it too.
    """
    from panelweave.operators.paths import fold_by_instrument

    def step(held, v):
        if v is not None and (held is None or abs(v - held) > h):
            held = v
        return held, held

    return fold_by_instrument(df.withColumn(f"{out}x", x), [f"{out}x"], [out], step).drop(f"{out}x")
