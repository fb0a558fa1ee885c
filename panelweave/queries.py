"""Registered queries: each language operator and pipeline stage over panels of the test tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.columns import PPF_A, PPF_B, PPF_C, PPF_D
from panelweave.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def _tidy(x, digits: int = DIGITS):
    """Rounded for comparison; the shift keeps exact halves from falling either way."""
    return F.round(x + F.lit(shift(digits)), digits) + F.lit(0.0)


def shift(digits: int) -> float:
    return 1.2345 * 10.0 ** -(digits + 2)


def _tidy_sql(x: str, digits: int) -> str:
    return f"round(CAST({x} AS DOUBLE) + {shift(digits)!r}, {digits}) + 0.0"


def _panel_query(make, expression: str, digits: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(spark, sf_dir).eval(expression).select("sid", "t", _tidy(F.col("value"), digits).alias("value"))

    return run


def on_months(name: str, expression: str, sql: str | None = None, digits: int = DIGITS) -> None:
    """A query over supplier-months; sql: a SELECT of sid, t, value over ``panel``."""
    QUERIES[name] = _panel_query(tables.supplier_month, expression, digits)
    if sql:
        SQL[name] = f"WITH {tables.SUPPLIER_MONTH_SQL}, found AS ({sql}) SELECT sid, t, {_tidy_sql('value', digits)} AS value FROM found"


def on_days(name: str, expression: str, sql: str | None = None, digits: int = DIGITS) -> None:
    QUERIES[name] = _panel_query(tables.user_day, expression, digits)
    if sql:
        SQL[name] = f"WITH {tables.USER_DAY_SQL}, found AS ({sql}) SELECT sid, t, {_tidy_sql('value', digits)} AS value FROM found"


def each(value: str, source: str = "panel") -> str:
    return f"SELECT sid, t, {value} AS value FROM {source}"


def over(w: int) -> str:
    return f"OVER (PARTITION BY sid ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def rolling(value: str, w: int, source: str = "panel") -> str:
    """value over {w}, empty before row w - 1."""
    return each(f"CASE WHEN t >= {w - 1} THEN {value.replace('{w}', over(w))} END", source)


DATE, TIME = "OVER (PARTITION BY t)", "OVER (PARTITION BY sid ORDER BY t)"


def ordinal(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) {DATE} > 1 THEN (row_number() OVER (PARTITION BY t ORDER BY {x} NULLS LAST, sid) - 1) / CAST(count({x}) {DATE} - 1 AS DOUBLE) END"


def ppf(p: str) -> str:
    """SQL of the normal quantile of an expression."""

    def poly(x, cs):
        out = f"({cs[0]!r})"
        for c in cs[1:]:
            out = f"({out} * {x} + ({c!r}))"
        return out

    c = f"greatest(least({p}, 1 - 1e-9), 1e-9)"
    q = f"({c} - 0.5)"
    low, high = f"sqrt(-2 * ln({c}))", f"sqrt(-2 * ln(1 - {c}))"
    tail = lambda x: f"{poly(x, PPF_C)} / {poly(x, (*PPF_D, 1.0))}"
    return f"CASE WHEN {p} IS NULL THEN NULL WHEN {c} < 0.02425 THEN {tail(low)} WHEN {c} > 1 - 0.02425 THEN -({tail(high)}) ELSE {q} * {poly(f'({q} * {q})', PPF_A)} / {poly(f'({q} * {q})', (*PPF_B, 1.0))} END"


# -- elementwise

on_months("elem_arith", "(rev - qty * 3 + 2) / (n ^ 2)", each("(rev - qty * 3 + 2) / pow(n, 2)"))
on_months("elem_compare", "(qty > 60) + (px <= 1500) * 2 + (n != 3) * 4 + (n == 2) * 8", each("CAST(qty > 60 AS INT) + CAST(px <= 1500 AS INT) * 2 + CAST(n != 3 AS INT) * 4 + CAST(n = 2 AS INT) * 8"))
on_months("elem_logic_infix", "(qty > 60 & px > 1500) + 2 * (qty > 60 | n)", each("CAST(coalesce(qty > 60, false) AND coalesce(px > 1500, false) AS INT) + 2 * CAST(coalesce(qty > 60, false) OR coalesce(n != 0, false) AS INT)"))
on_months("elem_logic", "and(qty - 30, n - 1) + 2 * or(qty - 30, n - 1) + 4 * not(n - 1)", each("CAST(qty - 30 != 0 AND n - 1 != 0 AS INT) + 2 * CAST(qty - 30 != 0 OR n - 1 != 0 AS INT) + 4 * CAST(n - 1 = 0 AS INT)"))
on_months("elem_is_nan", "is_nan(qty)", each("CAST(qty IS NULL AS INT)"))
on_months("elem_if_else", "qty > 60 ? px : n > 2 ? -n : 0", each("CASE WHEN coalesce(qty > 60, false) THEN px WHEN coalesce(n > 2, false) THEN -n ELSE 0 END"))
on_months("elem_abs_sign", "abs(qty - 60) * sign(qty - 60)", each("abs(qty - 60) * sign(qty - 60)"))
on_months("elem_log_sqrt", "log(qty - 50) + sqrt(qty - 60)", each("CASE WHEN qty > 50 THEN ln(qty - 50) END + sqrt(greatest(qty - 60, 0))"))
on_months("elem_max_min", "max(qty, n * 20) - min(px, 1500)", each("CASE WHEN qty IS NOT NULL THEN greatest(qty, n * 20) - least(px, 1500) END"))
on_months("elem_add_filter", "add(qty, px, 1, 5) - add(qty, px) + subtract(qty, n, 1) * multiply(n, 2)", each("CASE WHEN qty IS NULL THEN NULL ELSE (qty + px + 5) - (qty + px) + (qty - n) * (n * 2) END"))
on_months("elem_add_filled", "add(qty, 1, 1) + divide(px, 7, 1) + power(n, 2, 1)", each("coalesce(qty, 0) + 1 + coalesce(px, 0) / 7 + pow(coalesce(n, 0), 2)"))
on_months("elem_inverse_reverse", "inverse(n - 2) + reverse(n)", each("1 / nullif(n - 2, 0) - n"))
on_months("signed_power", "signed_power(qty - 60, 0.5)", each("sign(qty - 60) * pow(abs(qty - 60), 0.5)"))
on_months("truncate", "truncate((qty - 60) / 100, 0.2)", each("CASE WHEN qty IS NOT NULL THEN greatest(least((qty - 60) / 100, 0.2), -0.2) END"))
on_months("bucket_range", "bucket(qty, 0, 200, 25) + bucket(n, 0, 10)", each("floor(qty / 25) + floor(n / 1)"))
on_months("program", "a = ts_mean(qty, 3); b = a - ts_delay(a, 2); b / a", "SELECT sid, t, (a - lag(a, 2) OVER (PARTITION BY sid ORDER BY t)) / nullif(a, 0) AS value FROM (" + f"SELECT sid, t, CASE WHEN t >= 2 THEN avg(qty) {over(3)} END AS a FROM panel)")

# -- time series

on_months("ts_mean", "ts_mean(qty, 5)", rolling("avg(qty) {w}", 5))
on_months("ts_sum", "ts_sum(qty, 5)", rolling("sum(qty) {w}", 5))
on_months("ts_std_dev", "ts_std_dev(qty, 5)", rolling("stddev_pop(qty) {w}", 5))
on_months("ts_zscore", "ts_zscore(qty, 6)", rolling("(qty - avg(qty) {w}) / nullif(stddev_pop(qty) {w}, 0)", 6))
on_months("ts_product", "ts_product(n, 4)", rolling("product(n) {w}", 4))
on_months("ts_count_nans", "ts_count_nans(qty, 10)", rolling("10 - count(qty) {w}", 10))
on_months("ts_av_diff", "ts_av_diff(qty, 4)", rolling("qty - avg(qty) {w}", 4))
on_months("ts_scale", "ts_scale(qty, 6, 1)", rolling("(qty - min(qty) {w}) / nullif(max(qty) {w} - min(qty) {w}, 0) + 1", 6))
on_months("ts_delay", "ts_delay(qty, 3)", each(f"lag(qty, 3) {TIME}"))
on_months("ts_delta", "ts_delta(qty, 3)", each(f"qty - lag(qty, 3) {TIME}"))
on_days("ts_backfill", "ts_backfill(value, 3)", each(f"coalesce(value, lag(value, 1) {TIME}, lag(value, 2) {TIME}, lag(value, 3) {TIME})"))
on_days("ts_decay_linear", "ts_decay_linear(value, 4)", each("CASE WHEN t >= 3 THEN " + "(" + " + ".join(f"coalesce({4 - i} * lag(value, {i}) {TIME}, 0)" for i in range(4)) + ") / nullif(" + " + ".join(f"CASE WHEN lag(value, {i}) {TIME} IS NULL THEN 0 ELSE {4 - i} END" for i in range(4)) + ", 0) END"))
on_days("ts_rank", "ts_rank(value, 7)", rolling("CASE WHEN value IS NOT NULL THEN len(list_filter(list(value) {w}, lambda x: x < value)) / CAST(count(value) {w} AS DOUBLE) END", 7))
on_days("ts_quantile", "ts_quantile(value, 7)", f"SELECT sid, t, {ppf('p')} AS value FROM (SELECT sid, t, CASE WHEN t >= 6 AND value IS NOT NULL THEN len(list_filter(list(value) {over(7)}, lambda x: x < value)) / CAST(count(value) {over(7)} AS DOUBLE) END AS p FROM panel)")
on_days("ts_arg_max", "ts_arg_max(value, 6)", each("CASE WHEN t >= 5 THEN " + f"t - min(u) {over(1)} END", f"(SELECT p.sid, p.t, (SELECT min(q.t) FROM panel q WHERE q.sid = p.sid AND q.t BETWEEN p.t - 5 AND p.t AND q.value = (SELECT max(r.value) FROM panel r WHERE r.sid = p.sid AND r.t BETWEEN p.t - 5 AND p.t)) AS u FROM panel p)"))
on_days("ts_arg_min", "ts_arg_min(value, 6)", each("CASE WHEN t >= 5 THEN " + f"t - min(u) {over(1)} END", f"(SELECT p.sid, p.t, (SELECT min(q.t) FROM panel q WHERE q.sid = p.sid AND q.t BETWEEN p.t - 5 AND p.t AND q.value = (SELECT min(r.value) FROM panel r WHERE r.sid = p.sid AND r.t BETWEEN p.t - 5 AND p.t)) AS u FROM panel p)"))
on_months("ts_covariance", "ts_covariance(qty, n, 6)", rolling("covar_pop(qty, n) {w}", 6))
_SPREAD = "sqrt(var_pop(CASE WHEN px IS NOT NULL THEN qty END) {w} * var_pop(CASE WHEN qty IS NOT NULL THEN px END) {w})"
on_months("ts_corr", "ts_corr(qty, px, 8)", rolling(f"CASE WHEN regr_count(qty, px) {{w}} >= 2 AND {_SPREAD} > 1e-9 THEN corr(qty, px) {{w}} END", 8))
on_months("ts_regr_slope", "ts_regression(qty, n, 8)", rolling("CASE WHEN regr_count(qty, n) {w} >= 2 AND regr_sxx(qty, n) {w} > 1e-9 THEN regr_slope(qty, n) {w} END", 8))
on_months("ts_regr_intercept", "ts_regression(qty, n, 8, 0, 1)", rolling("CASE WHEN regr_count(qty, n) {w} >= 2 AND regr_sxx(qty, n) {w} > 1e-9 THEN regr_intercept(qty, n) {w} END", 8))
_LAGGED = f"(SELECT sid, t, qty, lag(n, 2) {TIME} AS n FROM panel)"
on_months("ts_regr_resid", "ts_regression(qty, n, 8, 2, 2)", rolling("CASE WHEN regr_count(qty, n) {w} >= 2 AND regr_sxx(qty, n) {w} > 1e-9 THEN qty - regr_intercept(qty, n) {w} - regr_slope(qty, n) {w} * n END", 8, _LAGGED))
on_days("kth_element", "kth_element(value, 5, 2)", rolling("list_extract(list_filter(list(value) {w}, lambda x: x IS NOT NULL), -2)", 5))
on_days("last_diff_value", "last_diff_value(value, 5)", each("CASE WHEN value IS NOT NULL THEN list_extract(list_filter(list(value) OVER (PARTITION BY sid ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), lambda x: x != value), -1) END"))
on_days("days_from_last_change", "days_from_last_change(bucket(value, 0, 100, 50))", f"SELECT sid, t, t - max(CASE WHEN b IS NOT NULL AND (before IS NULL OR before != b) THEN t END) OVER (PARTITION BY sid ORDER BY t ROWS UNBOUNDED PRECEDING) AS value FROM (SELECT sid, t, floor(value / 50) AS b, lag(floor(value / 50)) {TIME} AS before FROM panel)")
on_days("ts_step", "ts_step(1) + 0 * is_nan(value)", each("t"))
on_days("trade_when", "trade_when(value > 60, total, value < 20)", "SELECT sid, t, max(CASE WHEN kind = 1 THEN a END) OVER (PARTITION BY sid, run) AS value FROM (SELECT *, sum(CASE WHEN kind > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT sid, t, total AS a, CASE WHEN coalesce(value < 20, false) THEN 2 WHEN coalesce(value > 60, false) THEN 1 ELSE 0 END AS kind FROM panel))")
on_days("hump", "hump(value, 10)", "WITH RECURSIVE path AS (SELECT sid, t, value AS pos FROM panel WHERE t = 0 UNION ALL SELECT p.sid, p.t, CASE WHEN p.value IS NOT NULL AND (path.pos IS NULL OR abs(p.value - path.pos) > 10) THEN p.value ELSE path.pos END FROM path JOIN panel p ON p.sid = path.sid AND p.t = path.t + 1) SELECT sid, t, pos AS value FROM path")

# -- cross-section and groups

on_months("cs_rank", "rank(ts_mean(qty, 3))", f"SELECT sid, t, {ordinal('m')} AS value FROM (SELECT sid, t, CASE WHEN t >= 2 THEN avg(qty) {over(3)} END AS m FROM panel)")
on_months("flagship", "rank(ts_delta(qty, 3))", f"SELECT sid, t, {ordinal('m')} AS value FROM (SELECT sid, t, qty - lag(qty, 3) {TIME} AS m FROM panel)")
on_months("cs_quantile", "quantile(qty)", f"SELECT sid, t, {ppf('p')} AS value FROM (SELECT sid, t, {ordinal('qty')} AS p FROM panel)")
on_months("cs_quantile_uniform", "quantile(qty, 0)", f"SELECT sid, t, greatest(least(p, 1 - 1e-9), 1e-9) + 0 * p AS value FROM (SELECT sid, t, {ordinal('qty')} AS p FROM panel)")
on_months("cs_zscore", "zscore(qty)", each(f"(qty - avg(qty) {DATE}) / CASE WHEN stddev_samp(qty) {DATE} > 1e-12 THEN stddev_samp(qty) {DATE} END"))
on_months("cs_normalize", "normalize(qty) + normalize(px, 1, 2)", each(f"qty - avg(qty) {DATE} + greatest(least((px - avg(px) {DATE}) / nullif(stddev_samp(px) {DATE}, 0), 2), -2)"))
on_months("cs_winsorize", "winsorize(qty, 1.5)", each(f"CASE WHEN qty IS NOT NULL THEN greatest(least(qty, avg(qty) {DATE} + 1.5 * coalesce(stddev_samp(qty) {DATE}, 0)), avg(qty) {DATE} - 1.5 * coalesce(stddev_samp(qty) {DATE}, 0)) END"))
on_months("cs_scale", "scale(qty - 60, 2, 1, 0.5)", f"SELECT sid, t, CASE WHEN x > 0 THEN 2 * x / sum(CASE WHEN x > 0 THEN x END) {DATE} WHEN x < 0 THEN x / sum(CASE WHEN x < 0 THEN -x END) {DATE} WHEN x = 0 THEN 0 END AS value FROM (SELECT sid, t, qty - 60 AS x FROM panel)")
on_months("cs_bucket", "bucket(qty, 5)", each(f"floor(least({ordinal('qty')}, 1 - 1e-9) * 5) + 0 * qty"))
on_months("cs_densify", "densify(n)", each("CASE WHEN n IS NOT NULL THEN dense_rank() OVER (PARTITION BY t ORDER BY n NULLS LAST) - 1 END"))
on_months("densify_group", "densify(industry)", each("g", "(SELECT p.sid, p.t, c.g FROM panel p JOIN (SELECT industry, dense_rank() OVER (ORDER BY industry) - 1 AS g FROM (SELECT DISTINCT industry FROM panel)) c ON c.industry = p.industry)"))
on_months("vector_neut", "vector_neut(qty, n)", each(f"CASE WHEN qty IS NOT NULL AND count(qty) {DATE} >= 2 THEN qty - sum(qty * n) {DATE} / sum(n * n) {DATE} * n END"))
on_months("regression_neut", "regression_neut(qty, n)", each(f"CASE WHEN regr_count(qty, n) {DATE} >= 3 THEN qty - regr_intercept(qty, n) {DATE} - regr_slope(qty, n) {DATE} * n END"), 4)
_RESIDUALS = """WITH m AS (SELECT sid, t, qty AS y, n AS a, px AS b, qty IS NOT NULL AND n IS NOT NULL AND px IS NOT NULL AS ok FROM panel),
    c AS (SELECT t, y - avg(y) FILTER (ok) OVER d AS y, a - avg(a) FILTER (ok) OVER d AS a, b - avg(b) FILTER (ok) OVER d AS b, sid, ok, count(*) FILTER (ok) OVER d AS k FROM m WINDOW d AS (PARTITION BY t)),
    s AS (SELECT t, sum(a * a) FILTER (ok) AS aa, sum(a * b) FILTER (ok) AS ab, sum(b * b) FILTER (ok) AS bb, sum(a * y) FILTER (ok) AS ay, sum(b * y) FILTER (ok) AS yb FROM c GROUP BY t)
    SELECT sid, t, CASE WHEN ok AND k >= 4 THEN y - (ay * bb - yb * ab) / (aa * bb - ab * ab) * a - (yb * aa - ay * ab) / (aa * bb - ab * ab) * b END AS value FROM c JOIN s USING (t)"""
on_months("regression_neut_two", "regression_neut(qty, n, px)", _RESIDUALS, 4)
on_months("group_neutralize", "group_neutralize(qty, industry)", each("qty - avg(qty) OVER (PARTITION BY t, industry)"))
on_months("group_mean", "group_mean(qty, industry)", each("CASE WHEN qty IS NOT NULL THEN avg(qty) OVER (PARTITION BY t, industry) END"))
on_months("group_rank", "group_rank(qty, sector)", each("CASE WHEN qty IS NOT NULL THEN (row_number() OVER (PARTITION BY t, sector ORDER BY qty NULLS LAST, sid) - 1) / CAST(greatest(count(qty) OVER (PARTITION BY t, sector) - 1, 1) AS DOUBLE) END"))
on_months("group_zscore", "group_zscore(qty, sector)", each("CASE WHEN qty IS NOT NULL THEN CASE WHEN stddev_pop(qty) OVER (PARTITION BY t, sector) > 1e-9 THEN (qty - avg(qty) OVER (PARTITION BY t, sector)) / stddev_pop(qty) OVER (PARTITION BY t, sector) ELSE 0 END END"))
on_months("group_scale", "group_scale(qty - 60, sector)", each("CASE WHEN qty IS NOT NULL THEN coalesce((qty - 60) / nullif(sum(abs(qty - 60)) OVER (PARTITION BY t, sector), 0), 0) END"))
on_months("group_backfill", "group_backfill(qty, sector, 5)", each("coalesce(qty, avg(qty) OVER (PARTITION BY t, sector))"))
on_months("group_dynamic", "group_mean(qty, bucket(px, 4))", f"SELECT sid, t, CASE WHEN qty IS NOT NULL AND g IS NOT NULL THEN avg(qty) OVER (PARTITION BY t, g) END AS value FROM (SELECT sid, t, qty, floor(least({ordinal('px')}, 1 - 1e-9) * 4) + 0 * px AS g FROM panel)")
on_months("group_vector_neut", "group_vector_neut(qty, n, sector)", each("CASE WHEN qty IS NOT NULL THEN qty - sum(qty * n) OVER (PARTITION BY t, sector) / sum(n * n) OVER (PARTITION BY t, sector) * n END"))
on_months("mixed_axes", "ts_mean(group_neutralize(rank(ts_delta(qty, 2)), sector), 3)", f"SELECT sid, t, CASE WHEN t >= 2 THEN avg(g) {over(3)} END AS value FROM (SELECT sid, t, r - avg(r) OVER (PARTITION BY t, sector) AS g FROM (SELECT sid, t, sector, {ordinal('d')} AS r FROM (SELECT sid, t, sector, qty - lag(qty, 2) {TIME} AS d FROM panel)))")

# -- arrays

for _fn, _sql in {"vec_avg": "list_avg(parts)", "vec_mean": "list_avg(parts)", "vec_sum": "list_sum(parts)", "vec_max": "list_max(parts)", "vec_min": "list_min(parts)", "vec_std": "CASE WHEN len(parts) > 1 THEN list_stddev_samp(parts) END"}.items():
    on_days(_fn, f"{_fn}(parts)", each(_sql))
on_days("vec_choose", "vec_choose(parts, 1)", each("parts[2]"))
