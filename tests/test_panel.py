"""Operators over a small panel with missing values, ties and constants, against plain Python; causality; plan shapes."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from panelweave.panel import Panel, coverage, densify, validate
from panelweave.plans.syntax import ExpressionError

N, T = 6, 25


def cells():
    rng = random.Random(3)
    day = datetime.date(2020, 1, 1)
    out = []
    for sid in range(N):
        for t in range(T):
            x = None if rng.random() < 0.15 else float(rng.choice([1, 2, 2, 3, 5, -4])) if sid else 7.0
            y = None if rng.random() < 0.1 else rng.uniform(-1, 1)
            out.append((sid, t, day + datetime.timedelta(t), x, y, rng.uniform(-0.1, 0.1), sid % 2, sid % 3 == 0, [x or 0.0, y or 1.0, None]))
    return out


@pytest.fixture(scope="module")
def panel(spark):
    df = spark.createDataFrame(cells(), "sid int, t int, date date, x double, y double, returns double, sector int, sub boolean, v array<double>").cache()
    return Panel(df, ("x", "y", "returns"), ("sector",), ("v",), "sub", "small")


@pytest.fixture(scope="module")
def grid():
    out = {name: [[None] * T for _ in range(N)] for name in ("x", "y")}
    for sid, t, _, x, y, *_ in cells():
        out["x"][sid][t], out["y"][sid][t] = x, y
    return out


def values(panel, text):
    out = [[None] * T for _ in range(N)]
    for r in panel.eval(text).collect():
        out[r.sid][r.t] = r.value
    return out


def close(a, b):
    return a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def same(got, wanted):
    assert all(close(g, w) for a, b in zip(got, wanted, strict=True) for g, w in zip(a, b, strict=True)), (got, wanted)


def known(xs):
    return [v for v in xs if v is not None]


def rolling(xs, w, f, warm=True):
    return [None if warm and t < w - 1 else f(xs[max(0, t - w + 1) : t + 1]) for t in range(T)]


def test_rolling(panel, grid):
    w = 4
    mean = lambda xs: sum(known(xs)) / len(known(xs)) if known(xs) else None
    same(values(panel, f"ts_mean(x, {w})"), [rolling(r, w, mean) for r in grid["x"]])
    same(values(panel, f"ts_count_nans(x, {w})"), [rolling(r, w, lambda xs: w - len(known(xs))) for r in grid["x"]])
    same(values(panel, f"ts_product(x, {w})"), [rolling(r, w, lambda xs: math.prod(known(xs)) if known(xs) else None) for r in grid["x"]])
    same(values(panel, f"ts_rank(x, {w})"), [rolling(r, w, lambda xs: None if xs[-1] is None else sum(v < xs[-1] for v in known(xs)) / len(known(xs))) for r in grid["x"]])
    decay = lambda xs: (lambda p: sum(k * v for k, v in p) / sum(k for k, _ in p) if p else None)([(i + 1, v) for i, v in enumerate(xs) if v is not None])
    same(values(panel, f"ts_decay_linear(x, {w})"), [rolling(r, w, decay) for r in grid["x"]])
    arg = lambda pick: lambda xs: (lambda k: len(xs) - 1 - xs.index(pick(k)) if k else None)(known(xs))
    same(values(panel, f"ts_arg_max(x, {w})"), [rolling(r, w, arg(max)) for r in grid["x"]])
    same(values(panel, f"ts_arg_min(x, {w})"), [rolling(r, w, arg(min)) for r in grid["x"]])
    same(values(panel, f"kth_element(x, {w}, 2)"), [rolling(r, w, lambda xs: known(xs)[-2] if len(known(xs)) > 1 else None) for r in grid["x"]])
    same(values(panel, f"ts_backfill(x, {w})"), [rolling(r, w + 1, lambda xs: known(xs)[-1] if known(xs) else None, False) for r in grid["x"]])


def test_stateful(panel, grid):
    def hump(xs, h):
        held, out = None, []
        for v in xs:
            if v is not None and (held is None or abs(v - held) > h):
                held = v
            out.append(held)
        return out

    def trade(c, a, e):
        held, out = None, []
        for i, j, k in zip(c, a, e, strict=True):
            if k is not None and k > 0.5:
                held = None
            elif i is not None and i > 2:
                held = j
            out.append(held)
        return out

    same(values(panel, "hump(x, 1)"), [hump(r, 1) for r in grid["x"]])
    same(values(panel, "trade_when(x > 2, y, y > 0.5)"), [trade(x, y, y) for x, y in zip(grid["x"], grid["y"], strict=True)])


def test_cross_section(panel, grid):
    wanted = [[None] * T for _ in range(N)]
    groups = [[None] * T for _ in range(N)]
    for t in range(T):
        order = sorted((grid["x"][s][t], s) for s in range(N) if grid["x"][s][t] is not None)
        for place, (_, s) in enumerate(order):
            wanted[s][t] = place / (len(order) - 1) if len(order) > 1 else None
        for g in (0, 1):
            inner = [(v, s) for v, s in order if s % 2 == g]
            for place, (_, s) in enumerate(inner):
                groups[s][t] = place / max(len(inner) - 1, 1)
    same(values(panel, "rank(x)"), wanted)
    same(values(panel, "group_rank(x, sector)"), groups)


def test_regression_neut_is_least_squares(panel, grid):
    import numpy as np

    got = values(panel, "regression_neut(x, y, returns)")
    returns = {(r[0], r[1]): r[5] for r in cells()}
    for t in range(T):
        seen = [s for s in range(N) if grid["x"][s][t] is not None and grid["y"][s][t] is not None]
        if len(seen) < 4:
            assert all(got[s][t] is None for s in range(N))
            continue
        a = np.array([[1, grid["y"][s][t], returns[s, t]] for s in seen])
        b = np.array([grid["x"][s][t] for s in seen])
        left = b - a @ np.linalg.lstsq(a, b, rcond=None)[0]
        assert all(abs(got[s][t] - v) < 1e-6 for s, v in zip(seen, left, strict=True))


def test_missing_rules(panel, grid):
    same(values(panel, "x / 0"), [[None] * T] * N)
    same(values(panel, "(0 - 8) ^ 0.5 + 0 * x"), [[None] * T] * N)
    same(values(panel, "x & y"), [[float(x is not None and x != 0 and y is not None and y != 0) for x, y in zip(a, b, strict=True)] for a, b in zip(grid["x"], grid["y"], strict=True)])
    same(values(panel, "and(x, y)"), [[None if x is None or y is None else float(x != 0 and y != 0) for x, y in zip(a, b, strict=True)] for a, b in zip(grid["x"], grid["y"], strict=True)])
    same(values(panel, "x != nan"), [[None if x is None else 1.0 for x in a] for a in grid["x"]])
    same(values(panel, "if_else(x > 2, 1, 0)"), [[float(x is not None and x > 2) for x in a] for a in grid["x"]])
    same(values(panel, "sqrt(x)"), [[None if x is None else math.sqrt(max(x, 0)) for x in a] for a in grid["x"]])


CAUSAL = ["ts_mean(x, 3)", "ts_rank(x, 4)", "ts_decay_linear(x, 3)", "ts_backfill(x, 3)", "ts_corr(x, y, 5)", "ts_regression(x, y, 5, 1, 2)", "last_diff_value(x, 4)", "days_from_last_change(x)", "trade_when(x > 2, y, -1)", "hump(x, 1)", "ts_arg_max(x, 4)", "kth_element(x, 4, 1)", "ts_product(x, 3)", "ts_scale(x, 4)", "rank(ts_delta(x, 2))", "group_neutralize(ts_zscore(y, 5), sector)"]


@pytest.mark.parametrize("text", CAUSAL)
def test_later_rows_change_nothing(panel, text):
    cut = 15
    changed = Panel(panel.df.withColumns({c: F.when(F.col("t") > cut, F.lit(99.0)).otherwise(F.col(c)) for c in ("x", "y")}), panel.fields, panel.groups)
    a, b = values(panel, text), values(changed, text)
    same([r[: cut + 1] for r in a], [r[: cut + 1] for r in b])


@pytest.mark.parametrize("text", ["rank(ts_mean(ts_delta(x, 2), 3))", "ts_backfill(x, 3)", "ts_regression(x, y, 4, 2)"])
def test_pruned_history_gives_the_same(panel, text):
    wanted = {(r.sid, r.t): r.value for r in panel.eval(text).collect() if r.t >= 18}
    got = {(r.sid, r.t): r.value for r in panel.eval(text, first=18).collect()}
    assert wanted.keys() == got.keys() and all(close(wanted[k], got[k]) for k in wanted)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_axes_share_exchanges(panel):
    spark = panel.df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert exchanges(panel.eval("ts_mean(x, 3) + ts_delta(ts_std_dev(y, 4), 2)")) == 1
        assert exchanges(panel.eval("rank(x) + group_mean(y, sector) + zscore(y)")) == 1
        assert exchanges(panel.eval("rank(ts_mean(x, 3)) + group_mean(ts_delta(y, 2), sector)")) == 2
        assert exchanges(panel.eval("ts_mean(rank(ts_delta(x, 1)), 3)")) == 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_units(panel):
    with pytest.raises(ExpressionError):
        panel.eval("sector")
    assert all(v is None for row in values(Panel(panel.df, panel.fields, panel.groups), "nan") for v in row)
    assert panel.eval("sector", verify_units=False).where("value is not null").count() == 0


def test_fingerprint(panel):
    first = panel.fingerprint()
    assert first == Panel(panel.df.repartition(7), panel.fields, panel.groups, panel.vectors, "sub", "small").fingerprint()
    for change in ({"x": F.when(F.col("t") == 3, None).otherwise(F.col("x"))}, {"sector": F.col("sector") + 1}, {"sub": ~F.col("sub")}):
        assert first != Panel(panel.df.withColumns(change), panel.fields).fingerprint()


def test_validation_and_coverage(panel, spark):
    assert validate(panel) == []
    assert validate(Panel(panel.df.where("t != 3"), panel.fields))
    assert validate(Panel(panel.df.where("not (t = 3 and sid = 1)"), panel.fields))
    assert {r.field: round(r.coverage, 2) for r in coverage(panel).collect()}["returns"] == 1.0
    dates = spark.createDataFrame([(0, datetime.date(2020, 1, 1)), (1, datetime.date(2020, 1, 2))], "t int, date date")
    facts = spark.createDataFrame([(1, 0, 2.0)], "sid int, t int, x double")
    assert densify(facts, dates, spark.createDataFrame([(1,), (2,)], "sid int")).count() == 4


def test_slices_start_anew(panel):
    part = panel.between("2020-01-10", "2020-01-20")
    first = part.eval("ts_mean(returns, 3)").groupBy("t").agg(F.count("value").alias("n")).orderBy("t").collect()
    assert [r.n for r in first][:3] == [0, 0, N]
