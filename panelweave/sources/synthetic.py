"""A made-up market with every field of the catalogue.

A few rows a day describe the market: its return, and the states crisis (a sticky two-state chain), stress and bear
(dated episodes) and panic (entered on a deep fall with high volatility, left when both have eased). Each instrument is
made by one task from the seed and its sid alone; accounts come from ``accounts``, implied volatilities from the surface
of ``functions.options`` as columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.functions import options
from panelweave.panel import Panel, clean
from panelweave.plans.fields import ALIASES, FIELDS, GROUP, VECTOR
from panelweave.sources import accounts
from panelweave.sources.market import business_days, provider

#: Dated episodes with their daily drift and volatility multiple, and the chain's chances to enter and leave.
STRESS, BEAR = ("2020-02-24", "2020-03-31", -0.008, 2.0), ("2022-01-03", "2022-10-31", -0.0024, 1.75)
CRISIS_ENTER, CRISIS_LEAVE, CRISIS_LIFT = 0.015, 0.10, 2.0
PANIC_FALL, PANIC_VOLATILITY, PANIC_DAYS = -0.10, 2.5, 5
QUARTER = 63
SECTORS, INDUSTRIES, SUBINDUSTRIES = 11, 33, 66
GROUPS = ("sector", "industry", "subindustry", "market")
VECTORS = tuple(name for name, (kind, _) in FIELDS.items() if kind == VECTOR and name != "parts")


@dataclass
class Market:
    """Arrays of a value for each date."""

    returns: np.ndarray
    crisis: np.ndarray
    stress: np.ndarray
    bear: np.ndarray
    panic: np.ndarray


def panic_days(returns: np.ndarray) -> np.ndarray:
    """Days of panic. It starts when the market is 10 % under its peak with ``PANIC_VOLATILITY`` times its usual volatility
    over the last days, and ends when it is less than half as far down and volatility is usual again."""
    level = np.cumprod(1 + returns)
    fall = level / np.maximum.accumulate(level) - 1
    usual = pd.Series(returns).expanding(20).std().bfill().to_numpy()
    lately = pd.Series(returns).rolling(PANIC_DAYS, min_periods=1).apply(lambda x: np.sqrt(np.mean(x**2)), raw=True).to_numpy()
    ratio = lately / np.maximum(usual, 1e-12)
    out, inside = np.zeros(len(returns), bool), False
    for t in range(1, len(returns)):  # a state of yesterday's figures
        inside = fall[t - 1] < PANIC_FALL / 2 or ratio[t - 1] > 1 if inside else fall[t - 1] < PANIC_FALL and ratio[t - 1] > PANIC_VOLATILITY
        out[t] = inside
    return out


def market_path(dates: list, seed: int) -> Market:
    rng = np.random.default_rng([seed, 0])
    n, days = len(dates), np.array(dates, dtype="datetime64[D]")
    during = lambda episode: (days >= np.datetime64(episode[0])) & (days <= np.datetime64(episode[1]))
    stress, bear, crisis, now = during(STRESS), during(BEAR), np.zeros(n, bool), False
    for t, u in enumerate(rng.random(n)):
        now = u >= CRISIS_LEAVE if now else u < CRISIS_ENTER
        crisis[t] = now
    lift = np.where(stress, STRESS[3], 1) * np.where(bear, BEAR[3], 1) * np.where(crisis, CRISIS_LIFT, 1)
    returns = 0.0004 + stress * STRESS[2] + bear * BEAR[2] + 0.007 * np.minimum(lift, 4) * rng.standard_t(6, n) / np.sqrt(1.5)
    returns = np.clip(returns, -0.2, 0.2)
    return Market(returns, crisis, stress, bear, panic_days(returns))


def _sparse(rng: np.random.Generator, values: np.ndarray, share: float) -> np.ndarray:
    return np.where(rng.random(len(values)) < share, values, np.nan)


def _stepped(values: np.ndarray, quarter: np.ndarray) -> np.ndarray:
    """What is known each day of quarterly values: those of the quarter before."""
    return np.where(quarter > 0, values[np.maximum(quarter - 1, 0)], np.nan)


def one_instrument(sid: int, dates: list, market: Market, quarterly: dict[str, np.ndarray], size: float, seed: int) -> dict[str, np.ndarray]:
    """All stored fields of one instrument. Vector fields are lists of parts."""
    rng = np.random.default_rng([seed, 2, sid])
    n = len(dates)
    quarter = np.arange(n) // QUARTER
    sector = np.random.default_rng([seed, 3, sid % SECTORS]).normal(0, 0.004, n)

    shocks, volatility, level = rng.standard_t(5, n) / np.sqrt(5 / 3), np.empty(n), 1.0
    for t in range(n):
        volatility[t] = level
        level = 0.04 + 0.09 * level * min(shocks[t] ** 2, 25) + 0.87 * level
    own = 0.014 * rng.uniform(0.7, 1.4) * np.sqrt(volatility)
    returns = np.clip(rng.uniform(0.6, 1.4) * market.returns + sector + own * shocks, -0.6, 1.5)
    close = rng.uniform(10, 200) * np.cumprod(1 + returns)
    before = np.concatenate([[close[0]], close[:-1]])
    open_ = before * (1 + 0.3 * own * rng.standard_normal(n))
    reach = np.abs(rng.standard_normal((2, n))) * own * 0.5
    high, low = np.maximum(open_, close) * (1 + reach[0]), np.minimum(open_, close) * (1 - np.minimum(reach[1], 0.5))
    volume = np.exp(np.log(size) + 4 + 0.35 * rng.standard_normal(n) + 8 * np.abs(returns))
    shares = size * 2e4 / close[0]
    f = {"returns": returns, "close": close, "open": open_, "high": high, "low": low, "volume": volume, "vwap": (open_ + high + low + close) / 4, "shares_out": np.full(n, shares), "cap": shares * close}

    # accounts of the quarter before
    raw = quarterly
    ratio = rng.uniform(0.08, 0.30), rng.uniform(0.35, 0.65), rng.uniform(0.10, 0.30), rng.uniform(0.0, 0.2)
    owed = raw["assets"] * ratio[0]
    debt = np.where(raw["assets"] - raw["debt"] - owed < 0.05 * raw["assets"], np.maximum(0.95 * raw["assets"] - owed, 0), raw["debt"])
    q = {"sales": raw["sales"], "assets": raw["assets"], "debt": debt, "ebitda": raw["ebitda"], "cashflow_op": raw["cfo"], "liabilities_curr": owed, "assets_curr": raw["assets"] * rng.uniform(0.2, 0.5), "goodwill": raw["assets"] * ratio[3]}
    q["cogs"] = q["sales"] * ratio[1]
    q["gross_profit"] = q["sales"] - q["cogs"]
    q["operating_expense"] = q["cogs"] + q["sales"] * ratio[2]
    q["operating_income"] = q["ebitda"] - 0.03 * q["assets"]
    q["ebit"] = q["operating_income"] + q["sales"] * rng.normal(0, 0.005)
    q["tax_expense"] = np.maximum(0.21 * q["operating_income"], 0)
    q["net_income"] = q["operating_income"] - q["tax_expense"] - 0.01 * debt
    q["eps"] = q["net_income"] / shares
    q["liabilities"] = debt + owed
    q["equity"] = q["assets"] - q["liabilities"]
    q["cash_and_equiv"] = 0.4 * q["assets_curr"]
    q["working_capital"] = q["assets_curr"] - owed
    q["operating_cash_flow"] = q["cashflow_op"]
    q["capex"] = q["sales"] * rng.uniform(0.02, 0.08)
    q["free_cash_flow"] = q["operating_cash_flow"] - q["capex"]
    q["dividends_paid"] = np.maximum(q["net_income"], 0) * rng.uniform(0, 0.5)
    q["retained_earnings"] = np.cumsum(q["net_income"] - q["dividends_paid"])
    q["return_assets"] = q["net_income"] / q["assets"]
    f |= {name: _stepped(x, quarter) for name, x in q.items()}

    # estimates look at the coming quarter through noise
    ahead = np.minimum(np.arange(len(q["eps"])) + 1, len(q["eps"]) - 1)
    f["est_eps"] = _stepped(q["eps"][ahead], quarter) * (1 + rng.normal(0, 0.05, n))
    f["est_revenue"] = _stepped(q["sales"][ahead], quarter) * (1 + rng.normal(0, 0.03, n))
    f["est_eps_std"] = np.abs(f["est_eps"]) * rng.uniform(0.02, 0.1)
    f["recommendation"] = np.clip(3 + np.cumsum(rng.normal(0, 0.02, n)), 1, 5)
    f["eps_surprise"] = _sparse(rng, f["eps"] / np.where(np.abs(f["est_eps"]) > 1e-9, f["est_eps"], np.nan) - 1, 0.1)

    mood = rng.normal(0, 1, n) + 4 * returns / np.maximum(own, 1e-6) * 0.2
    f |= {"buzz": _sparse(rng, np.abs(mood) + rng.random(n), 0.06), "snt_news": _sparse(rng, np.tanh(mood), 0.05), "snt_social": _sparse(rng, np.tanh(mood + rng.normal(0, 1, n)), 0.04), "news_volume": rng.poisson(3 + 60 * np.abs(returns)).astype(float)}

    # options: quoted for an instrument or not, then tenors inside each other's days
    quoted = rng.random(n) < np.clip(0.5 + 0.1 * np.log(size / 2e4), 0.2, 0.95)
    f["cover_60"], f["cover_10"], f["cover_720"] = quoted, quoted & (rng.random(n) < 0.7), quoted & (rng.random(n) < 0.5)
    realised = pd.Series(returns).rolling(20, min_periods=5).std(ddof=0).to_numpy() * np.sqrt(252) * 100
    f["hv_20"] = realised
    f["iv_base"] = 0.6 * np.nan_to_num(realised, nan=25.0) + 10 + rng.normal(0, 0.5, n)
    f["liquidity"], f["skew0"] = np.full(n, rng.random()), np.full(n, rng.normal(0.03, 0.05))
    f["put_call_ratio"] = np.where(quoted, np.exp(rng.normal(-0.2, 0.3, n) - 3 * returns), np.nan)
    f["opt_open_interest"] = np.where(quoted, volume * rng.uniform(0.05, 0.3), np.nan)

    short = shares * np.clip(0.03 + np.cumsum(rng.normal(0, 0.0005, n)), 0.001, 0.4)
    f |= {"short_interest": short, "days_to_cover": short / np.maximum(pd.Series(volume).rolling(20, min_periods=1).mean().to_numpy(), 1), "borrow_fee": 0.003 + 0.2 * np.maximum(short / shares - 0.1, 0)}
    trades = rng.random(n)
    f["insider_buying"] = np.where(trades < 0.02, np.abs(rng.normal(0, 1, n)) * size * 1e-4, 0.0)
    f["insider_selling"] = np.where(trades > 0.97, -np.abs(rng.normal(0, 1, n)) * size * 1e-4, 0.0)

    shares_of = rng.dirichlet(np.ones(4))
    parts = {
        "nws12_afterhsz_01l": [_sparse(rng, mood + rng.normal(0, 0.5, n), 0.05) for _ in range(3)],
        "scl12_alltype_buzzvec": [_sparse(rng, np.abs(mood + rng.normal(0, 0.5, n)), 0.04) for _ in range(3)],
        "analyst_eps_estimates": [f["est_eps"] * (1 + 0.02 * (k + 1) + rng.normal(0, 0.02, n)) for k in range(4)],
        "segment_revenue": [f["sales"] * w for w in shares_of],
        "price_volume_intraday": [volume / 6 * (1 + rng.normal(0, 0.1, n)) for _ in range(6)],
    }
    return f | {name: list(map(list, zip(*x, strict=True))) for name, x in parts.items()}


STORED_VECTORS = tuple(v for v in VECTORS if v != "option_implied_vol_surface")
MADE = ("adv20", "adv60", "option_implied_vol_surface", "iv_10", "iv_30", *(f"implied_volatility_{side}_{days}" for days in (10, 60, 720) for side in ("call", "put")))
STORED = tuple(name for name, (kind, family) in FIELDS.items() if family and kind not in (GROUP, VECTOR) and name not in MADE)
HELPERS = ("iv_base", "liquidity", "skew0")
FLAGS = ("cover_60", "cover_10", "cover_720")


def implied(df: DataFrame) -> DataFrame:
    """Implied volatilities from the surface, where the tenor is quoted: at the money and 15 % either side."""
    crisis, cover = F.col("crisis").cast("double"), {10: "cover_10", 30: "cover_60", 60: "cover_60", 720: "cover_720"}
    lift = options.regime_multiplier(crisis=F.col("crisis"), panic=F.col("panic"), stress=F.col("stress"), bear=F.col("bear"))
    df = df.withColumns({"__rho": options.skew(F.col("skew0"), crisis), "__eta": options.curvature(F.col("liquidity"), crisis), "__iv": F.col("iv_base") * lift})
    df = df.withColumns({f"__w{days}": F.when(F.col(c), options.theta(F.col("__iv"), days)) for days, c in cover.items()})
    vol = lambda days, k: F.sqrt(options.total_variance(F.lit(k), F.col(f"__w{days}"), F.col("__rho"), F.col("__eta")) / (days / options.YEAR)) * 100
    made = {f"implied_volatility_{side}_{days}": vol(days, k) for days in (10, 60, 720) for side, k in (("call", 0.15), ("put", -0.15))}
    df = df.withColumns({**made, "iv_10": vol(10, 0.0), "iv_30": vol(30, 0.0), "option_implied_vol_surface": F.when(F.col("cover_60"), F.array(*[vol(60, k) for k in options.MONEYNESS]))})
    return df.drop("__rho", "__eta", "__iv", *(f"__w{days}" for days in cover))


@provider("synthetic")
def synthetic(spark: SparkSession, n: int = 100, start: str = "2020-01-01", end: str = "2020-12-31", seed: int = 11) -> Panel:
    """Panel of ``n`` instruments with all fields, vectors and other names of the catalogue, three levels of groups, and the
    more liquid half as sub-universe."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 2:
        raise ValueError("a panel needs two instruments at least")
    days = [r.date for r in business_days(spark, start, end).orderBy("t").collect()]  # a row for each day
    market = market_path(days, seed)
    quarters = len(days) // QUARTER + 1
    by_quarter = [float(market.returns[k * QUARTER : (k + 1) * QUARTER].mean()) if k * QUARTER < len(days) else 0.0 for k in range(quarters)]
    size_of = lambda sid: float(np.exp(np.random.default_rng([seed, 4, sid]).normal(10, 1)))
    middle = float(np.exp(10))

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for sid in frame["id"]:
                sid = int(sid)
                size = size_of(sid)
                quarterly = accounts.paths(np.array([size]), middle, np.array(by_quarter), *accounts.draws(seed, [sid], quarters))
                fields = one_instrument(sid, days, market, {k: v[:, 0] for k, v in quarterly.items()}, size, seed)
                base = {"sid": np.int32(sid), "t": np.arange(len(days), dtype=np.int32), "date": days, "sector": np.int32(sid % SECTORS), "industry": np.int32(sid % INDUSTRIES), "subindustry": np.int32(sid % SUBINDUSTRIES), "market": np.int32(0)}
                states = {name: getattr(market, name) for name in ("crisis", "stress", "bear", "panic")}
                yield pd.DataFrame({**base, **{c: fields[c] for c in (*STORED, *HELPERS, *FLAGS, *STORED_VECTORS)}, **states})

    doubles, flags = (*STORED, *HELPERS), (*FLAGS, "crisis", "stress", "bear", "panic")
    schema = "sid int, t int, date date, sector int, industry int, subindustry int, market int, " + ", ".join([*(f"{c} double" for c in doubles), *(f"{c} boolean" for c in FLAGS), *(f"{c} array<double>" for c in STORED_VECTORS), *(f"{c} boolean" for c in flags[3:])])
    df = implied(clean(spark.range(n).repartition(min(n, 64), "id").mapInPandas(make, schema), doubles)).drop(*HELPERS, *flags)
    past = Window.partitionBy("sid").orderBy("t")
    traded = F.col("close") * F.col("volume")
    df = df.withColumns({f"adv{w}": F.avg(traded).over(past.rowsBetween(1 - w, 0)) for w in (20, 60)})
    liquid = df.groupBy("sid").agg(F.avg("adv20").alias("__liquid")).withColumn("sub", F.row_number().over(Window.orderBy(F.desc("__liquid"), "sid")) <= n // 2)  # a row for each instrument
    df = df.join(F.broadcast(liquid.select("sid", "sub")), "sid")
    df = df.withColumns({alias: F.col(name) for alias, name in ALIASES.items()})
    numbers = (*STORED, *(c for c in MADE if c not in VECTORS), *(a for a, name in ALIASES.items() if name not in VECTORS))
    return Panel(df, numbers, GROUPS, (*VECTORS, *(a for a, name in ALIASES.items() if name in VECTORS)), "sub", f"synthetic-{n}-{start}-{end}-{seed}")
