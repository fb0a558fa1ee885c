"""Option surfaces: variance over moneyness and tenor, no-arbitrage checks, densities and range volatility.

A smile has total variance w(k) = theta / 2 * (1 + rho phi k + sqrt((phi k + rho)^2 + 1 - rho^2)) with
phi = eta / sqrt(theta), where theta is the variance at the money up to the tenor and k the log of strike over forward.
All but the fine-grid check of smiles are columns; grids of tenors and strikes are exploded literals, so no join is needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tenors in days, log-moneyness of the strikes, and how much each state of the market lifts volatility.
TENORS = (10, 30, 60, 720)
MONEYNESS = (-0.35, -0.15, 0.0, 0.15, 0.35)
REGIMES = {"crisis": 1.35, "panic": 1.25, "stress": 1.20, "bear": 1.10}
MOST_LIFT = 1.9
YEAR = 365.0
SLACK = 1e-8


def _between(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def term_multiplier(days: Column | float) -> Column:
    """Volatility of a tenor relative to that of 60 days: 8 % more at 720 days, linear in the log of days."""
    x = days if isinstance(days, Column) else F.lit(float(days))
    return _between(1 + 0.08 / math.log(12) * F.log(x / 60), 0.85, 1.15)


def regime_multiplier(**states: Column) -> Column:
    """Product of the lifts of the states (booleans) that hold, ``MOST_LIFT`` at most."""
    lifts = [F.when(holds, REGIMES[name]).otherwise(1.0) for name, holds in states.items()]
    return F.least(reduce(lambda a, b: a * b, lifts, F.lit(1.0)), F.lit(MOST_LIFT))


def skew(skew0: Column, crisis: Column) -> Column:
    """Slope rho of the smile, from -0.85 to 0: downside strikes are dearer, more so in a crisis."""
    return _between(-F.tanh(0.35 + 2.5 * skew0 + 0.1 * crisis), -0.85, 0.0)


def curvature(liquidity: Column, crisis: Column) -> Column:
    """eta, 0.75 at most: illiquid names and crises have more convex smiles."""
    return F.least(0.6 - 0.25 * liquidity + 0.15 * crisis, F.lit(0.75))


def theta(iv_base: Column, days: float) -> Column:
    """Total variance at the money up to a tenor, of a volatility in points."""
    sigma = iv_base / 100 * term_multiplier(days)
    return F.greatest(sigma * sigma * F.lit(days / YEAR), F.lit(1e-8))


def total_variance(k: Column, at_money: Column, rho: Column, eta: Column) -> Column:
    slope = eta / F.sqrt(F.greatest(at_money, F.lit(1e-8))) * k
    return at_money / 2 * (1 + rho * slope + F.sqrt((slope + rho) * (slope + rho) + 1 - rho * rho))


def surface(df: DataFrame, tenors: tuple[int, ...] = TENORS, moneyness: tuple[float, ...] = MONEYNESS) -> DataFrame:
    """A row for each row of ``df`` (iv_base, liquidity, skew0, crisis), tenor and strike: tenor, k, at_money, rho, eta, vol
    in points."""
    grid = F.array(*[F.struct(F.lit(d).alias("tenor"), F.lit(float(k)).alias("k"), theta(F.col("iv_base"), d).alias("at_money")) for d in tenors for k in moneyness])
    rows = df.withColumns({"rho": skew(F.col("skew0"), F.col("crisis")), "eta": curvature(F.col("liquidity"), F.col("crisis"))}).withColumn("__g", F.explode(grid))
    rows = rows.select("*", "__g.*").drop("__g")
    w = total_variance(F.col("k"), F.col("at_money"), F.col("rho"), F.col("eta"))
    return rows.withColumn("vol", F.sqrt(w / (F.col("tenor") / YEAR)) * 100)


def forward_variance(sigma1: Column, years1: float, sigma2: Column, years2: float) -> Column:
    """Variance between two tenors; negative where the calendar could be arbitraged."""
    return sigma2 * sigma2 * years2 - sigma1 * sigma1 * years1


def forward_volatility(sigma1: Column, years1: float, sigma2: Column, years2: float) -> Column:
    return F.sqrt(F.greatest(forward_variance(sigma1, years1, sigma2, years2), F.lit(0.0)) / (years2 - years1))


def falling(variances: list[Column]) -> Column:
    """Whether total variance falls from some tenor to the next."""
    return reduce(lambda a, b: a | b, (F.coalesce(y - x < -SLACK, F.lit(False)) for x, y in zip(variances, variances[1:], strict=False)))


def unbounded(at_money: Column, rho: Column, eta: Column) -> Column:
    """Whether a smile breaks the conditions theta phi (1 + |rho|) < 4 and theta phi^2 (1 + |rho|) <= 4 that rule out
    butterflies."""
    phi, wing = eta / F.sqrt(F.greatest(at_money, F.lit(1e-8))), 1 + F.abs(rho)
    return (at_money * phi * wing >= 4) | (at_money * phi * phi * wing > 4 + 1e-9)


def smile_faults(k: np.ndarray, vols: np.ndarray, years: np.ndarray, points: int = 200) -> pd.DataFrame:
    """butterfly, steep, crossing for each smile (a row of vols in points over k): a negative density, a wing steeper than
    2, distances d1 and d2 that don't fall with the strike; on a fine grid with straight lines between strikes."""
    fine = np.linspace(k[0], k[-1], points)
    vol = np.array([np.interp(fine, k, v) for v in vols]).reshape(len(vols), points) / 100
    w = vol**2 * years[:, None]
    slope = np.gradient(w, fine, axis=1)
    bend = np.gradient(slope, fine, axis=1)
    safe = np.maximum(w, 1e-12)
    density = (1 - fine * slope / (2 * safe)) ** 2 - slope**2 / 4 * (1 / safe + 0.25) + bend / 2
    spread = vol * np.sqrt(years)[:, None]
    d1 = spread / 2 - fine / np.maximum(spread, 1e-8)
    crossing = (np.diff(d1, axis=1) > SLACK).any(1) | (np.diff(d1 - spread, axis=1) > SLACK).any(1)
    return pd.DataFrame({"butterfly": (density < -1e-3).any(1), "steep": (np.abs(slope) > 2 + 1e-6).any(1), "crossing": crossing})


def faulty_smiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and tenor of smiles of a surface (keys, tenor, k, vol) with a fault, and which."""
    smiles = rows.groupBy(*keys, "tenor").agg(F.array_sort(F.collect_list(F.struct("k", "vol"))).alias("smile"))  # one entry for each strike

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                k = np.array([p["k"] for p in frame["smile"].iloc[0]])
                vols = np.array([[p["vol"] for p in s] for s in frame["smile"]])
                found = smile_faults(k, vols, frame["tenor"].to_numpy() / YEAR)
                out = pd.concat([frame.drop(columns="smile").reset_index(drop=True), found], axis=1)
                yield out[found.any(axis=1)]

    kinds = dict(smiles.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, "tenor")) + ", butterfly boolean, steep boolean, crossing boolean"
    return smiles.mapInPandas(run, schema)


def density(calls: DataFrame, keys: list[str], rate: float = 0.0, years: float = 1.0) -> DataFrame:
    """keys, strike, density of an evenly spaced chain (keys, strike, call): second differences of call prices over the
    square of the step, carried forward. A negative one can be arbitraged; the outer strikes have none."""
    by = Window.partitionBy(*keys).orderBy("strike")
    step = F.col("strike") - F.lag("strike").over(by)
    bend = F.lead("call").over(by) - 2 * F.col("call") + F.lag("call").over(by)
    return calls.select(*keys, "strike", (bend / (step * step) * math.exp(rate * years)).alias("density")).where("density is not null")


def garman_klass(open_: Column, high: Column, low: Column, close: Column) -> Column:
    """Volatility of a day from its range."""
    o, h, l, c = (F.log(F.greatest(x, F.lit(1e-12))) for x in (open_, high, low, close))
    return F.sqrt(F.greatest(0.5 * (h - l) * (h - l) - (2 * math.log(2) - 1) * (c - o) * (c - o), F.lit(0.0)))


def outside(inner: Column, outer: Column) -> Column:
    """Whether a cell is covered by ``inner`` but not by ``outer``, in which it should be nested."""
    return inner.isNotNull() & outer.isNull()
