"""Quarterly accounts of made-up firms: growth, margins and balance sheets with exact identities.

Growth follows its own past with clustered, asymmetric variance that is larger for small firms; EBITDA and cash-flow
margins move together, with fat tails, inside fixed bounds; assets and debt lean on margins and growth. Every firm is
made from the seed and its sid alone, so the result does not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Economy:
    """Fixed values of the processes."""

    growth_mean: float = 0.015
    growth_memory: float = 0.25
    growth_scale: float = 0.12
    growth_scale_least: float = 0.02
    shock_memory: tuple[float, float, float] = (0.08, 0.86, 0.06)  # of squares, of variance, more of falls
    size_variance: float = 0.20
    size_drift: float = -0.005
    market_growth: float = 0.4
    margin_means: tuple[float, float] = (0.12, 0.10)  # EBITDA, cash flow
    margin_bounds: tuple[tuple[float, float], tuple[float, float]] = ((-0.2, 0.6), (-0.3, 0.6))
    margin_memory: tuple[tuple[float, float], tuple[float, float]] = ((0.78, 0.08), (0.18, 0.52))
    margin_scales: tuple[float, float] = (0.35, 0.45)
    margin_scale_least: float = 0.05
    margin_shock_memory: tuple[float, float] = (0.08, 0.88)
    margin_tail: float = 6.0
    margin_coupling: float = 0.65
    market_margins: tuple[float, float] = (0.10, -0.10)
    asset_memory: float = 0.93
    asset_scale: float = 0.08
    asset_on_margin: float = 0.3
    debt_mean: float = -0.6
    debt_memory: float = 0.96
    debt_scale: float = 0.10
    debt_on_margin: float = -0.6
    debt_on_growth: float = -0.3
    balance_coupling: float = 0.2
    cash_slack: float = 0.15
    start_spread: float = 0.3


FIELDS = ("sales", "assets", "debt", "ebitda", "cfo", "leverage")
#: Random numbers a firm draws for its start and for each quarter.
START, EACH = 5, 5


def _inside(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return bounds[:, 0] + (bounds[:, 1] - bounds[:, 0]) / (1 + np.exp(-x))


def paths(sizes: np.ndarray, middle: float, market: np.ndarray, start: np.ndarray, normal: np.ndarray, chi: np.ndarray, e: Economy = Economy()) -> dict[str, np.ndarray]:
    """The fields of some firms as (quarter, firm). start: (firm, 5) and normal: (quarter, firm, 5) standard draws; chi:
    (quarter, firm) chi-square draws over their degrees of freedom; market: mean market return of each quarter."""
    bounds = np.array(e.margin_bounds)
    means = np.array(e.margin_means)
    level = np.log((means - bounds[:, 0]) / (bounds[:, 1] - means))
    memory, scales = np.array(e.margin_memory), np.array(e.margin_scales)
    lift = (middle / np.maximum(sizes, 1e-12)) ** e.size_variance
    of_squares, of_variance, of_falls = e.shock_memory

    log_sales = np.log(0.8 * sizes) + e.start_spread * start[:, 0]
    growth, shock, growth_var = np.full(len(sizes), e.growth_mean), np.zeros(len(sizes)), np.full(len(sizes), e.growth_scale**2)
    margins, margin_var = level + scales * start[:, 1:3], np.tile(scales**2, (len(sizes), 1))
    turnover, debt = e.asset_scale * start[:, 3], e.debt_mean + e.debt_scale * start[:, 4]
    out = {name: np.empty((len(market), len(sizes))) for name in FIELDS}
    for q, m in enumerate(market):
        z = normal[q]
        growth_var = np.maximum(shock**2 * np.where(shock < 0, of_squares + of_falls, of_squares) + of_variance * growth_var, e.growth_scale_least**2)
        shock = np.sqrt(growth_var) * lift * z[:, 0]
        growth = e.growth_mean + e.growth_memory * (growth - e.growth_mean) + e.size_drift * np.log(sizes / middle) + e.market_growth * m + shock
        log_sales = log_sales + growth

        pair = np.column_stack([z[:, 1], e.margin_coupling * z[:, 1] + np.sqrt(1 - e.margin_coupling**2) * z[:, 2]]) / np.sqrt(chi[q])[:, None]
        margin_var = np.maximum(e.margin_shock_memory[0] * pair**2 + e.margin_shock_memory[1] * margin_var, e.margin_scale_least**2)
        margins = level + (margins - level) @ memory.T + np.array(e.market_margins) * m + np.sqrt(margin_var) * pair
        ebitda_margin, cash_margin = _inside(margins, bounds).T

        other = e.balance_coupling * z[:, 3] + np.sqrt(1 - e.balance_coupling**2) * z[:, 4]
        turnover = e.asset_memory * turnover + e.asset_on_margin * (ebitda_margin - means[0]) + e.asset_scale * z[:, 3]
        debt = e.debt_mean + e.debt_memory * (debt - e.debt_mean) + e.debt_on_margin * (ebitda_margin - means[0]) + e.debt_on_growth * growth + e.debt_scale * other

        sales = np.exp(log_sales)
        ebitda, most = sales * ebitda_margin, e.cash_slack * sales
        beyond = sales * cash_margin - ebitda
        cash = ebitda + np.where(beyond > most, most * np.tanh(beyond / most), beyond)  # smoothly under the bound
        leverage = 1 / (1 + np.exp(-debt))
        assets = sales * np.exp(turnover)
        for name, x in zip(FIELDS, (sales, assets, assets * leverage, ebitda, cash, leverage), strict=True):
            out[name][q] = x
    return out


def draws(seed: int, sids, quarters: int, e: Economy = Economy()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, normal, chi of each firm, from the seed and its sid."""
    start, normal, chi = [], [], []
    for sid in sids:
        rng = np.random.default_rng([seed, 1, int(sid)])
        start.append(rng.standard_normal(START))
        normal.append(rng.standard_normal((quarters, EACH)))
        chi.append(rng.chisquare(e.margin_tail, quarters) / e.margin_tail)
    return np.array(start), np.array(normal).swapaxes(0, 1), np.array(chi).T


def quarterly(firms: DataFrame, market: list[float], seed: int = 7, economy: Economy = Economy()) -> DataFrame:
    """sid, quarter and ``FIELDS`` of firms (sid, size), over as many quarters as ``market`` has mean returns."""
    middle = firms.agg(F.percentile_approx("size", 0.5)).first()[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                found = paths(frame["size"].to_numpy(float), float(middle), np.array(market), *draws(seed, frame["sid"], len(market), economy), economy)
                n, k = len(frame), len(market)
                yield pd.DataFrame({"sid": np.tile(frame["sid"].to_numpy(), k), "quarter": np.repeat(np.arange(k, dtype=np.int32), n), **{name: x.ravel() for name, x in found.items()}})

    return firms.select(F.col("sid").cast("int").alias("sid"), F.col("size").cast("double").alias("size")).mapInPandas(run, "sid int, quarter int, " + ", ".join(f"{c} double" for c in FIELDS))


def with_equity(df: DataFrame, floor: float = 0.05, debt: str = "debt", current: str = "liabilities_curr") -> DataFrame:
    """Adds liabilities, equity and distress. Where equity would fall under ``floor`` of assets, debt is cut to what leaves
    that much, at least 0, and the firm is in distress."""
    assets, owed = F.col("assets"), F.col(current)
    distress = assets - F.col(debt) - owed < floor * assets
    df = df.withColumn("distress", distress).withColumn(debt, F.when(F.col("distress"), F.greatest(assets * (1 - floor) - owed, F.lit(0.0))).otherwise(F.col(debt)))
    return df.withColumn("liabilities", F.col(debt) + owed).withColumn("equity", assets - F.col("liabilities"))


def broken_identities(economy: Economy = Economy()) -> dict[str, Column]:
    """For each identity, whether a row (sales, assets, ebitda, cfo, liabilities, equity) breaks it."""
    sales = F.greatest(F.col("sales"), F.lit(1e-12))
    out = {}
    for name, (low, high) in zip(("ebitda", "cfo"), economy.margin_bounds, strict=True):
        margin = F.col(name) / sales
        out[f"{name}_margin"] = F.coalesce((margin < low) | (margin > high), F.lit(True))
    return out | {
        "balance": F.abs(F.col("assets") - F.col("liabilities") - F.col("equity")) > 1e-6,
        "negative_equity": F.col("equity") < 0,
        "cash_bound": F.col("cfo") > F.col("ebitda") + economy.cash_slack * F.abs("sales"),
    }


def audit(df: DataFrame, economy: Economy = Economy()) -> DataFrame:
    """One row: the share of rows that break each identity."""
    return df.agg(*[F.avg(F.coalesce(broken, F.lit(False)).cast("double")).alias(name) for name, broken in broken_identities(economy).items()])
