"""Execution lens: partial fills, costs and capacity. It never decides gates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.config import CUTOFFS, ExecutionSettings
from panelweave.operators.backtest import fitness
from panelweave.operators.paths import fold_by_instrument

TINY = 1e-12


def fills(df: DataFrame, settings: ExecutionSettings, scale: str = "__scale", keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """Adds effective, order, filled: targets are ``held`` * scale, orders what is left to the target, and a day fills at
    most ``max_participation`` of adv20. The first target counts as inherited."""
    most = settings.max_participation

    def step(held, target, adv, unit):
        if held is None:
            return target, target, 0.0, 0.0
        order = target - held
        done = order
        if abs(order) > TINY * unit:
            share = abs(order) / adv if adv is not None and adv > 0 else math.inf
            done = order * min(1.0, most / max(share, TINY))
        held += done
        return held, held, order, done

    ready = df.withColumn("__target", F.col("held") * F.col(scale))
    return fold_by_instrument(ready, ["__target", "adv20", scale], ["effective", "order", "filled"], step, keys)


def costed(df: DataFrame, settings: ExecutionSettings, scale: str = "__scale", keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """Adds cost and borrow for each cell."""
    # partial windows count; under 5 values there is no measure of risk
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(-19, 0)
    sigma = F.when(F.count("returns").over(w) >= 5, F.stddev_pop("returns").over(w)).otherwise(0.0)
    need = (F.abs("order") > TINY * F.col(scale)) & (F.col("adv20") > 0)
    part = F.when(need, F.try_divide(F.abs("filled"), F.col("adv20"))).otherwise(0.0)
    flat = (settings.spread_bps * settings.urgency + settings.commission_bps) / 1e4
    impact = F.lit(settings.impact_lambda) * sigma * F.pow(part, F.lit(settings.impact_alpha)) + F.lit(settings.impact_eta) * sigma * part
    out = df.withColumn("cost", F.abs("filled") * (F.lit(flat) + impact))
    fee = F.greatest(F.coalesce(F.col("borrow_fee"), F.lit(0.0)), F.lit(0.0)) if "borrow_fee" in df.columns else F.lit(0.0)
    return out.withColumn("borrow", F.greatest(-F.col("effective"), F.lit(0.0)) * fee / CUTOFFS["annualization"])


def report_frame(df: DataFrame, settings: ExecutionSettings, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each ``by``): net_sharpe, net_fitness, net_returns, filled_turnover, fill_rate, capped, shortfall and
    costs in bps."""
    past = Window.partitionBy(*by, "sid").orderBy("t")
    df = df.withColumn("__own", F.lag("effective").over(past) * F.coalesce("returns", F.lit(0.0)))
    need = F.abs("order") > TINY * F.col("__scale")
    days = df.groupBy(*by, "t").agg(
        (F.coalesce(F.sum("__own"), F.lit(0.0)) - F.sum("cost") - F.sum("borrow")).alias("net"),
        F.sum(F.abs("filled")).alias("filled"),
        F.sum(F.abs("order")).alias("wanted"),
        F.sum("cost").alias("cost"),
        F.sum("borrow").alias("borrow"),
        F.count_if(need).alias("orders"),
        F.count_if(need & (F.abs("filled") < F.abs("order") * (1 - 1e-9))).alias("capped"),
        F.first("__scale").alias("scale"),
    )
    late = days.where("t > 0")
    year = CUTOFFS["annualization"]
    d = F.stddev_pop("net")
    out = late.groupBy(*by).agg(
        F.when(d > TINY, F.try_divide(F.avg("net"), d) * math.sqrt(year)).otherwise(0.0).alias("net_sharpe"),
        (F.avg("net") * year / (F.first("scale") * CUTOFFS["book_size"] / 2)).alias("net_returns"),
        (F.avg("filled") / F.first("scale")).alias("filled_turnover"),
        F.coalesce(F.least(F.try_divide(F.sum("filled"), F.sum("wanted")), F.lit(1.0)), F.lit(1.0)).alias("fill_rate"),
        (F.sum("capped") / F.greatest(F.sum("orders"), F.lit(1))).alias("capped_cell_frac"),
        F.coalesce(F.try_divide(F.sum("cost") * 1e4, F.sum("filled")), F.lit(0.0)).alias("realized_cost_bps"),
        F.coalesce(F.try_divide(F.sum("borrow") * 1e4, F.sum("filled")), F.lit(0.0)).alias("borrow_cost_bps"),
    )
    return out.withColumns({"net_fitness": fitness(F.col("net_sharpe"), F.col("net_returns"), F.col("filled_turnover")), "shortfall_frac": 1 - F.col("fill_rate")})


def _cells(df: DataFrame) -> DataFrame:
    keep = [c for c in ("sid", "t", "held", "returns", "adv20", "borrow_fee") if c in df.columns]
    df = df.select(*keep)
    return df if "adv20" in keep else df.withColumn("adv20", F.lit(None).cast("double"))


def execution_report(df: DataFrame, settings: ExecutionSettings) -> dict:
    scaled = _cells(df).withColumn("__scale", F.lit(float(settings.notional or 1.0)))
    row = report_frame(costed(fills(scaled, settings), settings), settings).first()
    return {k: None if v is None else round(v, 4) for k, v in row.asDict().items()}


def capacity_frontier(df: DataFrame, settings: ExecutionSettings, hurdle: float = 1.25, low: float = 1e5, high: float = 1e10, points: int = 24, least_fill: float = 0.5) -> DataFrame:
    """notional, net_sharpe, fill_rate, feasible over a logarithmic grid of book sizes; all of them in one plan."""
    if not all(isinstance(v, (int, float)) and math.isfinite(v) for v in (hurdle, low, high, least_fill)):
        raise ValueError("hurdle, low, high and least_fill must be finite numbers")
    if not 0 < low < high:
        raise ValueError("the grid needs 0 < low < high")
    if isinstance(points, bool) or points != int(points) or points < 2:
        raise ValueError("points must be an integer from 2")
    if not 0 < least_fill <= 1:
        raise ValueError("least_fill must lie in (0, 1]")
    points = int(points)
    grid = [(float(low * (high / low) ** (i / (points - 1))),) for i in range(points)]
    sizes = df.sparkSession.createDataFrame(grid, "__scale double")
    cells = _cells(df).crossJoin(F.broadcast(sizes))  # ``points`` rows
    keys = ("__scale", "sid")
    out = costed(fills(cells, settings, keys=keys), settings, keys=keys)
    found = report_frame(out, settings, ("__scale",))
    return found.select(F.col("__scale").alias("notional"), "net_sharpe", "fill_rate", ((F.col("net_sharpe") >= hurdle) & (F.col("fill_rate") >= least_fill)).alias("feasible"))


def capacity(df: DataFrame, settings: ExecutionSettings, **options) -> dict:
    """The largest feasible book size of the frontier, and the curve; None where no sampled size is feasible."""
    curve = [tuple(r) for r in capacity_frontier(df, settings, **options).orderBy("notional").collect()]  # a row for each point
    best = max((r for r in curve if r[3]), default=None)
    return {"feasible": best is not None, "capacity_notional": best and round(best[0], 2), "net_sharpe_at_capacity": best and best[1], "curve": [(round(n, 2), s, f) for n, s, f, _ in curve]}
