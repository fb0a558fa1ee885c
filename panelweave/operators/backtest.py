"""Back-test: signal to weights, daily profit and loss, metrics and gates.

Cell-level stages are lazy DataFrame steps: windows by date for ranks, means
and sums, windows by instrument for decay and delay. They end in a frame of one
row for each date, over which single-partition windows are cheap.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.config import CUTOFFS, UNIVERSES, ExecutionSettings, SimulationSettings, get_cutoff, subuniverse_cutoff

from panelweave.operators.registry import of_date, of_time
from panelweave.operators.time_series import _ts_decay_linear as decay_linear
from panelweave.panel import Panel
from panelweave.plans.syntax import ExpressionError

MIN_NAMES = 5
TINY = 1e-12
ALL_PAST = (Window.unboundedPreceding, 0)


def by_day():
    """Over frames of a row for each date only."""
    return Window.orderBy("t")


def universe(df: DataFrame, n: int, width: int | None = None, adv: str = "adv20") -> DataFrame:
    """Adds in_universe: the n largest mean adv of the last 252 rows that end yesterday; all if n reaches the width.

    On the first row today's value counts; before row 20 all rows so far do.
    """
    if n <= 0:
        return df.withColumn("in_universe", F.lit(False))
    if width is not None and n >= width:
        return df.withColumn("in_universe", F.lit(True))
    before = F.avg(adv).over(of_time().rowsBetween(-252, -1))
    df = df.withColumn("__score", F.when(F.col("t") == 0, F.col(adv)).otherwise(before))
    place = F.row_number().over(of_date().orderBy(F.col("__score").desc_nulls_last(), "sid"))
    return df.withColumn("in_universe", (place <= n) & F.col("__score").isNotNull()).drop("__score")


def neutralization_group(level: str, groups: tuple[str, ...]) -> str | None:
    """The column of the level, or what stands in for it; None for the whole market."""
    level = level.upper().replace("SUB-INDUSTRY", "SUBINDUSTRY")
    for name in {"NONE": (), "MARKET": (), "SUBINDUSTRY": ("subindustry", "industry"), "INDUSTRY": ("industry",)}.get(level, (level.lower(), "sector")):
        if name in groups:
            return name
    return None


def neutralized(df: DataFrame, x: str, level: str, groups: tuple[str, ...]) -> DataFrame:
    if level.upper() == "NONE":
        return df
    group = neutralization_group(level, groups)
    mean = F.avg(x).over(of_date(group) if group else of_date())
    return df.withColumn(x, F.when(F.col(group).isNotNull(), F.col(x) - mean) if group else F.col(x) - mean)


def weights(df: DataFrame, x: str, truncation: float, book: float = 1.0, out: str = "weight") -> DataFrame:
    """Demeaned by date, absolute sum one book, then clipped without scaling anew; flat on dates of under 5 names."""
    centred = F.col(x) - F.avg(x).over(of_date())
    df = df.withColumn("__c", centred)
    gross, n = F.sum(F.abs("__c")).over(of_date()), F.count("__c").over(of_date())
    w = F.when((n >= MIN_NAMES) & (gross >= TINY), F.try_divide(F.col("__c") * F.lit(float(book)), gross)).otherwise(0.0)
    most = float(truncation) * book
    w = F.greatest(F.least(w, F.lit(most)), F.lit(-most)) if truncation else w
    return df.withColumn(out, F.coalesce(w, F.lit(0.0))).drop("__c")


def delayed(df: DataFrame, days: int, x: str = "weight", out: str = "held") -> DataFrame:
    return df.withColumn(out, F.coalesce(F.lag(x, days).over(of_time()), F.lit(0.0)) if days else F.col(x))


def positions(panel: Panel, expression: str, settings: SimulationSettings, n_instruments: int | None = None, mask: str | None = None, top: int | None = None) -> DataFrame:
    """The panel with signal (after all stages), weight and held (delayed weight). top: size of the universe, in place of
    the settings'."""
    df = panel.with_expressions({"signal": expression}, settings.unitHandling.upper() == "VERIFY")
    return staged(df, panel, settings, n_instruments, mask, top)


def staged(df: DataFrame, panel: Panel, settings: SimulationSettings, n_instruments: int | None = None, mask: str | None = None, top: int | None = None) -> DataFrame:
    """The stages of ``positions`` over a panel that has its signal."""
    if mask is None:
        adv = "adv20" if "adv20" in panel.fields else None
        if adv is None and {"close", "volume"} <= set(panel.fields):
            adv = "__liquidity"
            df = df.withColumn(adv, F.abs(F.col("close") * F.col("volume")))
        df = universe(df, top or UNIVERSES.get(settings.universe, 3000), n_instruments, adv) if adv else df.withColumn("in_universe", F.lit(True))
        keep = F.col("in_universe")
        if settings.pasteurization.upper() == "ON":
            for c in ("close", "adv20" if "adv20" in panel.fields else "volume"):
                if c in panel.fields:
                    keep = keep & F.col(c).isNotNull()
        df = df.withColumn("signal", F.when(keep, F.col("signal")))
        df = neutralized(df, "signal", settings.neutralization, panel.groups)
        if settings.decay > 1:
            df = df.withColumn("signal", decay_linear(F.col("signal"), settings.decay))
    df = weights(df, "signal", settings.truncation)
    return delayed(df, settings.delay)


def sub_positions(df: DataFrame, mask: str, settings: SimulationSettings) -> DataFrame:
    """The final signal within the sub-universe, neutralised over it."""
    df = df.withColumn("__sub", F.when(F.col(mask).cast("boolean"), F.col("signal")))
    df = df.withColumn("__sub", F.col("__sub") - F.avg("__sub").over(of_date()))
    return delayed(weights(df, "__sub", settings.truncation, out="__sub_weight"), settings.delay, "__sub_weight", "sub_held")


def daily(df: DataFrame, held: str = "held", returns: str = "returns") -> DataFrame:
    """A row for each date: pnl, turnover, gross, long, short, names, largest position."""
    df = df.withColumns({"__before": F.lag(held).over(of_time())})
    h, b, r = F.col(held), F.col("__before"), F.coalesce(F.col(returns), F.lit(0.0))
    return df.groupBy("t", "date").agg(
        F.coalesce(F.sum(b * r), F.lit(0.0)).alias("pnl"),
        F.coalesce(F.sum(F.abs(h - b)), F.lit(0.0)).alias("turnover"),
        F.sum(F.abs(h)).alias("gross"),
        F.sum(F.greatest(h, F.lit(0.0))).alias("long"),
        F.sum(F.least(h, F.lit(0.0))).alias("short"),
        F.sum(h).alias("net"),
        F.count_if(h > TINY).alias("n_long"),
        F.count_if(h < -TINY).alias("n_short"),
        F.max(F.abs(h)).alias("largest"),
    )


def sharpe(pnl: str = "pnl"):
    d = F.stddev_pop(pnl)
    return F.when(d > TINY, F.try_divide(F.avg(pnl), d) * math.sqrt(CUTOFFS["annualization"])).otherwise(0.0)


def fitness(sharpe_, returns, turnover):
    return sharpe_ * F.sqrt(F.abs(returns) / F.greatest(turnover, F.lit(CUTOFFS["fitness_turnover_floor"])))


def metrics(days: DataFrame, book: float = 1.0, cost_bps: float = CUTOFFS["cost_bps"]) -> DataFrame:
    """One row: sharpe, fitness, turnover_pct, returns_pct, returns_geo_pct, drawdown_pct, margin_bps,
    weight_concentration_pct, cost_drag_pct, returns_net_pct.

    A day that loses more than what is invested leaves no geometric return: returns_geo_pct is NaN then, unlike the NULL of
    no days; one that loses just that makes it -100."""
    invested, year = book / 2, CUTOFFS["annualization"]
    run = days.withColumn("cum", F.when(F.col("t") > 0, F.sum(F.when(F.col("t") > 0, F.col("pnl"))).over(by_day().rowsBetween(*ALL_PAST))))
    run = run.withColumn("fall", F.max("cum").over(by_day().rowsBetween(*ALL_PAST)) - F.col("cum"))
    late = F.col("t") > 0
    p, turn = F.when(late, F.col("pnl")), F.when(F.col("t") > 1, F.col("turnover"))
    d, worst = F.stddev_pop(p), F.min(p / invested)
    row = run.agg(
        F.when(d > TINY, F.try_divide(F.avg(p), d) * math.sqrt(year)).otherwise(0.0).alias("sharpe"),
        F.coalesce(F.avg(turn) / book, F.lit(0.0)).alias("turnover"),
        (F.avg(p) * year / invested).alias("returns"),
        F.when(worst > -1, F.exp(F.sum(F.log1p(p / invested)) * year / F.count(p)) - 1).when(worst == -1, -1.0).when(worst < -1, math.nan).alias("geo"),
        (F.max("fall") / book).alias("drawdown"),
        F.sum(p).alias("total"),
        F.sum(turn).alias("traded"),
        (F.max("largest") / book).alias("largest"),
    )
    drag = F.col("turnover") * year * cost_bps / 1e4
    return row.select(
        "sharpe",
        fitness(F.col("sharpe"), F.col("returns"), F.col("turnover")).alias("fitness"),
        (F.col("turnover") * 100).alias("turnover_pct"),
        (F.col("returns") * 100).alias("returns_pct"),
        (F.col("geo") * 100).alias("returns_geo_pct"),
        (F.col("drawdown") * 100).alias("drawdown_pct"),
        F.when(F.col("traded") > TINY, F.try_divide(F.col("total") * 1e4, F.col("traded"))).otherwise(0.0).alias("margin_bps"),
        (F.col("largest") * 100).alias("weight_concentration_pct"),
        (drag * 100).alias("cost_drag_pct"),
        ((F.col("returns") - drag) * 100).alias("returns_net_pct"),
    )


def yearly(days: DataFrame, n_instruments: int, book: float = 1.0) -> DataFrame:
    """A row for each calendar year. Turnover leaves out the first day of each."""
    days = days.withColumns({"year": F.year("date")}).withColumn("__nth", F.row_number().over(Window.partitionBy("year").orderBy("t")))
    some = F.col("n_long") + F.col("n_short") > 0
    out = days.groupBy("year").agg(
        sharpe().alias("sharpe"),
        F.coalesce(F.avg(F.when(F.col("__nth") > 1, F.col("turnover"))) / book, F.lit(0.0)).alias("turnover"),
        (F.avg("pnl") * CUTOFFS["annualization"] / (book / 2)).alias("returns"),
        F.avg(F.when(some, F.col("n_long"))).alias("mean_long"),
        F.avg(F.when(some, F.col("n_short"))).alias("mean_short"),
        F.min(F.when(some, F.col("n_long"))).alias("min_long"),
        F.min(F.when(some, F.col("n_short"))).alias("min_short"),
    )
    thin = max(5, n_instruments * 0.01)
    return out.withColumns({"fitness": fitness(F.col("sharpe"), F.col("returns"), F.col("turnover")), "thin": (F.coalesce("mean_long", F.lit(0.0)) < thin) | (F.coalesce("mean_short", F.lit(0.0)) < thin)})


def periods(days: DataFrame, n_days: int, book: float = 1.0) -> DataFrame:
    """IS, TEST and OS: the last 252 rows are OS and the 252 before TEST; under 756 rows 60, 20 and 20 %.
    Turnover is that of rows whose predecessor lies in the period too."""
    cuts = (n_days - 504, n_days - 252) if n_days >= 756 else (int(n_days * 0.6), int(n_days * 0.8))
    days = days.withColumn("period", F.when(F.col("t") < cuts[0], "IS").when(F.col("t") < cuts[1], "TEST").otherwise("OS"))
    days = days.withColumn("__nth", F.row_number().over(Window.partitionBy("period").orderBy("t")))
    out = days.groupBy("period").agg(
        F.count(F.lit(1)).alias("days"),
        sharpe().alias("sharpe"),
        F.coalesce(F.avg(F.when(F.col("__nth") > 1, F.col("turnover"))) / book, F.lit(0.0)).alias("turnover"),
        (F.avg("pnl") * CUTOFFS["annualization"] / (book / 2)).alias("returns"),
    )
    return out.where("days >= 10").withColumn("fitness", fitness(F.col("sharpe"), F.col("returns"), F.col("turnover")))


def self_correlation(days: DataFrame, pool: DataFrame, last: int = 1008) -> DataFrame:
    """ref, corr with each series of the pool (ref, t, pnl), aligned from the end over at most ``last`` rows, the first
    left out. Constant series and fewer than 10 rows give 0."""
    back = lambda df, *by: df.withColumn("__back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("t"))))
    mine = back(days.select("t", F.col("pnl").alias("x")), F.lit(1)).drop("t")
    other = back(pool.select("ref", "t", F.col("pnl").alias("y")), "ref").drop("t")
    both = other.join(F.broadcast(mine), "__back").where(F.col("__back") <= last)
    both = both.withColumn("__n", F.max("__back").over(Window.partitionBy("ref"))).where("__back < __n")
    c = F.when((F.count(F.lit(1)) >= 9) & (F.stddev_pop("x") >= TINY) & (F.stddev_pop("y") >= TINY), F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))).otherwise(0.0)
    return both.groupBy("ref").agg(F.coalesce(c, F.lit(0.0)).alias("corr"))


def exposures(df: DataFrame, held: str = "held") -> DataFrame:
    h = F.col(held)
    return df.groupBy("t", "date").agg(
        F.sum(F.abs(h)).alias("gross"),
        F.sum(F.greatest(h, F.lit(0.0))).alias("long"),
        F.sum(F.least(h, F.lit(0.0))).alias("short"),
        F.sum(h).alias("net"),
        F.count_if(F.abs(h) > TINY).alias("active"),
        F.max(F.abs(h)).alias("largest"),
        F.coalesce(F.try_divide(F.sum(h * h), F.sum(F.abs(h)) * F.sum(F.abs(h))), F.lit(0.0)).alias("concentration"),
    )


def rolling_sharpe(days: DataFrame, window: int) -> DataFrame:
    w = by_day().rowsBetween(-(window - 1), 0)
    d = F.stddev_pop("pnl").over(w)
    value = F.when(F.col("t") >= window, F.when(d > TINY, F.try_divide(F.avg("pnl").over(w), d) * math.sqrt(CUTOFFS["annualization"])).otherwise(0.0))
    return days.select("t", "date", value.alias("rolling_sharpe"))


def equity(days: DataFrame) -> DataFrame:
    """t, date, equity and drawdown in percent of the peak's size (of 1 where the peak is 0)."""
    run = days.withColumn("equity", F.sum("pnl").over(by_day().rowsBetween(*ALL_PAST)))
    run = run.withColumn("peak", F.max("equity").over(by_day().rowsBetween(*ALL_PAST)))
    size = F.when(F.col("peak") == 0, 1.0).otherwise(F.abs("peak"))
    return run.select("t", "date", "equity", ((F.col("equity") - F.col("peak")) / size * 100).alias("drawdown_pct"))


def top_positions(df: DataFrame, n: int = 3, x: str = "weight") -> DataFrame:
    """The largest cells by size, to 12 digits; of equals the earliest date, then the least sid."""
    return df.select("date", "t", "sid", x).orderBy(F.round(F.abs(x), 12).desc(), "t", "sid").limit(n)


def sides_by_year(df: DataFrame, x: str = "signal") -> DataFrame:
    """year, mean_long, min_long, mean_short, min_short: names above and below the date's mean, over dates with
    ``MIN_NAMES`` known values; 0 in years without such a date."""
    known = df.select("t", "date", "sid", F.col(x).alias("__x"))
    means = known.groupBy("t").agg(F.avg("__x").alias("__mean"), F.count("__x").alias("__n"))
    sides = known.join(F.broadcast(means), "t").groupBy("t", "date").agg(F.first("__n").alias("n"), F.count_if(F.col("__x") > F.col("__mean")).alias("long"), F.count_if(F.col("__x") < F.col("__mean")).alias("short"))
    full = F.col("n") >= MIN_NAMES
    found = [f(F.when(full, F.col(side))).alias(f"{name}_{side}") for side in ("long", "short") for name, f in (("mean", F.avg), ("min", F.min))]
    return sides.groupBy(F.year("date").alias("year")).agg(*found).fillna(0)


def cost_lens(days: DataFrame, bps: float, book: float = 1.0) -> DataFrame:
    return days.withColumn("net_pnl", F.col("pnl") - F.col("turnover") * book * bps / 1e4)


def gates_of(found: dict, cutoffs: dict | None = None) -> dict[str, bool]:
    """Gates that the metrics alone decide."""
    return {
        "sharpe": found["sharpe"] > get_cutoff("sharpe_min", cutoffs),
        "fitness": found["fitness"] > get_cutoff("fitness_min", cutoffs),
        "turnover": get_cutoff("turnover_min", cutoffs) <= found["turnover_pct"] / 100 <= get_cutoff("turnover_max", cutoffs),
        "weight_concentration": found["weight_concentration_pct"] / 100 <= get_cutoff("weight_conc_max", cutoffs) + 1e-9,
    }


def simulate(expression: str, panel: Panel, refs: DataFrame | None = None, ref_sharpes: dict[str, float] | None = None, settings: SimulationSettings | dict | None = None, cutoffs: dict | None = None, execution: ExecutionSettings | None = None, log=None) -> dict:
    """Run an expression through the whole back-test.

    refs: series (ref, t, pnl) to compare with; ref_sharpes: their Sharpe ratios. log: a TrialLog. A faulty expression
    gives a report with ``error`` and ``passed`` False; it is logged as a trial too.
    """
    settings = settings if isinstance(settings, SimulationSettings) else SimulationSettings.from_dict(settings or {})
    report: dict = {"expression": expression, "settings": settings.to_dict(), "dataset_id": panel.dataset_id, "mode": execution.mode if execution else "fast_gate"}
    try:
        n = panel.df.select("sid").distinct().count()
        df = positions(panel, expression, settings, n)
    except ExpressionError as e:
        report |= {"error": str(e), "passed": False}
        if log is not None:
            log.add(report)
        return report
    df = df.cache()
    try:
        days = daily(df).cache()
        found = {k: (None if v is None or math.isnan(v) else round(v, 4)) for k, v in metrics(days).first().asDict().items()}
        series = days.orderBy("t").select("t", "date", "pnl").collect()  # a row for each date
        gates = gates_of(found, cutoffs)
        if panel.subuniverse:
            sub_n = panel.df.where(F.col(panel.subuniverse).cast("boolean")).select("sid").distinct().count()
            limit = subuniverse_cutoff(sub_n, min(n, UNIVERSES.get(settings.universe, n)), found["sharpe"], cutoffs)
            sub = metrics(daily(sub_positions(df, panel.subuniverse, settings), "sub_held")).first().sharpe
            report |= {"subuniverse_cutoff": round(limit, 4), "subuniverse_sharpe": round(sub, 4)}
            gates["subuniverse"] = sub > limit
        report |= {"top_corr": 0.0, "top_corr_ref": None, "self_corr_2y": 0.0}
        if refs is not None:
            by_ref = {r.ref: r.corr for r in self_correlation(days, refs).collect()}  # a row for each reference
            short = {r.ref: r.corr for r in self_correlation(days, refs, 504).collect()}
            if by_ref:
                top = max(by_ref, key=lambda k: abs(by_ref[k]))
                report |= {"top_corr": round(by_ref[top], 4), "top_corr_ref": top, "self_corr_2y": round(max(short.values(), key=abs), 4), "self_corr_detail": {k: round(v, 4) for k, v in by_ref.items()}}
                blocking = [k for k, v in by_ref.items() if abs(v) >= get_cutoff("self_corr_max", cutoffs)]
                gates["self_correlation"] = all(found["sharpe"] >= get_cutoff("corr_sharpe_improve", cutoffs) * (ref_sharpes or {}).get(k, math.inf) for k in blocking)
        report |= {
            "metrics": found,
            "criteria": gates,
            "passed": all(gates.values()),
            "yearly": [r.asDict() for r in yearly(days, n).orderBy("year").collect()],
            "periods": {r.period: r.asDict() for r in periods(days, len(series)).collect()},
            "max_weight_dates": [r.asDict() for r in top_positions(df).collect()],
            "pnl": [r.pnl for r in series],
            "dates": [r.date for r in series],
        }
        if execution and execution.mode == "high_fidelity":
            from panelweave.operators.execution import execution_report

            report["high_fidelity"] = execution_report(df, execution)
            report["exec_settings"] = execution.to_dict()
        from panelweave.functions.risk import risk_report

        report["risk"] = risk_report(report["pnl"][1:])
        if log is not None:
            log.add(report)
        return report
    finally:
        df.unpersist()


