"""How near one sample's distribution is to another's."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = 2000
BINS = 50


def moments(df: DataFrame, x: str) -> DataFrame:
    """One row: n, mean, sd, skew, kurtosis (3 for a normal), p01, p05, median, p95, p99."""
    c, names = F.col(x), {"p01": 0.01, "p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}
    found = dict(zip(names, quantiles(df, x, list(names.values())), strict=True))
    row = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.skewness(c).alias("skew"), (F.kurtosis(c) + 3).alias("kurtosis"))
    return row.withColumns({name: F.lit(v).cast("double") for name, v in found.items()})


def quantiles(df: DataFrame, x: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles with straight lines between order statistics. Distinct values are counted, cut into ranges and
    numbered range by range, so no task holds them all; only the values next to a wanted rank come back."""
    counted = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("k"))
    parts, starts = _ranges(counted, ["k"])
    n = parts.agg(F.sum("k").alias("n")).first().n
    if not n:
        return [None] * len(shares)
    ranks = [p * (n - 1) for p in shares]
    wanted = sorted({f(r) for r in ranks for f in (math.floor, math.ceil)})
    run = parts.withColumn("stop", F.sum("k").over(Window.partitionBy("part").orderBy("x"))).join(F.broadcast(starts), "part")
    run = run.select("x", (F.col("k0") + F.col("stop") - F.col("k")).alias("a"), (F.col("k0") + F.col("stop")).alias("b"))
    found = run.select("x", F.explode(F.filter(F.array(*[F.lit(w) for w in wanted]), lambda r: (r >= F.col("a")) & (r < F.col("b")))).alias("rank")).collect()  # a row for each wanted rank
    at = {r.rank: r.x for r in found}
    return [at[math.floor(r)] + (r - math.floor(r)) * (at[math.ceil(r)] - at[math.floor(r)]) for r in ranks]


def trimmed(df: DataFrame, x: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows within the two percentiles; the others are dropped."""
    a, b = quantiles(df, x, [low, high])
    return df.where(F.col(x).between(a, b)) if a is not None else df.where("false")


def _ranges(counted: DataFrame, counts: list[str], ranges: int = 64) -> tuple[DataFrame, DataFrame]:
    """Distinct values x with their ``counts`` and range, and for each range the counts before it (``ranges`` rows)."""
    bounds = counted.agg(F.percentile_approx("x", [i / ranges for i in range(1, ranges)]).alias("q")).first().q or []
    part = F.lit(0)
    for q in sorted(set(bounds)):
        part = part + (F.col("x") > q).cast("int")
    parts = counted.withColumn("part", part)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("part").agg(*[F.sum(c).alias(c) for c in counts])
    return parts, sums.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in counts])


def _counted(a: DataFrame, b: DataFrame) -> DataFrame:
    one, two = a.select("x", F.lit(1).alias("na"), F.lit(0).alias("nb")), b.select("x", F.lit(0).alias("na"), F.lit(1).alias("nb"))
    return one.unionByName(two).where("x is not null").groupBy("x").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))


def ks(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row with ks, the largest distance of the two distribution functions.

    Running counts go over value ranges: each range is summed up in parallel and starts from the counts before it.
    """
    counted = _counted(a, b)
    parts, starts = _ranges(counted, ["na", "nb"])
    inner = Window.partitionBy("part").orderBy("x")
    total = counted.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    run = parts.withColumns({"ca": F.sum("na").over(inner), "cb": F.sum("nb").over(inner)}).join(F.broadcast(starts), "part").crossJoin(F.broadcast(total))
    return run.agg(F.max(F.abs((F.col("na0") + F.col("ca")) / F.col("ta") - (F.col("nb0") + F.col("cb")) / F.col("tb"))).alias("ks"))


def wasserstein(a: DataFrame, b: DataFrame, points: int = QUANTILES, accuracy: int = 1_000_000) -> float:
    """Mean distance of the quantile functions over a grid of shares from 0.001 to 0.999. Quantiles are sample values, exact
    for samples of up to ``accuracy`` distinct values and within one in ``accuracy`` of the rank beyond."""
    grid = F.array(*[F.lit(0.001 + 0.998 * i / (points - 1)) for i in range(points)])
    q = [df.agg(F.percentile_approx("x", grid, accuracy).alias("q")).first().q for df in (a, b)]
    return math.fsum(abs(x - y) for x, y in zip(*q, strict=True)) / points


def jensen_shannon(a: DataFrame, b: DataFrame, bins: int = BINS, cut: float = 0.005) -> float:
    """Divergence in bits, from 0 to 1, of two histograms between the pooled sample's outer quantiles."""
    low, high = quantiles(a.select("x").unionByName(b.select("x")), "x", [cut, 1 - cut])
    if low is None or high <= low:
        return 0.0
    inside = _counted(a, b).where(F.col("x").between(low, high))
    place = F.least(F.floor((F.col("x") - low) / (high - low) * bins), F.lit(bins - 1))
    rows = inside.groupBy(place.alias("bin")).agg(F.sum("na").alias("a"), F.sum("nb").alias("b")).collect()  # ``bins`` rows
    share = lambda total, k: (k / total if total else 0.0) + 1e-12
    ta, tb = sum(r.a for r in rows), sum(r.b for r in rows)
    p, q = ([share(total, getattr(r, side)) for r in rows] + [1e-12] * (bins - len(rows)) for side, total in (("a", ta), ("b", tb)))
    p, q = [x / math.fsum(p) for x in p], [x / math.fsum(q) for x in q]
    return math.fsum(0.5 * v * math.log2(2 * v / (x + y)) for x, y in zip(p, q, strict=True) for v in (x, y))


def panel_correlations(df: DataFrame, x: str, most: int = 2000) -> DataFrame:
    """sid, other, corr over pairs of instruments of a panel, over dates on which both are known. All pairs are a row each,
    so a panel of over ``most`` instruments is refused: choose some first."""
    n = df.select("sid").distinct().count()
    if n > most:
        raise ValueError(f"{n} instruments make {n * (n - 1) // 2} pairs; at most {most} instruments are paired")
    one = df.select("t", "sid", F.col(x).alias("a")).where("a is not null")
    two = one.select("t", F.col("sid").alias("other"), F.col("a").alias("b"))
    return one.join(two, "t").where("sid < other").groupBy("sid", "other").agg(F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")).alias("corr"))


#: Least and greatest of each figure of a panel in the market's records, and how much of that span a warning
#: reaches beyond it.
EXPECTED = {
    "sales_g_vol": (0.15, 0.25, 0.20),
    "gm_mean": (0.32, 0.40, 0.15),
    "gm_std": (0.18, 0.25, 0.20),
    "ebitda_kurt": (5.0, 15.0, 0.30),
    "lev_median": (0.20, 0.30, 0.15),
    "lev_iqr": (0.20, 0.30, 0.25),
    "ret_kurt": (6.0, 14.0, 0.25),
    "paircorr_all": (0.12, 0.25, 0.30),
    "paircorr_tail": (0.35, 0.55, 0.20),
    "fund_ar1": (0.70, 0.90, 0.10),
}
#: Figures that must not fail.
HARD = ("lev_median", "ret_kurt", "paircorr_tail")
QUARTER = 63


def verdict(value: float | None, low: float, high: float, reach: float) -> str:
    if value is None or not math.isfinite(value):
        return "fail"
    beyond = max(low - value, value - high, 0.0)
    return "pass" if not beyond else "warn" if beyond <= reach * (high - low) else "fail"


def _excess(df: DataFrame, x: str) -> float | None:
    return df.agg(F.kurtosis(x).alias("k")).first().k


def panel_moments(df: DataFrame, pairs: int = 200) -> dict[str, float | None]:
    """The ten figures of a panel (sid, t, returns, sales, cogs, ebitda, debt, assets).

    Accounts count from the second quarter on; their margins and leverages are trimmed to the middle 98 %. Growth and
    memory are taken between quarters, as days in between repeat the same figures. Returns are those beyond the date's
    mean; correlations are those of the first ``pairs`` instruments, over all dates and over the worst 5 % of them.
    """
    df = df.select("sid", "t", "returns", "sales", "cogs", "ebitda", "debt", "assets").persist(StorageLevel.DISK_ONLY)
    try:
        return _panel_moments(df, pairs)
    finally:
        df.unpersist()


def _panel_moments(df: DataFrame, pairs: int) -> dict[str, float | None]:
    sales = F.greatest(F.col("sales"), F.lit(1e-12))
    later = df.where(F.col("t") >= QUARTER)
    ratios = {"gm": (F.col("sales") - F.col("cogs")) / sales, "ebitda": F.col("ebitda") / sales, "lev": F.col("debt") / F.greatest(F.col("assets"), F.lit(1e-12))}
    cut = {name: trimmed(later.select(x.alias("x")).where("x is not null"), "x") for name, x in ratios.items()}
    by = Window.partitionBy("sid").orderBy("t")
    ends = later.where(F.col("t") % QUARTER == 0).select("sid", "t", F.log(sales).alias("s"), ratios["ebitda"].alias("m")).where("s is not null")
    steps = ends.withColumns({"g": F.col("s") - F.lag("s").over(by), "before": F.lag("m").over(by)})
    growth = steps.groupBy("sid").agg(F.stddev_pop("g").alias("sd"))
    gm = cut["gm"].agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd")).first()
    low, middle, high = quantiles(cut["lev"], "x", [0.25, 0.5, 0.75])
    r = df.where("t > 0").select("sid", "t", "returns")
    means = r.groupBy("t").agg(F.avg("returns").alias("m"))
    beyond = r.join(F.broadcast(means), "t").select((F.col("returns") - F.col("m")).alias("x"))
    some = r.where(F.col("sid") < pairs)
    worst = quantiles(some.groupBy("t").agg(F.avg("returns").alias("x")), "x", [0.05])[0]
    bad = some.groupBy("t").agg(F.avg("returns").alias("m")).where(F.col("m") < worst).select("t") if worst is not None else some.select("t").limit(0)
    mean_corr = lambda x: panel_correlations(x, "returns", pairs).agg(F.avg("corr").alias("c")).first().c
    return {
        "sales_g_vol": quantiles(growth, "sd", [0.5])[0],
        "gm_mean": gm.m,
        "gm_std": gm.sd,
        "ebitda_kurt": _excess(cut["ebitda"], "x"),
        "lev_median": middle,
        "lev_iqr": None if low is None else high - low,
        "ret_kurt": _excess(beyond, "x"),
        "paircorr_all": mean_corr(some),
        "paircorr_tail": mean_corr(some.join(F.broadcast(bad), "t")),
        "fund_ar1": steps.where("before is not null").agg(F.corr("before", "m").alias("c")).first().c,
    }


def panel_report(df: DataFrame, leaks: int | None = None) -> dict:
    """Figures with verdicts, whether point-in-time values were checked and free of leaks, the hard failures, and whether the
    panel may be used: no leak, no hard failure and two failures at most."""
    found = panel_moments(df)
    figures = {name: {"value": None if found[name] is None else round(found[name], 4), "expected": bounds[:2], "verdict": verdict(found[name], *bounds)} for name, bounds in EXPECTED.items()}
    failed = [name for name, f in figures.items() if f["verdict"] == "fail"]
    hard = [name for name in HARD if name in failed]
    leakage = "not checked" if leaks is None else "none" if leaks == 0 else f"{leaks} rows"
    return {"figures": figures, "leakage": leakage, "failed": failed, "hard": hard, "ship": leakage == "none" and not hard and len(failed) <= 2}


def fidelity_report(real: DataFrame, made: DataFrame) -> dict:
    """Distances and moments of two samples (x), with a verdict for each and whether all pass."""
    a, b = moments(real, "x").first().asDict(), moments(made, "x").first().asDict()
    out = {"real": a, "made": b, "ks": ks(real, made).first().ks, "wasserstein": wasserstein(real, made), "js": jensen_shannon(real, made)}
    out["verdicts"] = {"sd": abs(math.log((b["sd"] or 1e-12) / (a["sd"] or 1e-12))) < math.log(2), "tails": (b["kurtosis"] > 3) == (a["kurtosis"] > 3), "ks": out["ks"] < 0.2}
    out["ship"] = all(out["verdicts"].values())
    return out
